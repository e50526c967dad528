"""The queries of this subpackage, by name, and the SQL of those that have one."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "p1_furniture",
    "p2_sentences",
    "p3_repeated",
    "p4_sample",
    "p5_near",
    "p6_splits",
    "p7_consistent",
    "p8_tokens",
    "p9_leaks",
    "p10_subjects",
)


def load() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in _MODULES:
        m = import_module(f"gradja.llm.{name}")
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
