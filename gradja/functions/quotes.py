"""Quotation depth and the marking of sentences inside quotations, one Arrow pass an article."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks that open, close and switch a quotation; two apostrophes switch too.
OPENING, CLOSING, SWITCHING = "„«", "“”ˮ»", '"'
_QUOTE = re.compile("[„«“”ˮ»\"\n]|''")


def depths(text: str) -> list[int]:
    """Depth before each character; a line break sets it to 0, straight quotes switch between 0 and 1."""
    out, at, depth = [], 0, 0
    for m in _QUOTE.finditer(text):
        c = m.group()
        out += [depth] * (m.start() + 1 - at)
        if c == "\n":
            depth = 0
        elif c in OPENING:
            depth += 1
        elif c in CLOSING:
            depth = max(0, depth - 1)
        else:
            depth = 0 if depth else 1
        out += [depth] * (len(c) - 1)  # the second apostrophe
        at = m.end()
    return out + [depth] * (len(text) - at)


def shown(sentence: str | None, flag: str) -> str | None:
    """A sentence inside a quotation between „ and “, without what its own marks already show; others stay as they are."""
    t = (sentence or "").rstrip()
    if flag != "Y" or not t or t[0] in OPENING:
        return sentence
    return "„" + t + ("" if t[-1] in CLOSING + SWITCHING else "“")


def mark(sentences: list[str], article: str) -> list[str]:
    """Of each sentence, in order: 'Y' inside a quotation, '' outside, '?' if it can't be found.

    It is found by its first 40 characters behind the one before, or else from the start.
    """
    inside, cursor, out = depths(article), 0, []
    for s in sentences:
        head = s[:40]
        at = article.find(head, cursor) if head else -1
        if at < 0 and head:
            at = article.find(head)
        if at < 0:
            out.append("?")
            continue
        cursor = at + 1
        out.append("Y" if inside[at] > 0 else "")
    return out


def mark_quotes(df: DataFrame, article: str, idx: str, sentence: str, text: str | None, key: str) -> DataFrame:
    """(key, in_quote, text_marked) of every sentence; text is the article's text on its rows, None if it is its sentences with spaces between.

    Articles are sorted inside partitions and handled one after the other; one is held at a time.
    """
    cols = [key, article, idx, sentence] + ([text] if text else [])
    kind = df.schema[key].dataType.simpleString()
    placed = df.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(cols))).repartition("_1").sortWithinPartitions("_1", "_2", "_0")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []

        def done(rows: list) -> pd.DataFrame:
            sents = [r[3] or "" for r in rows]
            whole = ((rows[0][4] or "") if text else " ".join(sents)) if rows else ""
            flags = mark(sents, whole)
            return pd.DataFrame({key: [r[0] for r in rows], "in_quote": flags, "text_marked": [shown(r[3], f) for r, f in zip(rows, flags)]})

        for pdf in it:
            ready = []
            for r in pdf.itertuples(index=False, name=None):
                if held and r[1] != held[0][1]:
                    ready.append(done(held))
                    held = []
                held.append(r)
            if ready:
                yield pd.concat(ready)
        if held:
            yield done(held)

    return placed.mapInPandas(run, f"`{key}` {kind}, in_quote string, text_marked string")


def quoted_share(df: DataFrame, flag: str = "in_quote") -> DataFrame:
    return df.agg(F.avg((F.col(flag) == "Y").cast("double")).alias("share"))
