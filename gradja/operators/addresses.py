"""Page addresses: parts, slugs, ids and sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: str) -> Column:
    """Host without www; empty if there is none."""
    return F.regexp_extract(F.trim(url), r"^https?://(?:www\.)?([^/?#]+)", 1)


def bare_address(url: str) -> Column:
    """Address without query, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"/+$", "")


def last_segment(url: str) -> Column:
    return F.element_at(F.split(bare_address(url), "/"), -1)


def slugify(url: str, most: int = 60) -> Column:
    """Last path segment in [a-z0-9-], hyphens trimmed, cut; 'article' if nothing is left."""
    s = F.regexp_replace(F.lower(last_segment(url)), "[^a-z0-9-]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most), F.lit("")), F.lit("article"))


def number_at_end(url: str) -> Column:
    """The article number that closes a path; empty if there is none."""
    return F.regexp_extract(bare_address(url), r"-([0-9]+)$", 1)


def hash_id(path: Column) -> Column:
    """The first ten hex digits of sha1 as a decimal number."""
    return F.conv(F.substring(F.sha1(path), 1, 10), 16, 10)


def base36_id(text: Column) -> Column:
    return F.conv(text, 36, 10)


def title_of(slug: Column) -> Column:
    """Hyphens as spaces, the first letter in upper case and the others in lower case."""
    s = F.regexp_replace(slug, "-", " ")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(s.substr(F.lit(2), F.length(s))))


def script_path(url: str, old: str = "/scc/", new: str = "/sr/") -> Column:
    """The first occurrence of a path part by another."""
    at = F.instr(F.col(url), old)
    return F.when(at > 0, F.concat(F.substr(F.col(url), F.lit(1), at - 1), F.lit(new), F.substr(F.col(url), at + len(old)))).otherwise(F.col(url))


def cache_key(url: Column, most: int = 150) -> Column:
    return F.substring(F.regexp_replace(url, "[^A-Za-z0-9_.-]", "_"), 1, most)


def longest_section(df: DataFrame, sections: DataFrame, path: str, section: str, on: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Each row with the longest section that is its path or a leading part of it; rows of no section fall out.

    The candidates are the row's own leading paths, so the join is an equi-join.
    """
    parts = F.split(path, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    found = df.withColumn(section, F.explode(heads)).join(sections, [*on, section])
    w = Window.partitionBy(*keys, path).orderBy(F.length(section).desc(), section)
    return found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def links_in(html: str) -> Column:
    """Distinct addresses of a page's links, sorted, without fragments and queries."""
    found = F.regexp_extract_all(html, F.lit(r"""href=["']([^"'?#]+)"""), 1)
    return F.array_sort(F.array_distinct(found))
