"""Pages: fetching through an injectable getter, and the main text of HTML."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradja.operators.addresses import cache_key

#: A getter takes an address and gives (status, body). The library ships none that opens a connection.
Getter = Callable[[str], tuple[int, str]]
RETRY = frozenset({408, 429, 500, 502, 503, 504})


def fetch(urls: DataFrame, url: str, get: Getter, tries: int = 4, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, cache_key, status, body): each address got with retries and doubled waits; a failure keeps its status and no body."""

    def one(u: str) -> tuple[int, str | None]:
        status = 0
        for k in range(tries):
            try:
                status, body = get(u)
            except Exception:
                status, body = 0, None
            if status == 200:
                return status, body
            if status and status not in RETRY:
                return status, None
            if k + 1 < tries:
                sleep(wait * 2**k)
        return status, None

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [one(u) for u in pdf["url"]]
            yield pd.DataFrame({"url": pdf["url"], "cache_key": pdf["cache_key"], "status": [s for s, _ in got], "body": [b for _, b in got]})

    u = urls.select(F.col(url).alias("url")).filter("url is not null").distinct().withColumn("cache_key", cache_key(F.col("url")))
    return u.mapInPandas(run, "url string, cache_key string, status int, body string")


def fetch_missing(urls: DataFrame, url: str, cache: DataFrame, get: Getter, **kw) -> DataFrame:
    """The cache and what it lacks."""
    have = cache.select(F.col("url").alias(url)).distinct()
    return cache.unionByName(fetch(urls.join(have, url, "left_anti"), url, get, **kw))


def pages_until(get: Callable[[int], tuple], most: int = 15) -> list[str]:
    """Ids of numbered pages until one fails, is empty, brings nothing new, is the last, or `most` are read.

    get gives (status, ids) or (status, ids, number of pages in all), as a server tells it in a header.
    """
    seen: dict[str, None] = {}
    for n in range(1, most + 1):
        status, ids, *total = get(n)
        new = [i for i in ids if i not in seen] if status == 200 else []
        if not new:
            break
        seen.update(dict.fromkeys(new))
        if total and total[0] is not None and n >= int(total[0]):
            break
    return list(seen)


def numbered_page(section: str, n: int) -> str:
    """Address of the n-th listing page of a section, numbered in its path; the first is the section itself."""
    return section if n <= 1 else f"{section}{n}/"


def offset_page(section: str, n: int, start: int = 0, step: int = 10, name: str = "position") -> str:
    """Address of the n-th listing page of a section that takes an offset as a parameter."""
    return f"{section}{'&' if '?' in section else '?'}{name}={start + (n - 1) * step}"


def crawl_section(get: Getter, page: Callable[[int], str], links: Callable[[str], list[str]], take: Callable[[str, str], dict | None], target: int, most: int = 60) -> list[dict]:
    """Articles of a section from its listing pages until `target` are kept, a page is missing (404) or brings no new address, or `most` pages are read.

    take gives the record of an article from its address and page, None if it is too short;
    other failures of a page or article are passed over. Sorted by address. One section
    is a walk from page to page; run the sections as rows of a table (:func:`crawl`).
    """
    kept, seen = {}, set()
    for n in range(1, most + 1):
        if len(kept) >= target:
            break
        status, body = get(page(n))
        if status == 404:
            break
        if status != 200 or not body:
            continue
        new = [u for u in dict.fromkeys(links(body)) if u not in seen]
        if not new:
            break
        for u in new:
            if len(kept) >= target:
                break
            seen.add(u)
            status, body = get(u)
            record = take(u, body) if status == 200 and body else None
            if record is not None:
                kept[u] = record
    return [kept[u] for u in sorted(kept)]


def crawl(sections: DataFrame, section: str, target: str, get: Getter, page: Callable[[str, int], str], links: Callable[[str], list[str]], take: Callable[[str, str], dict | None], schema: str) -> DataFrame:
    """The articles of every section of a table, each row with its own target; sections are spread over the tasks."""
    placed = sections.select(F.col(section).alias("_s"), F.col(target).alias("_t")).filter("_s is not null").repartition("_s")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for s, t in zip(pdf["_s"], pdf["_t"]):
                yield pd.DataFrame([{"section": s, **r} for r in crawl_section(get, lambda n: page(s, n), links, take, int(t))], columns=["section", *(c.split()[0] for c in schema.split(", "))])

    return placed.mapInPandas(run, f"section string, {schema}")


_LD = re.compile(r'(?is)<script[^>]+type=["\']application/ld\+json["\'][^>]*>(.*?)</script>')
_JUNK = {"script", "style", "nav", "aside", "footer", "header", "form", "noscript", "iframe", "figure"}


class _Paragraphs(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title = ""
        self.h1 = ""
        self._junk = 0
        self._in: list[str] = []
        self._text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _JUNK:
            self._junk += 1
        elif tag in ("p", "title", "h1"):
            self._in.append(tag)
            self._text = []

    def handle_endtag(self, tag):
        if tag in _JUNK:
            self._junk = max(0, self._junk - 1)
        elif self._in and tag == self._in[-1]:
            text = " ".join("".join(self._text).split())
            self._in.pop()
            if tag == "p" and text:
                self.out.append(text)
            elif tag == "title":
                self.title = self.title or text
            elif tag == "h1":
                self.h1 = self.h1 or text

    def handle_data(self, data):
        if self._in and (not self._junk or self._in[-1] == "title"):
            self._text.append(data)


def _bodies(node) -> Iterator[str]:
    if isinstance(node, dict):
        if isinstance(node.get("articleBody"), str):
            yield node["articleBody"]
        for v in node.values():
            yield from _bodies(v)
    elif isinstance(node, list):
        for v in node:
            yield from _bodies(v)


def main_text(html: str | None, least: int = 120) -> tuple[str | None, str | None]:
    """(title, text): the articleBody of linked data if there is one, else paragraphs outside page furniture; None under `least` characters."""
    if not html:
        return None, None
    p = _Paragraphs()
    p.feed(html)
    text = ""
    for block in _LD.findall(html):
        try:
            text = max(_bodies(json.loads(block)), key=len, default="")
        except ValueError:
            continue
        if text:
            break
    text = text or "\n".join(p.out)
    return (p.h1 or p.title or None), (text if len(text) > least else None)


def extract(pages: DataFrame, html: str, keep: list[str], least: int = 120) -> DataFrame:
    """The kept columns with title and text of each page, in Arrow batches."""
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [main_text(h, least) for h in pdf[html]]
            yield pdf[keep].assign(title=[t for t, _ in got], text=[x for _, x in got])

    return pages.select(*keep, html).mapInPandas(run, f"{kinds}, title string, text string")


def longest_title(df: DataFrame, key: str, title: str) -> DataFrame:
    """Of each key the longest anchor text."""
    return df.groupBy(key).agg(F.max_by(title, F.struct(F.length(title), F.col(title))).alias(title))
