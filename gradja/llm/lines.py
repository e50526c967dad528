"""One narrow row per line of corpus: what problems 1, 2, 3 and 5 need to know of it.

One Arrow pass reads the text once and leaves only hashes and small numbers (for
problem 5 also the hashed words of the row, with its first line), so that every
later shuffle moves some 60 bytes a line and never the text.

Plain text has no tags. The *path* of a line stands for its root-to-leaf tag
path: the masked skeleton of the line (names, numbers and repeated separators
folded), which is the same wherever a site's template prints the same element.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradja.llm.arrow import h64
from gradja.llm.textform import clean_latin, consistent, to_latin

#: Rows of one page that are sorted and summed together; sums of a longer page go on from block to block.
BLOCK = 512
#: Words whose hash a task remembers; it forgets them all beyond that.
MEMO = 300_000

_ASCII_LETTER = re.compile("[A-Za-z]")
_ASCII = (("č", "c"), ("ć", "c"), ("š", "s"), ("ž", "z"), ("đ", "d"))
_NOT_SLUG = re.compile("[^a-z0-9]+")
_SEPARATORS = "|>»•·/"
_SEP = re.compile(r"[|>»•·/](?<=\s.)(?=\s)")
_DIGIT = re.compile(r"\d")
_DIGITS = re.compile(r"\d(?:[\d.,:/-]*\d)?")
_NAME = re.compile(r"[A-ZČĆŠŽĐ](?<=[\s„“\"(/–-].)\w*(?:[\s.]+[A-ZČĆŠŽĐ]\w*)*")
_FIRST_NAMES = re.compile(r"^[A-ZČĆŠŽĐ]\w*(?:\s+[A-ZČĆŠŽĐ]\w*)+")
_PREFIX = re.compile(r"((?:[^\s:]+\s){0,4}[^\s:]+):(?=\s|$)")
_LOW = re.compile(r"\s[a-zčćšžđ]")
_MARKS = re.compile(r"[„“”\"'’‘«»(),;:!?.…\[\]]")
_ENDS, _CLOSERS = frozenset("!?…。！？।؟."), "\"“”’»)]"
_DIGIT_RUN = re.compile(r"\d+")
_TOKEN = re.compile(r"[^\W_]+")
#: The same of lower-case text that :func:`clean_latin` passes.
_LATIN_TOKEN = re.compile("[0-9a-zčćšžđ²³¼½¾]+")
#: A letter, or what may be one, outside the Latin and Cyrillic blocks.
_OTHER_SCRIPT = re.compile("[^\x00-\u024f\u0400-\u052f]")
_LATIN_CYRILLIC = re.compile("[A-Za-z\u00c0-\u024f\u0400-\u052f]")
#: Scripts that mark the end of a sentence; text of others counts as text without.
_SPACED = re.compile("[A-Za-z\u0370-\u052f]")
_URL_TAIL = re.compile(r"[?#].*$")
_URL_NUMBER = re.compile(r"-\d+$")


def slug(text: str) -> str:
    """The address form of a headline: Latin without accents, hyphens between words, 60 characters."""
    return _slug(to_latin(text))


def _slug(latin: str) -> str:
    low = latin.lower()
    if not low.isascii():
        for a, b in _ASCII:
            low = low.replace(a, b)
    return _NOT_SLUG.sub("-", low).strip("-")[:60].strip("-")


def url_slug(url: str | None) -> str:
    """The headline part of a page address, additions and the closing number left off; empty for null."""
    if not url:
        return ""
    last = _URL_TAIL.sub("", url.strip().lower()).rstrip("/").rpartition("/")[2]
    return _URL_NUMBER.sub("", last)[:60].strip("-")


def skeleton(line: str, latin: str | None = None, digits: bool = True) -> str:
    """The path of a line in consistent form: names as N, numbers as 0, marks left out; a list is its separator.

    latin: its Latin spelling, if at hand; digits: whether it may hold any.
    """
    s = to_latin(line) if latin is None else latin
    if not _ASCII_LETTER.search(s):
        return s
    if s[0] == "©":
        return "©"
    for c in _SEPARATORS:
        if c in s:
            if len(seps := _SEP.findall(s)) > 1:
                return "list " + seps[0] + ("0" if _DIGIT.search(s) else "")
            break
    whole = _DIGITS.sub("0", s) if digits else s
    shout = line.isupper() and " " in line
    masked = whole if shout else _NAME.sub("N", _FIRST_NAMES.sub("N", whole, 1))
    if ":" in masked and (m := _PREFIX.match(masked)):
        return (m.group(1) if m.group(1)[0] == "N" else m.group(1).lower()) + ":"
    if not shout and s[-1] not in ".!?…,;" and "0" not in whole and (n := len(s.split())) >= 4 and len(_LOW.findall(s)) * 4 <= n:
        return "names"
    return _MARKS.sub("", masked).lower()


def ends_sentence(line: str) -> int:
    """1 if the line ends with an end mark, closing quotes and brackets aside; three full stops are none."""
    t = line.rstrip(_CLOSERS)
    return 1 if t and t[-1] in _ENDS and t[-3:] != "..." else 0


def _kol(genre: str | None) -> int:
    g = (genre or "").strip().lower()
    return 1 if g.startswith("kolumna") else 0 if g.startswith("vest") else -1


#: Fewest distinct words of a row that problem 5 compares.
MIN_WORDS = 10


class _Memo(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = out = h64(word) & 0x7FFFFFFF
        return out


class Words:
    """Sorted 31-bit hashes of the distinct words of a row, with a memory of words met before."""

    def __init__(self) -> None:
        self.memo = _Memo()

    def of(self, tokens: list[str], latin: bool = False) -> list[int] | None:
        """None if there are under MIN_WORDS words, or if they are mainly of other scripts than Latin and Cyrillic; latin: they are surely of the first."""
        if len(tokens) < MIN_WORDS:
            return None
        if not latin:
            joined = "".join(set(tokens))
            if _OTHER_SCRIPT.search(joined) and len(_LATIN_CYRILLIC.findall(joined)) * 2 <= sum(map(str.isalpha, joined)):
                return None
        if len(self.memo) >= MEMO:
            self.memo.clear()
        out = set(map(self.memo.__getitem__, tokens))
        if len(out) < MIN_WORDS and len(set(tokens)) < MIN_WORDS:  # words may share a hash
            return None
        return sorted(out)


_COLUMNS = {
    "sid": pa.string(), "line": pa.int32(), "page": pa.int64(), "block": pa.int32(), "idx": pa.int32(), "src": pa.string(), "path": pa.int64(), "head": pa.int64(), "tail": pa.int64(),
    "slug": pa.int64(), "kol": pa.int32(), "mass": pa.int32(), "term": pa.int32(), "lkey": pa.int64(), "cls": pa.int64(), "words": pa.binary(),
}
_SQL = {"string": "string", "int32": "int", "int64": "long", "binary": "binary"}


def _listed(column: pa.Array) -> list[str | None]:
    """The values of a column of strings, nulls as None."""
    return column.to_numpy(zero_copy_only=False).tolist()


def cut_lines(batch: pa.RecordBatch, keys: bool, words: Words | None) -> pa.RecordBatch:
    """The lines of a batch of (sentence_id, url, genre, source, text)."""
    rows: list[tuple] = []
    last_key = last_url = None
    page = own = 0
    kinds: dict[str | None, int] = {}  # genres and sources of one batch
    names: dict[str | None, str] = {}
    for sid, url, genre, source, text in zip(*(_listed(batch.column(i)) for i in range(5))):
        if sid is None or text is None:
            continue
        key, _, number = sid.rpartition("-")
        if key != last_key:
            page, last_key = h64(key), key
        if url != last_url:
            own, last_url = h64(u) if (u := url_slug(url)) else 0, url
        idx = int(number) if number.isdecimal() and len(number) < 10 else 0
        if (kol := kinds.get(genre)) is None:
            kol = kinds[genre] = _kol(genre)
        if (src := names.get(source)) is None:
            src = names[source] = (source or "").strip().lower()
        block, src = idx // BLOCK, src or key[:3]
        tokens: list[str] = []
        first = len(rows)
        is_latin = clean_latin(text)
        for i, line in enumerate((text if is_latin else consistent(text)).split("\n")):
            s = line.strip()
            if not s:
                rows.append((sid, i, page, block, idx, src, _EMPTY, 0, 0, own, kol, 0, 0, 0, None, None))
                continue
            term, latin, digits = ends_sentence(s), s if is_latin else to_latin(s), _DIGIT.search(s) is not None
            head = tail = 0
            if not term and len(s) < 200 or s[-1] == "?":
                head = h64(_slug(latin))
                cut = min((c for c in (latin.find(": "), latin.find(" – ")) if 0 < c < 40), default=-1)
                if cut > 0:
                    tail = h64(_slug(latin[cut + 2 :]))
            lkey = 0
            if keys:
                found = (_LATIN_TOKEN if is_latin else _TOKEN).findall(s.lower())
                letters = "".join(found)
                if words is not None:
                    tokens = tokens + found if tokens else found
                if digits:
                    letters = _DIGIT_RUN.sub("", letters)
                lkey = h64(letters) if letters else 0
            rows.append((sid, i, page, block, idx, src, h64(skeleton(s, latin, digits)), head, tail, own, kol, len(s) // 6 if term or not _SPACED.search(s) else 0, term, lkey, None, None))
        if words is not None:
            if (ws := words.of(tokens, is_latin)) is not None:
                packed = array("i", ws).tobytes()
                rows[first] = rows[first][:-2] + (xxhash.xxh3_64_intdigest(packed) - (1 << 63), packed)
    shown = _names(keys, words is not None)
    cols = dict(zip(_COLUMNS, zip(*rows) if rows else [()] * len(_COLUMNS)))
    return pa.RecordBatch.from_arrays([pa.array(cols[c], _COLUMNS[c]) for c in shown], shown)


def _names(keys: bool, words: bool) -> list[str]:
    return [c for c in _COLUMNS if (keys or c != "lkey") and (words or c not in ("cls", "words"))]


_EMPTY = h64("")


def cut_table(corpus: DataFrame, keys: bool = True, words: bool = False) -> DataFrame:
    """The lines of every delivered row of corpus, copies included; no shuffle.

    Rows with a null sentence_id or a null text have no lines. keys: with the letter
    key of each line (problems 3 and 5). words: with the hash of the row's set of
    words and the set itself (the bytes of its sorted hashes) on the row's first line (problem 5).
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Words() if words else None
        for b in it:
            yield cut_lines(b, keys, memory)

    schema = [f"{c} {_SQL[str(_COLUMNS[c])]}" for c in _names(keys, words)]
    return corpus.select("sentence_id", "url", "genre", "source", "text").mapInArrow(run, ", ".join(schema))


#: What problem 1 reads of a line.
LAYOUT = ("path", "head", "tail", "slug", "kol", "mass", "term")


def line_table(cut: DataFrame) -> DataFrame:
    """Each line of :func:`cut_table` once however often its row was delivered, laid out for problem 1.

    The rows lie by (page, block) and, within a block, in reading order: the one
    shuffle that steps by page need. A page longer than BLOCK lies in several blocks.
    """
    n = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut.select("page", "block", "idx", "sid", "line", *LAYOUT).repartition(n, "page", "block")
    return placed.groupBy("page", "block", "idx", "sid", "line").agg(*(F.max(c).alias(c) for c in LAYOUT))
