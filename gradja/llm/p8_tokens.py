"""Problem 8: the whole corpus as token ids of a public byte-level BPE.

The merges are compiled into a finite-state transducer over the bytes of a word
whose transitions are determinised as they are first needed: in the state after
i bytes the last token of the encoding is fixed, and the next one is the longest
token that the merges would leave standing beside it. Looking ahead is bounded by
the longest token. Words that were seen before are answered from the memo.

Defined cases: null and empty texts have no ids (an empty array); names of
special tokens in a text are ordinary text; lone control characters are bytes
like any other.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradja.llm.arrow import read

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which the vocabulary's makers cut text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a task before it starts afresh.
MEMO = 400_000


def vocabulary_path(path: str | None = None) -> str:
    """The file of merges: given, or where the tokenizers are installed."""
    if path:
        return path
    if os.path.exists(VOCABULARY):
        return VOCABULARY
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Transducer:
    """Byte-level BPE as a lazily determinised transducer."""

    def __init__(self, merges: bytes):
        self.rank: dict[bytes, int] = {}
        for line in merges.splitlines():
            if line:
                token, n = line.split()
                self.rank[base64.b64decode(token)] = int(n)
        self.token = {i: t for t, i in self.rank.items()}
        self.longest = max(map(len, self.rank), default=1)
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.words = regex.compile(PATTERN)

    def merged(self, word: bytes) -> list[bytes]:
        """The plain definition: the pair of the lowest rank is merged until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stands(self, a: bytes, b: bytes) -> bool:
        """Whether the merges leave a and b standing side by side."""
        k = (a, b)
        if k not in self.beside:
            self.beside[k] = self.merged(a + b) == ([a, b] if a else [b])
        return self.beside[k]

    def encode_word(self, word: bytes) -> list[int]:
        """Run the transducer over one word; a state is the last token before a byte."""
        if word in self.rank and self.stands(b"", word):
            return [self.rank[word]]
        last: list[bytes | None] = [b""]
        for i in range(1, len(word) + 1):
            found = None
            for n in range(min(self.longest, i), 0, -1):
                t = word[i - n : i]
                if t in self.rank and (p := last[i - n]) is not None and self.stands(p, t):
                    found = t
                    break
            last.append(found)
        out, i = [], len(word)
        while i:
            t = last[i]
            out.append(self.rank[t])
            i -= len(t)
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and empty."""
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for w in self.words.findall(text):
            ids = memo.get(w)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                    self.beside.clear()
                ids = memo[w] = tuple(self.encode_word(w.encode("utf-8")))
            out += ids
        return out


class Decoder:
    """Ids back to text as they arrive; a state machine holds the bytes of a character that is not complete."""

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.held = bytearray()
        self.need = 0

    def feed(self, ids) -> str:
        out: list[str] = []
        for i in ids:
            for b in self.token[i]:
                if self.need:
                    if b & 0xC0 == 0x80:
                        self.held.append(b)
                        self.need -= 1
                        if not self.need:
                            out.append(self.held.decode("utf-8", "replace"))
                            self.held.clear()
                        continue
                    out.append("�")
                    self.held.clear()
                    self.need = 0
                if b < 0x80:
                    out.append(chr(b))
                elif 0xC2 <= b < 0xF5:
                    self.held.append(b)
                    self.need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                else:
                    out.append("�")
        return "".join(out)

    def end(self) -> str:
        """What is left at the end: a cut character is replaced."""
        rest = "�" if self.need else ""
        self.held.clear()
        self.need = 0
        return rest


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every row. The merges (under a megabyte) are broadcast as they lie in the file."""
    with open(vocabulary_path(path), "rb") as f:
        merges = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer(merges.value)
        for b in it:
            flat, ends = [], [0]
            for s in b.column(1).to_pylist():
                flat += t.encode(s)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def round_trips(df: DataFrame, encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(key, n_ids, same) of every encoded row: whether decoding its ids as a stream gives the text back."""
    with open(vocabulary_path(path), "rb") as f:
        merges = df.sparkSession.sparkContext.broadcast(f.read())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = Transducer(merges.value).token
        for b in it:
            same = []
            for ids, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                d = Decoder(token)
                same.append(d.feed(ids or ()) + d.end() == (text or ""))
            n = pa.array([len(x) for x in b.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(same, pa.bool_())], ["doc_id", "n_ids", "same"])

    return encoded.join(df.select("doc_id", "text"), "doc_id").select("doc_id", "ids", "text").mapInArrow(run, "doc_id long, n_ids int, same boolean")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(read(spark, d, "documents", "doc_id", "text"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """How many documents come back from their ids unchanged, how many don't, and their ids in all."""
    docs = read(spark, d, "documents", "doc_id", "text")
    return round_trips(docs, encode_documents(docs)).groupBy("same").agg(F.count("*").alias("documents"), F.sum("n_ids").alias("ids"))


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
SQL: dict[str, str] = {}
