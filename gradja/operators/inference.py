"""Batched model inference with a resumable cache; providers are plug-ins, the stub needs no network."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradja.functions.text import batch_key, parse_reply
from gradja.operators.sampling import batches

#: A provider takes the texts of one batch and gives its raw reply.
Provider = Callable[[list[str]], str]


def stub(texts: list[str]) -> str:
    """A deterministic reply from the texts alone."""
    return json.dumps({str(i): "SUBJ" if int(hashlib.md5((t or "").encode()).hexdigest()[:2], 16) % 2 else "OBJ" for i, t in enumerate(texts, 1)})


def as_batches(rows: DataFrame, key: str, text: str, size: int = 15) -> DataFrame:
    """(key, ids, texts, n): consecutive rows in packs, with the key of their texts."""
    b = batches(rows.select(key, text), [key], size).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(key, text))).alias("_l"))
    texts = F.transform("_l", lambda x: F.coalesce(x[text], F.lit("")))
    return b.select(batch_key(texts).alias("key"), F.transform("_l", lambda x: x[key]).alias("ids"), texts.alias("texts"), F.size("_l").alias("n"))


def todo(packs: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Packs without a readable reply in the cache."""
    if cache is None:
        return packs
    done = cache.filter(parse_reply("raw", F.col("n")).isNotNull()).select("key").distinct()
    return packs.join(done, "key", "left_anti")


def ask(packs: DataFrame, provider: Provider = stub, tries: int = 3) -> DataFrame:
    """(key, ids, n, raw, tok): a provider's reply to each pack; an error is tried again and then leaves an empty reply."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            raw = []
            for texts in pdf["texts"]:
                out = ""
                for _ in range(tries):
                    try:
                        out = provider(list(texts))
                        break
                    except Exception:
                        continue
                raw.append(out)
            tok = [{"in": sum(len(t.split()) for t in texts), "out": len(r.split())} for texts, r in zip(pdf["texts"], raw)]
            yield pd.DataFrame({"key": pdf["key"], "ids": pdf["ids"], "n": pdf["n"], "raw": raw, "tok": tok})

    return packs.mapInPandas(run, "key string, ids array<string>, n int, raw string, tok struct<in:int,out:int>")


def scatter(replies: DataFrame) -> DataFrame:
    """(sentence_id, pred): a reply's labels on its rows, PARSE_FAIL on all of them if it can't be read."""
    p = replies.withColumn("_p", parse_reply("raw", F.col("n")))
    return p.select(F.posexplode("ids").alias("_i", "sentence_id"), "_p").select("sentence_id", F.coalesce(F.get("_p", F.col("_i")), F.lit("PARSE_FAIL")).alias("pred"))


def classify(rows: DataFrame, key: str = "sentence_id", text: str = "text", provider: Provider = stub, cache: DataFrame | None = None, size: int = 15) -> DataFrame:
    """(sentence_id, pred) of every row, cached replies first."""
    packs = as_batches(rows, key, text, size)
    fresh = ask(todo(packs, cache), provider)
    if cache is not None:
        fresh = fresh.unionByName(cache.select("key", "ids", "n", "raw", "tok").filter(parse_reply("raw", F.col("n")).isNotNull()))
    return scatter(fresh)
