"""Problem 1: the main body of each page, and its furniture by line.

Tag-path ratios, on text: the path of a line is its skeleton (see
:mod:`gradja.llm.lines`). Text mass and punctuation are summed along each page
in reading order; over all pages of the table each path of LEAST lines or more gets

* its *inner ratio*: how often it stands between text of the page's body, smoothed
  towards what its punctuation lets expect,
* its *opinion ratio*: how often it stands on a column rather than a news page.

A path that frames the text rather than standing in it is furniture, unless it
is a full sentence that only columns have (a columnist's standing phrase).
Headlines are told apart by address: the slug of the page's own url makes a
line its headline, any other page's slug or listed title makes it a pointer.
A page with neither text nor headline of its own is a listing, furniture throughout.

The lines are shuffled once, by page, and stay there; what is looked up elsewhere
(paths, headlines) comes back as marks on single lines. Sums of a page that fills
several blocks are put together from the sums of its blocks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradja.llm.arrow import h64, map_batches, read, small
from gradja.llm.lines import cut_table, line_table, slug, url_slug

#: Of more framing paths than BROADCAST only those that hold SHARE of all lines are broadcast, at most 1 / SHARE; the others join by shuffle, and none of them is hot. Either way marks the same lines.
BROADCAST, SHARE = 200_000, 2e-5
#: A path is judged if it holds so many lines, whatever the size of the table.
LEAST = 4
#: Below this smoothed inner ratio a path frames the text.
INNER = 0.5
#: Weight of the prior, in lines.
_PRIOR = 4.0
#: Mass (a sixth of the characters) from which a punctuated line counts as text of its page, and from which it is a long one.
TEXT, LONG = 12, 23
_AT = ["page", "block"]


def known_headlines(inventory: DataFrame) -> DataFrame:
    """Hashes of the slugs of every listed title and address; null titles and addresses have none."""

    def slugs(b):
        out = set()
        for t, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if t and (s := slug(t)):
                out.add(h64(s))
            if u and (s := url_slug(u)):
                out.add(h64(s))
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64())], ["known"])

    return map_batches(inventory.select("title", "url"), slugs, "known long")


def laid_out(lines: DataFrame) -> DataFrame:
    """The lines of :func:`line_table` with the text of their page before and after them and the page's own slug."""
    ahead = Window.partitionBy(*_AT).orderBy("idx", "sid", "line").rowsBetween(Window.unboundedPreceding, -1)
    text = F.when(F.col("mass") >= TEXT, F.col("mass")).otherwise(0)
    kept = lines.withColumn("text", text).withColumn("ahead", F.coalesce(F.sum("text").over(ahead), F.lit(0)))
    kept = kept.withColumn("key", F.xxhash64("sid", "line")).drop("idx").persist()
    blocks = kept.groupBy(*_AT).agg(F.sum("text").alias("sum"), F.max(F.when(F.col("slug") != 0, F.col("slug"))).alias("own"))
    page = Window.partitionBy("page")
    before = page.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    pages = blocks.select(
        *_AT,
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"),
        F.sum("sum").over(page).alias("all_text"),
        F.coalesce(F.max("own").over(page), F.lit(0)).alias("own_slug"),
    )
    above = F.col("ahead") + F.col("before")
    inner = ((above > 0) & (F.col("all_text") > above + F.col("text"))).cast("int")
    own = (F.col("head") != 0) & (F.col("head") == F.col("own_slug"))
    return kept.join(pages, _AT).select(*_AT, "sid", "line", "key", "path", "head", "tail", "kol", "term", "mass", "text", "all_text", "own_slug", inner.alias("inner"), own.alias("own"))


def judged_paths(placed: DataFrame) -> DataFrame:
    """(path, n, frame) of every path of LEAST lines or more on pages with text; frame = 1 if it frames the text, n counts its lines on all pages."""
    prior = F.when((F.col("punct") > 0.95) & (F.col("length") >= LONG), 0.9).when(F.col("punct") > 0.95, 0.6).otherwise(0.35)
    on_text = F.col("all_text") > 0
    columns = on_text & (F.col("kol") >= 0)
    summed = (F.sum(F.when(on_text, F.col(c))).alias(c) for c in ("inner", "term", "mass"))
    sums = placed.groupBy("path").agg(F.count("*").alias("n"), F.count_if(on_text).alias("seen"), *summed, F.count_if(columns).alias("told"), F.sum(F.when(columns, F.col("kol"))).alias("kol"))
    paths = sums.filter(F.col("seen") >= LEAST).select("path", "n", "seen", F.col("inner").alias("inside"), (F.col("term") / F.col("seen")).alias("punct"), (F.col("mass") / F.col("seen")).alias("length"), F.try_divide("kol", "told").alias("opinion"))
    ratio = (F.col("inside") + _PRIOR * prior) / (F.col("seen") + _PRIOR)
    standing = (F.col("punct") > 0.95) & (F.col("opinion") > 0.97)
    frames = ratio < F.when(F.col("length") >= LONG, INNER / 2).otherwise(INNER)
    return paths.select("path", "n", F.when(standing, 0).when(frames, 1).otherwise(0).alias("frame"))


def _marks(found: DataFrame, name: str) -> DataFrame:
    return found.select(*_AT, "key").groupBy(*_AT).agg(F.collect_set("key").alias(name))  # at most the lines of a block


def _marked(name: str) -> Column:
    return F.col(name).isNotNull() & F.array_contains(name, F.col("key"))


def furniture_lines(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """(sid, line) of the furniture among the rows of :func:`line_table`.

    Empty lines are no furniture; an empty table gives none.
    """
    placed = laid_out(lines)
    paths = judged_paths(placed).persist()
    frames, lines_judged = paths.agg(F.count(F.when(F.col("frame") == 1, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    told_hot = F.col("frame") == 1 if frames <= BROADCAST else F.col("n") >= F.lit(SHARE * lines_judged)
    hot = small(paths.filter(told_hot).select("path", F.col("frame").alias("hot")))
    placed = placed.join(F.broadcast(hot), "path", "left")
    framed = F.coalesce("hot", F.lit(0)) == 1
    known = known_headlines(inventory).union(placed.filter("own_slug <> 0").select("own_slug").distinct())
    pointers = placed.filter("not own and head <> 0").select(*_AT, "key", F.explode(F.array("head", "tail")).alias("known")).filter("known <> 0").join(known, "known", "left_semi")
    told = placed.join(_marks(pointers, "pointing"), _AT, "left")
    if frames > BROADCAST:
        rest = placed.filter("hot is null").select("path", *_AT, "key").join(paths.filter("frame = 1").select("path"), "path", "left_semi")
        told, framed = told.join(_marks(rest, "framed"), _AT, "left"), framed | _marked("framed")
    told = told.withColumn("out", ~F.col("own") & (_marked("pointing") | framed))
    told = told.select(*_AT, "sid", "line", "path", "own", "out", ((F.col("mass") > 0) | (F.col("term") > 0)).alias("body")).persist()
    # a page with no line of its own, neither text nor headline, is a listing
    by_block = told.groupBy(*_AT).agg(F.max((F.col("own") | (~F.col("out") & F.col("body"))).cast("int")).alias("has"))
    listing = by_block.select(*_AT, F.max("has").over(Window.partitionBy("page")).alias("has")).filter("has = 0")
    told = told.join(listing, _AT, "left").filter((F.col("out") | F.col("has").isNotNull()) & (F.col("path") != h64("")))
    return told.select("sid", "line")


def corpus_cut(spark: SparkSession, d: str, keys: bool = False, words: bool = False) -> DataFrame:
    """The lines of corpus as they were delivered."""
    return cut_table(read(spark, d, "corpus", "sentence_id", "url", "genre", "source", "text"), keys, words)


def page_furniture(spark: SparkSession, d: str, cut: DataFrame | None = None) -> DataFrame:
    """(sid, line) of the furniture of corpus; cut: its lines, if they are at hand."""
    return furniture_lines(line_table(corpus_cut(spark, d) if cut is None else cut), read(spark, d, "inventory", "title", "url"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return page_furniture(spark, d).select(F.col("sid").alias("sentence_id"), F.col("line").alias("line_no"))


def drop_lines(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """corpus with the found (sid, line) cut out of text; a row that loses all its lines keeps an empty text.

    Other columns stay as they are; rows with a null text stay null.
    """
    gone = found.groupBy("sid").agg(F.collect_set("line").alias("_gone"))
    parts = F.split("text", "\n")
    kept = F.array_join(F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains("_gone", i), x)), lambda x: x.isNotNull()), "\n")
    joined = corpus.join(gone, corpus["sentence_id"] == gone["sid"], "left")
    return joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)).drop("_gone", "sid")


def p1_body(spark: SparkSession, d: str) -> DataFrame:
    """The main body of each row: sentence_id and text without its furniture; rows of furniture only are left out."""
    corpus = read(spark, d, "corpus", "sentence_id", "text").filter("sentence_id is not null").dropDuplicates(["sentence_id"])
    return drop_lines(corpus, page_furniture(spark, d)).filter("trim(text) <> ''")


QUERIES = {"p1_found": p1_found, "p1_body": p1_body}
SQL: dict[str, str] = {}
