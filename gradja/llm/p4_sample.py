"""Problem 4: a sample that follows target shares by topic, genre and source.

Cells are counted over distinct sentence_ids, quotas are allocated by largest
remainder with floors and availability caps on the table of cells (bounded by
the targets), and the rows with the smallest seeded hash of each cell are taken.
The rows of a cell are ranked in hash ranges first, so no cell is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradja.llm.arrow import read

#: The sample is one row in so many of those in the target cells.
ONE_IN = 5
SEED = 42
#: Rows of one cell in a range of their hash, about.
RANGE = 4096


def cells_of(corpus: DataFrame) -> DataFrame:
    """(sentence_id, topic, genre, source), each once; a genre field of two words holds genre and topic.

    Rows with a null or unknown part are in no cell; case and outer spaces do not count.
    """
    tidy = lambda c: F.lower(F.trim(F.col(c)))
    parts = F.split(tidy("genre"), r"\s+")
    both = F.size(parts) == 2
    cells = corpus.select(
        "sentence_id",
        F.when(both, parts[1]).otherwise(tidy("topic")).alias("topic"),
        F.when(both, parts[0]).otherwise(tidy("genre")).alias("genre"),
        tidy("source").alias("source"),
    )
    return cells.filter("sentence_id is not null and topic <> '' and genre <> '' and genre <> '?' and source <> ''").distinct()


def counted(corpus: DataFrame, targets: DataFrame) -> DataFrame:
    """The target cells with available and wanted rows; a cell without rows counts 0, repeated targets count once."""
    have = cells_of(corpus).groupBy("topic", "genre", "source").agg(F.count("*").alias("available"))
    t = targets.select("topic", "genre", "source", F.coalesce("share_bp", F.lit(0)).alias("share_bp"), F.coalesce("min_rows", F.lit(0)).alias("min_rows")).dropDuplicates(["topic", "genre", "source"])
    own = [F.lower(F.trim(F.col(c))).alias(f"_{c}") for c in ("topic", "genre", "source")]
    have = have.toDF("_topic", "_genre", "_source", "available")
    cells = t.select("*", *own).join(have, ["_topic", "_genre", "_source"], "left").drop("_topic", "_genre", "_source")
    cells = cells.withColumn("available", F.coalesce("available", F.lit(0)))
    n = cells.agg(F.floor(F.coalesce(F.sum("available"), F.lit(0)) / ONE_IN).cast("long").alias("n"))
    wanted = F.greatest(F.col("min_rows").cast("long"), F.expr("(share_bp * n + 9999) div 10000"))
    return cells.crossJoin(F.broadcast(n)).withColumn("wanted", wanted)  # n is one row


def allocate(n: int, cells: list[tuple[int, int, int]]) -> list[int]:
    """Integer quotas of cells (share, floor, available) that sum to n, or to all there is, or to the floors if they ask for more.

    Each cell gets its share of one common scale, but not under its floor nor over what
    is available; what a cap takes away or a floor adds is made up by the cells that have
    room, in proportion. Leftovers go by largest remainder, ties by order.
    """
    caps = [max(a, 0) for _, _, a in cells]
    floors = [min(max(f, 0), a) for (_, f, _), a in zip(cells, caps)]
    n = min(max(n, sum(floors)), sum(caps))
    at = lambda scale: [min(max(scale * s, f), c) for (s, _, _), f, c in zip(cells, floors, caps)]
    low, high = 0.0, float(max(caps, default=0) + 1)  # a share is a whole number, so no scale needs to be larger
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(at(mid)) < n else (low, mid)
    ideal = at(high)
    quota = [min(int(x + 1e-9), c) for x, c in zip(ideal, caps)]
    by_rest = sorted(range(len(cells)), key=lambda i: (-(ideal[i] - quota[i]), i))
    while (left := n - sum(quota)) > 0:  # a second round only where shares are nought
        room = [i for i in by_rest if quota[i] < caps[i]]
        for i in room[:left]:
            quota[i] += 1
    return quota


def quotas(cells: DataFrame) -> DataFrame:
    """The cells with their quota, see :func:`allocate`; they are those of the targets, some tens of rows, and are read by the driver."""
    rows = cells.orderBy("topic", "genre", "source").collect()
    quota = allocate(rows[0].n if rows else 0, [(r.share_bp, r.min_rows, r.available) for r in rows])
    schema = "topic string, genre string, source string, quota long"
    table = cells.sparkSession.createDataFrame([(r.topic, r.genre, r.source, q) for r, q in zip(rows, quota)], schema)
    return cells.join(F.broadcast(table), ["topic", "genre", "source"])


def smallest_keys(cells: DataFrame, quota: DataFrame, key: Column) -> DataFrame:
    """Of each cell the rows with the smallest key, as many as its quota.

    Rows are counted by (cell, key range) first, which tells of each range how many
    rows are before it: ranges below the quota are taken whole, and only the one range of
    a cell in which its quota ends is ranked. A cell has the more ranges the more rows it
    has, about RANGE rows each.
    """
    by = ["topic", "genre", "source"]
    wanted = quota.select(*by, "quota", F.greatest(F.lit(1), F.ceil(F.col("available") / RANGE)).cast("long").alias("_ranges"))
    rows = cells.join(F.broadcast(wanted), by).withColumn("_key", key)
    rows = rows.withColumn("_range", F.expr(f"cast(shiftrightunsigned(_key, {64 - 31}) * _ranges div {1 << 31} as long)"))
    sizes = rows.groupBy(*by, "_range", "quota").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    last = ranges.filter("_ahead < quota and _ahead + _n >= quota").select(*by, F.col("_range").alias("_last"), (F.col("quota") - F.col("_ahead")).alias("_take"))  # one a cell
    rows = rows.join(F.broadcast(last), by, "left").filter("quota > 0 and (_last is null or _range <= _last)")
    whole = rows.filter("_last is null or _range < _last")
    ranked = Window.partitionBy(*by).orderBy("_key", "sentence_id")
    rest = rows.filter("_range = _last").withColumn("_r", F.row_number().over(ranked)).filter("_r <= _take").drop("_r")
    return whole.unionByName(rest).select(*cells.columns)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cells = counted(read(spark, d, "corpus", "sentence_id", "topic", "genre", "source"), read(spark, d, "sample_targets", "topic", "genre", "source", "share_bp", "min_rows"))
    return cells.filter("available < wanted").select("topic", "genre", "source")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Every target cell with what is available, wanted, its quota and its shortfall."""
    cells = quotas(counted(read(spark, d, "corpus", "sentence_id", "topic", "genre", "source"), read(spark, d, "sample_targets", "topic", "genre", "source", "share_bp", "min_rows")))
    return cells.select("topic", "genre", "source", "available", "wanted", "quota", F.greatest(F.col("wanted") - F.col("available"), F.lit(0)).alias("shortfall"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample itself: sentence_id and its cell."""
    corpus = read(spark, d, "corpus", "sentence_id", "topic", "genre", "source")
    quota = quotas(counted(corpus, read(spark, d, "sample_targets", "topic", "genre", "source", "share_bp", "min_rows")))
    return smallest_keys(cells_of(corpus), quota, F.xxhash64(F.lit(SEED), F.col("sentence_id")))


_CELLS = """
with c as (
  select distinct sentence_id,
    case when regexp_matches(g, '^\\S+\\s+\\S+$') then regexp_extract(g, '(\\S+)$', 1) else t end as topic,
    case when regexp_matches(g, '^\\S+\\s+\\S+$') then regexp_extract(g, '^(\\S+)', 1) else g end as genre, s as source
  from (select sentence_id, lower(trim(genre)) g, lower(trim(topic)) t, lower(trim(source)) s from corpus)
), h as (
  select t.topic, t.genre, t.source, t.share_bp, t.min_rows, count(c.sentence_id) as available
  from sample_targets t left join c on c.topic = t.topic and c.genre = t.genre and c.source = t.source group by all
), w as (
  select *, greatest(min_rows, (share_bp * ((select sum(available) from h) // 5) + 9999) // 10000) as wanted from h
)
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p4_sample": p4_sample}
SQL = {"p4_found": _CELLS + "select topic, genre, source from w where available < wanted"}
