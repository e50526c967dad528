"""Problem 6: train, validation and test splits that keep related records together.

Connected components over the links by alternating large-star and small-star,
each round a partial aggregation and a join on the node, with the edges cut
loose from their lineage by checkpoint(). The smallest key of a component, hashed,
falls into one of the split ranges. Components of like size and like share of
labels form a stratum with ranges of its own, proportional in rows, so that the
splits have similar shares of each label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradja.llm.arrow import article_key, read, shared_folder


def article_of(name: Column) -> Column:
    """The article key that a key or a page address names; null if it names none.

    An address gives the first three letters of its site's name and the number that closes its path.
    """
    n = F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
    site = F.regexp_extract(n, r"^(?:https?://)?(?:[^/?#]*\.)?([^./?#]+)\.[^./?#]+(?:/|$)", 1)
    number = F.regexp_extract(F.regexp_replace(n, r"[?#].*$", ""), r"(\d+)/*$", 1)
    address = F.when((site != "") & (number != ""), F.concat(F.substring(site, 1, 3), F.lit("-"), number))
    return F.when(n.rlike(r"^[a-z0-9]{3}-\d+$"), n).when(n.contains("/"), address)


def links_of(links: DataFrame) -> DataFrame:
    """Distinct undirected links (a < b) between article keys; nulls, unreadable names and links to itself fall out."""
    a, b = article_of(F.col("article_a")), article_of(F.col("article_b"))
    return links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), a.isNotNull().alias("x"), b.isNotNull().alias("y")).filter("x and y and a < b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node of its component.

    Rounds grow with the logarithm of the longest chain. No edge list of a node is
    ever gathered: a hub's edges are folded map-side and its join may be split by AQE.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    edges = edges.select("a", "b").checkpoint()
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: edges lead from a down to b
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.union(low.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root")).distinct()


def article_groups(corpus: DataFrame, links: DataFrame) -> DataFrame:
    """(article_key, group_key) of the articles of corpus that links tie to another article of corpus.

    Articles that corpus lacks still carry a tie between those it has; group_key is
    the smallest key of the articles of corpus in the group.
    """
    keys = corpus.filter("sentence_id is not null").select(article_key().alias("node")).distinct()
    tied = components(links_of(links)).join(keys, "node", "left_semi")
    groups = tied.groupBy("root").agg(F.min("node").alias("group_key"), F.count("*").alias("n")).filter("n > 1")
    return tied.join(groups, "root").select(F.col("node").alias("article_key"), "group_key")


#: Ranges of the hash into which the components of one stratum are counted.
RANGES = 1024


def strata(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(group_key, n, stratum) of every component: rows, and what its size and label shares are like.

    groups: (article_key, group_key); rows: (article_key, label), each row once. A
    stratum is the power of two of the rows and the quarter of SUBJ among the labelled.
    """
    of_article = rows.groupBy("article_key").agg(F.count("*").alias("n"), F.sum((F.col("label") == "SUBJ").cast("long")).alias("subj"), F.sum(F.col("label").isin("SUBJ", "OBJ").cast("long")).alias("labelled"))
    sums = of_article.join(groups, "article_key").groupBy("group_key").agg(*(F.sum(c).alias(c) for c in ("n", "subj", "labelled")))
    share = F.when(F.coalesce("labelled", F.lit(0)) > 0, F.floor(F.col("subj") * 4 / F.col("labelled"))).otherwise(-1)
    return sums.select("group_key", "n", F.concat_ws("/", F.floor(F.log2("n")), share).alias("stratum"))


def split_ranges(groups: DataFrame, shares: list[tuple[str, int]]) -> DataFrame:
    """(stratum, spot, split): to which split each hash range of each stratum goes, so that the rows of the stratum are split in proportion; at most RANGES rows a stratum."""
    spots = groups.groupBy("stratum", _spot()).agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("stratum").orderBy("spot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = (F.sum("n").over(upto) - F.col("n") / 2) / F.sum("n").over(Window.partitionBy("stratum")) * (sum(s for _, s in shares) or 1)
    out, to = None, 0
    for name, share in shares:
        to += share
        out = F.when(middle < to, name) if out is None else out.when(middle < to, name)
    return spots.select("stratum", "spot", (out if out is not None else F.lit(None).cast("string")).alias("split"))


def _spot() -> Column:
    return F.pmod(F.xxhash64(F.lit("split"), "group_key"), F.lit(RANGES)).alias("spot")


def assign(corpus: DataFrame, links: DataFrame, shares: DataFrame) -> DataFrame:
    """(article_key, group_key, split) of every article of corpus; an untied article is its own group.

    shares is a fixed table of a few splits and is read by the driver. Labels regardless
    of case and outer spaces; rows delivered again count once, other labels not at all.
    """
    named = [(r.split, r.share_bp) for r in shares.filter("split is not null and share_bp > 0").orderBy("split").collect()]
    rows = corpus.filter("sentence_id is not null").groupBy("sentence_id").agg(F.max(F.upper(F.trim("label"))).alias("label")).select(article_key().alias("article_key"), "label")
    keys = rows.select("article_key").distinct()
    groups = keys.join(article_groups(corpus, links), "article_key", "left").withColumn("group_key", F.coalesce("group_key", "article_key")).persist()
    placed = strata(groups, rows).persist()
    split = placed.select("group_key", "stratum", _spot()).join(split_ranges(placed, named), ["stratum", "spot"]).select("group_key", "split")
    return groups.join(split, "group_key").select("article_key", "group_key", "split")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return article_groups(read(spark, d, "corpus", "sentence_id"), read(spark, d, "article_links", "article_a", "article_b"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every article of corpus."""
    return assign(read(spark, d, "corpus", "sentence_id", "label"), read(spark, d, "article_links", "article_a", "article_b"), read(spark, d, "split_shares", "split", "share_bp"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each split: articles, rows, its share of all rows and the share of subjective labels among the labelled."""
    splits = p6_splits(spark, d)
    rows = read(spark, d, "corpus", "sentence_id", "label").filter("sentence_id is not null").groupBy("sentence_id").agg(F.max(F.upper(F.trim("label"))).alias("label"))
    per = rows.groupBy(article_key().alias("article_key")).agg(F.count("*").alias("n"), F.sum((F.col("label") == "SUBJ").cast("long")).alias("subj"), F.sum(F.col("label").isin("SUBJ", "OBJ").cast("long")).alias("labelled"))
    out = per.join(splits, "article_key").groupBy("split").agg(F.count("*").alias("articles"), F.sum("n").alias("rows"), F.sum("subj").alias("subj"), F.sum("labelled").alias("labelled"))
    share = F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy(F.lit(1))), 6)  # as many rows as splits
    return out.select("split", "articles", "rows", share.alias("row_share"), F.round(F.col("subj") / F.col("labelled"), 6).alias("subj_share"))


_ART = "case when regexp_matches(n, '^[a-z0-9]{3}-[0-9]+$') then n when n like '%/%' then substr(regexp_extract(n, '^(https?://)?([^/?#]*\\.)?([^./?#]+)\\.[^./?#]+(/|$)', 3), 1, 3) || '-' || regexp_extract(regexp_replace(n, '[?#].*$', ''), '([0-9]+)/*$', 1) end"

QUERIES = {"p6_found": p6_found, "p6_splits": p6_splits, "p6_report": p6_report}
SQL = {
    "p6_found": f"""
with recursive l as (
  select {_ART.replace('n,', 'x,').replace(' n ', ' x ').replace('(n', '(x')} a, {_ART.replace('n,', 'y,').replace(' n ', ' y ').replace('(n', '(y')} b
  from (select lower(regexp_replace(article_a, '^\\s+|\\s+$', '', 'g')) x, lower(regexp_replace(article_b, '^\\s+|\\s+$', '', 'g')) y from article_links)
), e as (select distinct a, b from l where a <> b union select distinct b, a from l where a <> b),
r as (select a as node, a as root from e union select e.b, r.root from r join e on e.a = r.node),
k as (select distinct regexp_extract(sentence_id, '^([^-]*-[^-]*)', 1) as node from corpus),
t as (select r.node, r.root from r join k using (node) join k k2 on k2.node = r.root),
g as (select node, min(root) as group_key, count(*) as n from t group by node)
select node as article_key, group_key from g where n > 1"""
}
