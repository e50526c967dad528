"""Problem 3: lines that stand in many articles of one source.

Lines are the same if their letters in plain form are the same in the same
order. A line counts each article it stands in once, as TESTDATA.md asks: copies
of an article under other keys are articles of their own. The clusters of such
copies and the publication dates a line stands in decide nothing and are reported
apart (:func:`p3_spread`). Only hashes move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradja.llm.arrow import read
from gradja.llm.p1_furniture import corpus_cut, drop_lines

#: Articles of one source in which a line must stand.
ARTICLES = 5
#: Ways into which the rows of a line that fills a source are spread before the join.
SALT = 16
#: Rows up to which a table is broadcast; a larger one joins by shuffle.
BROADCAST = 500_000


def _of_source(column: str, name: str) -> Column:
    """One key of a line, or of an article, within its source."""
    return F.xxhash64("src", column).alias(name)


def bounded(df: DataFrame, rows: int = BROADCAST) -> tuple[DataFrame, bool]:
    """The rows, kept, and whether they are so few that they may be broadcast."""
    df = df.persist()
    return df, df.count() <= rows


def repeated_keys(cut: DataFrame, articles: int = ARTICLES) -> DataFrame:
    """(key, n) of the line keys that stand in at least so many different articles of a source.

    Lines without letters have no key and are no case. An empty table gives none.
    """
    stands = cut.filter("lkey <> 0").select(_of_source("page", "article"), _of_source("lkey", "key")).distinct()
    return stands.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= articles)


def repeated_lines(cut: DataFrame, articles: int = ARTICLES) -> DataFrame:
    """(sid, line) of every line whose key is repeated, once for each delivered copy; of many keys a hot one is spread over SALT tasks."""
    keys, few = bounded(repeated_keys(cut, articles).select("key"))
    lines = cut.filter("lkey <> 0").select("sid", "line", _of_source("lkey", "key"))
    if few:
        return lines.join(F.broadcast(keys), "key", "left_semi").select("sid", "line")
    spread = keys.select("key", F.explode(F.array(*(F.lit(i) for i in range(SALT)))).alias("salt"))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALT)).cast("int"))
    return salted.join(spread, ["key", "salt"], "left_semi").select("sid", "line")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = repeated_lines(corpus_cut(spark, d, keys=True).select("sid", "line", "src", "page", "lkey").persist()).distinct()
    return found.select(F.col("sid").alias("sentence_id"), F.col("line").alias("line_no"))


def p3_removed(spark: SparkSession, d: str) -> DataFrame:
    """Every row of corpus with its repeated lines cut out: sentence_id, text (empty if none is left)."""
    corpus = read(spark, d, "corpus", "sentence_id", "text").filter("sentence_id is not null").dropDuplicates(["sentence_id"])
    return drop_lines(corpus, repeated_lines(corpus_cut(spark, d, keys=True).select("sid", "line", "src", "page", "lkey").persist()))


def publication_days(inventory: DataFrame) -> DataFrame:
    """(source, article_id, day): the first day on which each article was listed; dates that are none leave it out."""
    day = F.expr("try_cast(substr(trim(date), 1, 10) as date)")  # some have a time of day and its zone
    return inventory.select(F.lower(F.trim("source")).alias("source"), F.trim("article_id").alias("article_id"), day.alias("day")).groupBy("source", "article_id").agg(F.min("day").alias("day")).filter("day is not null")


def p3_spread(spark: SparkSession, d: str) -> DataFrame:
    """Of each source: how many repeated line keys, and how many distinct articles and publication dates they stand in at most.

    Documents whose lines are all the same are collapsed into one cluster first,
    so a republished article does not count twice here. Counts are exact; dates are
    those of inventory, and articles without one have none.
    """
    cut = corpus_cut(spark, d, keys=True).select("src", "lkey", "page", "sid").filter("lkey <> 0").persist()
    page = F.xxhash64(F.substring_index("sid", "-", 2)).alias("day_page")
    clusters = cut.select("page", "lkey").distinct().groupBy("page").agg(F.bit_xor("lkey").alias("cluster"))
    articles = (
        read(spark, d, "corpus", "sentence_id", "source", "article_id")
        .filter("sentence_id is not null")
        .select(F.xxhash64(F.substring_index("sentence_id", "-", 2)).alias("day_page"), F.lower(F.trim("source")).alias("source"), F.trim("article_id").alias("article_id"))
        .distinct()
    )
    listed = publication_days(read(spark, d, "inventory", "source", "article_id", "date"))
    taken = articles.join(listed, ["source", "article_id"]).groupBy("day_page").agg(F.min("day").alias("day"))
    stands = cut.select("src", "lkey", "page", page).distinct().join(clusters, "page").join(taken, "day_page", "left").select("src", "lkey", "page", "cluster", "day").persist()
    n_articles = stands.groupBy("src", "lkey").agg(F.count_distinct("page").alias("n_articles")).filter(F.col("n_articles") >= ARTICLES)
    n_clusters = stands.select("src", "lkey", "cluster").distinct().groupBy("src", "lkey").agg(F.count("*").alias("n_clusters"))
    n_days = stands.filter("day is not null").select("src", "lkey", "day").distinct().groupBy("src", "lkey").agg(F.count("*").alias("n_days"))
    stands = n_articles.join(n_clusters, ["src", "lkey"]).join(n_days, ["src", "lkey"], "left").fillna(0, ["n_days"])
    return stands.groupBy(F.col("src").alias("source")).agg(F.count("*").alias("n_lines"), F.max("n_articles").alias("most_articles"), F.max("n_clusters").alias("most_clusters"), F.max("n_days").alias("most_days"))


QUERIES = {"p3_found": p3_found, "p3_removed": p3_removed, "p3_spread": p3_spread}
SQL: dict[str, str] = {}
