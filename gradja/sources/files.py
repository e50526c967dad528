"""Readers and writers of the file forms that corpora come in. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_tsv(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Tab-separated, with a header and no quoting; empty fields are empty strings, as they were written."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("escape", "").csv(path).na.fill("")


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated without quoting; tabs and line breaks inside values become spaces, nulls empty."""
    cols = [F.coalesce(F.translate(F.col(c).cast("string"), "\t\n\r", "   "), F.lit("")).alias(c) for c in df.columns]
    df.select(*cols).write.mode(mode).option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped, a missing path gives an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line, nulls kept, letters unescaped."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Add rows to a table of results, parted by configuration if asked."""
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a file that is one JSON object of strings."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id), each once, of files of ids between white space."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("id")).filter("id <> ''").distinct()


def read_many(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """TSV files of a pattern with the name of the file each row comes from."""
    return read_tsv(spark, pattern, schema).withColumn("member", F.col("_metadata.file_name"))


def read_articles(spark: SparkSession, pattern: str) -> DataFrame:
    """(key, text): one article a file, named by the file."""
    t = spark.read.text(pattern, wholetext=True).withColumn("_f", F.input_file_name())
    return t.select(F.regexp_extract("_f", r"([^/]+)\.txt$", 1).alias("key"), F.col("value").alias("text"))


def write_articles(df: DataFrame, key: str, text: str, path: str) -> None:
    """One folder an article with its text; line breaks of the text stay."""
    df.select(key, F.col(text).alias("value")).write.partitionBy(key).text(path)


def write_sentences(df: DataFrame, key: str, sentences: str, path: str) -> None:
    """An index of articles and the table of their sentences, as CSV with a header."""
    forms = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(key, F.size(sentences).alias("n")).write.options(**forms).csv(f"{path}/index")
    df.select(key, F.posexplode(sentences).alias("sent_idx", "text")).write.options(**forms).csv(f"{path}/sentences")


def write_report(df: DataFrame, path: str) -> None:
    """A report (section, metric, value) as text, a line each, in order."""
    df.orderBy("section", "metric").select(F.concat_ws("\t", "section", "metric", "value")).coalesce(1).write.text(path)  # a report is some hundred lines


def read_worksheet(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Quoted CSV with line breaks inside fields."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod, keywords, title) of sitemaps, plain or gzipped."""
    return sitemap_entries(spark.read.text(path, wholetext=True), F.col("value"))


def sitemap_entries(df: DataFrame, xml: Column) -> DataFrame:
    """(loc, lastmod, keywords, title) of each url element; what it lacks is null. Namespaces don't matter."""
    blocks = df.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<url>(.*?)</url>"), 1)).alias("u"))
    one = lambda tag: F.nullif(F.trim(F.regexp_extract("u", rf"(?s)<(?:\w+:)?{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?{tag}>", 1)), F.lit(""))
    for_all = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]  # the last one last

    def text(tag: str) -> Column:
        out = one(tag)
        for entity, c in for_all:
            out = F.replace(out, F.lit(entity), F.lit(c))
        return out

    return blocks.select(text("loc").alias("loc"), F.substring(F.coalesce(one("lastmod"), one("publication_date")), 1, 10).alias("lastmod"), text("keywords").alias("keywords"), text("title").alias("title"))
