"""Queries: the file forms, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradja.plans.base import INVENTORY, WITH, inventory, query, sentences
from gradja.session import shared_path
from gradja.sources import files

_FLAT = "coalesce(translate({}, chr(9) || chr(10) || chr(13), '   '), '')"


@query("q_tsv", f"{WITH} select sentence_id, {_FLAT.format('source')} as source, {_FLAT.format('text')} as text from s")
def q_tsv(spark, d):
    path = shared_path(spark)
    files.write_tsv(sentences(spark, d, "source", "text"), path)
    return files.read_tsv(spark, path, "sentence_id string, source string, text string")


@query("q_tsv_members", f"{WITH} select source, count(*) as n from s where source is not null group by source")
def q_tsv_members(spark, d):
    """Rows of several files by the file they come from: a folder a source, read by one pattern."""
    path = shared_path(spark)
    s = sentences(spark, d, "source").filter("source is not null").withColumn("kept", F.col("source"))
    s.write.partitionBy("source").option("sep", "\t").option("header", True).csv(path)
    t = files.read_many(spark, f"{path}/*", "sentence_id string, kept string")
    return t.filter(F.col("member").endswith(".csv")).groupBy(F.col("kept").alias("source")).agg(F.count("*").alias("n"))


@query("q_jsonl", f"{WITH} select sentence_id, text, label from s")
def q_jsonl(spark, d):
    path = shared_path(spark)
    files.write_jsonl(sentences(spark, d, "text", "label"), path)
    return files.read_jsonl(spark, path, "sentence_id string, text string, label string")


@query("q_append", f"{WITH} select genre, count(*) as n from s where genre is not null group by genre")
def q_append(spark, d):
    """A table of results that grows by runs, parted by genre."""
    path = shared_path(spark)
    s = sentences(spark, d, "genre").filter("genre is not null")
    files.append(s.filter("genre = 'vest'"), path, ["genre"])
    files.append(s.filter("genre <> 'vest'"), path, ["genre"])
    return spark.read.schema(s.schema).parquet(path).groupBy("genre").agg(F.count("*").alias("n"))


@query("q_map_file", f"{WITH} select source as key, count(*)::varchar as value from s where source is not null group by source")
def q_map_file(spark, d):
    """A file that is one JSON object; sources are a handful."""
    path = shared_path(spark)
    n = sentences(spark, d, "source").filter("source is not null").groupBy("source").agg(F.count("*").cast("string").alias("n"))
    n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "n"))))).coalesce(1).write.text(path)
    return files.read_map(spark, path)


@query("q_id_file", f"{WITH} select sentence_id as id from s where not regexp_matches(sentence_id, '\\s')")
def q_id_file(spark, d):
    path = shared_path(spark)
    sentences(spark, d, "label").filter(~F.col("sentence_id").rlike(r"\s")).select(F.concat(F.col("sentence_id"), F.lit("  "))).write.text(path)
    return files.read_ids(spark, path)


@query("q_worksheet", f"{WITH} select sentence_id, nullif(text, '') as text from s where text is null or not contains(text, chr(13))")
def q_worksheet(spark, d):
    """Quoted CSV, line breaks inside fields; carriage returns are the form's own line ends and left out."""
    path = shared_path(spark)
    s = sentences(spark, d, "text").filter("text is null or not contains(text, '\\r')")
    s.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return files.read_worksheet(spark, path, "sentence_id string, text string").select("sentence_id", F.nullif("text", F.lit("")).alias("text"))


@query("q_sentence_files", f"{WITH}, g as (select art, list(text order by sentence_id) as l from s where text is not null and not regexp_matches(text, '[\\n\\r]') group by art) select art, unnest(l) as text, generate_subscripts(l, 1) - 1 as sent_idx from g")
def q_sentence_files(spark, d):
    """An index of articles and the table of their sentences, the latter read back."""
    path = shared_path(spark)
    s = sentences(spark, d, "art", "text").filter("text is not null").filter(~F.col("text").rlike("[\\n\\r]"))
    g = s.groupBy("art").agg(F.transform(F.sort_array(F.collect_list(F.struct("sentence_id", "text"))), lambda x: x["text"]).alias("l"))  # an article is some tens of sentences
    files.write_sentences(g, "art", "l", path)
    t = files.read_worksheet(spark, f"{path}/sentences", "art string, sent_idx int, text string")
    return t.select("art", F.coalesce("text", F.lit("")).alias("text"), "sent_idx")


@query("q_sitemap_file", f"with {INVENTORY} select distinct trim(url) as loc, substr(strftime(collected_at, '%Y-%m-%dT%H:%M:%S'), 1, 10) as lastmod, nullif(trim(title), '') as title from i where trim(url) <> '' and collected_at is not null")
def q_sitemap_file(spark, d):
    """Gzipped sitemaps, entities in addresses and titles decoded."""
    path = shared_path(spark)
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    i = inventory(spark, d).filter("trim(url) <> '' and collected_at is not null")
    entry = F.concat(F.lit("<url><loc>"), safe(F.trim("url")), F.lit("</loc><lastmod>"), F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("</lastmod><news:title><![CDATA["), safe(F.col("title")), F.lit("]]></news:title></url>"))
    i.select(entry).write.option("compression", "gzip").text(path)
    return files.read_sitemap(spark, path).select("loc", "lastmod", "title").distinct()


@query("q_report_file", f"{WITH} select 'rows' as section, source as metric, count(*)::varchar as value from s where source is not null group by source")
def q_report_file(spark, d):
    from gradja.operators.relational import report

    path = shared_path(spark)
    n = sentences(spark, d, "source").filter("source is not null").groupBy(F.col("source").alias("metric")).agg(F.count("*").alias("value"))
    files.write_report(report({"rows": n}), path)
    part = F.split("value", "\t")
    return spark.read.text(path).select(part[0].alias("section"), part[1].alias("metric"), part[2].alias("value"))
