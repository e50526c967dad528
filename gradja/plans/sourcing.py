"""Queries: sources, sinks and page text over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradja.plans.base import INVENTORY, WITH, inventory, query, read, sentences


@query("q_sitemap", f"with {INVENTORY} select distinct url as loc, substr(strftime(collected_at, '%Y-%m-%dT%H:%M:%S'), 1, 10) as lastmod from i where url is not null and collected_at is not null and not contains(url, '<')")
def q_sitemap(spark, d):
    from gradja.sources.files import sitemap_entries

    i = inventory(spark, d).filter("url is not null and collected_at is not null and not contains(url, '<')")
    xml = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc><lastmod>"), F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("</lastmod></url>"))
    return sitemap_entries(i.select(xml.alias("x")), F.col("x")).select("loc", "lastmod").distinct()


@query("q_longest_title", f"with {INVENTORY} select source, article_id, arg_max(title, (length(title), title)) as title from i where title is not null group by all")
def q_longest_title(spark, d):
    from gradja.sources.pages import longest_title

    i = inventory(spark, d).filter("title is not null").withColumn("k", F.struct("source", "article_id"))
    return longest_title(i, "k", "title").select("k.source", "k.article_id", "title")


@query("q_article_text", f"{WITH} select art, arg_min(topic, sentence_id) as topic, string_agg(text, chr(10) order by sentence_id) as text from s where text is not null group by art")
def q_article_text(spark, d):
    s = sentences(spark, d, "art", "topic", "text").filter("text is not null")
    l = F.sort_array(F.collect_list(F.struct("sentence_id", "text")))
    return s.groupBy("art").agg(F.min_by("topic", "sentence_id").alias("topic"), F.array_join(F.transform(l, lambda x: x["text"]), "\n").alias("text"))


@query("q_json_map", "select doc_id, title, genre from documents where title is not null and genre is not null")
def q_json_map(spark, d):
    t = read(spark, d, "documents", "doc_id", "title", "genre").filter("title is not null and genre is not null")
    j = t.select("doc_id", F.from_json(F.to_json(F.create_map(F.lit("title"), "title", F.lit("genre"), "genre")), "map<string,string>").alias("m"))
    return j.select("doc_id", F.element_at("m", "title").alias("title"), F.element_at("m", "genre").alias("genre"))


@query("q_id_list", "select distinct x as id from (select unnest(regexp_split_to_array(article_a || ' ' || article_b, '\\s+')) as x from article_links where article_a is not null and article_b is not null) where x <> ''")
def q_id_list(spark, d):
    a = read(spark, d, "article_links", "article_a", "article_b").filter("article_a is not null and article_b is not null")
    return a.select(F.explode(F.split(F.concat_ws(" ", "article_a", "article_b"), r"\s+")).alias("id")).filter("id <> ''").distinct()


@query("q_tsv_fields", f"{WITH} select sentence_id, translate(coalesce(text, ''), chr(9) || chr(10), '  ') as text from s")
def q_tsv_fields(spark, d):
    return sentences(spark, d, "text").select("sentence_id", F.coalesce(F.translate("text", "\t\n", "  "), F.lit("")).alias("text"))


@query("q_html_text")
def q_html_text(spark, d):
    from gradja.sources.pages import extract

    docs = read(spark, d, "documents", "doc_id", "title", "text").filter("text is not null")
    page = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><nav><p>Menu</p></nav><p>"), F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit("</p></body></html>"))
    return extract(docs.withColumn("html", page), "html", ["doc_id"])


@query("q_events_hourly", "select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def q_events_hourly(spark, d):
    from gradja.streaming.slices import hourly

    return hourly(read(spark, d, "events", "ts", "event_type", "value")).select("hour", "event_type", "n", F.round("total", 4).alias("total"))
