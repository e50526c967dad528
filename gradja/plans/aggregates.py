"""Queries: counts, shares, association, quotas, windows, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradja.functions import stats
from gradja.functions import text as X
from gradja.operators import sampling as W
from gradja.operators.relational import last_wins
from gradja.plans.base import ANNOTATIONS, INVENTORY, PREDS, SENTENCES, WITH, annotations, inventory, predictions, query, read, sentences

_SHARE = "round(avg((label = 'SUBJ')::int), 9)"


@query("q_value_counts", f"{WITH} select 'source' as field, source as value, count(*) as n from s group by source union all select 'genre', genre, count(*) from s group by genre union all select 'topic', topic, count(*) from s group by topic")
def q_value_counts(spark, d):
    s = sentences(spark, d, "source", "genre", "topic")
    fields = F.expr("stack(3, 'source', source, 'genre', genre, 'topic', topic) as (field, value)")
    return s.select(fields).groupBy("field", "value").agg(F.count("*").alias("n"))


@query("q_article_cells", f"{WITH}, a as (select art, arg_max(genre, sentence_id) as genre, arg_max(topic, sentence_id) as topic from s where genre is not null and topic is not null group by art) select genre, topic, count(*) as n from a group by all")
def q_article_cells(spark, d):
    s = sentences(spark, d, "art", "genre", "topic").filter("genre is not null and topic is not null")
    return last_wins(s, ["art"], ["sentence_id"]).groupBy("genre", "topic").agg(F.count("*").alias("n"))


@query("q_share_pivot", f"{WITH} select source, {_SHARE} filter (genre = 'kolumna') as kolumna, count(*) filter (genre = 'kolumna') as n_kolumna, {_SHARE} filter (genre = 'vest') as vest, count(*) filter (genre = 'vest') as n_vest from s where label in ('OBJ', 'SUBJ') group by source".replace("round(avg((label = 'SUBJ')::int), 9) filter (genre = 'kolumna')", "round(avg((label = 'SUBJ')::int) filter (genre = 'kolumna'), 9)").replace("round(avg((label = 'SUBJ')::int), 9) filter (genre = 'vest')", "round(avg((label = 'SUBJ')::int) filter (genre = 'vest'), 9)"))
def q_share_pivot(spark, d):
    s = sentences(spark, d, "source", "genre", "label").filter("label in ('OBJ', 'SUBJ')")
    subj = (F.col("label") == "SUBJ").cast("double")
    aggs = []
    for g in ("kolumna", "vest"):
        aggs += [F.round(F.avg(F.when(F.col("genre") == g, subj)), 9).alias(g), F.count_if(F.col("genre") == g).alias(f"n_{g}")]
    return s.groupBy("source").agg(*aggs)


@query("q_share_by", f"{WITH} select 'topic' as field, topic as value, {_SHARE} as share, count(*) as n from s where label in ('OBJ', 'SUBJ') group by topic union all select 'in_quote', coalesce(in_quote, ''), {_SHARE}, count(*) from s where label in ('OBJ', 'SUBJ') group by 2")
def q_share_by(spark, d):
    s = sentences(spark, d, "topic", "in_quote", "label").filter("label in ('OBJ', 'SUBJ')").withColumn("in_quote", F.coalesce("in_quote", F.lit("")))
    return s.select("label", F.expr("stack(2, 'topic', topic, 'in_quote', in_quote) as (field, value)")).groupBy("field", "value").agg(F.round(F.avg((F.col("label") == "SUBJ").cast("double")), 9).alias("share"), F.count("*").alias("n"))


_CROSS = "l as (select * from s where label in ('OBJ', 'SUBJ') and topic is not null), x as (select topic, label, count(*) as n from l group by all), k as (select t.topic, b.label, coalesce(n, 0) as o from (select distinct topic from l) t cross join (select distinct label from l) b left join x on x.topic = t.topic and x.label = b.label)"


@query("q_contingency", f"{WITH}, {_CROSS} select * from k")
def q_contingency(spark, d):
    return stats.contingency(sentences(spark, d, "topic", "label").filter("label in ('OBJ', 'SUBJ')"), "topic", "label")


@query(
    "q_cramers_v",
    f"""{WITH}, {_CROSS}, e as (select *, sum(o) over (partition by topic) * 1.0 * sum(o) over (partition by label) / sum(o) over () as e from k),
    t as (select sum(o) as n, sum(case when e > 0 then (o - e) ^ 2 / e end) as chi2, count(distinct topic) as r, count(distinct label) as c from e)
    select n::bigint as n, round(chi2, 6) as chi2, (r - 1) * (c - 1) as dof, round(sqrt(chi2 / (n * least(r - 1, c - 1))), 6) as v from t""",
)
def q_cramers_v(spark, d):
    t = stats.chi_square(sentences(spark, d, "topic", "label").filter("label in ('OBJ', 'SUBJ')"), "topic", "label")
    return t.select("n", F.round("chi2", 6).alias("chi2"), "dof", F.round("v", 6).alias("v"))


@query(
    "q_balance",
    f"""{WITH}, a as (select art, arg_max(genre, sentence_id) as genre, arg_max(source, sentence_id) as source from s where genre is not null and source is not null group by art),
    x as (select source, genre, count(*) as n from a group by all), k as (select t.source, g.genre, coalesce(n, 0) as o from (select distinct source from a) t cross join (select distinct genre from a) g left join x on x.source = t.source and x.genre = g.genre),
    e as (select *, sum(o) over (partition by source) * 1.0 * sum(o) over (partition by genre) / sum(o) over () as e from k),
    t as (select sum(o) as n, sum(case when e > 0 then (o - e) ^ 2 / e end) as chi2, count(distinct source) as r, count(distinct genre) as c from e)
    select round(sqrt(chi2 / (n * least(r - 1, c - 1))), 6) as v, sqrt(chi2 / (n * least(r - 1, c - 1))) >= 0.15 as flagged from t""",
)
def q_balance(spark, d):
    s = sentences(spark, d, "art", "genre", "source").filter("genre is not null and source is not null")
    t = stats.chi_square(last_wins(s, ["art"], ["sentence_id"]), "source", "genre")
    return t.select(F.round("v", 6).alias("v"), (F.col("v") >= 0.15).alias("flagged"))


_TOK = "len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> ''))"


@query("q_len_stats", f"{WITH}, t as (select source, {_TOK} as k, row_number() over (partition by source order by {_TOK}, sentence_id) - 1 as r, count(*) over (partition by source) as n from s where text is not null) select source, min(k) as least, max(case when r = n // 2 then k end) as upper_median, max(k) as most from t group by source")
def q_len_stats(spark, d):
    from gradja.operators.features import upper_median

    s = sentences(spark, d, "source", "text").filter("text is not null").select("sentence_id", "source", X.token_count("text").alias("k"))
    return upper_median(s, ["source"], "k")


@query("q_std_both", f"{WITH} select source, round(avg(length(text)), 6) as mean, round(stddev_samp(length(text)), 6) as sd, round(stddev_pop(length(text)), 6) as sd_pop from s where text is not null group by source")
def q_std_both(spark, d):
    n = F.length("text")
    return sentences(spark, d, "source", "text").filter("text is not null").groupBy("source").agg(F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("sd"), F.round(F.stddev_pop(n), 6).alias("sd_pop"))


@query("q_boilerplate", f"{WITH} select text, count(distinct art) as n from s where length(text) >= 30 group by text having count(distinct art) >= 3")
def q_boilerplate(spark, d):
    s = sentences(spark, d, "art", "text").filter("length(text) >= 30").select("text", "art").distinct()
    return s.groupBy("text").agg(F.count("*").alias("n")).filter("n >= 3")


@query("q_confusion", f"{WITH}, {PREDS} select model, label as gold, pred, count(*) as n from s join p using (sentence_id) where label in ('OBJ', 'SUBJ') group by all")
def q_confusion(spark, d):
    s = sentences(spark, d, "label").filter("label in ('OBJ', 'SUBJ')").withColumnRenamed("label", "gold")
    return s.join(predictions(spark, d), "sentence_id").groupBy("model", "gold", "pred").agg(F.count("*").alias("n"))


@query("q_group_lists", f"with {ANNOTATIONS} select annotator, label, list(sentence_id order by sentence_id) as ids from a group by all")
def q_group_lists(spark, d):
    return annotations(spark, d).groupBy("annotator", "label").agg(F.sort_array(F.collect_list("sentence_id")).alias("ids"))


@query("q_disagreements", f"with {ANNOTATIONS} select sentence_id, coalesce(max(label) filter (annotator = 'A'), '') as A, coalesce(max(label) filter (annotator = 'B'), '') as B, coalesce(max(label) filter (annotator = 'C'), '') as C from a group by sentence_id having count(distinct label) > 1")
def q_disagreements(spark, d):
    cols = [F.coalesce(F.max(F.when(F.col("annotator") == r, F.col("label"))), F.lit("")).alias(r) for r in "ABC"]
    return annotations(spark, d).groupBy("sentence_id").agg(F.count_distinct("label").alias("_k"), *cols).filter("_k > 1").drop("_k")


@query("q_uncertain", f"with {ANNOTATIONS} select sentence_id, max(nedoumica) <> '' as uncertain, count(*) filter (napomena <> '') as notes from a group by sentence_id having max(nedoumica) <> '' or count(*) filter (napomena <> '') > 0")
def q_uncertain(spark, d):
    g = annotations(spark, d).groupBy("sentence_id").agg((F.max("nedoumica") != "").alias("uncertain"), F.count_if(F.col("napomena") != "").alias("notes"))
    return g.filter("uncertain or notes > 0")


_CELL = "c as (select source, genre, count(*) as n from s where genre is not null group by all)"


@query("q_quota_lr", f"{WITH}, {_CELL}, q as (select *, n * 350 // sum(n) over () as b, n * 350 % sum(n) over () as m from c) select source, genre, n, (b + (row_number() over (order by m desc, source, genre) <= 350 - sum(b) over ())::int)::bigint as quota from q")
def q_quota_lr(spark, d):
    c = sentences(spark, d, "source", "genre").filter("genre is not null").groupBy("source", "genre").agg(F.count("*").alias("n"))
    return W.largest_remainder(c, "n", 350, ["source", "genre"])


@query("q_quota_round", f"{WITH}, {_CELL} select source, genre, n, greatest(1, round_even(n * 100.0::double / sum(n) over (), 0))::bigint as quota from c")
def q_quota_round(spark, d):
    c = sentences(spark, d, "source", "genre").filter("genre is not null").groupBy("source", "genre").agg(F.count("*").alias("n"))
    return W.rounded_quota(c, "n", 100)


@query("q_window8", f"{WITH}, g as (select art, min(url) as url, list(sentence_id order by sent_idx, sentence_id) as ids from s group by art having count(*) >= 4), t as (select *, xor(('0x' || substr(md5(url), 1, 8))::bigint, 42::bigint) % greatest(len(ids) - 7, 1) as st from g where url is not null) select art, ids[st + 1 : st + 8] as ids from t")
def q_window8(spark, d):
    s = sentences(spark, d, "art", "url", "sent_idx")
    g = s.groupBy("art").agg(F.min("url").alias("url"), F.sort_array(F.collect_list(F.struct("sent_idx", "sentence_id"))).alias("l")).filter("size(l) >= 4 and url is not null")
    ids = F.transform("l", lambda x: x["sentence_id"])
    return g.select("art", W.window_of(ids, W.start_of("url", 42, F.size("l") - 7)).alias("ids"))


@query("q_time_strata", f"with {INVENTORY}, b as (select source, article_id, min(date) as date from i where date is not null group by all), r as (select *, row_number() over (partition by source order by date, article_id) - 1 as r, count(*) over (partition by source) as n from b), k as (select source, article_id, (4 * r + 3) // n as chunk, row_number() over (partition by source, (4 * r + 3) // n order by md5('42:' || article_id), article_id) as p from r) select source, article_id, chunk::int as chunk from k where p <= 10 // 4 + (chunk < 10 % 4)::int")
def q_time_strata(spark, d):
    b = inventory(spark, d).filter("date is not null").groupBy("source", "article_id").agg(F.min("date").alias("date"))
    return W.chunks_over_time(b, ["date", "article_id"], ["source"], 10).select("source", "article_id", "chunk")


_H = "h as (select *, row_number() over (partition by art order by md5('7:' || sentence_id), sentence_id) as ra from s where genre is not null)"


@query("q_article_unique", f"{WITH}, {_H} select sentence_id from h where ra = 1 qualify row_number() over (partition by source, genre order by md5('7:' || sentence_id), sentence_id) <= 5")
def q_article_unique(spark, d):
    s = sentences(spark, d, "art", "source", "genre").filter("genre is not null")
    return W.sample_few_per(s, "art", ["source", "genre"], "sentence_id", 1, F.lit(5), 7).select("sentence_id")


@query("q_two_per_article", f"{WITH}, {_H} select sentence_id from h where ra <= 2 qualify row_number() over (partition by source, genre order by md5('7:' || sentence_id), sentence_id) <= 20")
def q_two_per_article(spark, d):
    s = sentences(spark, d, "art", "source", "genre").filter("genre is not null")
    return W.sample_few_per(s, "art", ["source", "genre"], "sentence_id", 2, F.lit(20), 7).select("sentence_id")


@query("q_sent_ids", f"{WITH} select sentence_id, art || '-' || printf('%03d', row_number() over (partition by art order by sent_idx, sentence_id)) as new_id from s")
def q_sent_ids(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("art").orderBy("sent_idx", "sentence_id"))
    return sentences(spark, d, "art", "sent_idx").select("sentence_id", F.concat("art", F.lit("-"), F.format_string("%03d", n)).alias("new_id"))


@query("q_rejoin", f"{WITH}, t as (select *, regexp_matches(text, '^\\s*[-–—]\\s*\\p{{Ll}}') as attr, row_number() over w as r from s where text is not null window w as (partition by art order by sentence_id)), u as (select *, sum(case when not attr or r = 1 then 1 else 0 end) over (partition by art order by sentence_id) as unit from t) select art, unit::bigint as unit, string_agg(text, ' ' order by sentence_id) as text from u group by all")
def q_rejoin(spark, d):
    s = sentences(spark, d, "art", "text").filter("text is not null")
    return W.glue_attributions(s, "art", "sentence_id", "text", X.is_attribution("text"))


@query("q_truncate", f"{WITH}, f as (select art, min(sent_idx) filter (regexp_matches(lower(text), '^(podelite|pratite|komentari|foto:)') and sent_idx >= n_clean // 2) as cut from s group by art) select sentence_id from s join f using (art) where cut is null or sent_idx < cut")
def q_truncate(spark, d):
    from gradja.operators.cleaning import cut_at_first

    s = sentences(spark, d, "art", "sent_idx", "n_clean", "text")
    return cut_at_first(s, "art", "sent_idx", "n_clean", F.lower("text").rlike("^(podelite|pratite|komentari|foto:)")).select("sentence_id")


@query("q_batches", f"{WITH} select sentence_id, (row_number() over (order by sentence_id) - 1) // 15 as batch from s")
def q_batches(spark, d):
    return W.batches(sentences(spark, d, "art"), ["sentence_id"], 15).select("sentence_id", "batch")


@query("q_topk", f"{WITH}, c as (select source, category, count(*) as n from s group by all) select source, category, n, row_number() over (partition by source order by n desc, category) as rank from c qualify rank <= 5")
def q_topk(spark, d):
    c = sentences(spark, d, "source", "category").groupBy("source", "category").agg(F.count("*").alias("n"))
    return W.top_k(c, ["source"], [F.desc("n"), "category"], 5)


@query("q_argmax", f"{WITH}, {PREDS}, c as (select model, lang, shots, avg((pred = label)::int) as acc from s join p using (sentence_id) where label in ('OBJ', 'SUBJ') group by all) select model, arg_max(lang || '-' || shots, (acc, lang || '-' || shots)) as best, round(max(acc), 9) as acc from c group by model")
def q_argmax(spark, d):
    s = sentences(spark, d, "label").filter("label in ('OBJ', 'SUBJ')")
    acc = predictions(spark, d).join(s, "sentence_id").groupBy("model", F.concat_ws("-", "lang", "shots").alias("cfg")).agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("acc"))
    return acc.groupBy("model").agg(F.max_by("cfg", F.struct("acc", "cfg")).alias("best"), F.round(F.max("acc"), 9).alias("acc"))


@query("q_config_order", "select distinct model, lang, shots, list_position(['model-b', 'model-a'], model) as place from llm_preds")
def q_config_order(spark, d):
    return read(spark, d, "llm_preds", "model", "lang", "shots").distinct().withColumn("place", F.array_position(F.array(F.lit("model-b"), F.lit("model-a")), F.col("model")))


@query("q_months", "select strftime(m, '%Y-%m') as month from (select unnest(generate_series(date '2025-10-01', date '2026-03-01', interval 1 month)) as m)")
def q_months(spark, d):
    return spark.range(1).select(F.explode(F.expr("sequence(date '2025-10-01', date '2026-03-01', interval 1 month)")).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))


@query("q_annotator_split", f"{WITH} select art, ['A', 'B', 'C'][(row_number() over (partition by source, genre order by md5('3:' || art), art) - 1) % 3 + 1] as annotator from (select art, min(source) as source, min(genre) as genre from s group by art)")
def q_annotator_split(spark, d):
    from pyspark.sql import Window

    a = sentences(spark, d, "art", "source", "genre").groupBy("art").agg(F.min("source").alias("source"), F.min("genre").alias("genre"))
    r = F.row_number().over(Window.partitionBy("source", "genre").orderBy(W.seeded(3, "art"), "art")) - 1
    return a.select("art", F.get(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (r % 3).cast("int")).alias("annotator"))


@query("q_calibration", f"{WITH}, x as (select s.* from s where genre is not null and sentence_id not in (select sentence_id from annotation where sentence_id is not null)), c as (select source, genre, count(*) as n from x group by all), q as (select *, n * 60 // sum(n) over () as b, n * 60 % sum(n) over () as m from c), z as (select source, genre, b + (row_number() over (order by m desc, source, genre) <= 60 - sum(b) over ())::int as quota from q), h as (select *, row_number() over (partition by art order by md5('11:' || sentence_id), sentence_id) as ra from x) select sentence_id from h join z using (source, genre) where ra = 1 qualify row_number() over (partition by source, genre order by md5('11:' || sentence_id), sentence_id) <= any_value(quota) over (partition by source, genre)")
def q_calibration(spark, d):
    x = sentences(spark, d, "art", "source", "genre").filter("genre is not null").join(read(spark, d, "annotation", "sentence_id"), "sentence_id", "left_anti")
    z = W.largest_remainder(x.groupBy("source", "genre").agg(F.count("*").alias("n")), "n", 60, ["source", "genre"]).select("source", "genre", "quota")
    return W.sample_few_per(x.join(F.broadcast(z), ["source", "genre"]), "art", ["source", "genre"], "sentence_id", 1, F.col("quota"), 11).select("sentence_id")  # z: a row a cell
