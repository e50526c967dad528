"""Queries: validation, filters, joins, set operations, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradja.operators import relational as R
from gradja.plans.base import ANNOTATIONS, INVENTORY, PREDS, SENTENCES, WITH, annotations, inventory, predictions, query, read, sentences

#: Most rows that an article should have.
MOST_ROWS = 8
SOURCES = ("blic", "danas", "n1info", "politika", "rts", "vreme")


@query(
    "q_validate",
    """
select sentence_id, code, count(*) as n from (
  select sentence_id, unnest(list_filter([
    case when not regexp_matches(sentence_id, '^[a-z0-9]{3}-[0-9]+-[0-9]{3}$') then 'id_grammar' end,
    case when not starts_with(lower(trim(source)), split_part(sentence_id, '-', 1)) then 'source_prefix' end,
    case when article_id <> split_part(sentence_id, '-', 2) then 'article_id' end,
    case when sent_idx <> try_cast(split_part(sentence_id, '-', 3) as int) then 'sent_idx' end,
    case when genre not in ('kolumna', 'vest') then 'genre' end,
    case when topic is null or topic not in ('pol-drustvo', 'svet', 'ekonomija', 'kultura', 'sport', 'hronika') then 'topic' end,
    case when text is null or trim(text) = '' then 'empty_text' end,
    case when contains(text, chr(9)) then 'tab' end,
    case when url is null or not starts_with(url, 'http') then 'url' end], lambda x: x is not null)) as code from corpus
  union all select sentence_id, 'duplicate' from corpus group by sentence_id having count(*) > 1
) group by all""",
)
def q_validate(spark, d):
    c = read(spark, d, "corpus", "sentence_id", "source", "article_id", "genre", "topic", "sent_idx", "url", "text")
    part = lambda i: F.split_part("sentence_id", F.lit("-"), F.lit(i))
    rules = {
        "id_grammar": ~F.col("sentence_id").rlike(r"^[a-z0-9]{3}-[0-9]+-[0-9]{3}$"),
        "source_prefix": ~F.startswith(F.lower(F.trim("source")), part(1)),
        "article_id": F.col("article_id") != part(2),
        "sent_idx": F.col("sent_idx") != F.expr("try_cast(split_part(sentence_id, '-', 3) as int)"),
        "genre": ~F.col("genre").isin("kolumna", "vest"),
        "topic": F.col("topic").isNull() | ~F.col("topic").isin("pol-drustvo", "svet", "ekonomija", "kultura", "sport", "hronika"),
        "empty_text": F.col("text").isNull() | (F.trim("text") == ""),
        "tab": F.contains("text", F.lit("\t")),
        "url": F.col("url").isNull() | ~F.startswith("url", F.lit("http")),
    }
    twice = R.repeated_keys(c.select("sentence_id"), "sentence_id").select("sentence_id", F.lit("duplicate").alias("code"))
    return R.violations(c, "sentence_id", rules).union(twice).groupBy("sentence_id", "code").agg(F.count("*").alias("n"))


@query("q_article_rows", f"{WITH} select art, count(*) as n from s group by art having count(*) > {MOST_ROWS}")
def q_article_rows(spark, d):
    return R.repeated_keys(sentences(spark, d, "art"), "art", least=MOST_ROWS + 1)


@query("q_repair_genre", "select sentence_id, min(split_part(trim(genre), ' ', 1)) as genre, min(split_part(trim(genre), ' ', 2)) as topic from corpus where trim(genre) like '% %' group by sentence_id")
def q_repair_genre(spark, d):
    from gradja.operators.cleaning import repair_merged

    c = read(spark, d, "corpus", "sentence_id", "genre", "topic").filter("trim(genre) like '% %'")
    return repair_merged(c, "genre", "topic").groupBy("sentence_id").agg(F.min("genre").alias("genre"), F.min("topic").alias("topic"))


@query("q_domain", f"{WITH} select genre, count(*) as n from s where genre not in ('kolumna', 'vest') group by genre")
def q_domain(spark, d):
    return sentences(spark, d, "genre").filter(~F.col("genre").isin("kolumna", "vest")).groupBy("genre").agg(F.count("*").alias("n"))


@query("q_valid_labels", "select model, lang, shots, count(*) filter (upper(trim(pred)) in ('OBJ', 'SUBJ')) as valid, count(*) filter (upper(trim(pred)) not in ('OBJ', 'SUBJ')) as dropped from llm_preds group by all")
def q_valid_labels(spark, d):
    ok = F.upper(F.trim("pred")).isin("OBJ", "SUBJ")
    return read(spark, d, "llm_preds", "pred", "model", "lang", "shots").groupBy("model", "lang", "shots").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("dropped"))


@query("q_coalesce_text", f"{WITH} select sentence_id, coalesce(nullif(text_marked, ''), text) as text from s")
def q_coalesce_text(spark, d):
    return sentences(spark, d, "text", "text_marked").select("sentence_id", F.expr("coalesce(nullif(text_marked, ''), text)").alias("text"))


@query(
    "q_predicates",
    f"""{WITH} select sentence_id, coalesce(in_quote, '') = 'Y' as quoted, ends_with(rtrim(text), '?') as question,
    regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(naravno|dakle|uostalom|naime|zapravo|inače)($|[^\\p{{L}}\\p{{N}}_])') as connector from s""",
)
def q_predicates(spark, d):
    from gradja.functions.text import has_connector, is_question

    s = sentences(spark, d, "text", "in_quote")
    return s.select("sentence_id", (F.coalesce("in_quote", F.lit("")) == "Y").alias("quoted"), is_question("text").alias("question"), has_connector("text").alias("connector"))


@query("q_since", f"with {INVENTORY} select source, article_id, count(*) as n from i where date >= '2026-01-10' group by all")
def q_since(spark, d):
    return inventory(spark, d).filter(F.col("date") >= "2026-01-10").groupBy("source", "article_id").agg(F.count("*").alias("n"))


_SECTIONS = "sec as (select source, category, min(topic) as topic, count(*) as n from i where category is not null group by all)"


@query(
    "q_section_lookup",
    f"""with {INVENTORY}, {_SECTIONS}, u as (select distinct source, article_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)/[^/]*$', 1) as path from i where url is not null)
    select u.source, u.article_id, u.path, sec.category, sec.topic from u join sec on sec.source = u.source and (u.path = sec.category or starts_with(u.path, sec.category || '/'))
    qualify row_number() over (partition by u.source, u.article_id, u.path order by length(sec.category) desc, sec.category) = 1""",
)
def q_section_lookup(spark, d):
    from gradja.operators.addresses import longest_section

    i = inventory(spark, d)
    sec = i.filter("category is not null").groupBy("source", "category").agg(F.min("topic").alias("topic"), F.count("*").alias("n"))
    u = i.filter("url is not null").select("source", "article_id", F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)/[^/]*$", 1).alias("path")).distinct()
    return longest_section(u, sec, "path", "category", ["source"], ["source", "article_id"]).select("source", "article_id", "path", "category", "topic")


@query("q_slug_override", f"with {INVENTORY} select source, article_id, min(case when regexp_matches(url, '/(kolumne|stav|pogledi|komentar|autori)/') then 'kolumna' else genre end) as genre from i group by source, article_id")
def q_slug_override(spark, d):
    i = inventory(spark, d)
    genre = F.when(F.col("url").rlike("/(kolumne|stav|pogledi|komentar|autori)/"), "kolumna").otherwise(F.col("genre"))
    return i.groupBy("source", "article_id").agg(F.min(genre).alias("genre"))


@query("q_first_known", f"with {INVENTORY} select source, article_id, min(coalesce(list_filter(string_split(category, '-'), lambda x: x in ('sport', 'film', 'berza', 'svet', 'politika'))[1], 'ostalo')) as known from i group by source, article_id")
def q_first_known(spark, d):
    known = F.filter(F.split("category", "-"), lambda x: x.isin("sport", "film", "berza", "svet", "politika"))
    return inventory(spark, d).groupBy("source", "article_id").agg(F.min(F.coalesce(F.get(known, F.lit(0)), F.lit("ostalo"))).alias("known"))


@query("q_links", "select distinct regexp_extract(trim(a), '^https?://(?:www\\.)?([^/]+)', 1) as host, regexp_replace(regexp_replace(trim(a), '[?#].*$', ''), '/+$', '') as address from (select unnest([article_a, article_b]) as a from article_links) where trim(a) like 'http%'")
def q_links(spark, d):
    from gradja.operators.addresses import bare_address, host_of

    a = read(spark, d, "article_links", "article_a", "article_b").select(F.explode(F.array("article_a", "article_b")).alias("a")).filter("trim(a) like 'http%'")
    return a.select(host_of("a").alias("host"), bare_address("a").alias("address")).distinct()


_GOLD = "g as (select sentence_id, max(upper(trim(dogovoreno))) as gold from usaglaseno where upper(trim(dogovoreno)) in ('OBJ', 'SUBJ') group by sentence_id)"


def gold(spark, d):
    """usaglaseno with one valid label a sentence."""
    u = read(spark, d, "usaglaseno", "sentence_id", "dogovoreno").select("sentence_id", F.upper(F.trim("dogovoreno")).alias("gold")).filter("gold in ('OBJ', 'SUBJ')")
    return u.groupBy("sentence_id").agg(F.max("gold").alias("gold"))


@query("q_gold_join", f"{WITH}, {PREDS} select s.sentence_id, s.label as gold, model, lang, shots, pred from s join p using (sentence_id) where s.label in ('OBJ', 'SUBJ') and pred in ('OBJ', 'SUBJ')")
def q_gold_join(spark, d):
    s = sentences(spark, d, "label").filter("label in ('OBJ', 'SUBJ')").withColumnRenamed("label", "gold")
    return s.join(predictions(spark, d).filter("pred in ('OBJ', 'SUBJ')"), "sentence_id").select("sentence_id", "gold", "model", "lang", "shots", "pred")


@query("q_multi_rater", f"with {ANNOTATIONS} select x.sentence_id, x.label as A, y.label as B, z.label as C from a x join a y using (sentence_id) join a z using (sentence_id) where x.annotator = 'A' and y.annotator = 'B' and z.annotator = 'C'")
def q_multi_rater(spark, d):
    return R.aligned(annotations(spark, d), "sentence_id", "annotator", "label", ["A", "B", "C"])


@query("q_left_default", f"{WITH}, k as (select sentence_id, max(pravilo) as pravilo from usaglaseno group by 1) select s.sentence_id, coalesce(pravilo, '') as pravilo from s left join k using (sentence_id)")
def q_left_default(spark, d):
    u = read(spark, d, "usaglaseno", "sentence_id", "pravilo").groupBy("sentence_id").agg(F.max("pravilo").alias("pravilo"))
    return sentences(spark, d, "art").join(u, "sentence_id", "left").select("sentence_id", F.coalesce("pravilo", F.lit("")).alias("pravilo"))


@query("q_unseen", "select distinct sentence_id from corpus where sentence_id is not null and sentence_id not in (select sentence_id from annotation where sentence_id is not null)")
def q_unseen(spark, d):
    return read(spark, d, "corpus", "sentence_id").distinct().join(read(spark, d, "annotation", "sentence_id"), "sentence_id", "left_anti").filter("sentence_id is not null")


_KEYS = "c as (select distinct split_part(sentence_id, '-', 2) as article_id from corpus), v as (select distinct trim(article_id) as article_id from inventory where article_id is not null)"


@query("q_coverage", f"with {_KEYS} select article_id, 'missing' as side from v where article_id not in (select article_id from c) union all select article_id, 'excess' from c where article_id not in (select article_id from v)")
def q_coverage(spark, d):
    c = read(spark, d, "corpus", "sentence_id").select(F.split_part("sentence_id", F.lit("-"), F.lit(2)).alias("article_id"))
    return R.coverage(inventory(spark, d).filter("article_id is not null"), c, "article_id")


@query("q_neighbours", f"{WITH} select s.sentence_id, s.sent_idx, coalesce(b.text, '') as before, coalesce(n.text, '') as after from s left join s b on b.art = s.art and b.sent_idx = s.sent_idx - 1 left join s n on n.art = s.art and n.sent_idx = s.sent_idx + 1")
def q_neighbours(spark, d):
    s = sentences(spark, d, "art", "sent_idx", "text")
    return R.with_neighbours(s, "art", "sent_idx", "text").select("sentence_id", "sent_idx", "before", "after")


@query(
    "q_contains_join",
    f"with {INVENTORY}, t as (select distinct lower(split_part(title, ' ', 1)) as w from i where length(split_part(title, ' ', 1)) > 0), k as (select distinct category as k from i where length(category) > 0) select w, k from t join k on contains(w, k) or contains(k, w)",
)
def q_contains_join(spark, d):
    i = inventory(spark, d)
    w = i.select(F.lower(F.split_part("title", F.lit(" "), F.lit(1))).alias("w"))
    return R.contains_either_way(w, i.select(F.col("category").alias("k")), "w", "k")


@query(
    "q_context_join",
    f"{WITH}, {INVENTORY}, t as (select source || '/' || article_id as k, min(title) as title, count(distinct title) as n from i group by 1), r as (select source || '/' || split_part(sentence_id, '-', 2) as k, count(*) as rows from s group by 1) select r.k, rows, coalesce(title, '') as title, coalesce(n, 0) > 1 as clash, t.k is null as missing from r left join t using (k)",
)
def q_context_join(spark, d):
    i = inventory(spark, d).groupBy(F.concat_ws("/", "source", "article_id").alias("k")).agg(F.min("title").alias("title"), F.count_distinct("title").alias("n"), F.lit(True).alias("there"))
    s = sentences(spark, d, "source", "art").groupBy(F.concat(F.col("source"), F.lit("/"), F.split_part("sentence_id", F.lit("-"), F.lit(2))).alias("k")).agg(F.count("*").alias("rows"))
    return s.join(i, "k", "left").select("k", "rows", F.coalesce("title", F.lit("")).alias("title"), (F.coalesce("n", F.lit(0)) > 1).alias("clash"), F.col("there").isNull().alias("missing"))


@query("q_grid", "select lang, shots, model from (select distinct lang from llm_preds), (select distinct shots from llm_preds), (select distinct model from llm_preds)")
def q_grid(spark, d):
    from gradja.operators.grids import grid

    p = read(spark, d, "llm_preds", "lang", "shots", "model")
    return grid(p, "lang", "shots", "model")


@query(
    "q_todo",
    "select sentence_id, lang, shots, model from (select distinct sentence_id from llm_preds), (select distinct lang, shots, model from llm_preds) except select sentence_id, lang, shots, model from llm_preds where pred in ('OBJ', 'SUBJ')",
)
def q_todo(spark, d):
    from gradja.operators.grids import todo

    p = read(spark, d, "llm_preds", "sentence_id", "lang", "shots", "model", "pred")
    return todo(p.select("sentence_id").distinct(), p.select("lang", "shots", "model").distinct(), p.filter("pred in ('OBJ', 'SUBJ')"), ["sentence_id", "lang", "shots", "model"])


@query("q_union_member", "select 'annotation' as member, sentence_id, label, annotator, null as pravilo from annotation union all select 'usaglaseno', sentence_id, dogovoreno, null, pravilo from usaglaseno")
def q_union_member(spark, d):
    a = read(spark, d, "annotation", "sentence_id", "label", "annotator")
    u = read(spark, d, "usaglaseno", "sentence_id", F.col("dogovoreno").alias("label"), "pravilo")
    return R.union_members({"annotation": a, "usaglaseno": u})


_NORM = "trim(regexp_replace(regexp_replace(translate(lower(text), 'čćšž', 'ccsz'), '\\s+', ' ', 'g'), '[^\\p{L}\\p{N}_\\s]', '', 'g'))"


@query("q_exact_dedup", f"{WITH}, n as (select sentence_id, {_NORM} as norm from s where text is not null), f as (select norm, min(sentence_id) as kept from n group by norm) select kept, sentence_id as dropped from n join f using (norm) where sentence_id > kept")
def q_exact_dedup(spark, d):
    from gradja.functions.text import norm_expr

    s = sentences(spark, d, "text").filter("text is not null").select("sentence_id", norm_expr("text").alias("norm"))
    return R.exact_duplicates(s, "sentence_id", "norm")


_FIRST = f"""with {INVENTORY}, o as (select source, article_id, min(coalesce(title, '')) as title, min(coalesce("date", '')) as date from i where collected_at < timestamp '2026-01-15' group by 1, 2),
w as (select source, article_id, min(coalesce(title, '')) as title, min(coalesce(date, '')) as date from i where collected_at >= timestamp '2026-01-10' group by 1, 2)"""


def _halves(spark, d):
    i = inventory(spark, d)
    fold = lambda x: x.groupBy("source", "article_id").agg(F.min(F.coalesce("title", F.lit(""))).alias("title"), F.min(F.coalesce("date", F.lit(""))).alias("date"))
    return fold(i.filter("collected_at < timestamp '2026-01-15'")), fold(i.filter("collected_at >= timestamp '2026-01-10'"))


@query("q_upsert", f"{_FIRST} select * from o union all select w.* from w anti join o using (source, article_id)")
def q_upsert(spark, d):
    return R.upsert(*_halves(spark, d), ["source", "article_id"])


@query("q_upsert_backfill", f"{_FIRST} select o.source, o.article_id, o.title, coalesce(nullif(o.date, ''), w.date) as date from o left join w using (source, article_id) union all select w.* from w anti join o using (source, article_id)")
def q_upsert_backfill(spark, d):
    return R.upsert_backfill(*_halves(spark, d), ["source", "article_id"], "date")


@query("q_last_wins", f"with {INVENTORY} select source, article_id, arg_max(coalesce(title, ''), (collected_at, coalesce(title, ''), coalesce(url, ''))) as title from i where collected_at is not null group by all")
def q_last_wins(spark, d):
    i = inventory(spark, d).filter("collected_at is not null").select("source", "article_id", "collected_at", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"))
    return R.last_wins(i, ["source", "article_id"], ["collected_at", "title", "url"]).select("source", "article_id", "title")


@query("q_first_doc_only", f"{WITH}, f as (select text, min(art) as first from s group by text) select sentence_id from s join f using (text) where art = first")
def q_first_doc_only(spark, d):
    return R.first_document_only(sentences(spark, d, "art", "text"), "text", "art").select("sentence_id")


@query("q_clashes", f"with {INVENTORY} select substr(sha1(url), 1, 3) as id, count(distinct url) as n from i where url is not null group by 1 having count(distinct url) > 1")
def q_clashes(spark, d):
    """Ids cut so short that some stand for several addresses; :func:`R.no_clashes` fails on such."""
    i = inventory(spark, d).filter("url is not null").select(F.substring(F.sha1("url"), 1, 3).alias("id"), "url").distinct()
    return R.repeated_keys(i, "id")


@query("q_equalize", f"{WITH}, r as (select sentence_id, source, row_number() over (partition by source order by sentence_id) as r from s) select sentence_id, source from r where r <= (select min(n) from (select count(*) as n from s group by source))")
def q_equalize(spark, d):
    return R.equalize(sentences(spark, d, "source"), "source", ["sentence_id"]).select("sentence_id", "source")


@query(
    "q_correctness_sets",
    f"""{WITH}, {PREDS}, m as (select p.sentence_id, max(case when model = 'model-a' then (pred = label)::int end) as a, max(case when model = 'model-b' then (pred = label)::int end) as b from p join s using (sentence_id) where label in ('OBJ', 'SUBJ') group by 1)
    select case when a + b = 2 then 'all' when a + b = 0 then 'none' when a = 1 then 'only_a' else 'only_b' end as kind, count(*) as n from m where a is not null and b is not null group by 1""",
)
def q_correctness_sets(spark, d):
    s = sentences(spark, d, "label").filter("label in ('OBJ', 'SUBJ')")
    p = predictions(spark, d).filter("model in ('model-a', 'model-b')").join(s, "sentence_id").withColumn("right", (F.col("pred") == F.col("label")).cast("int"))
    m = p.groupBy("sentence_id").pivot("model", ["model-a", "model-b"]).agg(F.max("right")).toDF("sentence_id", "a", "b").filter("a is not null and b is not null")
    kind = F.when(F.expr("a + b = 2"), "all").when(F.expr("a + b = 0"), "none").when(F.expr("a = 1"), "only_a").otherwise("only_b")
    return m.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    "q_label_precedence",
    f"""with {ANNOTATIONS}, {_GOLD}, {SENTENCES}, u as (select sentence_id, gold as label, 1 as prio, timestamp '1900-01-01' as o from g
    union all select sentence_id, label, 2, timestamp '1900-01-01' from a union all select sentence_id, label, 3, "at" from s where label in ('OBJ', 'SUBJ'))
    select sentence_id, arg_max(label, (-prio, coalesce(o, timestamp '1900-01-01'), label)) as label, min(prio) as prio from u group by 1""",
)
def q_label_precedence(spark, d):
    never = F.lit("1900-01-01").cast("timestamp")
    g = gold(spark, d).select("sentence_id", F.col("gold").alias("label"), never.alias("o"))
    a = annotations(spark, d).select("sentence_id", "label", never.alias("o"))
    s = sentences(spark, d, "label", "at").filter("label in ('OBJ', 'SUBJ')").select("sentence_id", "label", F.col("at").cast("timestamp").alias("o"))
    return R.resolve_labels([(1, g), (2, a), (3, s)], "sentence_id", "label", "o")


@query("q_first_rows", f"{WITH} select sentence_id, label from s where label is not null order by sentence_id limit 100")
def q_first_rows(spark, d):
    return R.first_rows(sentences(spark, d, "label").filter("label is not null"), ["sentence_id"], 100).select("sentence_id", "label")


@query("q_no_clashes", f"with {INVENTORY} select distinct source || '/' || article_id as k, source from i where article_id is not null and source is not null")
def q_no_clashes(spark, d):
    i = inventory(spark, d).filter("article_id is not null and source is not null").select(F.concat_ws("/", "source", "article_id").alias("k"), "source").distinct()
    return R.no_clashes(i, "k", "source")


_SHARE = "case when count(*) = 0 then '-' else printf('%.1f%%', round(100.0 * count(*) filter (label = 'SUBJ') / count(*), 1)) || ' (' || count(*) || ')' end"


@query(
    "q_gold_report",
    f"""{WITH}, g as (select * from s where label in ('OBJ', 'SUBJ')) select 'rows' as section, 'all' as metric, count(*)::varchar as value from s union all select 'rows', 'labelled', count(*)::varchar from g
    union all select 'missing', source, count(*)::varchar from s where label is null group by source union all select 'subjective by genre', genre, {_SHARE} from g where genre is not null group by genre
    union all select 'subjective by topic', topic, {_SHARE} from g where topic is not null group by topic union all select 'subjective in quotations', 'all', {_SHARE} from g where in_quote = 'Y'""",
)
def q_gold_report(spark, d):
    s = sentences(spark, d, "source", "genre", "topic", "in_quote", "label").persist()
    g = s.filter("label in ('OBJ', 'SUBJ')")
    share = F.format_string("%.1f%% (%d)", F.round(F.lit(100.0) * F.count_if(F.col("label") == "SUBJ") / F.count("*"), 1), F.count("*")).alias("value")
    by = lambda c: g.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("metric")).agg(share)
    quoted = g.filter("in_quote = 'Y'").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "SUBJ").alias("k"))
    quoted = quoted.select(F.lit("all").alias("metric"), F.when(F.col("n") == 0, "-").otherwise(F.format_string("%.1f%% (%d)", F.round(F.lit(100.0) * F.try_divide("k", "n"), 1), F.col("n"))).alias("value"))
    rows = s.agg(F.count("*").alias("value")).select(F.lit("all").alias("metric"), "value").union(g.agg(F.count("*").alias("value")).select(F.lit("labelled").alias("metric"), "value"))
    missing = s.filter("label is null").groupBy(F.col("source").alias("metric")).agg(F.count("*").alias("value"))
    return R.report({"rows": rows, "missing": missing, "subjective by genre": by("genre"), "subjective by topic": by("topic"), "subjective in quotations": quoted})
