"""Queries: scalar text, address, hash and reply functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradja.functions import text as X
from gradja.operators import addresses as A
from gradja.plans.base import INVENTORY, SENTENCES, WITH, inventory, query, read, sentences
from gradja.plans.relational import _NORM

_DOCS = "select doc_id, text from documents where text is not null"


def _docs(spark, d):
    return read(spark, d, "documents", "doc_id", "text").filter("text is not null")


@query("q_norm", f"{WITH} select sentence_id, {_NORM} as norm from s where text is not null")
def q_norm(spark, d):
    return sentences(spark, d, "text").filter("text is not null").select("sentence_id", X.norm_expr("text").alias("norm"))


_P = chr(0xE000)
_B = chr(0xE001)
_STOPPED = f"'(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(X.ABBREVIATIONS)})\\.', '\\1\\2{_P}', 'g'"
#: Sentences as the queries below take them, in SQL: full stops of abbreviations are held back, twice since neighbours share a space.
_SPLIT = f"""t as (select sentence_id, trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')) as x from s where text is not null),
    u as (select sentence_id, regexp_replace(regexp_replace(regexp_replace(x, {_STOPPED}), {_STOPPED}), '([.!?…])["»”'')\\]]* +', '\\1{_B}', 'g') as x from t),
    v as (select sentence_id, list_filter(list_transform(string_split(x, '{_B}'), lambda y: trim(replace(y, '{_P}', '.'))), lambda y: length(y) > 1) as parts from u)"""


@query("q_split", f"{WITH}, {_SPLIT} select sentence_id, unnest(parts) as sentence, generate_subscripts(parts, 1) - 1 as pos from v")
def q_split(spark, d):
    s = sentences(spark, d, "text").filter("text is not null")
    return s.select("sentence_id", F.posexplode(X.split_sentences("text")).alias("pos", "sentence"))


_LEAD = "regexp_replace(x, '^[\\s\\p{Z}]+', '')"
_FRAG = f"({_LEAD} = '' or regexp_matches({_LEAD}, '^[(),;:]') or regexp_matches({_LEAD}, '^[„«\"''“” –—-]*\\p{{Ll}}') or length(regexp_replace({_LEAD}, '[^\\p{{L}}]', '', 'g')) * 2 < length({_LEAD}))"


@query("q_fragment", f"{WITH} select sentence_id, {_FRAG.replace('(x,', '(text,')} as fragment from s where text is not null")
def q_fragment(spark, d):
    return sentences(spark, d, "text").filter("text is not null").select("sentence_id", X.is_fragment("text").alias("fragment"))


_TOK = "len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> ''))"


@query("q_keep_rule", f"{WITH} select sentence_id, {_TOK} between 5 and 50 and regexp_matches(text, '[.?!\"”’)]$') as kept from s where text is not null")
def q_keep_rule(spark, d):
    return sentences(spark, d, "text").filter("text is not null").select("sentence_id", X.keeps("text").alias("kept"))


_SENT = "len(list_filter(regexp_split_to_array(trim(sentence), '\\s+'), lambda x: x <> ''))"


@query(
    "q_clean",
    f"{WITH}, {_SPLIT}, w as (select sentence_id, unnest(parts) as sentence, generate_subscripts(parts, 1) - 1 as pos from v) select sentence_id, pos, sentence from w "
    f"where not regexp_matches(sentence, '(?i){X.BOILERPLATE}') and not regexp_matches(sentence, '(?i){X.DATELINE}') and {_SENT} >= 4 and regexp_matches(sentence, '[A-Za-zА-Яа-яЂ-џ]')",
)
def q_clean(spark, d):
    s = sentences(spark, d, "text").filter("text is not null").select("sentence_id", F.posexplode(X.split_sentences("text")).alias("pos", "sentence"))
    return s.filter(X.is_clean("sentence"))


_ORPHAN = "case when regexp_matches(x, '^\\s*[„“\"] ') then rtrim(ltrim(x, '„“”\"'' ')) else x end"


@query(
    "q_clean_articles",
    f"""{WITH}, r as (select sentence_id, art, text as x, row_number() over (partition by art order by sentence_id) - 1 as i, count(*) over (partition by art) as n from s where text is not null),
    b as (select x from r where length(x) >= 30 group by x having count(distinct art) >= 3), f as (select r.*, b.x is not null or regexp_matches(r.x, '(?i){X.CHROME}') as furniture from r left join b on b.x = r.x),
    c as (select art, min(i) filter (furniture and i >= n // 2) as cut from f group by art), k as (select sentence_id, {_ORPHAN} as x from f join c using (art) where not furniture and (cut is null or i < cut))
    select sentence_id, x as text from k where not regexp_matches(x, '(?i){X.CHROME}') and not regexp_matches(x, '(?i){X.EMBED}') and not {_FRAG}
    and len(list_filter(regexp_split_to_array(trim(x), '\\s+'), lambda y: y <> '')) between 5 and 50 and regexp_matches(x, '[.?!"”’)]$')""",
)
def q_clean_articles(spark, d):
    from gradja.operators.cleaning import clean_articles

    return clean_articles(sentences(spark, d, "art", "text").filter("text is not null"), "art", "sentence_id", "text").select("sentence_id", "text")


_BARE = "regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '')"


@query("q_url_parts", f"with {INVENTORY} select distinct url, regexp_extract(trim(url), '^https?://(?:www\\.)?([^/?#]+)', 1) as host, {_BARE} as address, string_split({_BARE}, '/')[-1] as last from i where url is not null")
def q_url_parts(spark, d):
    i = inventory(spark, d).filter("url is not null").select("url").distinct()
    return i.select("url", A.host_of("url").alias("host"), A.bare_address("url").alias("address"), A.last_segment("url").alias("last"))


@query("q_slug", f"with {INVENTORY} select distinct url, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(string_split({_BARE}, '/')[-1]), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'article') as slug, regexp_extract({_BARE}, '-([0-9]+)$', 1) as number from i where url is not null")
def q_slug(spark, d):
    i = inventory(spark, d).filter("url is not null").select("url").distinct()
    return i.select("url", A.slugify("url").alias("slug"), A.number_at_end("url").alias("number"))


@query("q_sha_id", f"with {INVENTORY} select distinct url, (('0x' || substr(sha1(url), 1, 10))::bigint)::varchar as id from i where url is not null")
def q_sha_id(spark, d):
    return inventory(spark, d).filter("url is not null").select("url").distinct().select("url", A.hash_id(F.col("url")).alias("id"))


@query("q_base36")
def q_base36(spark, d):
    return inventory(spark, d).filter("article_id is not null").select("article_id").distinct().select("article_id", A.base36_id(F.lower("article_id")).alias("id"))


@query("q_title", f"with {INVENTORY}, t as (select distinct replace(string_split({_BARE}, '/')[-1], '-', ' ') as x from i where url is not null) select upper(x[1]) || lower(x[2:]) as title from t")
def q_title(spark, d):
    i = inventory(spark, d).filter("url is not null").select(A.last_segment("url").alias("x")).distinct()
    return i.select(A.title_of(F.col("x")).alias("title"))


@query("q_strip_tags", "select doc_id, regexp_replace('<p>' || text || '</p>', '<[^>]+>', '', 'g') as text from documents where text is not null")
def q_strip_tags(spark, d):
    t = _docs(spark, d).withColumn("text", F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")))
    return t.select("doc_id", X.strip_tags("text").alias("text"))


@query("q_script_path", f"with {INVENTORY} select distinct url, case when instr(url, '/sport/') > 0 then substr(url, 1, instr(url, '/sport/') - 1) || '/s/' || substr(url, instr(url, '/sport/') + 7) else url end as path from i where url is not null")
def q_script_path(spark, d):
    i = inventory(spark, d).filter("url is not null").select("url").distinct()
    return i.select("url", A.script_path("url", "/sport/", "/s/").alias("path"))


@query("q_cache_key", f"with {INVENTORY} select distinct url, substr(regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 150) as k from i where url is not null")
def q_cache_key(spark, d):
    i = inventory(spark, d).filter("url is not null").select("url").distinct()
    return i.select("url", A.cache_key(F.col("url")).alias("k"))


@query("q_tokens", "select doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) as n from documents where text is not null")
def q_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.size(X.word_tokens("text")).alias("n"))


@query("q_batch_key", f"{WITH} select art, substr(sha1(string_agg(text, chr(10) order by sentence_id)), 1, 16) as k from s where text is not null group by art")
def q_batch_key(spark, d):
    s = sentences(spark, d, "art", "text").filter("text is not null").groupBy("art").agg(F.transform(F.sort_array(F.collect_list(F.struct("sentence_id", "text"))), lambda x: x["text"]).alias("l"))
    return s.select("art", X.batch_key(F.col("l")).alias("k"))


_REPLY = "'```json {\"1\": \"' || lower(coalesce(trim(label), 'x')) || '\"} ```'"


@query("q_parse_reply", f"select sentence_id, annotator, count(*) as n, max(case when upper(trim(label)) in ('OBJ', 'SUBJ') then upper(trim(label)) end) as label from annotation group by all")
def q_parse_reply(spark, d):
    raw = F.concat(F.lit('```json {"1": "'), F.lower(F.coalesce(F.trim("label"), F.lit("x"))), F.lit('"} ```'))
    a = read(spark, d, "annotation", "sentence_id", "annotator", "label").withColumn("raw", raw)
    return a.groupBy("sentence_id", "annotator").agg(F.count("*").alias("n"), F.max(F.get(X.parse_reply("raw", F.lit(1)), F.lit(0))).alias("label"))


_MSG = "case sent_idx % 4 when 0 then 'try again in ' || sent_idx || '.5s' when 1 then 'HTTP 429' when 2 then 'Quota exceeded' else 'timeout' end"


@query("q_backoff", f"{WITH} select sentence_id, (case sent_idx % 4 when 0 then least(sent_idx + 1.5, 60) when 3 then least(2 * (sent_idx % 7 + 1), 30) else least(5 * 2 ** (sent_idx % 7), 60) end)::double as wait from s")
def q_backoff(spark, d):
    msg = F.expr("case sent_idx % 4 when 0 then concat('try again in ', sent_idx, '.5s') when 1 then 'HTTP 429' when 2 then 'Quota exceeded' else 'timeout' end")
    s = sentences(spark, d, "sent_idx").withColumn("msg", msg)
    return s.select("sentence_id", X.backoff("msg", F.col("sent_idx") % 7 + 1).alias("wait"))


@query("q_prompt", f"{WITH}, g as (select art, list(text order by sentence_id) as l from s where text is not null group by art) select art, 'Oznaci.' || chr(10) || '1. Dan. -> OBJ' || chr(10) || chr(10) || array_to_string(list_transform(l, lambda x, i: i || '. ' || x), chr(10)) as prompt from g")
def q_prompt(spark, d):
    s = sentences(spark, d, "art", "text").filter("text is not null").groupBy("art").agg(F.transform(F.sort_array(F.collect_list(F.struct("sentence_id", "text"))), lambda x: x["text"]).alias("l"))
    return s.select("art", X.prompt("Oznaci.", [("Dan.", "OBJ")], F.col("l")).alias("prompt"))


_TAIL = "regexp_replace(text, '[\\s\\p{Z}]+$', '')"


@query("q_mark", f"{WITH} select sentence_id, case when coalesce(in_quote, '') = 'Y' and {_TAIL} <> '' and left({_TAIL}, 1) not in ('„', '«') then '„' || {_TAIL} || case when right({_TAIL}, 1) in ('“', '”', 'ˮ', '»', '\"') then '' else '“' end else text end as text from s")
def q_mark(spark, d):
    s = sentences(spark, d, "text", "in_quote")
    return s.select("sentence_id", X.marked("text", F.coalesce("in_quote", F.lit("")) == "Y").alias("text"))


@query("q_member_stem", f"{WITH} select sentence_id, regexp_extract(member, '([^/]+?)\\.[^.]*$', 1) as stem from s")
def q_member_stem(spark, d):
    return sentences(spark, d, "member").select("sentence_id", F.regexp_extract("member", r"([^/]+?)\.[^.]*$", 1).alias("stem"))


@query("q_percent", f"{WITH} select source, printf('%.1f%%', round(100.0 * count(*) / (select count(*) from s), 1)) as share from s group by source")
def q_percent(spark, d):
    n = sentences(spark, d, "source").groupBy("source").agg(F.count("*").alias("n"))
    all_rows = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(all_rows)).select("source", F.format_string("%.1f%%", F.round(F.lit(100.0) * F.col("n") / F.col("t"), 1)).alias("share"))  # one row


_FROM, _TO = X.ONE_LETTER


@query("q_cyr_lat", f"{WITH} select sentence_id, " + "".join("replace(" for _ in X.TWO_LETTERS) + f"translate(text, '{_FROM}', '{_TO}')" + "".join(f", '{k}', '{v}')" for k, v in X.TWO_LETTERS.items()) + " as text from s where text is not null")
def q_cyr_lat(spark, d):
    return sentences(spark, d, "text").filter("text is not null").select("sentence_id", X.cyrillic_to_latin("text").alias("text"))
