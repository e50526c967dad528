"""Queries: agreement, scores, paired tests, system comparison, inference, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradja.functions import stats as E
from gradja.operators import results as RS
from gradja.plans.base import ANNOTATIONS, PREDS, WITH, annotations, predictions, query, read, sentences

_J = f"{WITH}, {PREDS}, j as (select s.sentence_id, genre, topic, source, coalesce(in_quote, '') = 'Y' as quoted, ends_with(rtrim(text), '?') as question, label as gold, model || '-' || lang || '-' || shots as config, model, pred from s join p using (sentence_id) where label in ('OBJ', 'SUBJ') and pred in ('OBJ', 'SUBJ'))"


def judged(spark, d):
    s = sentences(spark, d, "genre", "topic", "source", "in_quote", "text", "label").filter("label in ('OBJ', 'SUBJ')")
    s = s.select("sentence_id", "genre", "topic", "source", (F.coalesce("in_quote", F.lit("")) == "Y").alias("quoted"), F.endswith(F.rtrim("text"), F.lit("?")).alias("question"), F.col("label").alias("gold"))
    return s.join(predictions(spark, d).filter("pred in ('OBJ', 'SUBJ')"), "sentence_id")


_CNT = "count(*) as n, count(*) filter (gold = 'SUBJ' and pred = 'SUBJ') as tp, count(*) filter (gold = 'OBJ' and pred = 'SUBJ') as fp, count(*) filter (gold = 'SUBJ' and pred = 'OBJ') as fn, count(*) filter (gold = 'OBJ' and pred = 'OBJ') as tn"
_F = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"
_G = "coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0)"


@query("q_f1", f"{_J}, c as (select config, {_CNT} from j group by config) select config, n, round(coalesce(1.0 * tp / nullif(tp + fp, 0), 0), 9) as p_subj, round(coalesce(1.0 * tp / nullif(tp + fn, 0), 0), 9) as r_subj, round({_F}, 9) as f_subj, round({_G}, 9) as f_obj, round(({_F} + {_G}) / 2, 9) as macro, round(1.0 * (tp + tn) / n, 9) as acc from c")
def q_f1(spark, d):
    t = E.f1_table(judged(spark, d), "gold", "pred", ["config"])
    return t.select("config", "n", *(F.round(c, 9).alias(c) for c in ("p_subj", "r_subj", "f_subj", "f_obj", "macro", "acc")))


@query("q_fail_rate", f"with {PREDS} select model, lang, shots, round(avg((pred = 'PARSE_FAIL')::int), 9) as fail_rate, round(avg((pred = 'SUBJ')::int) filter (pred <> 'PARSE_FAIL'), 9) as subj from p group by all")
def q_fail_rate(spark, d):
    fail = F.col("pred") == "PARSE_FAIL"
    return predictions(spark, d).groupBy("model", "lang", "shots").agg(F.round(F.avg(fail.cast("double")), 9).alias("fail_rate"), F.round(F.avg(F.when(~fail, (F.col("pred") == "SUBJ").cast("double"))), 9).alias("subj"))


_KAPPA = """x as (select q.annotator as a, r.annotator as b, q.label as la, r.label as lb from a q join a r using (sentence_id) where q.annotator < r.annotator),
po as (select a, b, count(*) as n, avg((la = lb)::int) as po from x group by all), m as (select a, b, la as l, count(*) as k from x group by all), o as (select a, b, lb as l, count(*) as k from x group by all),
pe as (select m.a, m.b, sum(m.k * o.k) as e from m join o on m.a = o.a and m.b = o.b and m.l = o.l group by all),
kp as (select po.a, po.b, n, po, case when e / (n * n) = 1 then 1.0 else (po - coalesce(e, 0) / (n * n)) / (1 - coalesce(e, 0) / (n * n)) end as kappa from po left join pe on po.a = pe.a and po.b = pe.b)"""


@query("q_kappa", f"with {ANNOTATIONS}, {_KAPPA} select a, b, n, round(po, 9) as po, round(kappa, 9) as kappa from kp")
def q_kappa(spark, d):
    return E.kappa_pairs(annotations(spark, d), "sentence_id", "annotator", "label").select("a", "b", "n", F.round("po", 9).alias("po"), F.round("kappa", 9).alias("kappa"))


@query("q_mean_kappa", f"with {ANNOTATIONS}, {_KAPPA} select round(avg(kappa), 9) as kappa from kp")
def q_mean_kappa(spark, d):
    return E.kappa_pairs(annotations(spark, d), "sentence_id", "annotator", "label").agg(F.round(F.avg("kappa"), 9).alias("kappa"))


@query("q_fleiss", f"with {ANNOTATIONS}, c as (select sentence_id, label, count(*) as k from a group by all), m as (select *, sum(k) over (partition by sentence_id) as m from c), f as (select * from m where m = 3), i as (select sentence_id, (sum(k * k) - 3) / 6.0 as p from f group by 1), t as (select count(*) as n, avg(p) as po from i), e as (select sum(k * k) / (sum(k) ^ 2) as pe from (select label, sum(k) as k from f group by label)) select n, round(case when pe = 1 then 1 else (po - pe) / (1 - pe) end, 9) as kappa from t, e")
def q_fleiss(spark, d):
    return E.fleiss(annotations(spark, d), "sentence_id", "label", 3).select("n", F.round("kappa", 9).alias("kappa"))


@query("q_alpha", f"with {ANNOTATIONS}, v as (select *, count(*) over (partition by sentence_id) as m from a), o as (select x.label as c, y.label as k, sum(1.0::double / (x.m - 1)) as o from v x join v y using (sentence_id) where x.m > 1 and x.annotator <> y.annotator group by all), n as (select c, sum(o) as nc from o group by c), t as (select sum(nc) as n, sum(nc * nc) as sq from n), z as (select coalesce(sum(o) filter (c <> k), 0) as obs from o) select round(case when n * n - sq = 0 then 1 else 1 - obs / ((n * n - sq) / (n - 1)) end, 9) as alpha from t, z")
def q_alpha(spark, d):
    return E.alpha(annotations(spark, d), "sentence_id", "annotator", "label").select(F.round("alpha", 9).alias("alpha"))


_SUB = "unnest(list_filter([genre, topic, source, case when quoted then 'quoted' end, case when question then 'question' end], lambda x: x is not null)) as subset"


def _subsets():
    parts = F.array("genre", "topic", "source", F.when(F.col("quoted"), "quoted"), F.when(F.col("question"), "question"))
    return F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("subset")


@query("q_subsets", f"{_J}, u as (select {_SUB}, config, gold, pred from j), c as (select subset, config, {_CNT} from u group by all having count(*) >= 30) select subset, config, n, round(({_F} + {_G}) / 2, 9) as macro from c")
def q_subsets(spark, d):
    u = judged(spark, d).select(_subsets(), "config", "gold", "pred")
    return E.f1_table(u, "gold", "pred", ["subset", "config"]).filter("n >= 30").select("subset", "config", "n", F.round("macro", 9).alias("macro"))


_SUBS = "unnest(list_filter(['all', 'genre ' || genre, 'source ' || source, case when quoted then 'quoted' end, case when question then 'question' end, case when connector then 'connector' end], lambda x: x is not null)) as subset"


@query(
    "q_subset_kappa",
    f"""{WITH}, {ANNOTATIONS}, w as (select sentence_id from a group by 1 having count(*) = (select count(distinct annotator) from a)),
    j as (select sentence_id, annotator, a.label, genre, source, coalesce(in_quote, '') = 'Y' as quoted, ends_with(rtrim(text), '?') as question, regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(naravno|dakle|uostalom|naime|zapravo|inače)($|[^\\p{{L}}\\p{{N}}_])') as connector from a join w using (sentence_id) join s using (sentence_id)),
    u as (select sentence_id, annotator, label, {_SUBS} from j), x as (select q.subset, q.annotator as a, r.annotator as b, q.label as la, r.label as lb from u q join u r on q.sentence_id = r.sentence_id and q.subset = r.subset and q.annotator < r.annotator),
    k as (select subset, a, b, avg((la = lb)::int) as po, avg((la = 'SUBJ')::int) * avg((lb = 'SUBJ')::int) + avg((la = 'OBJ')::int) * avg((lb = 'OBJ')::int) as pe from x group by all),
    n as (select subset, count(distinct sentence_id) as n from u group by 1 having count(distinct sentence_id) >= 20)
    select subset, any_value(n) as n, round(avg(case when pe = 1 then 1.0 else (po - pe) / (1 - pe) end), 9) as kappa from k join n using (subset) group by subset""",
)
def q_subset_kappa(spark, d):
    from gradja.functions.text import has_connector

    s = sentences(spark, d, "genre", "source", "in_quote", "text")
    named = lambda c: F.concat(F.lit(c + " "), F.col(c))
    parts = F.array(F.lit("all"), named("genre"), named("source"), F.when(F.col("in_quote") == "Y", "quoted"), F.when(F.endswith(F.rtrim("text"), F.lit("?")), "question"), F.when(has_connector("text"), "connector"))
    s = s.select("sentence_id", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("subset"))
    a = annotations(spark, d).select("sentence_id", "annotator", "label").join(s, "sentence_id")
    return E.subset_kappa(a, "sentence_id", "annotator", "label", "subset").select("subset", "n", F.round("kappa", 9).alias("kappa"))


_PAIR = "x as (select q.config as a, r.config as b, q.gold, q.pred = q.gold as ra, r.pred = r.gold as rb, q.pred = r.pred as same from j q join j r using (sentence_id) where q.config < r.config)"


def _system_pairs(spark, d):
    j = judged(spark, d)
    left = j.select("sentence_id", F.col("config").alias("a"), (F.col("pred") == F.col("gold")).alias("ra"), F.col("pred").alias("pa"))
    right = j.select("sentence_id", F.col("config").alias("b"), (F.col("pred") == F.col("gold")).alias("rb"), F.col("pred").alias("pb"))
    return left.join(right, "sentence_id").filter("a < b")


@query("q_mcnemar_counts", f"{_J}, {_PAIR} select a, b, count(*) filter (ra and not rb) as b10, count(*) filter (rb and not ra) as b01 from x group by all")
def q_mcnemar_counts(spark, d):
    return _system_pairs(spark, d).groupBy("a", "b").agg(F.expr("count_if(ra and not rb)").alias("b10"), F.expr("count_if(rb and not ra)").alias("b01"))


@query("q_mcnemar_p")
def q_mcnemar_p(spark, d):
    return q_mcnemar_counts(spark, d).withColumn("p", F.round(E.mcnemar("b01", "b10"), 9))


@query("q_agree_rate", f"{_J}, {_PAIR} select a, b, count(*) as n, round(avg(same::int), 9) as rate from x group by all")
def q_agree_rate(spark, d):
    return _system_pairs(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pa") == F.col("pb")).cast("double")), 9).alias("rate"))


@query("q_hard_core", f"{_J}, h as (select model, sentence_id, any_value(gold) as gold, any_value(genre) as genre, any_value(quoted) as quoted from j group by all having count(*) filter (pred = gold) = 0), a as (select model, avg(quoted::int) as quoted from (select distinct model, sentence_id, quoted from j) group by model) select h.model, gold, genre, count(*) as n, round(avg(h.quoted::int), 9) as quoted, round(any_value(a.quoted), 9) as quoted_in_all from h join a using (model) group by h.model, gold, genre")
def q_hard_core(spark, d):
    """Sentences that no configuration of a model gets right, by label and genre, with the share of quotations among them and among all it was asked."""
    items = judged(spark, d).groupBy("model", "sentence_id").agg(F.max("gold").alias("gold"), F.max("genre").alias("genre"), F.max("quoted").alias("quoted"), F.count_if(F.col("pred") == F.col("gold")).alias("_r"))
    share = F.avg(F.col("quoted").cast("double"))
    every = items.groupBy("model").agg(F.round(share, 9).alias("quoted_in_all"))
    return items.filter("_r = 0").groupBy("model", "gold", "genre").agg(F.count("*").alias("n"), F.round(share, 9).alias("quoted")).join(every, "model")


@query("q_errors", f"{_J} select config, gold, sentence_id from j where pred <> gold qualify row_number() over (partition by config, gold order by sentence_id) <= 8")
def q_errors(spark, d):
    from gradja.operators.sampling import top_k

    return top_k(judged(spark, d).filter("pred <> gold"), ["config", "gold"], ["sentence_id"], 8).select("config", "gold", "sentence_id")


_FOLD = f"{_J}, f as (select config, (abs(('0x' || substr(md5(sentence_id), 1, 6))::bigint) % 10)::int as fold, avg((pred = gold)::int) as acc from j group by all), r as (select config as ref, fold, acc as ra from f where config = (select min(config) from f)), e as (select f.config, f.fold, round(acc - ra, 9) as df from f join r using (fold) where f.config <> r.ref and round(acc - ra, 9) <> 0), k as (select *, rank() over (partition by config order by abs(df)) + (count(*) over (partition by config, abs(df)) - 1) / 2.0 as r from e)"


def _by_fold(spark, d):
    fold = (F.conv(F.substring(F.md5("sentence_id"), 1, 6), 16, 10).cast("long") % 10).cast("int")
    return judged(spark, d).groupBy("config", fold.alias("fold")).agg(F.avg((F.col("pred") == F.col("gold")).cast("double")).alias("acc"))


@query("q_wilcoxon_w", f"{_FOLD} select config, count(*) as n, sum(case when df > 0 then r else 0 end) as w_plus from k group by config")
def q_wilcoxon_w(spark, d):
    f = _by_fold(spark, d)
    first = f.agg(F.min("config").alias("ref"))
    r = f.join(F.broadcast(first), F.col("config") == F.col("ref")).select("fold", "ref", F.col("acc").alias("ra"))  # one row
    return E.wilcoxon_w(f.join(r, "fold").filter("config <> ref"), ["config"], F.round(F.col("acc") - F.col("ra"), 9)).select("config", "n", "w_plus")


#: Results as of cross-validation, from the systems' predictions: folds by sentence (plain) and by article (grouped), the shots as the parameter.
_RESULTS = f"""{_J}, o as (select sentence_id, model || '-' || split_part(config, '-', 3) as config, split_part(config, '-', 4) as param, gold, pred, split_part(sentence_id, '-', 1) || '-' || split_part(sentence_id, '-', 2) as art from j),
k as (select *, 'plain' as scheme, (('0x' || substr(md5(sentence_id), 1, 6))::bigint % 5)::int as fold from o union all select *, 'grouped', (('0x' || substr(md5(art), 1, 6))::bigint % 5)::int from o),
cnt as (select config, scheme, fold, param, {_CNT} from k group by all), f as (select config, scheme, fold, param, ({_F} + {_G}) / 2 as macro, {_F} as f_subj, n from cnt),
r as (select config, scheme, fold, max(macro) as macro_f1, arg_max(f_subj, (round(macro, 9), param)) as f1_subj, arg_max(param, (round(macro, 9), param)) as best_param, sum(n) as n_features from f group by all)"""


def results(spark, d):
    """A results table: each configuration's best parameter by scheme and fold."""
    fold = lambda c: (F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("long") % 5).cast("int")
    j = judged(spark, d).withColumn("parts", F.split("config", "-"))
    j = j.select("gold", "pred", F.array_join(F.slice("parts", 1, 3), "-").alias("config"), F.element_at("parts", 4).alias("param"), F.explode(F.array(F.struct(F.lit("plain").alias("scheme"), fold("sentence_id").alias("fold")), F.struct(F.lit("grouped").alias("scheme"), fold(F.substring_index("sentence_id", "-", 2)).alias("fold")))).alias("x"))
    t = E.f1_table(j.select("config", "param", "x.scheme", "x.fold", "gold", "pred"), "gold", "pred", ["config", "scheme", "fold", "param"])
    best = F.struct(F.round("macro", 9), "param")
    t = t.groupBy("config", "scheme", "fold").agg(F.max("macro").alias("macro_f1"), F.max_by("f_subj", best).alias("f1_subj"), F.max_by("param", best).alias("best_param"), F.sum("n").alias("n_features"))
    return t.withColumn("model", F.lit("llm"))


@query("q_leak_gap", f"{_RESULTS}, g as (select config, avg(macro_f1) filter (scheme = 'plain') - avg(macro_f1) filter (scheme = 'grouped') as gap from r group by config) select count(*) as n, round(avg(gap), 9) as mean, round(min(gap), 9) as least, round(max(gap), 9) as most from g where gap is not null")
def q_leak_gap(spark, d):
    t = RS.leakage(results(spark, d))
    return t.select("n", *(F.round(c, 9).alias(c) for c in ("mean", "least", "most")))


_REF = "(select min(config) from r)"


@query(
    "q_ablation",
    f"""{_RESULTS}, t as (select config, avg(macro_f1) filter (scheme = 'plain') as plain, stddev_pop(macro_f1) filter (scheme = 'plain') as plain_sd, avg(macro_f1) filter (scheme = 'grouped') as grouped, stddev_pop(macro_f1) filter (scheme = 'grouped') as grouped_sd,
    avg(f1_subj) filter (scheme = 'grouped') as f1_subj, avg(n_features) filter (scheme = 'grouped') as n_features from r group by config), e as (select q.config, round(q.macro_f1 - w.macro_f1, 9) as df from r q join r w using (fold) where q.scheme = 'grouped' and w.scheme = 'grouped' and w.config = {_REF} and q.config <> {_REF} and round(q.macro_f1 - w.macro_f1, 9) <> 0),
    z as (select *, rank() over (partition by config order by abs(df)) + (count(*) over (partition by config, abs(df)) - 1) / 2.0 as rk from e), ww as (select config, count(*) as n, sum(case when df > 0 then rk else 0 end)::double as w_plus from z group by config)
    select config, coalesce(n, 0) as n, coalesce(w_plus, 0) as w_plus, {', '.join(f'round({c}, 9) as {c}' for c in ('plain', 'plain_sd', 'grouped', 'grouped_sd', 'f1_subj', 'n_features'))}, round(plain - grouped, 9) as gap from t left join ww using (config)""",
)
def q_ablation(spark, d):
    r = results(spark, d).persist()
    ref = r.agg(F.min("config")).first()[0]
    t = RS.ablation(r, ref)
    return t.select("config", "n", "w_plus", *(F.round(c, 9).alias(c) for c in ("plain", "plain_sd", "grouped", "grouped_sd", "f1_subj", "n_features", "gap")))


@query(
    "q_edge_params",
    f"{_RESULTS}, n as (select config, best_param, count(*) as n from r where scheme = 'grouped' group by all), e as (select config, count(*) filter (best_param in ((select min(param) from o), (select max(param) from o))) * 2 >= count(*) as at_edge from r where scheme = 'grouped' group by config) select config, best_param, n, at_edge from n join e using (config)",
)
def q_edge_params(spark, d):
    grid = sorted(r.shots for r in predictions(spark, d).select("shots").distinct().collect() if r.shots)  # as many as parameters
    return RS.chosen_params(results(spark, d), grid or [""]).select("config", "best_param", "n", "at_edge")


_REPLY_TOK = "len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}\\x1c-\\x1f\\x85\\x0b]+'), lambda x: x <> ''))"


@query("q_token_use", f"{WITH}, b as (select text, (row_number() over (order by sentence_id) - 1) // 15 as batch from s where text is not null), p as (select batch, count(*) as n, sum({_REPLY_TOK}) as tok from b group by batch) select count(*) as replies, sum(tok)::bigint as tokens_in, sum(2 * n)::bigint as tokens_out from p")
def q_token_use(spark, d):
    """Tokens of the replies to all batches, in and out; the stub's reply has two a sentence."""
    from gradja.operators.inference import as_batches, ask

    replies = ask(as_batches(sentences(spark, d, "text").filter("text is not null"), "sentence_id", "text"))
    return replies.agg(F.count("*").alias("replies"), F.sum("tok.in").alias("tokens_in"), F.sum("tok.out").alias("tokens_out"))


@query("q_bootstrap")
def q_bootstrap(spark, d):
    from gradja.operators.models import bootstrap_delta

    j = judged(spark, d).groupBy("sentence_id", "gold").pivot("model", ["model-a", "model-b"]).agg(F.max("pred")).toDF("sentence_id", "gold", "a", "b").filter("a is not null and b is not null")
    return bootstrap_delta(j, "gold", "a", "b")


@query("q_infer_stub")
def q_infer_stub(spark, d):
    from gradja.operators.inference import classify

    return classify(sentences(spark, d, "text").filter("text is not null"))


@query("q_quotes")
def q_quotes(spark, d):
    from gradja.functions.quotes import mark_quotes

    s = sentences(spark, d, "art", "text").filter("text is not null")
    return mark_quotes(s, "art", "sentence_id", "text", None, "sentence_id").select("sentence_id", "in_quote", "text_marked")
