"""Queries: n-gram features, near-duplicate pairs, classifiers, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradja.operators import features as V
from gradja.operators import models as M
from gradja.operators import results as RS
from gradja.operators.near import near_pairs
from gradja.plans.base import WITH, query, sentences

_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_TF = f"""{WITH}, l as (select sentence_id, label, text from s where label in ('OBJ', 'SUBJ') and text is not null),
t as (select sentence_id, label, {_W} as w from l), u as (select sentence_id, label, unnest(w) as term from t),
tf as (select sentence_id, label, term, count(*) as tf from u group by all), v as (select term, count(*) as df from tf group by term having count(*) >= 2)"""


def labelled(spark, d, *more):
    return sentences(spark, d, "label", "text", *more).filter("label in ('OBJ', 'SUBJ') and text is not null")


def _tf(spark, d, n=1):
    return V.term_counts(labelled(spark, d), "sentence_id", "text", n, keep=["label"])


@query(
    "q_ngrams",
    f"""{_TF}, i2 as (select w, unnest(range(1, len(w))) as i from t where len(w) >= 2), i3 as (select w, unnest(range(1, len(w) - 1)) as i from t where len(w) >= 3),
    g as (select term from u union all select w[i] || ' ' || w[i + 1] from i2 union all select w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from i3) select term, count(*) as n from g group by term""",
)
def q_ngrams(spark, d):
    return _tf(spark, d, 3).groupBy("term").agg(F.sum("tf").alias("n"))


@query("q_vocab", f"{_TF} select term, df from v")
def q_vocab(spark, d):
    return V.vocabulary(_tf(spark, d))


@query("q_tf_l2", f"{_TF} select sentence_id, term, round(tf / sqrt(sum(tf * tf) over (partition by sentence_id)), 6) as w from tf join v using (term)")
def q_tf_l2(spark, d):
    return V.weights(_tf(spark, d), "sentence_id", idf=False).select("sentence_id", "term", F.round("w", 6).alias("w"))


@query("q_tfidf", f"{_TF}, n as (select count(distinct sentence_id) as n from tf), r as (select sentence_id, term, tf * (ln((1 + n) / (1 + df)) + 1) as raw from tf join v using (term), n) select sentence_id, term, round(raw / sqrt(sum(raw * raw) over (partition by sentence_id)), 6) as w from r")
def q_tfidf(spark, d):
    return V.weights(_tf(spark, d), "sentence_id").select("sentence_id", "term", F.round("w", 6).alias("w"))


_CHAR = f"""{WITH}, w as (select sentence_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) || ' ' as w from s where label in ('OBJ', 'SUBJ') and text is not null),
k4 as (select sentence_id, w, unnest(range(1, greatest(length(w) - 3, 1) + 1)) as i from w), g as (select sentence_id, substr(w, i, 4) as term from k4), c as (select sentence_id, term, count(*) as tf from g group by all)"""


@query("q_charwb", f"{_CHAR} select term, count(*) as df, sum(tf) as tf from c group by term having count(*) >= 2")
def q_charwb(spark, d):
    g = V.char_grams(labelled(spark, d), "sentence_id", "text")
    return g.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).filter("df >= 2")


_COS = f"""{_CHAR}, v as (select term, count(*) as df from c group by term having count(*) >= 2), n as (select count(distinct sentence_id) as n from c),
r as (select sentence_id, term, tf * (ln((1 + n) / (1 + df)) + 1) as raw from c join v using (term), n), k as (select sentence_id, term, raw / sqrt(sum(raw * raw) over (partition by sentence_id)) as w from r)
select x.sentence_id as a, y.sentence_id as b from k x join k y on x.term = y.term and x.sentence_id < y.sentence_id group by all having sum(x.w * y.w) >= 0.9"""


def _pairs(spark, d):
    return near_pairs(labelled(spark, d), "sentence_id", "text").select("a", "b")


@query("q_near_pairs", _COS)
def q_near_pairs(spark, d):
    return _pairs(spark, d)


@query("q_near_dedup")
def q_near_dedup(spark, d):
    return V.greedy_removal(_pairs(spark, d))


_NB = f"""{_TF}, k as (select sentence_id, label, term, tf from tf join v using (term)), lab as (select distinct label from l), s2 as (select term, label, sum(tf) as s from k group by all),
e as (select t.term, lab.label, coalesce(s, 0) as s from (select distinct term from k) t cross join lab left join s2 on s2.term = t.term and s2.label = lab.label),
lp as (select term, label, ln((s + 1) / (sum(s) over (partition by label) + count(*) over (partition by label))) as lp from e), pr as (select label, ln(count(*) / (select count(*) from l)) as prior from l group by label)"""


def _nb(spark, d):
    docs = labelled(spark, d)
    tf = V.term_counts(docs, "sentence_id", "text", keep=["label"])
    train = tf.join(V.vocabulary(tf).select("term"), "term").withColumn("w", F.col("tf").cast("double"))
    return docs, train, M.nb_log_probs(train, docs)


@query("q_nb_scores", f"{_NB} select k.sentence_id, lp.label, round(any_value(prior) + sum(tf * lp), 4) as score from k join lp using (term) join pr on pr.label = lp.label group by k.sentence_id, lp.label")
def q_nb_scores(spark, d):
    docs, train, lp = _nb(spark, d)
    return M.nb_scores(train, "sentence_id", lp, M.log_priors(docs)).select("sentence_id", "label", F.round("score", 4).alias("score"))


@query("q_feature_rank", f"{_NB} select term, round(max(lp) filter (label = 'SUBJ') - max(lp) filter (label = 'OBJ'), 6) as d from lp group by term")
def q_feature_rank(spark, d):
    return M.log_odds(_nb(spark, d)[2]).select("term", F.round("d", 6).alias("d"))


@query("q_strat_folds", f"{WITH} select sentence_id, label, ((row_number() over (partition by label order by md5('0:' || sentence_id), sentence_id) - 1) % 10)::int as fold from s where label in ('OBJ', 'SUBJ') and text is not null")
def q_strat_folds(spark, d):
    return M.stratified_folds(labelled(spark, d), "sentence_id", "label").select("sentence_id", "label", "fold")


@query("q_contrast", f"{_TF} select term, count(*) filter (label = 'SUBJ') as subj, count(*) filter (label = 'OBJ') as obj from tf group by term having count(*) >= 8 and count(*) filter (label = 'SUBJ') >= 2 * count(*) filter (label = 'OBJ')")
def q_contrast(spark, d):
    g = _tf(spark, d).groupBy("term").agg(F.count_if(F.col("label") == "SUBJ").alias("subj"), F.count_if(F.col("label") == "OBJ").alias("obj"))
    return g.filter("subj + obj >= 8 and subj >= 2 * obj")


_LOW, _RAW = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')", "regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"
_GRAMS = {1: "w", 2: "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))", 3: "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"}
_UNSTEMMED = [c for c in V.CONFIGS if not c.stem]
_COUNT = " union all ".join(f"select '{c.name}' as config, count(*) as n from (select term from (select distinct sentence_id, unnest({_GRAMS[c.n]}) as term from (select sentence_id, {_LOW if c.lower else _RAW} as w from l)) group by term having count(*) >= {c.min_df})" for c in _UNSTEMMED)


@query("q_feature_count", f"{WITH}, l as (select sentence_id, text from s where label in ('OBJ', 'SUBJ') and text is not null) {_COUNT}")
def q_feature_count(spark, d):
    """Terms of every configuration without stems; those with stems are in the nested search."""
    s, out = labelled(spark, d).select("sentence_id", "text").persist(), None
    for c in _UNSTEMMED:
        n = V.vocabulary(V.config_counts(s, "sentence_id", "text", c), c.min_df).agg(F.count("*").alias("n")).select(F.lit(c.name).alias("config"), "n")
        out = n if out is None else out.union(n)
    return out


@query("q_tf_ones", f"{_TF} select round(avg((tf = 1)::int), 9) as ones, count(*) as cells from tf join v using (term)")
def q_tf_ones(spark, d):
    tf = _tf(spark, d)
    return tf.join(V.vocabulary(tf).select("term"), "term").agg(F.round(F.avg((F.col("tf") == 1).cast("double")), 9).alias("ones"), F.count("*").alias("cells"))


@query("q_group_folds")
def q_group_folds(spark, d):
    s = labelled(spark, d, "art")
    return M.group_folds(s, "art", "label").groupBy("fold", "label").agg(F.count("*").alias("n"), F.count_distinct("art").alias("articles"))


@query("q_nb_oof")
def q_nb_oof(spark, d):
    docs = M.group_folds(labelled(spark, d, "art"), "art", "label").select("sentence_id", "label", "fold").persist()
    tf = V.term_counts(labelled(spark, d), "sentence_id", "text")
    return M.nb_out_of_fold(tf, docs, "sentence_id", 10)


ALPHAS = (0.01, 0.1, 0.5, 1.0, 2.0)


def grid_results(spark, d, k=5):
    """Results of naive Bayes over all configurations, on plain and on grouped folds."""
    s = labelled(spark, d, "art").persist()
    docs = M.stratified_folds(s, "sentence_id", "label", k).withColumn("scheme", F.lit("plain")).select(F.col("sentence_id").alias("doc"), "label", "scheme", "fold")
    docs = docs.unionByName(M.group_folds(s, "art", "label", k).withColumn("scheme", F.lit("grouped")).select(F.col("sentence_id").alias("doc"), "label", "scheme", "fold")).persist()
    tf = None
    for c in V.CONFIGS:  # the grid is a constant
        part = V.config_counts(s, "sentence_id", "text", c).select(F.lit(c.name).alias("config"), F.col("sentence_id").alias("doc"), "term", "tf")
        tf = part if tf is None else tf.unionByName(part)
    return RS.nested_nb(tf.persist(), docs, k, ALPHAS)


@query("q_grid_search")
def q_grid_search(spark, d):
    """Nested search over all configurations: the smoothing chosen on inner folds, scores on outer folds."""
    t = grid_results(spark, d)
    return t.select("config", "model", "scheme", "fold", "best_param", "n_features", F.round("macro_f1", 6).alias("macro_f1"), F.round("f1_subj", 6).alias("f1_subj"))


@query("q_grid_report")
def q_grid_report(spark, d):
    """The ablation table of the nested search: scores by scheme, leakage gap, features, signed ranks and p against the first configuration."""
    r, ref = grid_results(spark, d).persist(), V.CONFIGS[0].name
    t = RS.ablation(r, ref).join(RS.signed_rank_p(r, ref), ["config", "model"], "left")
    return t.select("config", "model", "n", "w_plus", *(F.round(c, 6).alias(c) for c in ("plain", "plain_sd", "grouped", "grouped_sd", "gap", "f1_subj", "n_features", "p")))


@query("q_logreg_oof")
def q_logreg_oof(spark, d):
    docs = M.stratified_folds(labelled(spark, d), "sentence_id", "label", 3)
    return M.logistic_out_of_fold(docs, "sentence_id", "text", 1.0, 3)


@query("q_leak_test")
def q_leak_test(spark, d):
    """Macro F1 of plain and grouped folds on rows whose label hangs on the article alone."""
    from gradja.functions.stats import f1_table

    rows = M.leak_corpus(spark).persist()
    tf = V.term_counts(rows, "doc", "text")
    out = None
    for scheme, docs in (("plain", M.stratified_folds(rows, "doc", "label")), ("grouped", M.group_folds(rows, "art", "label"))):
        p = M.nb_out_of_fold(tf, docs.select("doc", "label", "fold"), "doc", 10).withColumn("scheme", F.lit(scheme))
        out = p if out is None else out.union(p)
    return f1_table(out, "label", "pred", ["scheme"]).select("scheme", "n", F.round("macro", 6).alias("macro"))


@query("q_stem")
def q_stem(spark, d):
    from gradja.functions.stemming import stem_tokens
    from gradja.functions.text import word_tokens

    t = labelled(spark, d).select(F.explode(word_tokens(F.lower("text"))).alias("token"))
    return stem_tokens(t, "token").groupBy("stem").agg(F.count("*").alias("n"), F.count_distinct("token").alias("forms"))
