"""Small fixtures for what SQL can't tell, and golden values."""

import pytest
from pyspark.sql import functions as F

from gradja.functions import quotes, stats, stemming, text
from gradja.operators import addresses, features, inference, models, relational, sampling
from gradja.sources import files, pages


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_mcnemar_golden():
    for b01, b10, exact, p in [(88, 62, False, 0.041), (84, 113, False, 0.046), (41, 52, False, 0.300), (75, 50, True, 0.0314), (75, 50, False, 0.0318)]:
        assert round(stats.mcnemar_p(b01, b10, exact), len(str(p)) - 2) == pytest.approx(p, abs=0.0006)
    assert stats.mcnemar_p(0, 0) == 1.0


def test_wilcoxon_exact():
    assert stats.wilcoxon_p(list(range(1, 11)), 55) == pytest.approx(2 / 1024)
    assert stats.wilcoxon_p([], 0) == 1.0


def test_macro_f1_golden(spark):
    rows = [("OBJ", "OBJ")] * 1398 + [("OBJ", "SUBJ")] * 403 + [("SUBJ", "OBJ")] * 479 + [("SUBJ", "SUBJ")] * 848
    r = stats.f1_table(spark.createDataFrame(rows, "gold string, pred string").withColumn("g", F.lit(1)), "gold", "pred", ["g"]).first()
    assert (round(r.f_obj, 3), round(r.f_subj, 3), round(r.macro, 3)) == (0.760, 0.658, 0.709)


def test_quote_depth():
    assert quotes.depths('a „b „c“ d“ e') == [0, 0, 0, 1, 1, 1, 2, 2, 1, 1, 1, 0, 0]
    assert quotes.depths('„a\nb')[-1] == 0
    assert quotes.depths("a''b''c") == [0, 0, 1, 1, 1, 0, 0] and quotes.depths("'a’ ‚b‘")[-1] == 0  # apostrophes are no quotation marks
    assert quotes.depths("«a» ˮb") == [0, 1, 1, 0, 0, 0]
    assert [quotes.shown(t, "Y") for t in ("Da. ", "„Da.", "«Da.", "Da.»", 'Da."', "", None)] == ["„Da.“", "„Da.", "«Da.", "„Da.»", '„Da."', "", None]
    assert quotes.shown("Da. ", "") == "Da. "
    assert quotes.mark(["Prva.", "Druga.", "Nema"], "„Prva. Druga.“ Kraj") == ["Y", "Y", "?"]


def test_quotes_of_articles(spark):
    rows = [("a", 1, "Rekao je: „Prva."), ("a", 2, "Druga."), ("a", 3, "Treća“ i otišao."), ("b", 1, "Sama."), ("b", 2, None)]
    df = spark.createDataFrame([(f"{g}{i}", g, i, t) for g, i, t in rows], "id string, g string, i int, t string")
    got = {r.id: (r.in_quote, r.text_marked) for r in quotes.mark_quotes(df, "g", "i", "t", None, "id").collect()}
    assert got == {"a1": ("", "Rekao je: „Prva."), "a2": ("Y", "„Druga.“"), "a3": ("Y", "„Treća“ i otišao.“"), "b1": ("", "Sama."), "b2": ("?", None)}


def test_sentence_rules(spark):
    t = "Dr. Ana i PROF. Petar rade od 3.5 sati. Kraj!\") Nova g.g. stvar… A. Da"
    df = spark.createDataFrame([(t,)], "x string")
    assert df.select(text.split_sentences("x")).first()[0] == ["Dr. Ana i PROF. Petar rade od 3.5 sati.", "Kraj!", "Nova g.g. stvar…", "A.", "Da"]
    frag = spark.createDataFrame([(x,) for x in ["", " (da)", "«malo", "”Veliko pravo", "12.5 + 3", "Prvo\ndrugo", "– nije"]], "x string")
    assert [r[0] for r in frag.select(text.is_fragment("x")).collect()] == [True, True, True, False, True, False, True]


def test_clean_articles(spark):
    from gradja.operators.cleaning import clean_articles

    frame = "Pretplatite se na naše dnevne vesti odmah sada."
    body = lambda a: [f"Ovo je {w} rečenica ovog članka {a}." for w in ("prva", "druga", "treća")]
    rows = [(a, i, t) for a in "abc" for i, t in enumerate([f"„ Ovo je navod {a} bez kraja ovde.", *body(a), "View this post on the network now.", "nastavak bez početka koji ne vredi.", frame, f"Ovo je ostatak {a} iza okvira sajta."])]
    got = [tuple(r) for r in clean_articles(spark.createDataFrame(rows + [("d", 0, None)], "a string, i int, t string"), "a", "i", "t").orderBy("a", "i").collect()]
    assert got == [(a, i, t) for a in "abc" for i, t in enumerate([f"Ovo je navod {a} bez kraja ovde.", *body(a)])]


def test_stemmer():
    assert stemming.stem_word("je") == "je"
    assert stemming.stem_word("kuće") == stemming.stem_word("kuća") == "kuć"
    assert stemming.stem_text("Kuća, kuće!") == "kuć, kuć!"
    assert stemming.stem_text(None) is None


def test_upsert_and_ties(spark):
    old = spark.createDataFrame([("a", 1, ""), ("b", 2, "2020")], "s string, k int, d string")
    new = spark.createDataFrame([("a", 1, "2021"), ("c", 3, "2022")], "s string, k int, d string")
    assert sorted(map(tuple, relational.upsert(old, new, ["s", "k"]).collect())) == [("a", 1, ""), ("b", 2, "2020"), ("c", 3, "2022")]
    assert sorted(map(tuple, relational.upsert_backfill(old, new, ["s", "k"], "d").collect()))[0] == ("a", 1, "2021")
    cells = spark.createDataFrame([("x", 1), ("y", 1), ("z", 1)], "c string, n int")
    assert {r.c: r.quota for r in sampling.largest_remainder(cells, "n", 4, ["c"]).collect()} == {"x": 2, "y": 1, "z": 1}


def test_greedy_removal_is_not_transitive(spark):
    pairs = spark.createDataFrame([("1", "2"), ("2", "3")], "a string, b string")
    assert [tuple(r) for r in features.greedy_removal(pairs).collect()] == [("2", "1")]
    assert features.greedy_removal(pairs.limit(0)).count() == 0


def test_similar_pairs_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["ana ide kući danas", "ana ide kući danas", "ana ide kući danas!", "sasvim drugo", "sasvim drugo ovde"])], "d int, t string")
    w = features.weights(features.char_grams(docs, "d", "t"), "d", min_df=1).cache()
    got = {(r.a, r.b) for r in features.similar_pairs(w, "d", 0.7).collect()}
    v = {}
    for r in w.collect():
        v.setdefault(r.d, {})[r.term] = r.w
    want = {(a, b) for a in v for b in v if a < b and sum(x * v[b].get(t, 0) for t, x in v[a].items()) >= 0.7}
    assert got == want and (0, 1) in got


def test_group_folds_keep_groups(spark):
    rows = [(f"a{i // 4}", "SUBJ" if i % 3 else "OBJ", i) for i in range(200)]
    f = models.group_folds(spark.createDataFrame(rows, "art string, label string, i int"), "art", "label", 5)
    assert f.groupBy("art").agg(F.count_distinct("fold").alias("k")).filter("k > 1").count() == 0
    assert f.count() == 200 and f.select("fold").distinct().count() == 5


def test_leak_gap(spark):
    rows = models.leak_corpus(spark, 60, 8).cache()
    tf = features.term_counts(rows, "doc", "text")

    def acc(docs):
        p = models.nb_out_of_fold(tf, docs.select("doc", "label", "fold"), "doc", 5)
        return p.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]

    assert acc(models.stratified_folds(rows, "doc", "label", 5)) - acc(models.group_folds(rows, "art", "label", 5)) > 0.1


def test_replies_and_inference(spark):
    df = spark.createDataFrame([('```json\n{"1": "obj", "2": "SUBJ"}\n```', 2), ('{"2": "OBJ", "3": "OBJ"}', 2), ("nothing", 1), (None, 1), ('{"1": "MAYBE"}', 1)], "raw string, n int")
    assert [r.p for r in df.select(text.parse_reply("raw", F.col("n")).alias("p")).collect()] == [["OBJ", "SUBJ"], None, None, None, None]
    rows = spark.createDataFrame([(f"s{i:02}", f"t{i}") for i in range(20)], "sentence_id string, text string")
    assert inference.classify(rows, provider=lambda t: "bad").filter("pred = 'PARSE_FAIL'").count() == 20
    packs = inference.as_batches(rows, "sentence_id", "text", 15)
    cache = inference.ask(packs).cache()
    assert inference.todo(packs, cache).count() == 0
    assert inference.classify(rows, cache=cache).count() == 20


def test_cyrillic_and_norm(spark):
    df = spark.createDataFrame([("Љубав, Њива и Џеп",), (None,), ("",)], "t string")
    assert [r.x for r in df.select(text.cyrillic_to_latin("t").alias("x")).collect()] == ["Ljubav, Njiva i Džep", None, ""]
    df = spark.createDataFrame([("a - b",), ("Čaša 12, Đak!",)], "t string")
    assert [r.x for r in df.select(text.norm_expr("t").alias("x")).collect()] == ["a  b", "casa 12 đak"]
    assert [r.x for r in df.select(text.norm_any("t").alias("x")).collect()] == ["a  b", "casa 12 đak"]


def test_addresses(spark):
    df = spark.createDataFrame([("https://www.x.rs/a/Naslov_Teksta-12/?q=1#z",)], "u string")
    assert tuple(df.select(addresses.host_of("u"), addresses.slugify("u"), addresses.number_at_end("u")).first()) == ("x.rs", "naslov-teksta-12", "12")


def test_html():
    html = '<html><head><title>T</title></head><body><nav><p>Meni</p></nav><p>' + "Tekst članka. " * 20 + "</p></body></html>"
    title, body = pages.main_text(html)
    assert title == "T" and "Meni" not in body
    assert pages.main_text('<script type="application/ld+json">{"@graph":[{"articleBody":"' + "x" * 130 + '"}]}</script>')[1] == "x" * 130
    assert pages.main_text(None) == (None, None) and pages.main_text("<p>kratko</p>")[1] is None
    calls = iter([(503, ""), (200, "ok")])
    assert pages.pages_until(lambda n: (200, ["a"]) if n == 1 else next(calls)) == ["a"]


def test_file_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x\t"y„\nz'), ("b", None)], "k string, v string")
    files.write_tsv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_tsv(spark, str(tmp_path / "t"), "k string, v string").collect())) == [("a", 'x "y„ z'), ("b", "")]
    files.write_jsonl(df, str(tmp_path / "j"))
    assert sorted((r.k, r.v) for r in files.read_jsonl(spark, str(tmp_path / "j"), "k string, v string").collect()) == [("a", 'x\t"y„\nz'), ("b", None)]
    assert files.read_jsonl(spark, str(tmp_path / "none"), "k string").count() == 0
    (tmp_path / "m.json").write_text('{"a": "1", "b": "2"}')
    assert files.read_map(spark, str(tmp_path / "m.json")).count() == 2
    (tmp_path / "ids").write_text("a b\n b c")
    assert files.read_ids(spark, str(tmp_path / "ids")).count() == 3


def test_streaming_slice(spark, tmp_path):
    from gradja.streaming import slices

    src = str(tmp_path / "in")
    spark.sql("select timestamp '2026-01-01 00:10:00' as ts, 'view' as event_type, 1.0D as value, 1L as id union all select timestamp '2026-01-01 00:50:00', 'view', 2.0D, 1L").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double, id long").parquet(src)
    q = slices.hourly(stream.withColumn("value", F.col("value").cast("double")), "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r)[1:] for r in spark.table("hours").collect()] == [("view", 2, 3.0)]


def test_greedy_removal_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(113)], "a string, b string")
    assert sorted(map(tuple, features.greedy_removal(pairs).collect())) == [(f"{i + 1:03}", f"{i:03}") for i in range(0, 113, 2)]


def test_group_folds_of_many_groups(spark):
    r = spark.range(66_000).select(F.expr("concat('a', id div 3)").alias("art"), F.when(F.expr("id % 7 = 0 or (id div 3) % 50 = 0"), "SUBJ").otherwise("OBJ").alias("label"))
    f = models.group_folds(r, "art", "label", 5).cache()
    assert f.count() == 66_000 and f.groupBy("art").agg(F.count_distinct("fold").alias("k")).filter("k > 1").count() == 0
    n = {(x.fold, x.label): x["count"] for x in f.groupBy("fold", "label").count().collect()}
    assert all(max(v) - min(v) <= 6 for v in ([n[i, y] for i in range(5)] for y in ("OBJ", "SUBJ")))
    assert models.group_folds(r.limit(0), "art", "label", 5).count() == 0


def test_nested_search_against_brute_force(spark):
    import math
    import random

    from gradja.operators import results

    rng, k, alphas = random.Random(8), 3, (0.1, 1.0)
    rows = [(f"d{i}", rng.choice(["OBJ", "SUBJ"]), rng.randrange(k)) for i in range(60)]
    texts = {d: [rng.choice("abcdefgh" if y == "OBJ" else "efghijkl") for _ in range(5)] for d, y, _ in rows}
    tf = [("c", d, t, w.count(t)) for d, w in texts.items() for t in set(w)]
    got = results.nested_nb(spark.createDataFrame(tf, "config string, doc string, term string, tf long"), spark.createDataFrame([(d, y, "plain", f) for d, y, f in rows], "doc string, label string, scheme string, fold int"), k, alphas).collect()

    def predict(unseen, fold, alpha):
        train = [(y, texts[d]) for d, y, f in rows if f not in unseen]
        vocab = {t for t in set("abcdefghijkl") if sum(t in w for _, w in train) >= 2}
        total = {y: sum(w.count(t) for z, w in train if z == y for t in vocab) for y in ("OBJ", "SUBJ")}
        lp = {(y, t): math.log((sum(w.count(t) for z, w in train if z == y) + alpha) / (total[y] + alpha * len(vocab))) for y in total for t in vocab}
        prior = {y: math.log(sum(z == y for z, _ in train)) for y in total}
        out = []
        for d, y, f in rows:
            if f == fold:
                score = {z: prior[z] + sum(lp[z, t] for t in texts[d] if t in vocab) for z in total}
                out.append((y, "SUBJ" if score["SUBJ"] >= score["OBJ"] else "OBJ"))
        f1 = lambda z: 2 * sum(a == b == z for a, b in out) / max(1, sum(a == z for a, _ in out) + sum(b == z for _, b in out))
        return (f1("OBJ") + f1("SUBJ")) / 2, len(vocab)

    assert len(got) == k
    for r in got:
        inner = {a: sum(predict({r.fold, g}, g, a)[0] for g in range(k) if g != r.fold) / (k - 1) for a in alphas}
        best = max(alphas, key=lambda a: (round(inner[a], 12), -a))
        assert r.best_param == str(best)
        assert (r.macro_f1, r.n_features) == (pytest.approx(predict({r.fold}, r.fold, best)[0]), predict({r.fold}, r.fold, best)[1])


def test_reports_of_results(spark):
    from gradja.operators import results

    rows = [(c, "nb", s, f, m + (0.1 if s == "plain" else 0) + f / 100, 0.5, p, 10) for c, m, p in (("ref", 0.5, "0.1"), ("x", 0.6, "2.0")) for s in ("plain", "grouped") for f in range(5)]
    r = spark.createDataFrame(rows, "config string, model string, scheme string, fold int, macro_f1 double, f1_subj double, best_param string, n_features long")
    assert results.leakage(r).first().mean == pytest.approx(0.1)
    t = {x.config: x for x in results.ablation(r, "ref").collect()}
    assert t["x"].gap == pytest.approx(0.1) and (t["x"].n, t["x"].w_plus, t["ref"].n) == (5, 15.0, 0)
    assert results.signed_rank_p(r, "ref").first().p == pytest.approx(2 / 32)
    assert {x.config: (x.n, x.at_edge) for x in results.chosen_params(r, ["0.01", "0.1", "2.0"]).collect()} == {"ref": (5, False), "x": (5, True)}


def test_poisson_table():
    from gradja.operators.models import poisson_table

    for mean in (0, 1, 7, 400):
        low, *cdf = poisson_table(mean)
        p = [b - a for a, b in zip([0.0] + cdf, cdf)]
        assert cdf[-1] == pytest.approx(1) and sum(x * (low + i) for i, x in enumerate(p)) == pytest.approx(mean, abs=1e-6)


def test_crawl(spark):
    site = {"s/": (200, "a b"), "s/2/": (500, ""), "s/3/": (200, "b c d"), "s/4/": (404, ""), "a": (200, "kratko"), "b": (200, "dug tekst " * 9), "c": (500, ""), "d": (200, "još duži tekst " * 9)}
    get = lambda u: site.get(u, (404, ""))
    take = lambda u, body: {"url": u, "n": len(body)} if len(body) > 20 else None
    assert [r["url"] for r in pages.crawl_section(get, lambda n: pages.numbered_page("s/", n), str.split, take, 5)] == ["b", "d"]
    assert [r["url"] for r in pages.crawl_section(get, lambda n: pages.numbered_page("s/", n), str.split, take, 1)] == ["b"]
    df = spark.createDataFrame([("s/", 5), ("leer/", 5), (None, 1)], "s string, t int")
    got = pages.crawl(df, "s", "t", get, pages.numbered_page, str.split, take, "url string, n int")
    assert sorted((r.section, r.url) for r in got.collect()) == [("s/", "b"), ("s/", "d")]
    assert pages.offset_page("x?a=1", 3) == "x?a=1&position=20" and pages.offset_page("x", 1) == "x?position=0"
    assert pages.pages_until(lambda n: (200, [str(n)], 2)) == ["1", "2"]


def test_contains_short_keys_and_clashes(spark):
    l = spark.createDataFrame([("a",), ("kultura",), ("",), (None,), ("ul",)], "a string")
    r = spark.createDataFrame([("ultra",), ("kult",), ("u",), ("",)], "b string")
    want = {(a, b) for a in ("a", "kultura", "ul") for b in ("ultra", "kult", "u") if a in b or b in a}
    assert {tuple(x) for x in relational.contains_either_way(l, r, "a", "b").collect()} == want
    ok = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    assert relational.no_clashes(ok, "k", "v").count() == 3
    with pytest.raises(Exception, match="clashes"):
        relational.no_clashes(ok.union(spark.createDataFrame([(2, "z")], "k int, v string")), "k", "v").collect()


def _alike_texts():
    import random

    rng = random.Random(4)
    words = ["".join(rng.choices("abcčćdeđžшљ", k=rng.randint(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(60)]
    return [(f"{i:03}", t) for i, t in enumerate([*texts, *(t.replace(words[0], words[1]) + "!" * (i % 2) for i, t in enumerate(texts)), *texts[:9], "a", "a", "", " \t", None, "A  b c", "𐐀𐐁 x", "𐐀𐐁  x"])]


def test_near_pairs_are_those_of_the_index_join(spark, monkeypatch):
    from gradja.operators import near

    docs = spark.createDataFrame(_alike_texts(), "d string, t string")
    w = features.weights(features.char_grams(docs, "d", "t"), "d").cache()
    for least in (0.6, 0.9):
        want = {(r.a, r.b): round(r.cos, 9) for r in features.similar_pairs(w, "d", least).collect()}
        assert len(want) > 20
        for most in (2_000_000, 3):  # grams whose counts are sent, and too many
            monkeypatch.setattr(near, "MOST_GRAMS", most)
            assert {(r.a, r.b): round(r.cos, 9) for r in near.near_pairs(docs, "d", "t", least).collect()} == want


def test_near_pairs_lose_none_in_blocks(monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa

    from gradja.operators import near

    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeghijklmn", k=rng.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(150)]
    texts += [" ".join(w for w in t.split() if rng.random() > 0.12) + " " + rng.choice(words) for t in texts for _ in range(2)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i:04}" for i in range(len(texts))]), pa.array(texts)], ["d", "t"])
    counts = pa.Table.from_batches(near._document_counts(iter([pa.RecordBatch.from_arrays([batch.column(1)], ["t"])]))).group_by("term").aggregate([("df", "sum")])
    df = counts["df_sum"].to_numpy()

    class Sent:
        value = near.Vocabulary(counts["term"].to_numpy().view(np.uint64)[df > 1], df[df > 1], len(texts))

    row, rank, w = Sent.value.vectors(texts)
    whole = np.zeros((len(texts), len(Sent.value.keys)))
    whole[row, rank] = w
    for least in (0.7, 0.9):
        want = {(f"{x:04}", f"{y:04}") for x, y in zip(*np.nonzero(np.triu(whole @ whole.T >= least, 1)))}
        assert len(want) > 20
        for piece, block, size in ((400_000, 2048, 100_000), (500, 3, 7)):
            monkeypatch.setattr(near, "PIECE", piece)
            monkeypatch.setattr(near, "BLOCK", block)
            heads = pa.Table.from_batches(near._heads(Sent, least)(iter([batch]))).sort_by("term")
            met = {(r["a"], r["b"]) for b in near._meet(least)(iter(heads.combine_chunks().to_batches(max_chunksize=size))) for r in b.to_pylist()}
            assert want <= met and len(met) < len(texts) ** 2 / 4


def test_near_pairs_shuffle_no_row_a_gram(spark, tmp_path):
    from gradja.plans.registry import QUERIES

    rows = [(f"s-{d}-1", "OBJ", t) for d, t in _alike_texts()]
    spark.createDataFrame(rows, "sentence_id string, label string, text string").write.parquet(f"{tmp_path}/corpus.parquet")
    plan = QUERIES["q_near_pairs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_near_dedup_takes_the_sketched_pairs(spark, tmp_path, monkeypatch):
    from gradja.plans.registry import QUERIES

    rows = [(f"s-{d}-1", "OBJ", t) for d, t in _alike_texts()]
    spark.createDataFrame(rows, "sentence_id string, label string, text string").write.parquet(f"{tmp_path}/corpus.parquet")
    w = features.weights(features.char_grams(spark.createDataFrame(rows, "d string, l string, t string"), "d", "t"), "d")
    want = sorted(map(tuple, features.greedy_removal(features.similar_pairs(w, "d").select("a", "b")).collect()))
    monkeypatch.setattr(features, "similar_pairs", None)  # the join of every gram
    assert sorted(map(tuple, QUERIES["q_near_dedup"](spark, str(tmp_path)).collect())) == want and want
