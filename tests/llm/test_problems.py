"""Each problem's operator against brute force or stated cases: nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from gradja.llm import p1_furniture, p2_sentences, p3_repeated, p4_sample, p5_near, p6_splits, p7_consistent, p8_tokens, p9_leaks, p10_subjects, registers
from gradja.llm.lines import cut_table, line_table
from gradja.llm.textform import consistent, plain

CORPUS = "sentence_id string, url string, genre string, source string, text string, page string, n long"


def corpus(spark, rows):
    """Extra columns clash with names the operators use inside."""
    return spark.createDataFrame([(s, u, g, src, t, "clash", 1) for s, u, g, src, t in rows], CORPUS)


# 7
@pytest.mark.parametrize(
    "text,want",
    [
        (None, None), ("", ""), ("Običan tekst.", "Običan tekst."), ("ｐｏｓｌｅ 𝗺𝗶𝗻𝘂𝘁", "posle minut"), ("pomoć", "pomoć"), ("Zdravǉe", "Zdravlje"), ("do​bro", "dobro"), ("a b c", "a b c"),
        ("рosle lеtа", "posle leta"), ("Клeфховаград", "Клефховаград"), ("Ðorðe", "Đorđe"), ("👩‍💻 ❤️", "👩‍💻 ❤️"), ("m² ½ „da“ – …", "m² ½ „da“ – …"), ("šifra β-474/γ", "šifra β-474/γ"),
        ("Το εθνικό πάρκο", "Το εθνικό πάρκο"), ("на српском", "на српском"),
    ],
)
def test_consistent(text, want):
    assert consistent(text) == want


def test_consistent_is_stable():
    rng = random.Random(1)
    letters = "abcčćdž аеорсхљњ ＡｂＣ̌́​ ǆ🙂β"
    for _ in range(300):
        t = "".join(rng.choice(letters) for _ in range(30))
        assert consistent(consistent(t)) == consistent(t)


def test_inconsistent_rows(spark):
    df = corpus(spark, [("a-1-1", None, None, None, "ｐｏ"), ("a-1-1", None, None, None, "ｐｏ"), ("a-1-2", None, None, None, "po"), (None, None, None, None, "ｐｏ"), ("a-1-3", None, None, None, None)])
    assert [r.sentence_id for r in p7_consistent.inconsistent_rows(df, model=p7_consistent.fit_bigrams(df)).collect()] == ["a-1-1"]
    assert p7_consistent.inconsistent_rows(df.limit(0)).count() == 0


# 1 and 3
def site(spark):
    rng, rows = random.Random(2), []
    for a in range(40):
        u = f"https://www.x.example/svet/naslov-teksta-broj-{a}-{1000 + a}"
        word = lambda: "".join(rng.choice("abcdefghijklmn") for _ in range(7))
        body = [f"Savet danas razmatra {word()} o kome se dugo i {word()} raspravljalo {word()} u gradu {word()}." for _ in range(4)]
        lines = ["Vrh strane", f"Naslov teksta broj {a}", *body, "Podelite ovu vest", f"Naslov teksta broj {(a + 1) % 40}"]
        rows += [(f"abc-{1000 + a}-{i:03}", u if i % 2 else None, "vest", " Abc" if i % 3 else "abc", t) for i, t in enumerate(lines, 1)]
    return corpus(spark, rows + rows[:30] + [("abc-1000-900", None, None, None, None), (None, None, None, None, "x")])


def test_furniture_and_repeats(spark):
    df = site(spark)
    inv = spark.createDataFrame([], "title string, url string")
    cut = cut_table(df).cache()
    lines = line_table(cut).cache()
    got = {(r.sid, r.line) for r in p1_furniture.furniture_lines(lines, inv).collect()}
    assert got == {(f"abc-{1000 + a}-{i:03}", 0) for a in range(40) for i in (1, 7, 8)}
    again = {(r.sid, r.line) for r in p3_repeated.repeated_lines(cut).collect()}
    count = {}
    for r in cut.filter("lkey <> 0").collect():
        count.setdefault((r.src, r.lkey), set()).add(r.page)
    want = {(r.sid, r.line) for r in cut.collect() if len(count.get((r.src, r.lkey), ())) >= 5}
    assert again == want and ("abc-1000-001", 0) in again
    kept = p1_furniture.drop_lines(df.filter("sentence_id = 'abc-1000-001'"), p1_furniture.furniture_lines(lines, inv)).first()
    assert kept.text == "" and kept.page == "clash"
    empty = cut_table(df.limit(0))
    assert p1_furniture.furniture_lines(line_table(empty), inv).count() == 0 and p3_repeated.repeated_lines(empty).count() == 0


# 2
def begins(text):
    return [text[i:] for i in p2_sentences.starts(text)[0]]


@pytest.mark.parametrize(
    "text,n",
    [
        ("Da. Ne.", 1), ("prof. dr Ana je tu. Ode.", 1), ("Od 11. do 24. jula radi. Ide.", 1), ("Zna broj: 48911. Kako?", 1), ("„Stani! Ide“, viče Ana. Kraj.", 1), ("– Zašto? – pita Ana. Kraj.", 1),
        ("– Ide. Košta 5 dinara – kaže Ana. Kraj.", 1), ("u 2014. godine… bar tako piše.", 0), ("Ćuti.Zašto ide?", 1), ("在云市，公布了财报。在谷市，出口了货物！", 1), ("V. D. Petrović, odn. Ana, npr. br. 4.55 d.o.o. i dr. ide.", 0),
        ("Ode (v. A. B. Ide. Kraj) kući. Sutra.", 1), ("Kraj. prof. Ana ide.", 1), ("", 0),
    ],
)
def test_sentence_starts(text, n):
    assert len(begins(text)) == n


def test_rows_that_continue(spark):
    rows = [("abc-1-001", "Ide u ul."), ("abc-1-002", "Glavna br. 5. Kraj."), ("abc-1-003", "v. d. direktora dolazi."), ("abc-1-004", "furniture"), ("abc-1-005", "Počinje ovde, a"), ("abc-1-007", "nastavlja se."), ("abc-1-008", None), ("abc-1-009", " ")]
    df = corpus(spark, [(s, None, None, None, t) for s, t in rows + rows[:2]])
    skipped = spark.createDataFrame([("abc-1-004",)], "sid string")
    got = sorted(map(tuple, p2_sentences.sentence_corrections(df, skipped).collect()))
    assert got == [("abc-1-002", 0), ("abc-1-002", 14), ("abc-1-007", 0)]
    assert p2_sentences.sentence_corrections(df.limit(0), skipped.limit(0)).count() == 0


def test_long_article_is_cut_into_blocks(spark):
    rows = [(f"abc-9-{i:04}", None, None, None, "Rečenica ide" if i % 2 else "dalje. Nova.") for i in range(1, 1500)]
    got = p2_sentences.sentence_corrections(corpus(spark, rows), spark.createDataFrame([], "sid string"))
    assert got.filter("pos = 0").count() >= 749 and got.count() == got.distinct().count()


def test_units_put_the_pieces_together(spark):
    rows = [("abc-1-001", "Ide u ul."), ("abc-1-002", "Glavna br. 5. Kraj."), ("abc-1-003", None), ("abc-1-004", "Nova rečenica. I još jedna.")]
    got = p2_sentences.sentence_units(corpus(spark, [(s, None, None, None, t) for s, t in rows + rows[:1]]), spark.createDataFrame([], "sid string"))
    units = {}
    for r in got.orderBy("sentence_id", "pos").collect():
        units.setdefault((r.unit_sentence_id, r.unit_pos), []).append(r.text)
    assert [" ".join(t) for t in units.values()] == ["Ide u ul. Glavna br. 5.", "Kraj.", "Nova rečenica.", "I još jedna."]
    assert p2_sentences.sentence_units(corpus(spark, []), spark.createDataFrame([], "sid string")).count() == 0


def test_list_levels():
    text = "Uslovi su:\n1. Prijava je uredna.\na) potpis\nb) pečat i\n   datum\n2. Rok nije istekao. Važi odmah.\nKraj liste."
    assert [t.split("\n")[0] for t in begins(text)] == ["1. Prijava je uredna.", "a) potpis", "b) pečat i", "2. Rok nije istekao. Važi odmah.", "Važi odmah.", "Kraj liste."]
    assert begins("• jedno\n• drugo. Treće") == ["• drugo. Treće", "Treće"]
    assert begins("5. oktobra je sunčano. Kraj.") == ["Kraj."]


def test_thai_phrases():
    assert len(begins("นายกรัฐมนตรีเดินทางไปกรุงเทพ และพบกับรัฐมนตรีต่างประเทศ")) == 0
    assert len(begins("นายกรัฐมนตรีเดินทางไปกรุงเทพ ฝนตกหนักในภาคเหนือวันนี้")) == 1


# 4
def test_sample(spark):
    rows = [(f"s{i}", "svet" if i % 4 else None, "vest" if i % 4 else "vest svet", " BLIC ") for i in range(200)] + [("q", "svet", "?", "blic")]
    df = spark.createDataFrame(rows + rows[:50], "sentence_id string, topic string, genre string, source string")
    t = spark.createDataFrame([("svet", "vest", "blic", 9000, 5), ("sport", "vest", "blic", 1000, 7)], "topic string, genre string, source string, share_bp int, min_rows int")
    c = {r.topic: r for r in p4_sample.quotas(p4_sample.counted(df, t)).collect()}
    assert (c["svet"].available, c["svet"].n, c["svet"].wanted, c["svet"].quota) == (200, 40, 36, 40)  # what sport lacks is made up
    assert (c["sport"].available, c["sport"].wanted, c["sport"].quota) == (0, 7, 0)
    got = p4_sample.smallest_keys(p4_sample.cells_of(df), p4_sample.quotas(p4_sample.counted(df, t)), F.xxhash64("sentence_id"))
    assert got.count() == got.select("sentence_id").distinct().count() == 40
    assert p4_sample.counted(df.limit(0), t).filter("available = 0").count() == 2


def test_quotas_make_up_what_caps_and_floors_take():
    a = p4_sample.allocate
    assert a(10, [(5, 0, 100), (3, 0, 100), (2, 0, 100)]) == [5, 3, 2]
    assert a(10, [(5, 0, 1), (3, 0, 100), (2, 0, 100)]) == [1, 5, 4]  # 9 by 3 to 2: 5.4 and 3.6
    assert a(10, [(8, 0, 100), (1, 4, 100), (1, 0, 100)]) == [5, 4, 1]  # 6 by 8 to 1: 5.33 and 0.67
    assert a(3, [(1, 2, 9), (1, 2, 9)]) == [2, 2] and a(50, [(1, 0, 3), (1, 0, 4)]) == [3, 4]
    assert a(4, [(0, 0, 9), (0, 0, 9)]) == [2, 2] and a(5, []) == [] and a(7, [(1, 0, 9)] * 3) == [3, 2, 2]


def test_smallest_keys_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(p4_sample, "RANGE", 10)
    cells = spark.range(2000).select(F.col("id").cast("string").alias("sentence_id"), F.lit("a").alias("topic"), F.lit("b").alias("genre"), F.lit("c").alias("source"))
    for q in (0, 1, 700, 2000, 3000):
        quota = spark.createDataFrame([("a", "b", "c", q, 2000)], "topic string, genre string, source string, quota long, available long")
        got = {r.sentence_id for r in p4_sample.smallest_keys(cells, quota, F.xxhash64("sentence_id")).collect()}
        key = F.expr("cast(case when xxhash64(sentence_id) < 0 then 1 else 0 end as int)"), F.xxhash64("sentence_id")  # by the bits, unsigned
        assert got == {r.sentence_id for r in cells.orderBy(*key).limit(q).collect()}


# 5
def test_near_pairs_against_brute_force(spark):
    rng, rows, names = random.Random(3), [], [f"ime{i}" for i in range(3000)]
    for i in range(300):
        w = rng.sample(names, 12) + ["i", "u", "na", "je"]
        rows.append((f"a-{i}-1", " ".join(w)))
        if i % 3 == 0:
            v = list(w)
            v[rng.randrange(12)] = "drugo"
            rng.shuffle(v)
            rows.append((f"a-{i}-2", " ".join(v)))
        if i % 10 == 0:
            rows.append((f"a-{i}-3", " ".join(w).upper()))
    rows += [("a-900-1", None), ("a-900-2", ""), ("a-900-3", "samo tri reči"), ("a-900-4", "在 云 市 公 布 了 财 报 出 口 货 物")]
    df = corpus(spark, [(s, None, None, None, t) for s, t in rows + rows[:20]])
    skipped = spark.createDataFrame([("a-0-2",)], "sid string")
    got = {tuple(r) for r in p5_near.near_pairs(*p5_near.near_rows_of(df, skipped)).collect()}
    sets = {s: set(w) for s, t in rows if s != "a-0-2" and (w := p5_near.word_set(t))}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert p5_near.near_pairs(*p5_near.near_rows_of(df.limit(0), skipped)).count() == 0


# 6
def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(f"x-{a}", f"x-{b}") for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(200)) if a != b] + [(f"y-{i:03}", f"y-{i + 1:03}") for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "a string, b string")
    assert {r.node: r.root for r in p6_splits.components(df).collect()} == {x: find(x) for e in edges for x in e}
    assert p6_splits.components(df.limit(0)).count() == 0


def test_article_names(spark):
    links = [(" BLI-12\t", "https://www.danas.example/a/b-77/?x=1"), ("bli-12", "bli-12"), (None, "dan-1"), ("bli-12", "vre-404"), ("pol-1", "vre-404"), ("nešto", "dan-77")]
    df = spark.createDataFrame(links, "article_a string, article_b string")
    c = spark.createDataFrame([(x, None) for x in ("bli-12-001", "dan-77-001", "pol-1-001", "rts-5-001", None)], "sentence_id string, label string")
    got = {tuple(r) for r in p6_splits.article_groups(c, df).collect()}
    assert got == {("bli-12", "bli-12"), ("dan-77", "bli-12"), ("pol-1", "bli-12")}
    shares = spark.createDataFrame([("train", 8000), ("test", 2000)], "split string, share_bp int")
    split = {r.article_key: r.split for r in p6_splits.assign(c, df, shares).collect()}
    assert len({split[k] for k in ("bli-12", "dan-77", "pol-1")}) == 1 and set(split.values()) <= {"train", "test"}


def test_splits_have_like_label_shares(spark):
    rows = [(f"xxx-{a}-{i}", "subj " if a % 3 == 0 else "OBJ" if a % 3 == 1 else None) for a in range(600) for i in range(4)]
    c = spark.createDataFrame(rows + rows[:9], "sentence_id string, label string")
    links = spark.createDataFrame([(f"xxx-{a}", f"xxx-{a + 1}") for a in range(0, 60, 2)], "article_a string, article_b string")
    shares = spark.createDataFrame([("train", 8000), ("test", 1000), ("validation", 1000)], "split string, share_bp int")
    got = {r.article_key: r.split for r in p6_splits.assign(c, links, shares).collect()}
    assert len(got) == 600 and all(got[f"xxx-{a}"] == got[f"xxx-{a + 1}"] for a in range(0, 60, 2))
    for split, share in (("train", 0.8), ("test", 0.1), ("validation", 0.1)):
        for kind in range(3):
            n = sum(s == split and int(k[4:]) % 3 == kind for k, s in got.items())
            assert abs(n / 200 - share) < 0.05
    assert p6_splits.assign(c.limit(0), links, shares).count() == 0


# 8
def test_tokens_against_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    try:
        path = p8_tokens.vocabulary_path()
    except ImportError:
        pytest.skip("no vocabulary")
    t = p8_tokens.Transducer(open(path, "rb").read())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=p8_tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    for text in ["Dobar dan, čćšžđ! <|endoftext|>", "  \n\t a  b ", "x" * 3000, "在云市 👩‍💻"] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xC0, 0x500), rng.randrange(0x4E00, 0x4F00)])) for _ in range(60)) for _ in range(100)]:
        ids = t.encode(text)
        assert ids == e.encode_ordinary(text)
        d = p8_tokens.Decoder(t.token)
        assert "".join(d.feed([i]) for i in ids) + d.end() == text
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in p8_tokens.encode_documents(df).collect()}
    assert got[1] == [] and got[2] == [] and got[3] == e.encode_ordinary("a b")
    assert {r.same for r in p8_tokens.round_trips(df, p8_tokens.encode_documents(df)).collect()} == {True}


# 9
def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"rec{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 30)))) for i in range(40)] + [(99, None), (98, "kratko")]
    docs = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(60)]
        if i % 4 == 0:
            x = items[i % 40][1].split()
            w[10:10] = x[: rng.randrange(5, 12)]
        docs.append((i, ", ".join(w).upper() if i % 2 else " ".join(w)))
    docs += [(500, None), (501, ""), (502, "  ")]
    d, x = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in p9_leaks.leaks(d, x).collect()}

    def shingles(t):  # these texts have neither accents nor Cyrillic, so their words need no module to tell them
        w = (t or "").lower().replace(",", " ").split()
        return {tuple(w[i : i + 8]) for i in range(len(w) - 7)}

    assert got == {(d, i) for d, t in docs for i, x in items if shingles(t) & shingles(x)} and got
    assert {tuple(r) for r in p9_leaks.leaks(d, x, most=0).collect()} == got  # by shuffle
    assert p9_leaks.leaks(d.limit(0), x).count() == p9_leaks.leaks(d, x.limit(0)).count() == p9_leaks.leaks(d.limit(0), x, most=0).count() == 0


def test_words_are_read_alike():
    assert p9_leaks.words("Čaša ШАШЋ\u200bе, đak") == ["casa", "sasce", "đak"]
    # accents split off, on Latin and on Cyrillic letters
    assert p9_leaks.words("sc\u030cim сведоц\u030cе Млатдумавиц\u0301") == ["scim", "svedoce", "mlatdumavic"]


# 10
def test_subjects_on_held_out_documents(spark):
    rng = random.Random(7)

    own = {"sport": ["golman", "utakmica", "liga", "trener"], "pravo": ["sudija", "presuda", "zakon", "tužba"], "svet": ["ambasada", "sporazum", "granica", "savez"]}
    def sentence(a):
        return "Danas " + " ".join(rng.choice(own[a]) for _ in range(3)) + " je ovde " + rng.choice(["stigla", "viđena", "tražena"]) + "."
    docs, labels, truth = [], [], {}
    for i in range(240):
        areas = rng.sample(sorted(own), 1 if i % 3 else 2)
        docs.append((i, " ".join(sentence(a) for a in areas for _ in range(3)), f"https://x.example/{own[areas[0]][0]}-{own[areas[0]][1]}-{i}" if i % 2 else None, None, None, None))
        truth[i] = set(areas)
        if i < 160:
            labels += [(i, a) for a in areas]
    docs += [(n, t, None, None, None, None) for n, t in ((900, None), (901, ""), (902, " "))]
    df = spark.createDataFrame(docs, "doc_id long, text string, url string, title string, source string, genre string")
    sub = spark.createDataFrame([(a,) for a in own] + [(None,)], "subject string")
    lab = spark.createDataFrame(labels + [(None, "sport"), (3, "ništa")], "doc_id long, subject string")
    got = {}
    for r in p10_subjects.subject_shares(df, p10_subjects.train(df, lab, sub)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == truth[i] for i in range(160, 240))
    assert right >= 74 and not {900, 901, 902} & set(got)
    assert p10_subjects.subject_shares(df, p10_subjects.train(df, lab.limit(0), sub)).count() == 0


def test_words_of_a_row_are_told_as_defined(monkeypatch):
    """The short ways of the line pass give what the definition gives: tokens of clean Latin text, words whose hashes collide."""
    from gradja.llm import lines
    from gradja.llm.textform import clean_latin

    clean = [c for c in map(chr, range(0x110000)) if clean_latin(c)]
    assert len(clean) > 100 and all(lines._LATIN_TOKEN.findall(f"a{c.lower()}b") == lines._TOKEN.findall(f"a{c.lower()}b") for c in clean)
    monkeypatch.setattr(lines, "h64", lambda w: len(w))
    ten = [c * n for c in "ab" for n in range(1, 6)]
    assert lines.Words().of(ten) == [1, 2, 3, 4, 5] and lines.Words().of(ten[:9] * 3) is None
    monkeypatch.setattr(lines, "MEMO", 3)
    words = lines.Words()
    assert [words.of(ten), words.of(ten)] == [[1, 2, 3, 4, 5]] * 2


def test_skipped_rows_are_no_members(spark):
    text = " ".join(f"reč{i}" for i in range(12))
    df = corpus(spark, [(s, None, None, "a", t) for s, t in (("a-1-1", text), ("a-1-1", text), ("a-1-2", text), ("a-1-3", "kratko"), ("a-1-4", None), ("a-1-5", text))])
    skipped = spark.createDataFrame([("a-1-2",), ("a-1-2",), ("a-1-3",), ("a-9-9",)], "sid string")
    members, classes = p5_near.near_rows_of(df, skipped)
    assert sorted(r.sid for r in members.collect()) == ["a-1-1", "a-1-5"] and [(r.rows, r.rep, r.n) for r in classes.collect()] == [(2, "a-1-1", 12)]


def test_sections_give_weak_labels():
    labelled = [(p10_subjects.section_features(f"https://x.example/{w}-utakmica-liga-{i}", None, "s", None), [a]) for i, (w, a) in enumerate([("golman", "sport"), ("trener", "sport"), ("golman", "sport")] * 5)]
    labelled += [(p10_subjects.section_features(f"https://x.example/sudija-presuda-{i}", None, "s", None), ["pravo"]) for i in range(12)]
    m = p10_subjects.Sections(["pravo", "sport"], labelled)
    assert m.area(p10_subjects.section_features(None, "Utakmica i liga", "s", None)) == "sport"
    assert m.area(p10_subjects.section_features("https://x.example/presuda-sudija-7", None, "t", None)) == "pravo"
    assert m.area(p10_subjects.section_features(None, None, None, None)) is None and m.area(set()) is None


def test_plain():
    assert plain("ＤＡ") == "da" and plain(None) is None


# what the first review found missing
def near(spark, rows, **kw):
    df = corpus(spark, [(s, None, None, None, t) for s, t in rows])
    members, classes = p5_near.near_rows_of(df, spark.createDataFrame([], "sid string"))
    sets = {s: frozenset(w) for s, t in rows if (w := p5_near.word_set(t))}
    named = {r.cls: sets[r.sid] for r in members.collect()}
    got = [tuple(r) for r in p5_near.similar_classes(classes, **kw).collect()]
    want = {(a, b) for a in named for b in named if a < b and 10 * len(named[a] & named[b]) >= 7 * len(named[a] | named[b])}
    return got, want


@pytest.mark.parametrize("share,edits", [(1.0, 2), (0.3, 3), (0.02, 2)])
def test_every_pair_of_a_large_edited_group_is_found(spark, share, edits):
    rng, rows, base = random.Random(7), [], [f"zajedno{i}" for i in range(25)]
    for i in range(800):
        w = list(base) if i < 800 * share else [f"ime{rng.randrange(4000)}" for _ in range(rng.randrange(10, 40))]
        for e in range(edits if i < 800 * share else 0):
            w[rng.randrange(25)] = f"izmena{i}n{e}"
        rows.append((f"a-{i}-1", " ".join(w)))
    got, want = near(spark, rows)
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.98 * len(want) and want
    # a hot bucket's postings meet chunk by chunk, and find the same
    again, _ = near(spark, rows, chunk=50)
    assert sorted(again) == sorted(got)


def test_near_pairs_of_a_tiny_table(spark):
    text = [f"reč{i}" for i in range(12)]
    got, want = near(spark, [("a-1-1", " ".join(text)), ("a-2-1", " ".join([*text[:11], "drugo"])), ("a-3-1", " ".join([*text[:6], *(f"t{i}" for i in range(6))]))])
    assert set(got) == want and len(want) == 1


def test_furniture_of_a_small_site_in_a_large_table(spark, monkeypatch):
    inv = spark.createDataFrame([], "title string, url string")
    lines = line_table(cut_table(site(spark).filter("sentence_id < 'abc-1010'"))).cache()
    other = spark.range(600_000).select(
        F.concat(F.lit("f-"), "id", F.lit("-1")).alias("sid"), F.lit(0).alias("line"), F.col("id").alias("page"), F.lit(0).alias("block"), F.lit(1).alias("idx"), F.xxhash64("id").alias("path"),
        *(F.lit(0).cast("long").alias(c) for c in ("head", "tail", "slug")), F.lit(0).alias("kol"), F.lit(40).alias("mass"), F.lit(1).alias("term"),
    )
    found = lambda df: {(r.sid, r.line) for r in p1_furniture.furniture_lines(df, inv).collect()}
    alone = found(lines)
    assert {f"abc-{1000 + a}-{i:03}" for a in range(10) for i in (1, 7)} <= {s for s, _ in alone}
    assert found(lines.unionByName(other)) == alone
    # with more framing paths than are broadcast, the rest come by shuffle
    monkeypatch.setattr(p1_furniture, "BROADCAST", 0)
    monkeypatch.setattr(p1_furniture, "SHARE", 0.1)
    assert found(lines) == alone


def test_paths_joined_by_shuffle_frame_pages_without_text_too(spark, monkeypatch):
    """A page with a headline of its own and no text loses its furniture, however many framing paths there are."""
    inv = spark.createDataFrame([], "title string, url string")
    bare = [(f"abc-{2000 + a}-{i:03}", f"https://www.x.example/svet/samo-naslov-broj-{a}-{2000 + a}", "vest", "abc", t) for a in range(30) for i, t in enumerate(("Vrh strane", f"Samo naslov broj {a}", "Podelite ovu vest"), 1)]
    lines = line_table(cut_table(site(spark).unionByName(corpus(spark, bare)))).cache()
    found = lambda: {(r.sid, r.line) for r in p1_furniture.furniture_lines(lines, inv).collect()}
    few = found()
    assert {(f"abc-{2000 + a}-{i:03}", 0) for a in range(30) for i in (1, 3)} == {x for x in few if x[0] >= "abc-2000"}
    monkeypatch.setattr(p1_furniture, "BROADCAST", 0)
    for share in (0.9, 0.1, 1e-9):  # none, some and all of them are hot
        monkeypatch.setattr(p1_furniture, "SHARE", share)
        assert found() == few


def test_hot_paths_are_told_by_all_their_lines(spark):
    """What a path holds on pages without text counts for how it is joined, and not for whether it frames."""
    bare = [(f"abc-{2000 + a}-{i:03}", None, "vest", "abc", t) for a in range(30) for i, t in enumerate(("Vrh strane", "Podelite ovu vest"), 1)]
    judged = lambda df: {r.path: r for r in p1_furniture.judged_paths(p1_furniture.laid_out(line_table(cut_table(df)))).collect()}
    alone, more = judged(site(spark)), judged(site(spark).unionByName(corpus(spark, bare)))
    assert {p: r.frame for p, r in alone.items()} == {p: r.frame for p, r in more.items()}
    assert sorted(more[p].n - r.n for p, r in alone.items() if more[p].n > r.n) == [30, 30]


def test_a_page_of_many_blocks_is_one_page(spark):
    """Lines at the edges of the blocks of one long page stand inside its text; its furniture is at its ends only."""
    inv = spark.createDataFrame([], "title string, url string")
    word = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    long = ["Vrh strane", *(f"Savet danas razmatra {word(i)} o kome se dugo i {word(i * 7)} raspravljalo u {word(i * 3)} gradu na {word(i * 11)}." if i % 50 else "Kratak međunaslov" for i in range(1, 2000)), "Podelite ovu vest"]
    rows = [(f"abc-1-{i:04}", None, "vest", "abc", t) for i, t in enumerate(long, 1)]
    df = site(spark).unionByName(corpus(spark, rows))
    got = {r.sid for r in p1_furniture.furniture_lines(line_table(cut_table(df)), inv).collect() if r.sid.startswith("abc-1-")}
    assert got == {"abc-1-0001", "abc-1-2001"}


def test_estimate_is_corrected_for_collisions():
    """Registers of sets that share nothing agree by chance; the estimate of their similarity is nought all the same."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 31, (2, 4000, 30))
    half = np.concatenate([a[:, :20], b[:, :10]], axis=1)  # 20 of 40 words shared
    lists = lambda x: pa.array([row.astype("<i4").tobytes() for row in x], pa.binary())
    sig = lambda x: registers.rows_of(registers.as_column(registers.signatures(lists(x))))[:, : registers.REGISTERS]
    assert abs(registers.shared_words(lists(np.sort(a)), lists(np.sort(half))).mean() - 20) < 0.1
    n = np.full(4000, 30)
    assert abs(registers.estimate(sig(a), sig(b), n, n).mean()) < 0.005 < (sig(a) == sig(b)).mean()
    assert abs(registers.estimate(sig(a), sig(half), n, n).mean() - 0.5) < 0.01


def test_long_quotations_brackets_and_remarks():
    said = " ".join(f"Rečenica broj {w} traje dugo i ne kaže ništa." for w in ["jedan", "dva", "tri", "pet"] * 15)
    for text in (f"Kaže: „{said}“ ističe ministar. Kraj je tu.", f"Kaže: «{said}» ističe ministar. Kraj je tu.", f"Spisak ({said}) je dug. Kraj je tu.", f"– {said} – kaže ministar. Kraj je tu."):
        assert [text[n:] for n in p2_sentences.starts(text)[0]] == ["Kraj je tu."]
    # a bracket that is never closed holds nothing back
    assert len(p2_sentences.starts("Prva (nije zatvorena. Druga je tu. Treća (jeste) tu.")[0]) == 2


def test_articles_whose_lines_only_sum_alike_count_apart(spark):
    """Two articles without a line in common are two, even if their lines are as many and their keys have the same exclusive or."""
    table = lambda rows: spark.createDataFrame([("abc", *r) for r in rows], "src string, page long, lkey long")
    keys = {r.lkey: r.key for r in table([(0, k) for k in range(1, 70)]).select("lkey", F.xxhash64("src", "lkey").alias("key")).collect()}
    basis, alike = [], 0  # an even number of keys whose exclusive or is 0: bit 64 is the parity of their number
    for k, key in keys.items():
        v, used = key & (1 << 64) - 1 | 1 << 64, 1 << k
        for b, u in basis:
            if v ^ b < v:
                v, used = v ^ b, used ^ u
        if not v:
            alike = used
            break
        basis = sorted([*basis, (v, used)], reverse=True)
    lines = [k for k in keys if alike >> k & 1]
    half = len(lines) // 2
    rows = [(1, k) for k in lines[:half]] + [(2, k) for k in lines[half:]] + [(p, k) for p in range(10, 14) for k in lines[: p - 9] + lines[half:]] + [(p, k) for p in range(20, 24) for k in lines[:half]]
    count = {}
    for page, k in rows:
        count.setdefault(keys[k], set()).add(page)
    want = {key: len(pages) for key, pages in count.items()}
    assert lines and {r.key: r.n for r in p3_repeated.repeated_keys(table(rows + rows[:5]), 1).collect()} == want
    assert {r.key: r.n for r in p3_repeated.repeated_keys(table(rows)).collect()} == {key: n for key, n in want.items() if n >= 5}


def test_spread_counts_clusters_and_listed_dates(spark, tmp_path):
    d, n = str(tmp_path), 120
    rows = [(f"abc-{a}-{i}", None, "vest", "abc", f"{a}", t, "2026-01-01") for a in range(n) for i, t in ((1, "Podelite ovu vest"), (2, "Isti tekst" if a < 3 else "Tekst " + "".join("abcdefghij"[int(c)] for c in str(a))))]
    c = spark.createDataFrame(rows, "sentence_id string, url string, genre string, source string, article_id string, text string, collected_at string")
    c.withColumn("collected_at", F.to_timestamp("collected_at")).write.parquet(f"{d}/corpus.parquet")
    listed = [("ABC ", f"{a}", f"2025-{1 + a // 28:02}-{1 + a % 28:02}" + ("T04:40:00+01:00" if a % 5 else "")) for a in range(n - 1)] + [("abc", f"{n - 1}", None), ("abc", "3", "2025-12-30")]
    spark.createDataFrame(listed, "source string, article_id string, date string").write.parquet(f"{d}/inventory.parquet")
    assert [tuple(r) for r in p3_repeated.p3_spread(spark, d).collect()] == [("abc", 1, n, n - 2, n - 1)]
