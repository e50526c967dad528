"""Scalar text functions as Columns; everything stays in the JVM unless said otherwise."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Discourse connectors.
CONNECTORS = ("naravno", "dakle", "uostalom", "naime", "zapravo", "inače")
# Abbreviations whose full stop ends no sentence, whatever their case.
ABBREVIATIONS = (
    "г", "гг", "др", "мр", "проф", "ул", "бр", "стр", "тзв", "нпр", "итд", "тј", "год", "в", "св", "ум", "н", "мин", "макс", "тел",
    "g", "gg", "dr", "mr", "prof", "ul", "br", "str", "tzv", "npr", "itd", "tj", "god", "v", "sv", "min", "maks", "tel",
)
# What marks a sentence as page furniture, a date line, an embedded widget, and the frame of a site.
BOILERPLATE = r"foto\s*:|izvor\s*:|autor\s*:|video\s*:|bonus video|pratite nas|pro[cč]itajte (jo[sš]|i)|vezane vesti|podeli|tagovi|copyright|sva prava zadr|rts|извор\s*:|фото\s*:|аутор\s*:|видео\s*:|прочитајте|подели"
DATELINE = r"^\s*(pon|uto|sre|[cč]et|pet|sub|ned|понедељак|уторак|среда|четвртак|петак|субота|недеља).*[0-9]{1,2}[.:][0-9]{2}"
EMBED = r"A post shared by|View this post|Pogledajte ovu objavu|Sledeći video|Prati nas na|Podeli ovu vest"
CHROME = r"Vidi sve|Podržite nas|Pravo novinarstvo košta|odaberite pretplatu|njuzleter|Međuvreme stiže|pretplat|popust na|digitalno izdanje|Arhiva nedeljnika|PDF format|odražavaju stavove autora|^Izvor:|^\*|^Foto|^FOTO"
# Cyrillic letters that have one Latin letter, and those that have two.
ONE_LETTER = ("абвгдђежзијклмнопрстћуфхцчшАБВГДЂЕЖЗИЈКЛМНОПРСТЋУФХЦЧШ", "abvgdđežzijklmnoprstćufhcčšABVGDĐEŽZIJKLMNOPRSTĆUFHCČŠ")
TWO_LETTERS = {"љ": "lj", "њ": "nj", "џ": "dž", "Љ": "Lj", "Њ": "Nj", "Џ": "Dž"}
ACCENTED = ("čćšžČĆŠŽ", "ccszCCSZ")


def is_question(text: str) -> Column:
    return F.endswith(F.rtrim(text), F.lit("?"))


def has_connector(text: str) -> Column:
    return F.lower(text).rlike(r"(^|[^\p{L}\p{N}_])(" + "|".join(CONNECTORS) + r")($|[^\p{L}\p{N}_])")


def norm_expr(text: str) -> Column:
    """Lower case without accents, white space folded before punctuation is deleted, trimmed. đ stays.

    Exact for the accents of Serbian Latin; :func:`norm_any` takes any script.
    """
    t = F.translate(F.lower(text), *ACCENTED)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"[^\p{L}\p{N}_\s]", ""))


def norm_any(text: str) -> Column:
    """norm for any script: NFKD with combining marks dropped (an Arrow batch UDF, since Spark has no decomposition)."""

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        t = t.str.lower().str.normalize("NFKD").str.replace("[\u0300-\u036f]", "", regex=True)
        return t.str.replace(r"\s+", " ", regex=True).str.replace(r"[^\w\s]", "", regex=True).str.strip()

    return run(F.col(text))


def cyrillic_to_latin(text: str) -> Column:
    """Serbian Cyrillic by its Latin spelling; two-letter forms keep a capital first."""
    start = F.translate(F.col(text), *ONE_LETTER)
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), TWO_LETTERS.items(), start)


#: Where a sentence ends: after an end mark that is no abbreviation's full stop, closing marks and white space being cut away.
SENTENCE_END = r"(?<=[.!?…])(?<!(?<![\p{L}\p{N}_])(?iu:" + "|".join(ABBREVIATIONS) + r")\.)[\"»”')\]]*\s+"


def split_sentences(text: str) -> Column:
    """Sentences of a text, white space folded; pieces of one character are none."""
    folded = F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    return F.filter(F.transform(F.split(folded, SENTENCE_END), lambda x: F.trim(x)), lambda x: F.length(x) > 1)


def matches_any(text, pattern: str) -> Column:
    """Whether a pattern stands anywhere in the text, in any case."""
    return (F.col(text) if isinstance(text, str) else text).rlike("(?iu)" + pattern)


def is_clean(text) -> Column:
    """A sentence that is neither furniture nor a date line and has four words and a letter at least."""
    t = F.col(text) if isinstance(text, str) else text
    return ~matches_any(t, BOILERPLATE) & ~matches_any(t, DATELINE) & (token_count(t) >= 4) & t.rlike("[A-Za-zА-Яа-яЂ-џ]")


def token_count(text) -> Column:
    """Tokens between white space."""
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))


def is_fragment(text) -> Column:
    """Empty, begins with a bracket or separator, begins in lower case behind openers, or has letters in under half its length."""
    t = F.regexp_replace(text, r"^[\s\p{Z}]+", "")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return (t == "") | t.rlike(r"^[(),;:]") | t.rlike("^[„«\"'“” –—-]*\\p{Ll}") | (letters * 2 < F.length(t))


def keeps(text) -> Column:
    """5 to 50 tokens and an end mark or a closing quote or bracket at the end."""
    n = token_count(text)
    return (n >= 5) & (n <= 50) & (F.col(text) if isinstance(text, str) else text).rlike(r"[.?!\"”’)]$")


def is_attribution(text: str) -> Column:
    """A dash and a word in lower case: what follows a remark."""
    return F.col(text).rlike(r"^\s*[-–—]\s*\p{Ll}")


def strip_tags(text: str) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def word_tokens(text) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), 0)


def marked(text: str, quoted: Column) -> Column:
    """A quoted sentence between „ and “, without what its own marks already show; it opens or closes a quotation itself if it begins or ends with such a mark."""
    t = F.regexp_replace(text, r"[\s\p{Z}]+$", "")
    closed = t.rlike("[“”ˮ»\"]$")
    return F.when(quoted & (t != "") & ~t.rlike("^[„«]"), F.concat(F.lit("„"), t, F.when(closed, F.lit("")).otherwise(F.lit("“")))).otherwise(F.col(text))


def prompt(task: str, examples: list[tuple[str, str]], rows: Column) -> Column:
    """Task, numbered examples and numbered sentences of one batch."""
    shown = "".join(f"\n{i}. {t} -> {label}" for i, (t, label) in enumerate(examples, 1))
    listed = F.array_join(F.transform(rows, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    return F.concat(F.lit(task + shown + "\n\n"), listed)


def parse_reply(raw: str, n: Column) -> Column:
    """Labels of a reply by sentence number; null unless the keys are exactly 1 to n and the labels OBJ or SUBJ."""
    body = F.regexp_extract(F.regexp_replace(raw, "```[a-z]*", ""), r"(?s)\{.*\}", 0)
    m = F.from_json(F.when(body != "", body), "map<string,string>")
    m = F.map_filter(F.transform_values(m, lambda k, v: F.upper(F.trim(v))), lambda k, v: k.rlike("^[0-9]+$") & v.isin("OBJ", "SUBJ"))
    want = F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string"))
    whole = (F.size(m) == n) & (F.size(F.array_except(want, F.map_keys(m))) == 0)
    return F.when(whole, F.transform(want, lambda k: F.element_at(m, k)))


def batch_key(texts: Column) -> Column:
    return F.substring(F.sha1(F.array_join(texts, "\n")), 1, 16)


def backoff(message: str, attempt: Column) -> Column:
    """Seconds to wait: as the message says and one more, 5 doubled each time for limits, else 2 each time; capped."""
    said = F.regexp_extract(message, r"try again in ([0-9.]+)s", 1)
    limit = F.lower(message).rlike("429|rate|quota")
    doubled = F.lit(5.0) * F.pow(F.lit(2.0), attempt - 1)
    return F.when(said != "", F.least(F.try_to_number(said, F.lit("999990.99")).cast("double") + 1, F.lit(60.0))).when(limit, F.least(doubled, F.lit(60.0))).otherwise(F.least(F.lit(2.0) * attempt, F.lit(30.0)))
