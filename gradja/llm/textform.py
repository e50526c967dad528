"""Consistent written form of text (problem 7) and the plain form built on it.

Method: compatibility normalisation restricted to letters and digits, deletion
of ignorable characters, then a Viterbi search over each token's look-alike
lattice: every letter may stand for itself or for the letter it looks like in
another script, and a path is scored by script-consistent character bigrams.

Everything here is plain Python over one string; :mod:`gradja.llm.p7_consistent`
applies it to tables in Arrow batches.

Defined cases: null stays null, the empty text stays empty, line breaks are
kept, and a text that is already consistent is returned unchanged.
"""

from __future__ import annotations

import math
import re as _re
import unicodedata
from functools import lru_cache

import regex as re

# Letters that look alike, by script (Latin, Cyrillic, Greek).
LATIN_CYRILLIC = {
    "a": "а", "c": "с", "e": "е", "i": "і", "j": "ј", "o": "о", "p": "р", "s": "ѕ", "x": "х", "y": "у", "h": "һ",
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р",
    "S": "Ѕ", "T": "Т", "X": "Х", "Y": "У", "d": "ԁ", "q": "ԛ", "w": "ԝ", "k": "к", "v": "ѵ", "l": "ӏ", "r": "г",
    "m": "м", "t": "т", "n": "п", "u": "и",
}
LATIN_GREEK = {
    "a": "α", "i": "ι", "k": "κ", "o": "ο", "p": "ρ", "u": "υ", "v": "ν", "x": "χ", "y": "γ", "n": "η", "w": "ω", "t": "τ",
    "A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ",
    "X": "Χ", "Y": "Υ", "Z": "Ζ", "c": "ϲ", "j": "ϳ", "C": "Ϲ",
}
# Letters of other Latin or Cyrillic alphabets for the home letter they look like.
OTHER_ALPHABET = {
    "ð": "đ", "Ð": "Đ", "Ɖ": "Đ", "ɖ": "đ", "ı": "i", "ɡ": "g", "ɑ": "a", "ꜱ": "s", "ᴏ": "o", "ě": "ě",
    "ǎ": "ǎ", "ҫ": "с", "ӡ": "з", "ʐ": "ž", "ȷ": "j", "ƚ": "l",
}

_CLEAN_LATIN = _re.compile(r"[^\n\r -~čćšžđČĆŠŽĐ„“”’‘–—…°·•»«©½¼¾²³€§]")
_CLEAN_CYRILLIC = _re.compile(r"[^\n\r -@\[-`{-~абвгдђежзијклљмнњопрстћуфхцчџшАБВГДЂЕЖЗИЈКЛЉМНЊОПРСТЋУФХЦЧЏШ„“”’‘–—…°·•»«©½¼¾²³€§]")
_IGNORABLE = _re.compile("[\u00ad\u034f\u061cᅟᅠ\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206fㅤ\ufe00-\ufe0f\ufeffﾠ\U000e0000-\U000e0fff]")
_SPACES = _re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\t\v\f]")
_COMPAT = _re.compile("[０-９Ａ-Ｚａ-ｚｦ-ﾝ\U0001d400-\U0001d7ffĲĳĿŀŉſǄ-ǌǱ-ǳʰ-ʸﬀ-ﬆ℀-⅏Ⅰ-ⅿ]")
_MARKED = re.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}]\p{Mn}+")
_WORD = re.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Mn}]+")
_HOME_MIX = re.compile(r"[A-Za-zčćšžđČĆŠŽĐ][\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][A-Za-zčćšžđČĆŠŽĐ]|[\p{Cyrillic}][\p{Greek}]|[\p{Greek}][\p{Cyrillic}]|[ðÐƉɖıɡɑꜱᴏҫӡʐȷƚ]|[іѕһԁԛԝѵӏІЅ]")
_EMOJI = re.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}\ufe0f\u200d⃣\U000e0020-\U000e007f]")
_JOINING = re.compile(r"[\p{Arabic}\p{Hebrew}\p{Syriac}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Mongolian}\p{Han}\p{Tibetan}]")
_CJK = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}、-〿\uff00-\uffef]")
_THAI_LIKE = re.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]")
_WORD_INNER = re.compile(r"[\p{L}\p{N}\p{Mn}]")


def script(ch: str) -> str:
    """L, C or G for a letter of the Latin, Cyrillic or Greek script, else an empty string."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0x250 <= o < 0x2B0 or 0x1D00 <= o < 0x1DC0 or 0xA720 <= o < 0xA800:
        return "L" if ch.isalpha() else ""
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G" if ch.isalpha() else ""
    if 0x400 <= o < 0x530 or 0x1C80 <= o < 0x1C90 or 0x2DE0 <= o < 0x2E00 or 0xA640 <= o < 0xA6A0:
        return "C" if ch.isalpha() else ""
    return ""


def _lattice() -> dict[str, dict[str, str]]:
    """For each letter its look-alike in every script, itself included."""
    out: dict[str, dict[str, str]] = {}
    groups: dict[str, dict[str, str]] = {}
    for l, c in LATIN_CYRILLIC.items():
        groups.setdefault(l, {"L": l})["C"] = c
    for l, g in LATIN_GREEK.items():
        groups.setdefault(l, {"L": l})["G"] = g
    for forms in groups.values():
        for s, ch in forms.items():
            if ch not in out or s == "L":
                out[ch] = dict(forms)
    for ch, home in OTHER_ALPHABET.items():
        if ch != home:
            out.setdefault(ch, {})[script(home)] = home
    return out


LATTICE = _lattice()
#: Pairs that look alike only in some hands; a path through them costs more.
#: Cyrillic letters that Serbian does not write.
_FOREIGN = set("іѕһԁԛԝѵӏІЅ")
_CODE = tuple("-/0123456789")
_FAINT = set("γгміпинωуτтηк")


class Bigrams:
    """Character bigram scores by script, start and end of word included.

    Without counts every bigram of a script scores the same, so that only the
    consistency of the script and the script of the surrounding text decide.
    """

    def __init__(self, counts: dict[str, int] | None = None):
        self.counts = counts or {}
        totals: dict[str, int] = {}
        for pair, n in self.counts.items():
            totals[pair[0]] = totals.get(pair[0], 0) + n
        self.score = {p: math.log((n + 0.1) / (totals[p[0]] + 30)) for p, n in self.counts.items()}
        self.floor = {a: math.log(0.1 / (n + 30)) for a, n in totals.items()}

    def of(self, a: str, b: str) -> float:
        if not self.counts:
            return -4.0
        return self.score.get(a + b) or self.floor.get(a, -6.0)


PLAIN_BIGRAMS = Bigrams()
_SWITCH, _CHANGE, _FAINT_COST, _CONTEXT = 14.0, 0.6, 3.0, 0.8


def _viterbi(word: str, main: str, model: Bigrams) -> str:
    """The best path through the look-alike lattice of one word; main: the script of most of the text."""
    paths: dict[tuple[str, str], tuple[float, str]] = {("", "^"): (0.0, "")}
    for ch in word:
        own = script(ch)
        steps: list[tuple[str, str, float]] = []
        if ch not in OTHER_ALPHABET or OTHER_ALPHABET[ch] == ch:
            steps.append((own, ch, 0.0))
        else:
            steps.append((own, ch, 8.0))
        for s, to in LATTICE.get(ch, {}).items():
            if to != ch:
                steps.append((s, to, _CHANGE + (_FAINT_COST if ch in _FAINT or to in _FAINT else 0.0)))
        nxt: dict[tuple[str, str], tuple[float, str]] = {}
        for (s0, c0), (score, text) in paths.items():
            for s, to, cost in steps:
                now = s or s0
                v = score - cost + model.of(c0.lower(), to.lower()) - (_SWITCH if s0 and s and s != s0 else 0.0)
                if now == main:
                    v += _CONTEXT
                if (now, to) not in nxt or v > nxt[now, to][0]:
                    nxt[now, to] = (v, text + to)
        paths = nxt
    return max((v + model.of(c.lower(), "$"), t) for (_, c), (v, t) in paths.items())[1]


@lru_cache(maxsize=100_000)
def _best(word: str, main: str, model: Bigrams) -> str:
    return _viterbi(word, main, model)


def _compat(m) -> str:
    ch = m.group()
    d = unicodedata.decomposition(ch)
    cat = unicodedata.category(ch)
    if not d or cat[0] not in "LN" or cat in ("No", "Lm"):
        return ch
    tag = d.split(" ", 1)[0]
    if tag == "<super>" or (tag == "<compat>" and cat == "So"):
        return ch
    to = unicodedata.normalize("NFKC", ch)
    return to if all(c.isalnum() or c in "ʼ·" for c in to) else ch


def _ignorable(text: str) -> str:
    """Delete characters that nobody sees, but for those of an emoji or of their own script's writing."""
    out, last = [], 0
    for m in _IGNORABLE.finditer(text):
        i, ch = m.start(), m.group()
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if ch in "\u200d\ufe0f\ufe0e" or ch >= "\U000e0000":
            keep = bool(before and _EMOJI.match(before)) or (ch == "\u200d" and bool(before and _JOINING.match(before)))
        elif ch in "\u200c\u200e\u200f\u061c\u034f" or "\u202a" <= ch <= "\u202e" or "\u2066" <= ch <= "\u2069" or "\u180b" <= ch <= "\u180f":
            keep = bool(before and _JOINING.match(before)) or bool(not ch == "\u200c" and after and _JOINING.match(after))
        elif ch == "\u200b":
            keep = bool(before and _THAI_LIKE.match(before) and after and _THAI_LIKE.match(after))
        elif "\ufe00" <= ch <= "\ufe0d":
            keep = bool(before and (_CJK.match(before) or unicodedata.category(before)[0] == "S"))
        else:
            keep = False
        if not keep:
            out.append(text[last:i])
            last = i + 1
    return "".join(out) + text[last:] if last or out else text


def _space(m) -> str:
    if m.group() != "\u3000":
        return " "
    s, i = m.string, m.start()
    return "\u3000" if i and i + 1 < len(s) and _CJK.match(s[i - 1]) and _CJK.match(s[i + 1]) else " "


def clean_latin(text: str) -> bool:
    """True if the text is surely consistent and has no letters but those of the home alphabet's Latin spelling."""
    return not _CLEAN_LATIN.search(text)


def is_clean(text: str) -> bool:
    """True if the text is surely consistent; cheap, and it decides nearly all rows."""
    return not _CLEAN_LATIN.search(text) or not _CLEAN_CYRILLIC.search(text)


def _lookalikes(text: str, model: Bigrams) -> str:
    n = {"L": 0, "C": 0, "G": 0}
    words = list(_WORD.finditer(text))
    for w in words:
        # a letter counts for its script unless it could be a look-alike
        for ch in w.group():
            s = script(ch)
            if s and ch not in LATTICE:
                n[s] += 1
    main = max(n, key=lambda s: (n[s], s == "L"))
    out, last, changed = [], 0, False
    for w in words:
        word = w.group()
        scripts = {s for s in map(script, word) if s}
        if len(scripts) > 1 or any(ch in OTHER_ALPHABET for ch in word) or (scripts == {"C"} and main == "C" and re.search("[іѕһԁԛԝѵӏІЅ]", word)):
            if scripts == {"L"} and re.search("[þÞæÆ]", text):  # an alphabet that owns the letter
                continue
            to = _best(word, main, model)
            # a word that no single script can write is no word of any; it stays
            if to != word and len({s for s in map(script, to) if s}) == 1:
                out += [text[last : w.start()], to]
                last, changed = w.end(), True
    if not changed:
        return text
    text = "".join(out) + text[last:]
    # short words of look-alikes only, left over beside others that were borrowed; a letter in a code (β-474/γ) is none
    out, last = [], 0
    for w in _WORD.finditer(text):
        word = w.group()
        if len(word) > 4 or script(word[0]) in ("", main) or text[w.start() - 1 : w.start()] in _CODE or text[w.end() : w.end() + 1] in _CODE:
            continue
        to = [LATTICE.get(ch, {}).get(main, "") for ch in word]
        if all(c and c not in _FOREIGN and ch not in _FAINT for c, ch in zip(to, word)):
            out += [text[last : w.start()], "".join(to)]
            last = w.end()
    return "".join(out) + text[last:]


def consistent(text: str | None, model: Bigrams = PLAIN_BIGRAMS) -> str | None:
    """The text in its one consistent form; null stays null."""
    if text is None or text.isascii() and "\t" not in text or is_clean(text):
        return text
    if _IGNORABLE.search(text):
        text = _ignorable(text)
    text = _SPACES.sub(_space, text)
    text = _COMPAT.sub(_compat, text)
    if _MARKED.search(text):
        text = _MARKED.sub(lambda m: unicodedata.normalize("NFC", m.group()), text)
    if _HOME_MIX.search(text):
        text = _lookalikes(text, model)
        if _MARKED.search(text):
            text = _MARKED.sub(lambda m: unicodedata.normalize("NFC", m.group()), text)
    return text


def plain(text: str | None, model: Bigrams = PLAIN_BIGRAMS) -> str | None:
    """The consistent form in lower case."""
    return None if text is None else consistent(text, model).lower()


# Serbian Cyrillic letters by their Latin spelling.
CYRILLIC_LATIN = dict(zip("абвгдђежзијклљмнњопрстћуфхцчџш", "a b v g d đ e ž z i j k l lj m n nj o p r s t ć u f h c č dž š".split()))
_TO_LATIN = str.maketrans(CYRILLIC_LATIN | {k.upper(): v.capitalize() for k, v in CYRILLIC_LATIN.items()})
_HAS_CYRILLIC = _re.compile("[а-шђјљњћџА-ШЂЈЉЊЋЏ]")


def to_latin(text: str) -> str:
    """Serbian Cyrillic letters by their Latin spelling; all else stays."""
    return text.translate(_TO_LATIN) if _HAS_CYRILLIC.search(text) else text
