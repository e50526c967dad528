"""Problem 2: sentence units of every article, whatever its language and script.

A pushdown automaton runs over the article's rows in order. One stack holds the
open quotations and brackets, a second one the levels of the list it is in (an
item is a unit, its mark belongs to it); the side state tells whether a dashed
remark is open; abbreviations are looked up in a trie read backwards from the full stop, and each
script brings its own end marks. It emits the offsets at which sentences begin.

Rows travel once, sorted by (article, block of sent_idx); blocks of long
articles overlap by HALO rows, so no article is ever held as a whole.

Defined cases: null and blank texts have no units; a row delivered again counts
once; where rows are missing before a row, only its own text can tell whether it
continues (it begins in lower case, or closes a quotation it didn't open). A
quotation, bracket or remark is open for as long as it takes within a block; one
that runs over more than HALO rows before a block is seen from the block on only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradja.llm.arrow import article_key, read
from gradja.llm.lines import slug, url_slug
from gradja.llm.p1_furniture import page_furniture
from gradja.llm.textform import consistent, to_latin

#: Rows of an article that are looked at together, and how many before them are looked at again.
BLOCK, HALO = 512, 32

# Abbreviations, Latin spelling, lower case. After the first kind a sentence never ends, after the second
# it ends where the next word is capitalised.
NEVER = "dr mr prof doc akad inž ing g gđa gđica gosp v d vd odn tzv npr tj ul br st str sv čl tel fax god.br op ref jr sr kap por gen puk up usp cca red tab sl.br mrs ms vs no vol fig eq approx bzw z nr".split()
SOMETIMES = "itd itsl sl god o a n e p ml hilj mil min sek st.c etc inc ltd co usw".split()
TITLE = re.compile(r"(?:v\. ?d\.|dr|prof\.|mr|doc\.|akad\.|inž\.|gđa|в\. ?д\.|др|проф\.|мр)\s")

_END = ".!?…。！？｡।॥؟۔;؛։።"
_WIDE_END = "。！？｡।॥؟۔։።"
_OPEN = {"„": "“”", "“": "”“", "‘": "’", "‚": "‘’", "「": "」", "『": "』", "《": "》", "(": ")", "[": "]", "（": "）", "【": "】"}
_CLOSE = set("“”’」』》)]）】")
_EVENT = re.compile("[" + re.escape(_END) + "]+|[„“”\"«»「」『』《》()\\[\\]（）【】]|\n|(?<=[฀-໿])[ \x1f]+(?=[฀-໿])")
_SKIP = re.compile("[\\s​⁠﻿­]*")
_WORD_BEFORE = re.compile(r"(\d+|[^\W\d_](?:[^\W\d_]|[̀-ͯ​-‍⁠﻿­])*)$")
_SHOUT = re.compile(r"[^\W\d_]{2,}\b")
_DASH = "-–—―"
#: The dash between a remark and its attribution.
_SAID = re.compile(r"[\s!?…][-–—―]\s*(?=([^\W\d_]))")
#: Where a remark ends at the latest: the end of its paragraph, or a row that begins with a quotation.
_PARAGRAPH = re.compile("\n|\x1f„")
_BRACKET = re.compile(r"[()\[\]（）【】]")
#: The mark of a list item at the beginning of a line: a number, a letter in a half bracket, or a bullet.
_ITEM = re.compile(r"(?:(\d{1,3}[.)])|([^\W\d_]\))|([•*·▪◦‣]))[ \t]+(?=\S)")
# Thai and Lao words and marks that go on with what stands before a space, and marks after which it goes on.
_GOES_ON = re.compile("และ|หรือ|แต่|ซึ่ง|ว่า|กับ|โดย|เพราะ|คือ|เช่น|ได้แก่|รวมทั้ง|ๆ|ฯ|ແລະ|ຫຼື|ແຕ່|ເຊິ່ງ|ວ່າ|ກັບ|ໂດຍ|ເພາະ|ຄື|ເຊັ່ນ|ໆ|ຯ")
_WAITS = "ๆฯໆຯ"
#: Letters a Thai or Lao phrase has at least on either side of a space that ends a sentence.
_PHRASE = 8
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")


class Trie:
    """Abbreviations by their letters from last to first; the kind is at the node where a word may begin."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for w, kind in words.items():
            node = self.root
            for ch in reversed(w):
                node = node.setdefault(ch, {})
            node[""] = kind

    def kind(self, text: str) -> int:
        """The kind of the whole word text, 0 if it is none."""
        node = self.root
        for ch in reversed(text):
            node = node.get(ch)
            if node is None:
                return 0
        return node.get("", 0)


ABBREVIATIONS = Trie({w: 2 for w in SOMETIMES} | {w: 1 for w in NEVER})


def _begins(text: str, n: int) -> bool:
    """Whether a sentence may begin at n."""
    c = text[n]
    if c in _DASH:
        n = _SKIP.match(text, n + 1).end()
        return n < len(text) and (text[n].isupper() or text[n] in "„“\"«»「(" or TITLE.match(text, n) is not None)
    if c.islower():
        return TITLE.match(text, n) is not None
    return c.isalnum() or c in "„“\"«»「『《(（[【‘©#@" or ord(c) > 0x2190


def _ends(text: str, p: int, e: int, n: int) -> bool:
    """Whether the run of end marks text[p:e] ends a sentence, the next character being at n."""
    run, apart = text[p:e], n > e
    if run[-1] in _WIDE_END or run[0] in _WIDE_END:
        return text[n] not in "”」』）】)“" or text[n] in "“「『（"
    if run == ";" or run == "؛":
        return apart and bool(_GREEK.search(text[max(0, p - 2) : p])) and _begins(text, n)
    if run != ".":
        return _begins(text, n) and (apart or text[n] not in "0123456789")
    w = _WORD_BEFORE.search(text, max(0, p - 40), p)
    word = w.group() if w else ""
    if word.isdigit():
        shout = (m := _SHOUT.match(text, n)) and m.group().isupper()  # 2. DO 27. septembra
        return apart and not text[n].isdigit() and not shout and _begins(text, n)
    if word:
        letters = word if word.isascii() else to_latin(consistent(word))
        if len(letters) == 1 and letters.isupper():
            return False
        kind = ABBREVIATIONS.kind(letters.lower())
        if kind == 1:
            return False
        if kind == 2:
            return apart and text[n].isupper() and not (len(letters) == 1 and text[w.start() - 1 : w.start()] != ".")
    if apart:
        return _begins(text, n)
    return (len(word) >= 3 or text[p - 1 : p] in (")", "“", "”", "»", '"')) and not text[n].islower() and _begins(text, n)


def closed_brackets(text: str) -> set[int]:
    """Offsets of the opening brackets that have a closing one of their own."""
    out, stacks = set(), {c: [] for c in ")]）】"}
    for m in _BRACKET.finditer(text):
        c = m.group()
        if c in stacks:
            if stacks[c]:
                out.add(stacks[c].pop())
        else:
            stacks[_OPEN[c]].append(m.start())
    return out


def _item_kind(m: re.Match) -> str:
    """What the items of one level have in common: the form of their mark."""
    return m.group(3) or (m.group(1) and "0" + m.group(1)[-1]) or "a)"


def _unspaced_end(text: str, p: int, e: int) -> bool:
    """Whether the space text[p:e] between Thai or Lao letters ends a sentence: two full phrases meet, and the second doesn't go on with the first."""
    if text[p - 1] in _WAITS or _GOES_ON.match(text, e):
        return False
    before = max(text.rfind(c, 0, p) for c in " \n\x1f") + 1
    after = min((i for c in " \n\x1f" if (i := text.find(c, e)) >= 0), default=len(text))
    return p - before >= _PHRASE and after - e >= _PHRASE


def starts(text: str, plain: list[tuple[int, int]] = ()) -> tuple[list[int], bool]:
    """Offsets at which sentences begin after the first, and whether the text began inside a quotation.

    plain: spans (headlines) that are one unit each, a new one beginning after them.
    """
    out: list[int] = []
    stack: list[str] = []
    held: list[int] = []  # ends inside the open quotation; they count if it turns out not to be one
    inside = False
    spans = list(plain)
    levels: list[str] = []  # of the list that a line is an item of, by the form of their marks
    stop = item_end = -1
    size = len(text)
    last = {c: text.rfind(c) for c in {*"".join(_OPEN.values()), *'"«»'}}  # an opening mark needs a closing one anywhere after it
    balanced = closed_brackets(text)
    first = _SKIP.match(text).end()
    remark = first if first < size and text[first] in _DASH else -1  # where a dashed remark began whose attribution has not come yet

    def item(n: int) -> int:
        """Enter or leave list levels if an item begins at n; the end of its mark, or -1."""
        m = _ITEM.match(text, n)
        if m is None:
            return -1
        kind = _item_kind(m)
        if kind in levels:
            del levels[levels.index(kind) + 1 :]
        else:
            levels.append(kind)
        return m.end()

    if (m := _ITEM.match(text, first)) and any(_item_kind(x) == _item_kind(m) for line in re.finditer("\n", text) if (x := _ITEM.match(text, line.end()))):
        item_end = item(first)  # a number that begins the text is an item's only if others follow

    def paragraph_end(n: int) -> int:
        nonlocal stop
        if stop < n:
            stop = m.start() if (m := _PARAGRAPH.search(text, n)) else size
        return stop

    def begin(n: int) -> None:
        nonlocal remark
        if remark >= 0 and text[n] not in _DASH:
            said = _SAID.search(text, remark + 1, n)
            ahead = None if said and said.group(1).islower() else _SAID.search(text, n, paragraph_end(n))
            if ahead and ahead.group(1).islower():
                return  # the remark goes on and its attribution is still to come
        out.append(n)
        remark = n if text[n] in _DASH else -1

    for m in _EVENT.finditer(text):
        p, e = m.span()
        ev = m.group()
        while spans and spans[0][1] <= p:
            spans.pop(0)
        if spans and spans[0][0] <= p:
            continue
        if p < item_end:
            continue
        c = ev[0]
        if c == "\n":
            n = _SKIP.match(text, e).end()
            mark = item(n)
            if mark < 0 and n < size and not text[n].islower():
                levels.clear()
            item_end = max(item_end, mark)
            if n < size and (mark >= 0 or not text[n].islower() or TITLE.match(text, n)):
                out += [*held, n]
                remark = n if text[n] in _DASH else -1
                stack.clear()
                held.clear()
            continue
        if c in " \x1f":
            if not stack and _unspaced_end(text, p, e):
                out.append(e)
            continue
        if c in _END:
            n = _SKIP.match(text, e).end()
            if n >= size:
                continue
            if _ends(text, p, e, n):
                if not stack:
                    begin(n)
                elif stack[-1] not in "([（【":
                    held.append(n)
            continue
        # quotations and brackets
        closed = False
        if stack and (c in _OPEN.get(stack[-1], "") or c == stack[-1] == '"' or (stack[-1] in "«»" and c in "«»" and c != stack[-1])):
            stack.pop()
            closed = True
            if not stack:
                held.clear()
        elif c in "«»":
            other = "»" if c == "«" else "«"
            if (p == 0 or not text[p - 1].isalnum()) and text[e : e + 1].strip() and last[other] >= e:
                stack.append(c)
        elif c == '"':
            if last['"'] >= e:
                stack.append(c)
        elif c in _OPEN and not (c == "“" and p and not text[p - 1].isspace() and text[p - 1] not in "(„、，,:：说" and (e >= size or not text[e].isalnum())):
            if c == "„" and "„" in stack and held:  # the one before was never closed
                out += held
                held.clear()
                stack.clear()
            if p in balanced if c in "([（【" else any(last[x] >= e for x in _OPEN[c]):
                stack.append(c)
        elif c in _CLOSE and c not in ")]）】" and not out and not stack:
            inside = True
        if closed and not stack and p and text[p - 1] in _END:
            n = _SKIP.match(text, e).end()
            if n < size and (n > e or text[p - 1] in _WIDE_END) and _begins(text, n):
                begin(n)
    return sorted({*out, *held}), inside


def article_starts(rows: list[tuple]) -> list[tuple[str, str, list[int], bool]]:
    """(sentence_id, text, begun, continues) of the rows (idx, sentence_id, text, url, skipped, halo) of one block, in order.

    begun: where further sentences begin in the text; continues: the row goes on with
    the one before it. Skipped rows only fill gaps, halo rows belong to the block before.
    """
    own = next((s for r in rows if (s := url_slug(r[3]))), "")
    found: list[tuple[str, str, list[int], bool]] = []
    part: list[tuple] = []
    last = None

    def flush(after_gap: bool) -> None:
        if not part:
            return
        text = "\x1f".join(r[2] for r in part)
        at, offsets = 0, []
        heads: list[tuple[int, int]] = []
        for r in part:
            offsets.append(at)
            if own:
                i = at
                for line in r[2].split("\n"):
                    if 8 < len(line) < 250 and line.strip()[-1:] not in (".", "!", "…") and slug(consistent(line)) == own:
                        heads.append((i, i + len(line)))
                    i += len(line) + 1
            at += len(r[2]) + 1
        begun, inside = starts(text, heads)
        begun = set(begun)
        for a, b in heads:
            begun.add(a)
            n = _SKIP.match(text, b).end()
            if n < len(text):
                begun.add(n)
        for r, o in zip(part, offsets):
            first = _SKIP.match(text, o).end()
            end = o + len(r[2])
            if r[5] or first >= end:
                continue
            c = text[first]
            if o == 0:
                goes_on = after_gap and (inside or c in ",;)”" or (c.islower() and not TITLE.match(text, first)) or (c in _DASH and not _begins(text, first)))
            else:
                goes_on = first not in begun and not "฀" <= c <= "໿"  # a row of Thai or Lao is a phrase of its own
            found.append((r[1], r[2], sorted(n - o for n in begun if first < n < end), bool(goes_on)))

    gap = bool(rows) and rows[0][0] > 1
    seen = None
    for r in rows:
        if r[1] == seen:
            continue
        seen = r[1]
        if last is not None and r[0] > last + 1:
            flush(gap)
            part, gap = [], True
        last = r[0]
        if not r[4] and r[2] and r[2].strip():
            part.append(r)
    flush(gap)
    return found


def article_corrections(rows: list[tuple]) -> list[tuple[str, int]]:
    """(sentence_id, pos) of the corrections to the rows of one block."""
    return [(sid, n) for sid, _, begun, goes_on in article_starts(rows) for n in ([0] if goes_on else []) + begun]


def article_units(rows: list[tuple]) -> list[tuple[str, int, str, int, str]]:
    """(unit_sentence_id, unit_pos, sentence_id, pos, text) of the pieces of the sentence units of one block, in order.

    A unit is named by where it begins; a piece is what one row holds of it. A row that
    goes on with one the block doesn't hold begins a unit of that block.
    """
    out, unit = [], None
    halo = {r[1] for r in rows if r[5]}
    for sid, text, begun, goes_on in article_starts([(*r[:5], False) for r in rows]):
        cuts = [0, *begun, len(text)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if unit is None or k or not goes_on:
                unit = (sid, a)
            if sid not in halo and text[a:b].strip():
                out.append((*unit, sid, a, text[a:b].strip()))
    return out


def _fold_copies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop what this task has seen already, by a 64-bit hash of the id."""
    seen: set[int] = set()
    for b in it:
        keep = []
        for s in b.column(0).to_pylist():
            h = hash(s)
            keep.append(h not in seen)
            seen.add(h)
        yield b.filter(pa.array(keep, pa.bool_()))


_IN = "sentence_id string, url string, text string"


def by_article(corpus: DataFrame, skipped: DataFrame, fn, schema: str) -> DataFrame:
    """fn over the rows of each block of each article, in order; rows in skipped (sid) are left out as furniture."""
    rows = corpus.select("sentence_id", "url", "text").filter("sentence_id is not null").mapInArrow(_fold_copies, _IN)
    marks = skipped.select(F.col("sid").alias("sentence_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind")).distinct()
    both = rows.withColumn("kind", F.lit(1)).unionByName(marks)
    both = both.withColumn("page", article_key()).withColumn("idx", F.coalesce(F.expr("try_cast(substring_index(sentence_id, '-', -1) as int)"), F.lit(0)))
    block = F.expr(f"idx div {BLOCK}")
    halo = F.when(F.pmod("idx", F.lit(BLOCK)) >= BLOCK - HALO, F.array(block, block + 1)).otherwise(F.array(block))
    placed = both.withColumn("block", F.explode(halo)).withColumn("halo", F.expr(f"block > idx div {BLOCK}"))
    ordered = placed.repartition("page", "block").sortWithinPartitions("page", "block", "idx", "sentence_id", "kind")
    kinds = [pa.string() if c.split()[1] == "string" else pa.int32() for c in schema.split(", ")]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []

        def done(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * len(kinds), kinds)], names)

        for b in it:
            found: list[tuple] = []
            for sid, url, text, kind, page, idx, blk, hal in zip(*(c.to_pylist() for c in b.columns)):
                if (page, blk) != now:
                    found += fn(group)
                    now, group = (page, blk), []
                group.append((idx, sid, text, url, kind == 0, hal))
            yield done(found)
        yield done(fn(group))

    return ordered.select("sentence_id", "url", "text", "kind", "page", "idx", "block", "halo").mapInArrow(run, schema)


def sentence_corrections(corpus: DataFrame, skipped: DataFrame) -> DataFrame:
    """(sentence_id, pos) of the corrections to the rows of corpus; rows in skipped (sid) are left out as furniture."""
    return by_article(corpus, skipped, article_corrections, "sentence_id string, pos int")


def sentence_units(corpus: DataFrame, skipped: DataFrame) -> DataFrame:
    """The pieces of every sentence unit, named by where it begins: unit_sentence_id, unit_pos, sentence_id, pos, text."""
    return by_article(corpus, skipped, article_units, "unit_sentence_id string, unit_pos int, sentence_id string, pos int, text string")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_corrections(read(spark, d, "corpus", "sentence_id", "url", "text"), page_furniture(spark, d).select("sid"))


def p2_units(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units of every article, a row for each piece: the article, where the unit begins, and the piece's row, position and text. Ordered by sentence_id and pos they read as the article does."""
    units = sentence_units(read(spark, d, "corpus", "sentence_id", "url", "text"), page_furniture(spark, d).select("sid"))
    return units.select(article_key("sentence_id").alias("article_key"), "unit_sentence_id", "unit_pos", "sentence_id", "pos", "text")


QUERIES = {"p2_found": p2_found, "p2_units": p2_units}
SQL: dict[str, str] = {}
