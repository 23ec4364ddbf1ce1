"""Problem 4: sentence units across languages and scripts.

A blank line ends every unit. Inside a block the possible ends form a lattice: in spaced scripts each run of
terminators with the quotes and brackets that it closes; in scripts without blanks between words each terminator, and
in scripts without terminators (Thai, Lao, Khmer, Burmese) each gap. An end has a price for being taken and one for
being passed; a unit has a price for quotes or brackets left open. The cheapest path gives the units. The prices come
from abbreviations, numbers, the case of the next word and, in scripts without blanks, from word lattices over a
small dictionary: every run without blanks is segmented once as a whole, and the words that end and begin at a gap tell
final particles and opening words.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from quillstack.llm.common import arrow_map, first_delivery

# Abbreviations by what may follow them. NEVER: they always have something behind them in their sentence.
NEVER = frozenset(
    "abs abschn anh anl anm art aufl az bd bzw ca cf ders dgl dipl dr ebd evtl fr frl gem geb ggf hrsg hr inkl insb ing jg kap lfd lit mind max min nr od orig "
    "pos prof rd resp rn s sog st str tab tel univ urspr vgl verf vorl vs v z zi ziff zz zzgl zzt bspw einschl entspr exkl allg a.d d.h i.d.r i.d.f i.v.m o.ä "
    "o.g s.o s.u u.a u.ä z.b z.t z.zt m.w m.e e.g i.e fig figs sec no nos mr mrs ms messrs jr mt ch eq eqs ref refs vol pp ed eds p esp approx dept univ "
    "al cap chap n° mme mlle mm m ex p.ex av bd sr sra srta dra lic núm pág ej ee.uu ust hab np mgr inż ul tzw prof.dr md örn sn dok yrd doç av alb "
    "ts ths gs pgs bs пр проф им ул рис табл ст п пп т.е т.н см напр акад доц г-н г-жа κ κα άρθ παρ π.χ δρ αρ βλ σελ د أ م डॉ श्री श्रीमती प्रो क्र".split()
)
#: Abbreviations that may also be the last word of a sentence; a capital behind them decides.
MAYBE = frozenset("usw etc u.s.w jun sen usf ff f a.m p.m am pm inc ltd co corp u.s u.k b.c a.d т.д т.п др г гг r w в др и.т.д κ.λπ κλπ itd itp vb vs.vb dgl".split())
#: Months, before which a number with a point is a day.
MONTHS = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember jan feb apr jun jul aug sep sept okt nov dez january february march may june "
    "july october december janvier février mars avril juin juillet août septembre octobre novembre décembre".split()
)
#: German words before an ordinal number.
BEFORE_ORDINAL = frozenset("am im vom zum zur der dem den des die das und oder bis ab beim jeder jede jedes jedem jeden ein eine einem einen einer dieser diesem diesen ihr ihrem sein seinem seit".split())
#: Words that often open a sentence, for the places where a capital alone does not tell.
OPENING_WORDS = frozenset(
    "der die das den dem des ein eine einer einem einen in im am an auf aus bei bis durch für gegen mit nach ob ohne seit sofern soweit über um unter von vor während wer wenn wie wir zu zum zur zwischen "
    "alle auch dabei daher damit danach dies diese dieser dieses es er sie ist sind hat kann mein nur so sowie werden wird bitte zuständig studierende gemäß siehe nachträglich prof dr herr frau "
    "the a an this that these those it he she they we if in on at for to and but or as by where when while each both all no nobody do does is are students applications candidates participation under see "
    "le la les un une des ce cette il elle el los las en au selon sans chaque".split()
)

#: Small dictionary for word lattices of scripts without blanks: words that open a sentence, ...
OPENERS = frozenset(
    "เมื่อใด เมื่อ หาก ถ้า ตาม ตามข้อ นักศึกษา อาจารย์ คณะกรรมการ คณะ ผู้ ทั้งนี้ อย่างไรก็ตาม ดังนั้น โดย ในการ ใน กรุณา โปรด ห้าม ทุก การ ข้อ แต่ละ เพราะ เนื่องจาก ใคร ทำไม อย่า "
    "如果 请 根据 关于 学生 导师 没有 必修 因为 但是 所以 同时 此外 本 每 各 任何 对于 为了 在 "
    "学生 担当 担当教員 第 ただし また しかし なお この その 必修 追加 もし".split()
)
#: ... words that close one, ...
FINALS = frozenset(
    "ไม่ได้ ได้ แล้ว ทุกปี ปี คะแนน ครับ ค่ะ คะ นะ เลย ด้วย เท่านั้น ต่อไป ใหม่ เต็ม ออนไลน์ ประจำปี ชั่วคราว ภาคบังคับ ร่วม "
    "吗 呢 吧 了 的 啊 么 です ます でした ました ください か た る ん".split()
)
#: ... words that go on with the sentence before, ...
GO_ON = frozenset(
    "และ หรือ แต่ ที่ ซึ่ง อัน ว่า กับ พร้อม ของ ให้ จึง ก็ คือ เพื่อ ๆ ฯ ฯลฯ เป็นต้น "
    "和 或 与 及 而 并 的 地 得 等 、 と って という との と述べ で".split()
)
#: ... and other frequent words.
COMMON = frozenset("ตรวจ ต้อง ส่ง ก่อน สัปดาห์ ฉบับ มี ค่าเฉลี่ย เริ่ม ใช้ แทน จะ สอบ ลงนาม ประกาศ จึงจะ ไม่มี รายงาน สัญญา 可以 必须 不能 以及 包括 要求 公布 参加 は が を に の も から まで より ので いつ".split())

_BLANK = regex.compile(r"\r?\n[^\S\n]*(?:\r?\n\s*)+| \s*|\s*\f\s*")
_STRONG = "!?！？。؟।॥።។။‼⁇⁈⁉｡"
_CLOSE = "\"'”“’‘»«›‹)]}）］】」』〉》〕"
_ENDING = regex.compile(rf"(?:[{regex.escape(_STRONG)}]|\.|…|;)(?:[{regex.escape(_STRONG)}.…]|(?<=[!?])\s[!?])*")
_PAIRS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "〈": "〉", "《": "》", "［": "］"}
_HEADING = regex.compile(
    r"(?:#{1,6} .*|(?:Kapitel|Teil|Abschnitt|Anlage|Anhang|Artikel|Section|Chapter|Part|Annex|Appendix) [\dA-Z]+(?:[.\d]*)(?: ?[:–—-] .*)?|\d+(?:\.\d+)+\.? \p{Lu}.*|§ ?\d+[a-z]? \p{Lu}\S*(?: (?:und|im|Fach|\p{Lu}\S*))*|\d+\.? \p{Lu}\S*(?: (?:und|and|im|Fach|\p{Lu}?\S*)){0,5})"
)
_FREE = 6.0


def _spaceless(c: str) -> str:
    """cjk for scripts with terminators but without blanks, gap for scripts with neither, else empty."""
    o = ord(c)
    if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x3FFFF:
        return "cjk"
    if 0x0E00 <= o <= 0x0EFF or 0x1000 <= o <= 0x109F or 0x1780 <= o <= 0x17FF:
        return "gap"
    return ""


@lru_cache(maxsize=1)
def _lexicon() -> tuple[dict[str, str], int]:
    kinds: dict[str, str] = {}
    for kind, words in (("common", COMMON), ("final", FINALS), ("opener", OPENERS), ("go_on", GO_ON)):
        for w in words:
            kinds[w] = kind
    return kinds, max(map(len, kinds))


def word_lattice(run: str) -> list[tuple[str, str]]:
    """Cheapest segmentation of a run without blanks: (word, kind). Known words cost 1, other characters 1.5 each."""
    kinds, longest = _lexicon()
    n = len(run)
    best, back = [0.0] + [1e9] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            known = run[i:j] in kinds
            if (known or j - i == 1) and best[i] + (1.0 if known else 1.5) < best[j]:
                best[j], back[j] = best[i] + (1.0 if known else 1.5), i
    out: list[tuple[str, str]] = []
    j = n
    while j:
        i = back[j]
        kind = kinds.get(run[i:j], "")
        if not kind and out and not out[-1][1]:
            out[-1] = (run[i:j] + out[-1][0], "")
        else:
            out.append((run[i:j], kind))
        j = i
    return out[::-1]


_SPACELESS = regex.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_RUN = regex.compile(r"\S+")


def word_edges(block: str) -> tuple[dict[int, str], dict[int, str]]:
    """(kind of the known word that begins at a place, kind of the one that ends there), from the lattices of all runs
    that hold characters of scripts without blanks."""
    begins: dict[int, str] = {}
    ends: dict[int, str] = {}
    if _SPACELESS.search(block):
        for m in _RUN.finditer(block):
            if _SPACELESS.search(m.group()):
                at = m.start()
                for word, kind in word_lattice(m.group()):
                    if kind:
                        begins[at], ends[at + len(word)] = kind, kind
                    at += len(word)
    return begins, ends


def _depth_changes(block: str) -> list[int]:
    """Running number of open quotes and brackets behind each character; unmatched closers do not count."""
    stack: list[str] = []
    out = []
    for k, c in enumerate(block):
        before = block[k - 1] if k else " "
        after = block[k + 1] if k + 1 < len(block) else " "
        if stack and c == stack[-1]:
            stack.pop()
        elif stack and c in "”“" and stack[-1] in "”“":
            stack.pop()
        elif c in _PAIRS:
            stack.append(_PAIRS[c])
        elif c == "„":
            stack.append("“")
        elif c == "«":
            stack.append("»")
        elif c == "»" and (before.isspace() or before in "(„") and not after.isspace():
            stack.append("«")
        elif c in "“”" and (before.isspace() or before in "(（：:，,。！？；、…—" or _spaceless(before) or not k) and not after.isspace():
            stack.append("”")
        elif c == '"' and (before.isspace() or before in "(" or not k):
            stack.append('"')
        out.append(len(stack))
    return out


def _next_word(block: str, at: int) -> tuple[str, str]:
    """(first visible character behind a place, the word there without opening quotes and brackets)."""
    while at < len(block) and block[at].isspace():
        at += 1
    first = block[at] if at < len(block) else ""
    while at < len(block) and not block[at].isalnum() and block[at] != "§" and not block[at].isspace():
        at += 1
    end = at
    while end < len(block) and (block[end].isalnum() or unicodedata.category(block[end])[0] == "M" or block[end] in "-'’"):
        end += 1
    return first, block[at:end]


def _prices(block: str, a: int, e: int, closed: bool, begins: dict[int, str]) -> tuple[float, float]:
    """(price of ending a unit at e, price of going on), for the terminators block[a:...] and the closers up to e."""
    mark = block[a:e]
    first, word = _next_word(block, e)
    before = block[a - 1] if a else " "
    lower = word[:1].islower() and not (len(word) > 1 and any(c.isupper() for c in word[1:3]))
    caseless = bool(word) and not word[0].isdigit() and word[0].lower() == word[0].upper() and word[0].isalpha()
    quote = closed and mark[-1] not in ")]）］"
    cjk = bool(_spaceless(before) == "cjk" or first and _spaceless(first) == "cjk")
    if cjk:
        at = e
        while at < len(block) and block[at].isspace():
            at += 1
        going_on = begins.get(at) == "go_on"
        if quote:
            return (1.0, 1.0 if first in "“「『\"" else 0.0) if not going_on else (4.0, 0.0)
        if mark[0] == "…":
            return (4.0, 0.0) if going_on or first in "，、,；。" else (0.5, 1.5)
        return (4.0, 0.0) if going_on and mark[0] not in "。！？!?" else (0.0, 3.0)
    if first and first in ",;:，、；：،؛":
        return 5.0, 0.0
    if quote and caseless:
        return 2.0, 0.0  # the words behind a quotation tell who says it
    if any(c in _STRONG for c in mark):
        return (4.0, 0.0) if lower else (0.0, 3.0)
    if mark[0] == ";":
        return 0.0, 2.0
    if lower:
        return 5.0, 0.0
    if mark[0] == "…" or "..." in mark:
        alone = before.isspace()
        return (2.0, 0.5) if alone and word.lower() not in OPENING_WORDS else (0.5, 1.5)
    start = a
    while start > 0 and not block[start - 1].isspace() and block[start - 1] not in "(„“«\"[":
        start -= 1
    token = block[start:a]
    key = token.lower().strip("(„“«\"'’[,")
    tail = key.rsplit("'", 1)[-1].rsplit("’", 1)[-1]
    if closed and mark[-1] in ")]" and block[a] == ".":
        pass
    if key in NEVER or tail in NEVER:
        return 5.0, 0.0
    opens = word.lower() in OPENING_WORDS or first in "§„“«\"(¿¡#" or word[:1].isdigit()
    if key in MAYBE:
        # two abbreviations in a row: the letters before belong to it too
        return (0.0, 2.0) if word[:1].isupper() or opens or caseless else (5.0, 0.0)
    if token and token[-1].isdigit():
        if token.isdigit() and len(token) <= 3:
            prior = block[max(0, start - 80) : start].split()[-1:] or [""]
            if start <= 40 and not block[:start].strip().strip("#"):
                return 5.0, 0.0  # a number that opens a block is a numbering
            if word.lower() in MONTHS or prior[0].lower().strip("(„,") in BEFORE_ORDINAL and not token.startswith("0") and word[:1].isupper() and word.lower() not in OPENING_WORDS:
                return 5.0, 0.0
        return 0.0, 2.0
    if regex.fullmatch(r"(?:\p{L}{1,4}\.)+\p{L}{1,4}", key):  # degrees and other dotted letters
        return (0.5, 1.0) if opens else (3.0, 0.0)
    if len(token) == 1 and token.isalpha():
        if caseless and not token.isupper():
            return (3.0, 0.0) if len(key) == 1 and not _spaceless(token) else (0.0, 2.0)
        return (0.5, 1.0) if opens and not token.isupper() else (4.0, 0.0)
    return 0.0, 2.5


def _gap_prices(block: str, a: int, e: int, numbering: int, edges: tuple[dict[int, str], dict[int, str]]) -> tuple[float, float]:
    """The same for a gap [a, e) in a script without terminators; numbering is the end of a number that opens the block."""
    if a <= numbering:
        return 5.0, 0.0
    left, right = block[a - 1], block[e : e + 1]
    ahead, behind = edges[0].get(e, ""), edges[1].get(a, "")
    end, go = 0.0, 1.0
    if ahead == "opener":
        go += 1.5
    if ahead == "go_on":
        end += 3.0
    if behind == "final" or left.isdigit() or left in "?!":
        go += 1.0
    if behind in ("go_on", "opener"):
        end += 3.0
    if right.isdigit() or right in ",;:)" or left in ",;:(":
        end += 2.0
    if not _spaceless(right) or not (_spaceless(left) or left.isdigit() or left in _STRONG + _CLOSE):
        end += 1.5  # foreign words and signs are set off by blanks too
    return end, go


def _ends(block: str) -> list[tuple[int, float, float]]:
    """Possible ends in ascending order: (place behind the unit, price of ending, price of going on)."""
    out: dict[int, tuple[float, float]] = {}
    n = len(block)
    edges = word_edges(block)
    opening = regex.match(r"\s*\d+", block)
    numbering = opening.end() if opening else 0
    for m in _ENDING.finditer(block):
        a, e = m.start(), m.end()
        before = block[a - 1] if a else " "
        if m.group()[0] == ";" and not ("Ͱ" <= before <= "Ͽ" or "ἀ" <= before <= "῿"):
            continue
        closed = False
        while e < n and (block[e] in _CLOSE or block[e].isspace() and e + 1 < n and block[e + 1] in "»" and (e + 2 >= n or not block[e + 2].isalnum())):
            # an ASCII or opening quote behind a blank belongs to the next unit
            if block[e] in _CLOSE:
                closed = True
            e += 1
        if e >= n:
            continue
        wide = any(c in "。！？｡" for c in m.group()) or _spaceless(block[e]) == "cjk" or _spaceless(before) == "cjk" and m.group()[0] == "…"
        if not block[e].isspace() and not wide and not (m.group()[0] in "।?!" and _spaceless(block[e]) == "gap"):
            continue
        out[e] = _prices(block, a, e, closed, edges[0])
    for m in regex.finditer(r"\s+", block):
        a, e = m.span()
        if 0 < a and e < n and a not in out and ("gap" in (_spaceless(block[a - 1]), _spaceless(block[e]))):
            out[a] = _gap_prices(block, a, e, numbering, edges)
    return [(k, *v) for k, v in sorted(out.items())]


def _units_of_block(block: str, at: int, first: bool) -> list[tuple[int, int]]:
    out = []
    if first and "\n" in block:
        line, rest = block.split("\n", 1)
        if len(line) <= 90 and _HEADING.fullmatch(line.strip()) and not regex.search(r"[.!?…,;:]$", line.strip()) and rest[:1].isupper() and _heads(line, rest):
            out.append((at, at + len(line.rstrip())))
            skip = len(line) + 1
            at, block = at + skip, block[skip:]
    ends = _ends(block)
    depth = _depth_changes(block)
    places = [0, *[e for e, _, _ in ends], len(block)]
    take = [0.0, *[x for _, x, _ in ends], 0.0]
    keep = [0.0, *[x for _, _, x in ends], 0.0]
    open_at = [0, *[depth[e - 1] for e in places[1:]]] if block else [0]
    back, begun, begin = [0] * len(places), 0.0, 0  # the cheapest way to have a unit run on, and the place it began at
    for j in range(1, len(places)):
        price = begun + take[j]
        if open_at[j] and j < len(places) - 1:
            price += _FREE
        back[j] = begin
        begun += keep[j]
        if price < begun:
            begun, begin = price, j
    cuts, j = [], len(places) - 1
    while j:
        cuts.append((places[back[j]], places[j]))
        j = back[j]
    for a, b in reversed(cuts):
        while a < b and block[a].isspace():
            a += 1
        while b > a and block[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((at + a, at + b))
    return out


def _heads(line: str, rest: str) -> bool:
    """A first line is a heading rather than the first line of broken text if the next line would have had room for more."""
    nxt = rest.split("\n", 1)[0]
    return len(line) + 1 + len(nxt.split(" ", 1)[0]) <= max(len(x) for x in rest.split("\n")) - 8 or not regex.search(r"\n", rest) and len(line) < 60


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every unit in order, as places in the text as stored. Null and blank texts have none."""
    out: list[tuple[int, int]] = []
    if not text or not text.strip():
        return out
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        block = text[at:end]
        lead = len(block) - len(block.lstrip())
        block = block.strip()
        if block:
            out += _units_of_block(block, at + lead, not out)
        at = m.end() if m else end
    return out


def sentence_units(df: DataFrame, id_col: str, text_col: str, with_text: bool = True) -> DataFrame:
    """(id, unit_no, start_pos, end_pos[, sentence]): a row for each unit of each id, numbered from 0 in order.

    Deliveries of an id count once (the smallest text, should they differ). Places count characters from 0 in the
    text as stored. Null ids are dropped; null and blank texts give no rows. Texts are shuffled once, by id with map-side
    combine, and cut where they arrive."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    source = first_delivery(source, "id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, numbers, starts, ends, texts, keep = [], [], [], [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            for no, (a, b) in enumerate(units(text)):
                keep.append(k)
                numbers.append(no)
                starts.append(a)
                ends.append(b)
                texts.append(text[a:b])
        cols = [batch.column(0).take(pa.array(keep, pa.int32())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
        names = ["id", "unit_no", "start_pos", "end_pos"]
        return pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())] if with_text else cols, names=[*names, "sentence"] if with_text else names)

    out = arrow_map(source, run, f"id {kind}, unit_no int, start_pos int, end_pos int{', sentence string' if with_text else ''}")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
