"""Problem 8: one form for texts that look the same.

The form is computed by DuckDB inside each Arrow partition: one SQL expression of nfc_normalize, translate, replace
and regexp_replace. The tables it needs are derived from the Unicode data by rule; only the look-alike letters are a
list of fixed values. Rules of the form:

* canonical composition (NFC), before and after the other steps;
* wide, narrow, mathematical and positional forms, ligatures, digraphs, Roman numerals, radicals become their letters;
  raised and lowered digits, circled forms and fractions stay, since they can be seen;
* a look-alike letter of another alphabet or block becomes the Latin (for kana: the Han) letter, with its accents;
* any hyphen becomes "-"; dashes stay;
* invisible characters go, except a joiner inside an emoji sequence, which changes the picture;
* a run of white space becomes one blank, none at the ends.
"""

from __future__ import annotations

import sys
import threading
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstack.llm.common import arrow_map, pairs_between, pairs_within, spread
from quillstack.session import materialise

#: Letters of other alphabets and the letter that they look like.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V", "Һ": "h", "Ԁ": "d",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l", "ԍ": "g", "ӕ": "æ", "Ӕ": "Æ", "ә": "ə", "Ә": "Ə", "ө": "ɵ", "Ө": "Ɵ", "ҫ": "ç", "Ҫ": "Ç",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "ɑ": "a", "µ": "μ",
    # Armenian, Cherokee, Coptic, Lisu and Latin letters of other blocks
    "օ": "o", "Օ": "O", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "Տ": "S", "Լ": "L", "յ": "j", "ա": "w",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "Ꭰ": "D", "Ꮐ": "G",
    "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲭ": "X", "ⲭ": "x", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T", "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "ɡ": "g", "Ð": "Đ", "Ɖ": "Đ", "Ǝ": "Ə",
    # kana and Han
    "ロ": "口", "ニ": "二", "カ": "力", "エ": "工", "ト": "卜", "タ": "夕", "ハ": "八", "ヘ": "へ",
}
#: The kinds of hyphen.
HYPHENS = "‐‑⁃˗−﹣－᠆"
_FORMS = {"<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Ranges whose <compat> forms look like their letters: ligatures, digraphs, numerals, radicals, Thai and Lao AM.
_COMPAT = ((0xFB00, 0xFB17), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0x2E80, 0x2FDF), (0xE33, 0xE33), (0xEB3, 0xEB3), (0x587, 0x587), (0xB5, 0xB5))
#: Invisible characters besides those of category Cf and Cc (class of a regular expression).
_INVISIBLE = (
    r"\x{00}-\x{08}\x{0E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}"
    r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}"
    r"\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}"
)
_SPACES = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{2800}\x{3000}"
#: Private-use stand-in while the other invisible characters are removed.
_KEPT_JOINER = "\ue000"


def _composed_lookalikes() -> dict[str, str]:
    """Accented letters whose base is a look-alike: the accented Latin letter, where Unicode has it as one character."""
    out = dict(LOOKALIKES)
    for code in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in LOOKALIKES:
            out[chr(code)] = unicodedata.normalize("NFC", LOOKALIKES[parts[0]] + parts[1:])
    return out


@lru_cache(maxsize=1)
def tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """(form to one character, form to several, look-alike to letter), from the Unicode data and LOOKALIKES."""
    forms: dict[str, str] = {h: "-" for h in HYPHENS}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or chr(code) in forms:
            continue
        form = unicodedata.decomposition(chr(code)).split(" ")
        if form[0] in _FORMS or form[0] == "<compat>" and any(a <= code <= b for a, b in _COMPAT):
            plain = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", chr(code)))
            if plain[:1] != " " and plain != chr(code):
                forms[chr(code)] = plain
    return {a: b for a, b in forms.items() if len(b) == 1}, {a: b for a, b in forms.items() if len(b) > 1}, _composed_lookalikes()


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _ranges(table: dict[str, str]) -> str:
    """The keys of a table as ranges of a character class."""
    codes = sorted(map(ord, table))
    out, first = [], codes[0]
    for a, b in zip(codes, [*codes[1:], -1], strict=True):
        if b != a + 1:
            out.append(rf"\x{{{first:X}}}-\x{{{a:X}}}")
            first = b
    return "".join(out)


@lru_cache(maxsize=1)
def form_sql(source: str = "batch_in") -> str:
    """The embedded SQL: (id, text, form) of a relation (id, text), step by step; null stays null."""
    single, several, alike = tables()
    one, more = {a: b for a, b in alike.items() if len(b) == 1}, {a: b for a, b in alike.items() if len(b) > 1}
    picture = r"[\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}]\x{FE0F}?"

    def translate(table: dict[str, str]) -> str:
        return f"CASE WHEN regexp_matches(t, '[{_ranges(table)}]') THEN translate(t, {_sql(''.join(table))}, {_sql(''.join(table.values()))}) ELSE t END"

    def expand(table: dict[str, str]) -> str:
        known = f"MAP {{{', '.join(f'{_sql(a)}: {_sql(b)}' for a, b in table.items())}}}"
        spelt = f"array_to_string(list_transform(string_split(t, ''), lambda c: coalesce(map_extract_value({known}, c), c)), '')"
        return f"CASE WHEN regexp_matches(t, '[{_ranges(table)}]') THEN {spelt} ELSE t END"

    steps = (
        "nfc_normalize(text)",
        rf"regexp_replace(t, '({picture})\x{{200D}}', '\1{_KEPT_JOINER}', 'g')",  # a joiner behind a picture stays
        f"regexp_replace(t, '[{_INVISIBLE}]+', '', 'g')",
        expand(several),
        f"nfc_normalize({translate(single)})",  # a narrow letter and its mark are one letter before look-alikes are sought
        expand(more),
        f"nfc_normalize({translate(one)})",
        f"trim(regexp_replace(t, '[{_SPACES}]+', ' ', 'g'))",
    )
    query = f"SELECT id, text, text AS t FROM {source}"
    for step in steps:
        query = f"SELECT id, text, {step} AS t FROM ({query})"
    return f"SELECT id, text, t AS form FROM ({query})"


_LOCAL = threading.local()


def _duck():
    con = getattr(_LOCAL, "con", None)
    if con is None:
        import duckdb

        con = _LOCAL.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
    return con


def unify(df: DataFrame, id_col: str, text_col: str, keep_form: bool = True, balance: bool = True) -> DataFrame:
    """(id, form string, form_key binary, text_key binary), a row for each row of df.

    form is the one form of the text ("" if nothing can be seen, null for null); form_key and text_key are 128-bit
    digests of the form and of the text as stored. keep_form=False leaves the form out."""
    kind = df.schema[id_col].dataType.simpleString()
    shown = "form, " if keep_form else ""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        con = _duck()
        con.register("batch_in", pa.Table.from_batches([batch]))
        try:
            out = con.sql(f"SELECT id, {shown}CASE WHEN form <> '' THEN unhex(md5(form)) END AS form_key, unhex(md5(text)) AS text_key FROM ({form_sql()})").to_arrow_table()
        finally:
            con.unregister("batch_in")
        return out.combine_chunks().cast(_schema(batch.schema.field(0).type, keep_form)).to_batches()[0] if out.num_rows else _nothing(batch, keep_form)

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = arrow_map(spread(source) if balance else source, run, f"id {kind}, {'form string, ' if keep_form else ''}form_key binary, text_key binary", rows=10_000)
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def _schema(kind: pa.DataType, keep_form: bool) -> pa.Schema:
    fields = [pa.field("id", kind), pa.field("form", pa.string()), pa.field("form_key", pa.binary()), pa.field("text_key", pa.binary())]
    return pa.schema(fields if keep_form else [fields[0], *fields[2:]])


def _nothing(batch: pa.RecordBatch, keep_form: bool) -> pa.RecordBatch:
    schema = _schema(batch.schema.field(0).type, keep_form)
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


def _spelled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form_key, cls) of the ids whose form is written in several ways; cls is the digest of the text as stored."""
    keys = materialise(unify(df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()), id_col, text_col, keep_form=False), "forms")
    code = F.xxhash64("text_key")
    mixed = keys.where("form_key IS NOT NULL").groupBy("form_key").agg(F.min(code).alias("a"), F.max(code).alias("b")).where("a <> b").select("form_key")
    return materialise(keys.join(mixed, "form_key", "left_semi").select(id_col, "form_key", F.col("text_key").alias("cls")).distinct(), "spelled")


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str, a: str, b: str) -> DataFrame:
    """Pairs of ids whose texts have one form but differ as stored, the smaller id first.

    Only digests are shuffled, and after one grouping by form with map-side combine only forms with several spellings go
    on. Equal texts are one class: links are formed between the spellings of a form and then expanded to ids, both part
    by part, so that a hot form or text is dealt over the cluster. Null texts, texts without a visible character and null
    ids give no pair; a repeated row counts once."""
    spelled = _spelled(df, id_col, text_col)
    spellings = spelled.select(F.col("form_key").alias("cls"), F.col("cls").alias("text_key")).distinct()
    links = pairs_within(spellings, "text_key", "cls_a", "cls_b")
    return pairs_between(spelled.select(id_col, "cls"), links, id_col, a, b)


def lookalike_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form_id, spelling_id, n_links): the compact form of the pairs, a row for each id that has some; n_links counts
    the other spellings of its form."""
    spelled = _spelled(df, id_col, text_col)
    ways = spelled.groupBy("form_key").agg((F.count_distinct("cls") - 1).alias("n_links"))
    return spelled.join(ways, "form_key").select(id_col, F.lower(F.hex("form_key")).alias("form_id"), F.lower(F.hex("cls")).alias("spelling_id"), "n_links")
