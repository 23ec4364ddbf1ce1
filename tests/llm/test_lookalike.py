import unicodedata

import pytest

from quillstack.llm import lookalike as look

SAME = [
    ("Prüfung", unicodedata.normalize("NFD", "Prüfung")), ("Modul 12", "Ｍｏｄｕｌ　１２"), ("Modul", "Mοdul"), ("Akte", "Аktе"), ("fließt", "ﬂießt"), ("finden", "ﬁnden"), ("ab", "a​b"), ("ab", "a­b"), ("a b", "a b"), ("a b", " a \n\n b "),
    ("E-Mail", "E‑Mail"), ("Noël", "Noёl"), ("ёж", "ëж"), ("text", "𝐭𝐞𝐱𝐭"), ("XII", "Ⅻ"), ("カタ", "ｶﾀ"), ("ガ", "ｶﾞ"), ("한글", unicodedata.normalize("NFD", "한글")), ("ab", "﻿a⁠b‍"), ("น้ำ", "น้ํา"), ("ω", "𝜔"), ("ó", "ό"),
]
OTHER = [("a", "ä"), ("a", "A"), ("m2", "m²"), ("a-b", "a–b"), ("H2O", "H₂O"), ("“a”", '"a"'), ("ab", "a b"), ("1", "l"), ("o", "0"), ("①", "1"), ("½", "1/2"), ("Straße", "Strasse"), ("👩‍🎓", "👩🎓")]


@pytest.fixture(scope="module")
def forms(spark):
    texts = sorted({t for pair in SAME + OTHER for t in pair} | {"", " ​", "ab"})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.form for r in look.unify(df, "doc_id", "text").collect()}
    return {t: got[i] for i, t in enumerate(texts)} | {None: got[999]}


def test_same(forms):
    for a, b in SAME:
        assert forms[a] == forms[b], (a, b, forms[a], forms[b])


def test_different(forms):
    for a, b in OTHER:
        assert forms[a] != forms[b], (a, b)


def test_nothing_visible(forms):
    assert forms[""] == forms[" ​"] == "" and forms[None] is None


def test_forms_are_stable(spark, forms):
    df = spark.createDataFrame([(i, f) for i, f in enumerate(sorted({f for f in forms.values() if f}))], "doc_id bigint, text string")
    twice = {r.doc_id: r.form for r in look.unify(df, "doc_id", "text").collect()}
    assert all(twice[r.doc_id] == r.text for r in df.collect())


def test_pairs(spark):
    rows = [(1, "Plan A"), (2, "Рlan A"), (3, "Plan A"), (4, "Plan  A"), (5, "plan A"), (6, None), (7, ""), (8, "​"), (2, "Рlan A"), (9, "einzeln"), (None, "Plan  A"), (10, "x" * 100_000), (11, "х" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, form int")
    got = sorted(tuple(r) for r in look.lookalike_pairs(df, "doc_id", "text", "a", "b").collect())
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11)]
    assert look.lookalike_pairs(df.where("false"), "doc_id", "text", "a", "b").count() == 0


def test_tables_come_from_the_unicode_data():
    single, several, alike = look.tables()
    assert len(single) > 1000 and single["Ａ"] == "A" and several["ﬃ"] == "ffi" and "²" not in single and "½" not in several
    assert alike["Ё"] == "Ë" and not any(a in t for t in (single, several, alike) for a in "abcABC0123")


def test_hot_form_in_compact_and_full(spark, monkeypatch):
    """A third of the rows are one text; its other spelling is linked to each of them, whatever the size of parts."""
    from quillstack.llm import common

    monkeypatch.setattr(common, "PART_IDS", 7)
    rows = [(i, "Plan der Stelle") for i in range(50)] + [(100, "Plan der  Stelle"), (101, "Рlan der Stelle")] + [(200 + i, f"Text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in look.lookalike_pairs(df, "doc_id", "text", "a", "b").collect())
    assert got == sorted([(i, j) for i in range(50) for j in (100, 101)] + [(100, 101)])
    classes = look.lookalike_classes(df, "doc_id", "text").collect()
    assert len(classes) == 52 and {r.n_links for r in classes} == {2} and len({r.form_id for r in classes}) == 1 and len({r.spelling_id for r in classes}) == 3


def test_pairs_inside_classes_part_by_part(spark, monkeypatch):
    from quillstack.llm import common

    monkeypatch.setattr(common, "PART_IDS", 4)
    df = spark.createDataFrame([(i, "a" if i < 30 else f"b{i}") for i in range(40)] + [(3, "a")], "id int, cls string")
    got = sorted(tuple(r) for r in common.pairs_within(df, "id", "x", "y").collect())
    assert got == [(i, j) for i in range(30) for j in range(i + 1, 30)]
