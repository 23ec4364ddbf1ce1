import random

import pytest
import regex

from quillstack.llm import tree_split as ts

UNITS = (("characters", 60, 10), ("counter_tokens", 20, 7), ("characters", 5, 0), ("counter_tokens", 3, 2), ("characters", 4000, 200))


def size(text, unit):
    return len(text) if unit == "characters" else len(regex.findall(r"[\p{L}\p{N}]{1,4}|[^\p{White_Space}\p{L}\p{N}]", text))


def check(text, unit, limit, overlap):
    pieces = ts.split_text(text, unit, limit, overlap)
    assert pieces[0].core == 0 and pieces[-1].end == len(text)
    assert (len(pieces) > 1) == (size(text, unit) > limit)
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert a.end == b.core and b.start >= a.start
        assert size(text[b.start : b.core], unit) == overlap == b.overlap
    for p in pieces:
        assert size(text[p.start : p.end], unit) == p.size <= limit
    return [text[p.core : p.end] for p in pieces]


def test_random_texts():
    rnd = random.Random(5)
    bits = ["Haus ", ". ", "\n", "\n\n", "# A\n", "漢字", "- x\n", "  - y\n", "a" * 30, "́", "  ", "1.2 Titel\n", "| a | b |\n", "<h2>T</h2>\n", " ", "\r\n\r\n"]
    for _ in range(800):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 200)))
        for unit, limit, overlap in UNITS:
            check(text, unit, limit, overlap)


def test_cuts_at_boundaries():
    text = "# A\n\n" + "Satz eins ist hier. " * 4 + "\n\n## B\n\n" + "Satz zwei ist da. " * 4 + "\n\n# C\n\n" + "Ende gut, alles gut. " * 3
    cores = check(text, "characters", 130, 20)
    assert [c[:4] for c in cores][:2] == ["# A\n", "## B"] and cores[-1].startswith("# C")
    sentences = check("Ein Satz steht hier. " * 30, "characters", 100, 20)
    assert all(c.endswith(". ") for c in sentences)
    items = check("".join(f"- Punkt {i} der Liste\n" for i in range(30)), "characters", 90, 10)
    assert all(c.startswith("- Punkt") for c in items)


def test_heading_stays_with_its_text():
    text = "Vorher steht Text. " * 4 + "\n\n# Titel\n\n" + "Danach steht Text. " * 6
    cores = check(text, "characters", 120, 10)
    assert not any(c.rstrip().endswith("# Titel") for c in cores)


def test_no_boundary_at_all():
    assert len(check("x" * 10_000, "characters", 4000, 200)) == 3
    assert len(check("x" * 1_000_000, "counter_tokens", 512, 100)) > 500


def test_bad_sizes(spark):
    for limit, overlap in ((5, 5), (5, -1)):
        with pytest.raises(ValueError):
            ts.split_text("x", "characters", limit, overlap)
    df = spark.createDataFrame([("a", "b")], "id string, text string")
    with pytest.raises(ValueError):
        ts.split_items(df, "k", "id", "text", "words", 5, 1)


def test_items(spark):
    long = "Wort " * 30
    rows = [(1, long, 3), (1, long, None), (2, "kurz", 900), (3, None, 1), (4, "", 1), (5, "a" * 20, 1), (6, "a" * 21, 1), (None, long, 1)]
    df = spark.createDataFrame(rows, "item_id bigint, text string, size int")
    got = ts.split_items(df, "k", "item_id", "text", "characters", 20, 4).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.item_id, r.piece_index)):
        by.setdefault(r.item_id, []).append(r)
    assert set(by) == {"1", "2", "5", "6"} and len(by["2"]) == len(by["5"]) == 1 and len(by["6"]) == 2
    assert all(r.n_pieces == len(by[r.item_id]) and r.piece == long[r.start_pos : r.end_pos] for r in by["1"])
    some = ts.split_items(df, "k", "item_id", "text", "characters", 20, 4, only_oversized=True)
    assert {r.item_id for r in some.collect()} == {"1", "6"}
    assert ts.split_items(df.where("false"), "k", "item_id", "text", "counter_tokens", 20, None).count() == 0


def test_tokens_are_counted_not_believed(spark):
    df = spark.createDataFrame([("a", "x y z", 999), ("b", "x y z u", 1), ("c", "ab　cd ef", 0)], "chunk_id string, text string, token_count int")
    got = {r.item_id: r.n_pieces for r in ts.split_items(df, "chunk", "chunk_id", "text", "counter_tokens", 3, 1).collect()}
    assert got["a"] == 1 and got["b"] > 1 and got["c"] == 1


def test_deliveries_that_differ_give_one_set_of_pieces(spark):
    df = spark.createDataFrame([("a", "kurz"), ("a", "lang " * 50), ("b", "kurz"), ("b", "kurz")], "k string, t string")
    got = ts.split_items(df, "page", "k", "t", "characters", 60, 10).collect()
    assert {r.item_id: r.n_pieces for r in got} == {"a": len([r for r in got if r.item_id == "a"]), "b": 1} and len([r for r in got if r.item_id == "b"]) == 1


def test_nested_items_are_cut_between_outer_ones():
    text = "".join(f"- Punkt {i}\n" + "".join(f"  - Teil {i}{j}\n" + "".join(f"    - Stück {i}{j}{k}\n" for k in range(3)) for j in range(3)) for i in range(4))
    size = len(text) // 4 + 12
    cores = [text[p.core : p.end] for p in ts.split_text(text, "characters", size, 0)]
    assert "".join(cores) == text and all(c.startswith("- Punkt") for c in cores)
