import random

from quillstack.llm import repetition as rep


def brute(text, window=40):
    s = " ".join((text or "").lower().split())
    seen, again = set(), bytearray(len(s))
    for i in range(len(s) - window + 1):
        w = s[i : i + window]
        if w in seen:
            again[i : i + window] = b"\1" * window
        seen.add(w)
    return sum(again), len(s)


def test_share_equals_brute_force():
    rnd = random.Random(1)
    parts = ["Der Antrag ist gestellt. ", "xy", "漢字かな", "  ", "\n", "A" * 50, "Ein ganz anderer Satz mit Länge. ", "İ", "😀"]
    for _ in range(600):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        assert rep.repeated_share(text) == brute(text)
        assert rep.repeated_share(text, 5) == brute(text, 5)
        s = rep.normal(text)
        assert rep._by_slices(s, 40) == brute(text)[0]


def test_ends():
    assert rep.repeated_share(None) == rep.repeated_share(" \n") == (0, 0)
    assert rep.repeated_share("a" * 40) == (0, 40) and rep.repeated_share("a" * 41) == (40, 41)
    base = "".join(chr(97 + i % 26) + str(i) for i in range(100))[:100]
    assert rep.repeated_share(base + base) == (100, 200)


def test_very_long_text():
    text = "Wort und noch ein Wort im Satz ohne Ende. " * 20_000
    repeated, n = rep.repeated_share(text)
    assert repeated == n - 42 + 0 and n > 800_000


def test_distances():
    german = "Die Prüfung ist in der Ordnung geregelt und wird von der Hochschule im Semester für die Studierenden durchgeführt. " * 2
    chars, words = rep.divergence(german)
    junk_chars, junk_words = rep.divergence("###### ****** %%%% ==== " * 20)
    assert chars < junk_chars and words < 0.4 < junk_chars
    assert rep.divergence("kurz") == (None, None) == rep.divergence(None)
    assert rep.js_distance({"a": 1}, {"a": 5}) == 0 and abs(rep.js_distance({"a": 1}, {"b": 1}) - 1) < 1e-9 and rep.js_distance({}, {"a": 1}) == 1.0


def test_profile(spark):
    double = "Ein langer Satz über die Ordnung der Prüfungen an der Hochschule steht hier. " * 2
    rows = [(1, double, 0.5), (1, double, 0.5), (2, None, None), (3, "", 1.0), (4, "kurz", 1.0), (None, "x", 1.0)]
    df = spark.createDataFrame(rows, "page_id bigint, content string, repeated_share double")
    got = {r.page_id: r for r in rep.repetition_profile(df, "page_id", "content").collect()}
    assert len(got) == 5 and 0.45 < got[1].repeated_share < 0.51
    assert got[2].repeated_share == got[3].repeated_share == got[4].repeated_share == 0.0 and got[2].n_chars == 0
    assert rep.repetition_profile(df.where("false"), "page_id", "content").count() == 0
