import random

import pytest
from pyspark.sql import functions as F

from quillstack.functions.where import any_starts_with, apply_where
from quillstack.operators import retrieval as ret


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("a_0", "a", 0, "eins", None, "a_1", [1.0, 0.0]), ("a_1", "a", 1, "zwei", "a_0", "a_2", [0.9, 0.1]), ("a_2", "a", 2, "drei", "a_1", None, [0.0, 1.0]), ("b_0", "b", 0, "vier", None, None, [-1.0, 0.0]), ("z", "z", 0, "null", None, None, [0.0, 0.0])]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string, prev_chunk_id string, next_chunk_id string, embedding array<float>")


@pytest.mark.parametrize(("metric", "order"), [("cosine", ["a_0", "a_1", "a_2", "b_0"]), ("l2", ["a_0", "a_1", "z", "a_2"]), ("ip", ["a_0", "a_1", "a_2", "z"])])
def test_ranking(corpus, metric, order):
    got = ret.search(corpus, [1.0, 0.0], 4, metric).collect()
    assert [r.chunk_id for r in got] == order
    assert got[0].distance == 0.0 and got[0].similarity == 1.0


def test_more_asked_than_there(corpus):
    assert ret.search(corpus, [1.0, 0.0], 99).count() == 4  # the zero vector has no cosine
    with pytest.raises(ValueError):
        ret.search(corpus, [1.0, 0.0], 0)


def test_filter_comes_first(corpus):
    got = ret.search(corpus, [1.0, 0.0], 1, where={"document_id": {"$ne": "a"}}).collect()
    assert [r.chunk_id for r in got] == ["b_0"]
    assert ret.search(corpus, [1.0, 0.0], 9, where={}).count() == 4


def test_many_equal_single(spark, corpus):
    queries = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.2, 0.7]), ("q0", [0.0, 0.0]), ("qn", None)], "query_id string, vector array<float>")
    for metric in ("cosine", "l2", "ip"):
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.distance) for r in ret.search_many(corpus, queries, 3, metric).collect()}
        for q, v in (("q1", [1.0, 0.0]), ("q2", [0.2, 0.7])):
            for i, r in enumerate(ret.search(corpus, v, 3, metric).collect()):
                assert got[q, i + 1][0] == r.chunk_id and abs(got[q, i + 1][1] - r.distance) < 2e-6
    assert not ret.search_many(corpus, queries.where("false"), 3).count()
    with pytest.raises(ValueError):
        ret.search_many(corpus, queries, 0)


def test_blocks_and_ties(spark, monkeypatch):
    rnd = random.Random(7)
    vectors = [[float(rnd.randint(-2, 2)) for _ in range(3)] for _ in range(300)]
    corpus = spark.createDataFrame([(f"c{i:03d}", v) for i, v in enumerate(vectors)] + [("n", None), ("s", [1.0])], "chunk_id string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(vectors[:25])], "query_id string, vector array<float>")
    monkeypatch.setattr(ret, "QUERY_BLOCK", 10)
    monkeypatch.setattr(ret, "CORPUS_ROWS", 40)
    got = {(r.query_id, r["rank"]): r.chunk_id for r in ret.search_many(corpus, queries, 4, "l2").collect()}
    for q, v in enumerate(vectors[:25]):
        want = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), f"c{i:03d}") for i, w in enumerate(vectors))[:4]
        assert [got[f"q{q}", n + 1] for n in range(4)] == [name for _, name in want]


def test_index(spark):
    """Every row lies in one list; all lists give the exact result, few lists nearly so; odd rows harm nothing."""
    rnd = random.Random(8)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    vectors = [[c + rnd.gauss(0, 0.4) for c in rnd.choice(centres)] for _ in range(600)]
    rows = [(f"c{i:03d}", v) for i, v in enumerate(vectors)] + [("n", None), ("s", [1.0]), ("z", [0.0] * 8), (None, vectors[0]), ("h", [None] * 8)]
    corpus = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(vectors[::12])] + [("qn", None)], "query_id string, vector array<float>")
    fitted = ret.fit_index(corpus, lists=6, sample_rows=300)
    assert len(fitted) == 6 and ret.assign_lists(corpus.where("chunk_id IS NOT NULL"), "embedding", fitted).count() == len(rows) - 1
    exact = {(r.query_id, r["rank"]): r.chunk_id for r in ret.search_many(corpus, queries, 5).collect()}
    assert len(exact) == 250
    for probes, least in ((6, 1.0), (2, 0.9)):
        got = {(r.query_id, r.chunk_id) for r in ret.search_index(corpus, queries, fitted, 5, probes).collect()}
        assert len(got & {(q, c) for (q, _), c in exact.items()}) >= least * 250
    assert ret.fit_index(corpus.where("false")) == [] and ret.search_index(corpus.where("false"), queries, [], 5).count() == 0


def test_neighbours(spark, corpus):
    hits = spark.createDataFrame([("q", "a_1", 0.5, 0.5), ("q", "a_2", 0.6, 0.4)], "query_id string, chunk_id string, distance double, similarity double")
    got = {r.chunk_id: (r.is_hit, r.distance) for r in ret.expand_neighbours(hits, corpus).collect()}
    assert got == {"a_0": (False, 0.0), "a_1": (True, 0.5), "a_2": (True, 0.6)}


def plain_budget(rows, most):
    taken, total, before = [], 0, None
    for doc, index, tokens in rows:
        if total + tokens + (3 if taken else 0) > most:
            if not taken:
                taken.append((doc, index, False))
            break
        gap = bool(taken) and (doc != before[0] or index > before[1] + 1)
        total += tokens + 3 * gap
        taken.append((doc, index, gap))
        before = (doc, index)
    return taken


def test_budget_equals_brute_force(spark):
    rnd = random.Random(4)
    sets = {f"q{q}": sorted({(rnd.choice("abc"), rnd.randint(0, 12)): rnd.randint(1, 40) for _ in range(rnd.randint(1, 9))}.items()) for q in range(60)}
    rows = [(q, f"{d}_{i:02d}", d, i, "x " * t, 0.0, 1.0, True) for q, s in sets.items() for (d, i), t in s]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, document_id string, chunk_index int, text string, distance double, similarity double, is_hit boolean")
    for most in (5, 50, 120):
        got = {}
        for r in ret.budget(df, most).where("included").orderBy("query_id", "position").collect():
            got.setdefault(r.query_id, []).append((r.document_id, r.chunk_index, r.separated))
        assert got == {q: plain_budget([(d, i, t) for (d, i), t in s], most) for q, s in sets.items()}


def test_context_text(spark, corpus):
    hits = spark.createDataFrame([("q", "a_0", 0.0, 1.0), ("q", "a_2", 0.1, 0.9), ("q", "b_0", 0.2, 0.8)], "query_id string, chunk_id string, distance double, similarity double")
    row = ret.retrieve(corpus, hits, 100, expand=False).first()
    assert row.context_text == "eins\n\n---\n\ndrei\n\n---\n\nvier" and row.total_results == 3 and row.token_count == 9
    assert ret.retrieve(corpus, hits, 1, expand=False).first().context_text == "eins"
    assert ret.retrieve(corpus, hits.where("false"), 9).count() == 0


def test_where_operators(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "n int, s string")
    ids = lambda w: [r.n for r in apply_where(df, w).orderBy("n").collect()]
    assert ids(None) == [1, 2, 3] and ids({}) == [1, 2, 3] and ids({"s": "x"}) == [1]
    assert ids({"n": {"$gt": 1, "$lte": 3}}) == [2, 3] and ids({"n": {"$gte": 2}, "s": {"$eq": "y"}}) == [2] and ids({"n": {"$lt": 2}}) == [1]
    assert ids({"s": {"$ne": "x"}}) == [2, 3] and ids({"s": {"$nin": ["x"]}}) == [2, 3] and ids({"s": {"$in": ["x", "y"]}}) == [1, 2]
    assert ids({"$or": [{"n": 1}, {"s": "y"}]}) == [1, 2] and ids({"$and": [{"n": {"$gt": 1}}, {"s": "y"}]}) == [2]
    for bad in ({"n": {"$like": 1}}, {"$not": []}):
        with pytest.raises(ValueError):
            apply_where(df, bad)


def test_prefix_match(spark):
    df = spark.createDataFrame([(["nomic-embed:latest", "x"],), ([],), (None,)], "a array<string>")
    assert [r[0] for r in df.select(any_starts_with(F.col("a"), "nomic")).collect()] == [True, False, False]
