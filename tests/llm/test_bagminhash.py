import random
import threading
from pathlib import Path

import numpy as np

from quillstack.llm import bagminhash as bmh, groups

WORDS = [f"w{i}" for i in range(4000)]


def similarity(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b) if a | b else 0.0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    for a, b in (([1] * 40 + [0] * 20, [0] * 10 + [1] * 50), ([3] * 20 + [5] * 10, [1] * 20 + [7] * 10), ([1, 9, 0], [4, 2, 100]), ([1] * 5, [1] * 5)):
        words = rng.integers(0, 2**63, len(a)).astype(np.uint64)
        a, b = np.array(a), np.array(b)
        bag = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = bmh.signatures(bag, np.concatenate([words[a > 0], words[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 8192)
        assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    sizes = [1, 3, 50, 400]
    words = [rng.integers(0, 2**63, n).astype(np.uint64) for n in sizes]
    weights = [rng.integers(1, 9, n) for n in sizes]
    bag = np.repeat(np.arange(len(sizes)), sizes)
    together = bmh.signatures(bag, np.concatenate(words), np.concatenate(weights), len(sizes), 64)
    for k, (w, n) in enumerate(zip(words, weights, strict=True)):
        assert (bmh.signatures(np.zeros(len(w), int), w, n, 1, 64)[0] == together[k]).all()


def corpus(rnd):
    texts = []
    for g in range(40):
        base = rnd.sample(WORDS, rnd.randint(15, 60))
        for _ in range(rnd.randint(1, 5)):
            t = list(base)
            for _ in range(rnd.randint(0, len(t) // 6)):
                t[rnd.randrange(len(t))] = rnd.choice(WORDS)
            rnd.shuffle(t) if rnd.random() < 0.3 else None
            texts.append((f"c{g}_{len(texts)}", " ".join(t)))
    return texts


def test_pairs_equal_brute_force(spark):
    rows = corpus(random.Random(2))
    rows += [("same1", "Ein  Text\nhier x"), ("same2", "ein text hier X"), ("same3", "hier ein x text"), ("empty", ""), ("blank", " \n"), ("null", None), ("one", "Wort"), ("two", "wort")]
    df = spark.createDataFrame([(*r, 7) for r in rows] + [(*rows[0], 8), (None, "Ein Text hier x", 9)], "chunk_id string, text string, cls int")
    got = bmh.near_duplicate_pairs(df, "chunk_id", "text", 0.75, "a", "b").collect()
    want = {(x, y) for x, s in rows for y, t in rows if x < y and s and t and similarity(s, t) >= 0.75}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and len(want) > 20
    assert bmh.near_duplicate_pairs(df.where("false"), "chunk_id", "text", 0.75, "a", "b").count() == 0


def test_weighted_pairs(spark):
    rows = [("a", "x x x y z u v w"), ("b", "x x x y z u v w w"), ("c", "x y z u v w"), ("d", "x x x x x x x x y z")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {tuple(r) for r in bmh.near_duplicate_pairs(df, "id", "text", 0.7, "a", "b", weights="count").collect()}
    assert got == {("a", "b"), ("a", "c")}


def test_hot_class(spark):
    """A third of all rows are the same text: one class, and all its pairs."""
    rows = [(f"h{i:03d}", "immer der gleiche text in jeder zeile") for i in range(60)] + corpus(random.Random(3))[:30]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    members, links = bmh.near_duplicates(df, "chunk_id", "text", 0.75)
    assert members.select("cls").distinct().count() <= 31
    pairs = bmh.near_duplicate_pairs(df, "chunk_id", "text", 0.75, "a", "b")
    assert pairs.where("a LIKE 'h%'").count() == 60 * 59 // 2
    got = groups.membership(members, links, "chunk_id").where("chunk_id LIKE 'h%'")
    assert got.select("group_id").distinct().count() == 1 and got.agg({"n_links": "max"}).first()[0] == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(bytes([0, i]), bytes([0, i + 1])) for i in range(30)] + [(bytes([1, rnd.randrange(9)]), bytes([1, 9 + rnd.randrange(9)])) for _ in range(12)] + [(b"\x02\x01", b"\x02\x01")]
    df = spark.createDataFrame(edges, "cls_a binary, cls_b binary")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert {bytes(r.cls): bytes(r.root) for r in groups.components(df).collect()} == {k: v for k, v in want.items() if k != v}


def test_rounds_parts_and_hot_bands_keep_all_pairs(spark, monkeypatch):
    """As brute force finds them, with a round for each plane, all parts, and bands expanded by lists of classes."""
    for name, value in (("ROUND_KEYS", 1), ("PART_BYTES", 1), ("HOT", 3), ("BLOCK_WORDS", 100), ("SEEN", 2)):
        monkeypatch.setattr(bmh, name, value, raising=False)
    rnd = random.Random(5)
    base = rnd.sample(WORDS, 40)
    rows = corpus(rnd)[:40] + [(f"h{i:02d}", " ".join([*base, f"x{i}"])) for i in range(25)] + [(f"k{i}", " ".join(base)) for i in range(4)]
    df = spark.createDataFrame(rows, "id string, text string")
    for weights in ("set", "count"):
        got = bmh.near_duplicate_pairs(df, "id", "text", 0.75, "a", "b", weights=weights).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(x, y) for x, s in rows for y, t in rows if x < y and similarity(s, t) >= 0.75}


def test_disk_stays_below_a_bound_a_record(spark, monkeypatch):
    """Shuffle files and written tables at any time, for records that resemble each other by a fifth; a plane a round."""
    monkeypatch.setattr(bmh, "ROUND_KEYS", 1, raising=False)
    rng = np.random.default_rng(6)
    n, often = 6000, " ".join(f"o{k}" for k in range(20))
    df = spark.createDataFrame([(i, f"{often} " + " ".join(f"w{w}" for w in rng.integers(0, 20000, 40))) for i in range(n)], "id int, text string").localCheckpoint()
    shuffles = [Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    tables = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))

    def used():
        total = 0
        for p in [p for d in shuffles for p in d.rglob("shuffle_*")] + list(tables.rglob("*.parquet")):
            try:
                total += p.stat().st_size
            except OSError:
                pass
        return total

    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    before, most, over = used(), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            most[0] = max(most[0], used() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        _, links = bmh.near_duplicates(df, "id", "text", 0.75)
    finally:
        over.set()
        watcher.join()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert links.count() == 0
    assert max(most[0], used() - before) < 1400 * n


def test_bands_of_a_plane():
    """Two bands share one component at most; the planes for each length miss a pair at 0.75 hardly ever."""
    rng = np.random.default_rng(7)
    for r, (p, slopes, planes) in bmh.PLANES.items():
        bands = bmh.lines(r, p, slopes)
        on = np.zeros((len(bands), r * p), int)
        on[np.arange(len(bands))[:, None], bands] = 1
        assert ((on @ on.T)[~np.eye(len(bands), dtype=bool)] <= 1).all() and (on.sum(axis=1) == r).all()
        agree = rng.random((4000, r * p)) < 0.75
        assert (1 - agree[:, bands].all(axis=2).any(axis=1).mean()) ** planes < 3e-5
    sizes = [bmh.band_length(n) for n in (0, 1, 10**4, 10**5, 10**6, 10**7, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] == min(bmh.PLANES) and sizes[-1] == max(bmh.PLANES)


def test_sql(spark, data):
    from compare import against_sql

    from quillstack.llm.queries import oracle_sql, queries

    for name, sql in oracle_sql().items():
        against_sql(queries()[name](spark, data), sql, data)
