"""From query vectors to a context text within a budget: top-k, neighbours, order, budget."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstack.functions.tokens import Counter, count_tokens
from quillstack.functions.vectors import METRICS, distance
from quillstack.functions.where import apply_where
from quillstack.session import materialise

SEPARATOR, SEPARATOR_TOKENS = "---", 3


def search(corpus: DataFrame, vector: list[float], k: int = 3, metric: str = "cosine", where: Mapping[str, Any] | None = None) -> DataFrame:
    """The k nearest rows of corpus (chunk_id, embedding, ...), best first, ties by chunk_id, with distance and similarity.

    The filter comes before the distance and reaches the scan; each task keeps its own k best. Distances that are not
    defined (a zero vector) are left out. Fewer rows than k give all of them."""
    if k < 1:
        raise ValueError("k must be at least 1")
    d = distance(F.col("embedding"), F.lit([float(x) for x in vector]), metric, sum(float(x) ** 2 for x in vector) ** 0.5)
    scored = apply_where(corpus, where).withColumn("_d", d).where("_d IS NOT NULL").orderBy("_d", "chunk_id").limit(k)
    return scored.select(*[c for c in corpus.columns if c != "embedding"], (F.round("_d", 6) + 0.0).alias("distance"), (F.round(1 - F.col("_d"), 6) + 0.0).alias("similarity"))


#: Queries of one block on average, corpus rows compared at a time, and parts in which a block meets the corpus for each
#: core: together they bound the memory of a task and the rows it passes on.
QUERY_BLOCK, CORPUS_ROWS, PARTS_A_CORE = 2000, 1000, 2
_NEAR = "query_id string, chunk_id string, d double"


def _packs(rows: DataFrame, id_col: str, vector: str, keys: list[str], size: int | None = None) -> DataFrame:
    """(keys, ids, width, vectors): rows of the same keys and vector length in packs of at most `size`, one behind another
    within each task; vectors are 8-byte floats in a row. Null ids and vectors, and vectors with nulls, are left out."""
    size = size or CORPUS_ROWS
    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    light = rows.select(*keys, F.col(id_col).cast("string").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                lists = batch.column("v")
                widths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
                sound = widths > 0
                if flat.null_count:
                    sound &= np.array([v.is_valid and not v.values.null_count for v in lists])
                values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
                begins = np.concatenate([[0], np.cumsum(widths)])[:-1]
                marks = [widths.tolist(), *[batch.column(k).to_pylist() for k in keys]]
                groups: dict[tuple, list[int]] = {}
                for i in np.flatnonzero(sound).tolist():
                    groups.setdefault(tuple(m[i] for m in marks), []).append(i)
                ids = batch.column("id")
                for (width, *key), members in groups.items():
                    picked = values[(begins[members][:, None] + np.arange(width)).ravel()]
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array([x], batch.schema.field(k).type) for k, x in zip(keys, key, strict=True)], pa.array([ids.take(pa.array(members)).to_pylist()], pa.list_(pa.string())), pa.array([width], pa.int32()), pa.array([picked.tobytes()], pa.binary())],
                        names=[*keys, "ids", "width", "vectors"],
                    )

    return light.mapInArrow(run, f"{kinds}ids array<string>, width int, vectors binary")


def _meeting(asked: DataFrame, packs: DataFrame) -> DataFrame:
    """Packs of queries and of the corpus with one part, block and width behind one another, queries first; both have
    (part, block, width, ids, vectors)."""
    names = ("part", "block", "width", "ids", "vectors")
    both = asked.select(*names, F.lit(False).alias("given")).unionByName(packs.select(*names, F.lit(True).alias("given")))
    return both.repartition("part", "block", "width").sortWithinPartitions("part", "block", "width", "given")


def _nearest(met: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_id, chunk_id, d): for each part at least the k nearest rows of every query there. met: _meeting.

    Of what a query has seen in a part only the k best are kept, ties by chunk_id."""

    def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if metric == "ip":
            return 1.0 - q @ x.T
        if metric == "l2":
            return (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T
        a, b = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        d = 1.0 - (q / np.where(a > 0, a, 1.0)[:, None]) @ (x / np.where(b > 0, b, 1.0)[:, None]).T
        d[:, b == 0] = np.inf
        d[a == 0] = np.inf
        return d

    def run(batches):
        key, packs, q_ids, q, limit, held = None, [], [], None, None, []

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The k best of what is held for each query, and their limits."""
            at, d, names = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((names, d, at))
            at, d, names = at[order], d[order], names[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            full = rank == k - 1
            limit[at[full]] = d[full]
            return at[rank < k], d[rank < k], names[rank < k]

        def rows() -> pa.RecordBatch:
            at, d, names = best()
            return pa.RecordBatch.from_arrays([pa.array(np.array(q_ids, dtype=object)[at], pa.string()), pa.array(names, pa.string()), pa.array(d)], names=["query_id", "chunk_id", "d"])

        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                part, block, width, given = (columns[n][i].as_py() for n in ("part", "block", "width", "given"))
                if (part, block, width) != key:
                    if held:
                        yield rows()
                    key, packs, q, held = (part, block, width), [], None, []
                names, x = columns["ids"][i].as_py(), np.frombuffer(columns["vectors"][i].as_py()).reshape(-1, width)
                if not given:
                    packs.append((names, x))
                    continue
                if not packs:
                    continue
                if q is None:
                    q_ids, q = [n for own, _ in packs for n in own], np.concatenate([v for _, v in packs])
                    limit = np.full(len(q_ids), np.inf)
                d = distances(q, x)
                at, col = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
                if len(at):
                    held.append((at, d[at, col], np.array(names, dtype=object)[col]))
                    held = [best()]
        if held:
            yield rows()

    return met.mapInArrow(run, _NEAR)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("d", "chunk_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", "rank", (F.round("d", 6) + 0.0).alias("distance"), (F.round(1 - F.col("d"), 6) + 0.0).alias("similarity"))


def _checked(k: int, metric: str) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")


def search_many(corpus: DataFrame, queries: DataFrame, k: int = 3, metric: str = "cosine", where: Mapping[str, Any] | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, distance, similarity) of the k nearest rows for each of a stated set of queries.

    queries: (query_id, vector). Queries and corpus are packed on the executors; every block of queries meets every part
    of the corpus in a task of its own, as matrix products, and passes on k rows a query. No vector goes through the
    driver, and the plan does not grow with the set. Ties are broken by chunk_id; null vectors are left out, rows of
    another length than a query's are not compared with it, and neither are zero vectors for the cosine."""
    _checked(k, metric)
    parts = max(2, corpus.sparkSession.sparkContext.defaultParallelism * PARTS_A_CORE)
    asked = materialise(queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").where("query_id IS NOT NULL AND vector IS NOT NULL"), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    packs = _packs(apply_where(corpus, where).select("chunk_id", "embedding"), "chunk_id", "embedding", [])
    packs = packs.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    return _ranked(_nearest(_meeting(_packs(dealt, "query_id", "vector", ["block"]).withColumn("part", every(parts)), packs), k, metric), k)


def fit_index(corpus: DataFrame, lists: int = 16, sample_rows: int = 20_000, rounds: int = 12) -> list[list[float]]:
    """Centres of an inverted-list index, fitted by k-means of directions on a sample of at most sample_rows rows, those
    with the smallest hashes of chunk_id. Only the sample comes to the driver. Fewer rows than lists give as many centres."""
    sample = corpus.where("chunk_id IS NOT NULL AND embedding IS NOT NULL").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample_rows).select("embedding").toArrow()
    rows = [v for v in sample.column("embedding").to_pylist() if v and None not in v]
    rows = [v for v in rows if len(v) == len(rows[0])]
    if not rows:
        return []
    x = np.array(rows, dtype=np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    centres = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], centres)
    return centres.tolist()


def assign_lists(rows: DataFrame, vector: str, centres: list[list[float]], probes: int = 1) -> DataFrame:
    """rows with `cell`, a row for each of the `probes` lists whose centres are nearest in direction; rows whose vector is
    null or of another length have the cell -1."""
    grid = np.array(centres, dtype=np.float64)

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        good = [i for i, v in enumerate(vectors) if v is not None and len(v) == grid.shape[1]]
        out: list[list[int]] = [[-1]] * len(vectors)
        if good:
            order = np.argsort(-(np.nan_to_num(np.array([vectors.iloc[i] for i in good], dtype=np.float64)) @ grid.T), axis=1, kind="stable")[:, :probes]
            for i, own in zip(good, order.tolist(), strict=True):
                out[i] = own
        return pd.Series(out)

    return rows.withColumn("cell", F.explode(cells(F.col(vector))))


def search_index(corpus: DataFrame, queries: DataFrame, centres: list[list[float]], k: int = 3, probes: int = 4, metric: str = "cosine") -> DataFrame:
    """search_many over the `probes` nearest lists of each query only; every corpus row lies in one list.

    Rows of a list are packed and its packs dealt over several parts, so a hot list is split. More
    probes find more: with all lists the result is that of search_many, which is the exact way."""
    _checked(k, metric)
    if not centres:
        return search_many(corpus, queries, k, metric)
    salts = max(1, corpus.sparkSession.sparkContext.defaultParallelism // 4)
    part = lambda salt: F.concat_ws("-", "cell", salt)
    asked = materialise(assign_lists(queries.select("query_id", "vector").where("query_id IS NOT NULL"), "vector", centres, probes), "queries")
    blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("_n"))
    dealt = asked.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("_n")).cast("int"))
    wanted = _packs(dealt, "query_id", "vector", ["cell", "block"]).withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), part)))
    packs = _packs(assign_lists(corpus.select("chunk_id", "embedding"), "embedding", centres), "chunk_id", "embedding", ["cell"]).join(blocks, "cell")
    packs = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1))).withColumn("part", part(F.pmod(F.xxhash64("ids"), F.lit(salts))))
    return _ranked(_nearest(_meeting(wanted, packs), k, metric), k)


def expand_neighbours(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """hits and the rows right before and after each of them, once each; a hit keeps its own row and distance.

    hits: (query_id, chunk_id, distance, similarity); corpus: (chunk_id, document_id, chunk_index, text, prev_chunk_id,
    next_chunk_id). Neighbours that do not exist are left out and have distance 0 and similarity 1, as rows looked up
    by id. A filter of the search does not apply to them."""
    rows = corpus.select("chunk_id", "document_id", "chunk_index", "text", "prev_chunk_id", "next_chunk_id")
    found = hits.select("query_id", "chunk_id", "distance", "similarity").join(rows, "chunk_id")
    near = found.select("query_id", F.explode(F.array("prev_chunk_id", "next_chunk_id")).alias("chunk_id")).where("chunk_id IS NOT NULL").distinct()
    near = near.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(rows, "chunk_id")
    both = found.withColumn("is_hit", F.lit(True)).unionByName(near.withColumns({"distance": F.lit(0.0), "similarity": F.lit(1.0), "is_hit": F.lit(False)}))
    return both.select("query_id", "chunk_id", "document_id", "chunk_index", "text", "distance", "similarity", "is_hit")


def budget(rows: DataFrame, max_tokens: int, counter: Counter = count_tokens) -> DataFrame:
    """Rows of each query in document order with `separated` and `included`.

    The first row is always included; rows follow until one does not fit, with the cost of a separator checked for
    every further row but added only where the document changes or indices leave a gap."""
    order = Window.partitionBy("query_id").orderBy(F.coalesce("document_id", F.lit("")), F.coalesce("chunk_index", F.lit(0)), "chunk_id")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    document, index = F.coalesce("document_id", F.lit("")), F.coalesce("chunk_index", F.lit(0))
    placed = rows.withColumn("tokens", counter(F.col("text"))).withColumn("position", F.row_number().over(order) - 1)
    gap = (F.lag(document).over(order) != document) | (index > F.lag(index).over(order) + 1)
    placed = placed.withColumn("separated", F.coalesce(gap, F.lit(False)))
    cost = F.col("tokens") + F.col("separated").cast("int") * SEPARATOR_TOKENS
    spent = F.coalesce(F.sum(cost).over(earlier), F.lit(0))
    placed = placed.withColumn("_fails", (spent + F.col("tokens") + F.when(F.col("position") > 0, SEPARATOR_TOKENS).otherwise(0) > max_tokens).cast("int"))
    failed = F.max("_fails").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("included", (F.col("position") == 0) | (failed == 0)).drop("_fails")


def context_text(budgeted: DataFrame, counter: Counter = count_tokens) -> DataFrame:
    """(query_id, context_text, chunk_ids, token_count, total_results): included texts in order, counted afresh."""
    part = F.when(F.col("separated"), F.concat(F.lit(f"{SEPARATOR}\n\n"), F.col("text"))).otherwise(F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct("position", part.alias("part"), "chunk_id")))
    out = budgeted.where("included").groupBy("query_id").agg(ordered.alias("o"))
    out = out.select("query_id", F.array_join(F.transform("o", lambda x: x["part"]), "\n\n").alias("context_text"), F.transform("o", lambda x: x["chunk_id"]).alias("chunk_ids"))
    return out.withColumn("token_count", counter(F.col("context_text"))).withColumn("total_results", F.size("chunk_ids"))


def retrieve(corpus: DataFrame, hits: DataFrame, max_tokens: int = 1024, expand: bool = True, counter: Counter = count_tokens) -> DataFrame:
    """Hits to one context for each query."""
    if expand:
        rows = expand_neighbours(hits, corpus)
    else:
        rows = hits.join(corpus.select("chunk_id", "document_id", "chunk_index", "text"), "chunk_id")
    return context_text(budget(rows, max_tokens, counter), counter)
