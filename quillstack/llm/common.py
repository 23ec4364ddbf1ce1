"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstack.session import materialise, spread  # noqa: F401  the operators here take it from this module

#: Rows of one Arrow batch that is handed to Python at most; documents are kilobytes, so batches stay small.
BATCH_ROWS = 1000


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with one batch in, one batch out, and slices of at most so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def first_delivery(df: DataFrame, key: str, *values: str) -> DataFrame:
    """One row for each key. Deliveries of a key carry the same values; should they differ, the smallest row wins."""
    return df.groupBy(key).agg(F.min(F.struct(*values)).alias("_d")).select(key, *[F.col(f"_d.{v}").alias(v) for v in values])


#: Ids of one part of a class on average. Parts are the unit in which classes are expanded to pairs.
PART_IDS = 500


def class_parts(members: DataFrame, id_col: str, wanted: DataFrame | None = None) -> DataFrame:
    """(cls, part, ids): the different ids of each class in parts of about PART_IDS, dealt by hash. members: (id, cls);
    wanted: (cls, _n), the classes to take with their numbers of rows, by default all."""
    sizes = members.groupBy("cls").agg(F.count("*").alias("_n")) if wanted is None else wanted
    dealt = members.join(sizes, "cls").select("cls", F.pmod(F.xxhash64(id_col), F.ceil(F.col("_n") / PART_IDS)).alias("part"), id_col)
    return dealt.groupBy("cls", "part").agg(F.collect_set(id_col).alias("ids"))


def _between(parts: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    left = parts.select(F.col("cls").alias("cls_a"), F.col("part").alias("_p"), F.col("ids").alias("_x"))
    right = parts.select(F.col("cls").alias("cls_b"), F.col("part").alias("_q"), F.col("ids").alias("_y"))
    joined = links.join(left, "cls_a").join(right, "cls_b").repartition("cls_a", "_p", "cls_b", "_q")
    pairs = joined.select(F.explode("_x").alias("_x"), "_y").select("_x", F.explode("_y").alias("_y")).where(F.col("_x") != F.col("_y"))
    return pairs.select(F.least("_x", "_y").alias(a), F.greatest("_x", "_y").alias(b))


def _within(parts: DataFrame, a: str, b: str) -> DataFrame:
    left = parts.select("cls", F.col("part").alias("_p"), F.col("ids").alias("_x"))
    right = parts.select("cls", F.col("part").alias("_q"), F.col("ids").alias("_y"))
    joined = left.join(right, "cls").where("_p < _q OR _p = _q AND size(_x) > 1").repartition("cls", "_p", "_q")
    pairs = joined.select("_p", "_q", F.explode("_x").alias("_x"), "_y").select("_p", "_q", "_x", F.explode("_y").alias("_y")).where("_p < _q OR _x < _y")
    return pairs.select(F.least("_x", "_y").alias(a), F.greatest("_x", "_y").alias(b))


def pairs_between(members: DataFrame, links: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """Expand links between classes to pairs of ids. members: (id, cls); links: (cls_a, cls_b) with each link once.

    Classes are joined part by part and the pairs of parts are dealt over the cluster before they are expanded, so no
    task holds a class or makes all pairs of two of them. The smaller id comes first in each pair. Ids compare by their
    own type (numbers) or by code point (strings)."""
    linked = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    return _between(class_parts(members.join(linked, "cls", "left_semi"), id_col), links, a, b)


def pairs_within(members: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """All pairs of ids inside each class (identical records), part by part as in pairs_between."""
    several = members.groupBy("cls").agg(F.count("*").alias("_n")).where("_n > 1")
    return _within(class_parts(members, id_col, several), a, b)


def pairs_of_classes(members: DataFrame, links: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """pairs_within and pairs_between together, over one written table of parts."""
    linked = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct().withColumn("_linked", F.lit(True))
    wanted = members.groupBy("cls").agg(F.count("*").alias("_n")).join(linked, "cls", "left").where("_n > 1 OR _linked").select("cls", "_n")
    parts = materialise(class_parts(members, id_col, wanted), "parts")
    return _between(parts, links, a, b).unionByName(_within(parts, a, b))
