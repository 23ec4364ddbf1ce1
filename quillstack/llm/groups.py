"""Groups of linked classes: connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillstack.session import materialise


def components(links: DataFrame, a: str = "cls_a", b: str = "cls_b") -> DataFrame:
    """(cls, root): the smallest class of each component that has links.

    Large-star and small-star steps in turn, each a shuffle by node with partial minimum; a node's neighbours are
    never collected, and the least neighbours are written first, so that adaptive execution can split a hub in the join. Every step is written to the shared folder, so that lost executors cost one step; it ends when
    the links no longer change."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "stars")
    before = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        after = _mark(edges)
        if after == before:
            return edges.groupBy(F.col("u").alias("cls")).agg(F.min("v").alias("root"))
        before = after


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def membership(members: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """(id, class_id, n_links, group_id) for every member; class_id and group_id are hexadecimal digests.

    n_links counts the linked classes, not the ids in them; group_id is the smallest class of the component."""
    degree = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    roots = components(links)
    out = members.join(degree, "cls", "left").join(roots, "cls", "left")
    return out.select(id_col, F.lower(F.hex("cls")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.lower(F.hex(F.coalesce("root", "cls"))).alias("group_id"))
