"""Running sums and positions inside large groups, in two levels.

A window over one group sorts the whole group in one task. Here a group is cut into buckets of neighbouring places:
totals by bucket are accumulated in a window over buckets (a row for each), and each bucket gets its own short window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_sum(df: DataFrame, group: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of value over all earlier rows of the group. bucket must not decrease along the order."""
    df = df.withColumn("_bucket", bucket).withColumn("_value", value.cast("bigint"))
    totals = df.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(offsets, [*group, "_bucket"])
    return out.withColumn(name, F.col("_offset") + F.col("_inside")).drop("_bucket", "_value", "_inside", "_offset")


def beside(df: DataFrame, group: list[str], bucket: Column, order: str, value: str, name: str, ahead: bool = False) -> DataFrame:
    """Adds `name`: the value of the row before (or, with ahead, behind) in the group; null at its end."""
    df = df.withColumn("_bucket", bucket)
    edge = (F.min_by if ahead else F.max_by)(value, order)
    edges = df.groupBy(*group, "_bucket").agg(edge.alias("_edge"))
    step = F.lead if ahead else F.lag
    carried = edges.select(*group, "_bucket", step("_edge").over(Window.partitionBy(*group).orderBy("_bucket")).alias("_carried"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(order)
    out = df.withColumns({"_inside": step(value).over(inside), "_edge_row": step(F.lit(1)).over(inside).isNull()}).join(carried, [*group, "_bucket"])
    return out.withColumn(name, F.when(F.col("_edge_row"), F.col("_carried")).otherwise(F.col("_inside"))).drop("_bucket", "_inside", "_edge_row", "_carried")


def latest(df: DataFrame, key: list[str], newest_first: list[str]) -> DataFrame:
    """One row for each key: that with the greatest values of the given columns (partial maximum, no window)."""
    rest = [c for c in df.columns if c not in key and c not in newest_first]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*newest_first, *rest), F.struct(*newest_first)).alias("_row"))
    return picked.select(*[F.col(k) for k in key], *[F.col(f"_row.{c}").alias(c) for c in (*newest_first, *rest)]).select(*df.columns)
