"""Filters given as small dictionaries, compiled to columns so that they reach the scan.

{"field": value}, {"field": {"$op": value}} with $eq $ne $gt $gte $lt $lte $in $nin, {"$and": [...]}, {"$or": [...]}.
Several fields in one dictionary must all hold. An empty dictionary or None is no filter.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

_OPS = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: ~c.eqNullSafe(v),
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~F.coalesce(c.isin(list(v)), F.lit(False)),
}


def compile_where(where: Mapping[str, Any] | None) -> Column | None:
    if not where:
        return None
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            inner = [c for c in map(compile_where, value) if c is not None]
            if inner:
                parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), inner))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif isinstance(value, Mapping):
            for op, operand in value.items():
                if op not in _OPS:
                    raise ValueError(f"unknown operator {op}")
                parts.append(_OPS[op](F.col(key), operand))
        else:
            parts.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, parts) if parts else None


def apply_where(df: DataFrame, where: Mapping[str, Any] | None) -> DataFrame:
    condition = compile_where(where)
    return df if condition is None else df.where(condition)


def any_starts_with(names: Column, prefix: str) -> Column:
    """True if an element of an array of names starts with the prefix."""
    return F.coalesce(F.exists(names, lambda n: F.startswith(n, F.lit(prefix))), F.lit(False))
