"""Problem 7: filling containers of fixed capacity.

A text larger than the capacity is cut into full containers and one rest; everything else stays whole. Items are dealt
into groups of bounded size by a hash, each group is packed by best fit in descending order and then improved by local
search between underfull containers: an item moves, one is exchanged for one, or two for one (either way), whenever
that raises the sum of squared fills. All items and pairs of items of two containers are looked at: sizes and sums of
pairs are kept as bits of one number for each container, and a shift finds the best gain. Containers that run empty are
dropped. The search ends when a pass over all underfull containers changes nothing; the squared fills rise with every
exchange, so it does end.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillstack.session import materialise

#: Items of a group on average. Each group leaves at most about one container underfull.
GROUP_ITEMS = 4000


def _gain(given: int, got: int, free: int) -> int:
    """The largest t from 1 to free for which a bit k of given and the bit k + t of got are set; 0 if there is none."""
    if given.bit_count() >= free:
        return next((t for t in range(free, 0, -1) if given & got >> t), 0)
    best, window = 0, (1 << free) - 1
    while given and best < free:
        k = given.bit_length() - 1
        given ^= 1 << k
        best = max(best, (got >> k + 1 & window).bit_length())
    return best


class _Bins:
    """Bins of item numbers, and of the underfull ones the sizes of items and the sums of pairs as bits."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.bits: dict[int, tuple[int, int]] = {}  # by underfull bin: (sizes, sums of two)

    def best_fit(self) -> None:
        room: list[tuple[int, int]] = []  # (free, bin), ascending
        for k in sorted(range(len(self.sizes)), key=lambda k: (-self.sizes[k], k)):
            n = self.sizes[k]
            at = bisect_left(room, (n, -1))
            if at < len(room):
                free, b = room.pop(at)
                self.items[b].append(k)
                self.fill[b] += n
            else:
                free, b = self.capacity, len(self.items)
                self.items.append([k])
                self.fill.append(n)
            if free > n:
                insort(room, (free - n, b))

    def list_bin(self, b: int) -> None:
        """Bring the bits in line with a bin."""
        self.bits.pop(b, None)
        if 0 < self.fill[b] < self.capacity:
            ones = twos = 0
            for n, times in sorted(Counter(self.sizes[k] for k in self.items[b]).items()):
                twos |= (ones | (1 << n if times > 1 else 0)) << n
                ones |= 1 << n
            self.bits[b] = ones, twos

    def search(self) -> None:
        for b in range(len(self.items)):
            self.list_bin(b)
        changed = True
        while changed:
            changed = False
            for b in sorted(self.bits, key=lambda b: (-self.fill[b], b)):
                while 0 < self.fill[b] < self.capacity and self._improve(b):
                    changed = True

    def _improve(self, b: int) -> bool:
        """The exchange with a bin filled no more than this one that gains most for it."""
        free = self.capacity - self.fill[b]
        others = [x for x in self.bits if x != b and self.fill[x] <= self.fill[b]]
        ones = twos = 0
        for x in others:
            ones |= self.bits[x][0]
            twos |= self.bits[x][1]
        mine, pairs = self.bits[b]
        gain, n_out, n_come, given, got = 0, 0, 0, 0, 0
        for k_out, k_come, out, come in ((0, 1, 1, ones), (1, 1, mine, ones), (2, 1, pairs, ones), (1, 2, mine, twos)):
            if gain < free and (t := _gain(out, come, free)) > gain:
                gain, n_out, n_come, given, got = t, k_out, k_come, out, come
        if not gain:
            return False
        hits = given & got >> gain
        size = (hits & -hits).bit_length() - 1
        other = min((x for x in others if self.bits[x][n_come - 1] >> size + gain & 1), key=lambda x: (self.fill[x], x))
        out, come = self._items(b, size, n_out), self._items(other, size + gain, n_come)
        for k in come:
            self.items[other].remove(k)
            self.items[b].append(k)
        for k in out:
            self.items[b].remove(k)
            self.items[other].append(k)
        self.fill[b] += gain
        self.fill[other] -= gain
        self.list_bin(b)
        self.list_bin(other)
        return True

    def _items(self, b: int, size: int, n: int) -> tuple[int, ...]:
        """n items of a bin (none, one or two) that have this size together."""
        if not n:
            return ()
        at: dict[int, int] = {}
        for k in sorted(self.items[b]):
            if n == 1 and self.sizes[k] == size:
                return (k,)
            if n == 2 and size - self.sizes[k] in at:
                return at[size - self.sizes[k]], k
            at.setdefault(self.sizes[k], k)
        raise LookupError("no such items")


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item, numbered from 0 without gaps; items of size 0 go to bin 0."""
    if any(n > capacity or n < 0 for n in sizes):
        raise ValueError("an item must not be larger than the capacity")
    real = [k for k, n in enumerate(sizes) if n]
    bins = _Bins([sizes[k] for k in real], capacity)
    bins.best_fit()
    bins.search()
    out = [0] * len(sizes)
    for no, members in enumerate(m for m in bins.items if m):
        for k in members:
            out[real[k]] = no
    return out


SCHEMA = "container_kind string, container_id string, doc_id bigint, part_no int, start_token bigint, n_tokens int"


def fill_containers(sized: DataFrame, id_col: str, kind: str, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container_kind, container_id, id, part_no, start_token, n_tokens): where each part of each text goes.

    sized: (id, size). Texts of size 0 (empty, null) take no room and lie in a container of their group. Sizes that
    are null or negative count as 0. An id that comes several times is packed once, with its largest size. An empty
    table gives no rows. Only texts larger than the capacity have several parts."""
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    once = sized.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))).cast("bigint").alias("size"))
    parts = once.select("id", "size", F.expr(f"cast(size div {capacity} as int)").alias("full"), F.expr(f"cast(size % {capacity} as int)").alias("rest"))
    whole = parts.where("full > 0").select("id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part_no")).select(
        F.lit(kind).alias("container_kind"), F.concat_ws("-", F.lit(kind), F.lit("full"), F.col("id"), F.col("part_no")).alias("container_id"),
        "id", "part_no", (F.col("part_no").cast("bigint") * capacity).alias("start_token"), F.lit(capacity).alias("n_tokens"),
    )
    rest = parts.where("rest > 0 OR size = 0").select("id", F.col("full").alias("part_no"), (F.col("full").cast("bigint") * capacity).alias("start_token"), F.col("rest").alias("n_tokens"))
    groups = max(1, -(-rest.count() // group_items))
    id_type = sized.schema[id_col].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "id"], ascending=[False, True], kind="stable")
        bins = pack(rows["n_tokens"].tolist(), capacity)
        return pd.DataFrame({"container_kind": kind, "container_id": [f"{kind}-{key[0]}-{b}" for b in bins], "id": rows["id"], "part_no": rows["part_no"], "start_token": rows["start_token"], "n_tokens": rows["n_tokens"]})

    dealt = rest.withColumn("_group", F.pmod(F.xxhash64("id"), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInPandas(run, SCHEMA.replace("doc_id bigint", f"id {id_type}"))
    out = whole.unionByName(packed)
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def fill_all(sized: DataFrame, id_col: str, capacities: dict[str, int]) -> DataFrame:
    """fill_containers for several capacities; sizes are computed once."""
    sized = materialise(sized, "sizes")
    out = None
    for kind, capacity in sorted(capacities.items()):
        one = fill_containers(sized, id_col, kind, capacity)
        out = one if out is None else out.unionByName(one)
    return out


def fill_report(parts: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(container_kind, capacity, parts, tokens, containers, least_containers, fill) for each kind."""
    room = F.create_map(*[F.lit(x) for pair in sorted(capacities.items()) for x in pair])
    used = parts.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"))
    by = used.groupBy("container_kind").agg(F.sum("parts").alias("parts"), F.sum("n").alias("tokens"), F.sum((F.col("n") > 0).cast("int")).alias("containers"))
    capacity = room[F.col("container_kind")]
    return by.select("container_kind", capacity.alias("capacity"), "parts", "tokens", "containers", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("fill"))
