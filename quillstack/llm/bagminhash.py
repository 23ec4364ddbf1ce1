"""Problem 2: near-duplicate records with small edits, by BagMinHash signatures, bands and verification.

A record is a bag of words with weights. For each word a Poisson process over the weight axis is simulated, seeded by
the word alone: its points come in ascending order of their hash value, and each falls into one of the m components of
the signature and at one weight. A component keeps the least value among all points that lie below the weight of their
word, so two signatures agree in a component with probability equal to the weighted Jaccard similarity of the bags.
The weight axis is discretised at whole numbers and organised as a hierarchy of halves, which sends every point to the
lower or the upper half of its range, so that processes of different weights share their points below the lesser
weight. With weights of one, a single range is left and the similarity is that of the sets.

Records with the same bag are one class. Copies are dropped where they are read and again where they meet, so that a task
signs a class once. A signature is made in planes: r by p components (p a prime), of which every line (x, m * x + b mod p)
is a band of r components; two lines share one component at most. Classes that agree in a band are candidates, and each
candidate pair is verified on the words themselves. PLANES says how many planes of how many slopes miss a pair at the
threshold 0.75 with less than 1e-5 (simulated), and more similar pairs far less often.

The unlike pairs that meet grow with the square of the table, so the length r of the bands grows with the table: each
component more leaves about a quarter of them. Disk is bounded by rounds: a round signs a plane (several, of a small table),
deals its band keys over buckets as packed arrays, joins each bucket in memory and keeps the different pairs, and what it
wrote for that is removed before the next one. Words are sent for a part of the candidates at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillstack.llm.common import BATCH_ROWS, pairs_of_classes, spread
from quillstack.session import discard, materialise

#: Band length r -> (prime p, slopes, planes): slopes * p bands a plane.
PLANES = {8: (11, 5, 3), 9: (11, 5, 4), 10: (11, 5, 5), 11: (11, 6, 6), 12: (13, 5, 7), 13: (13, 5, 9), 14: (17, 4, 11)}
#: Band keys that a round makes, unless a single plane makes more.
ROUND_KEYS = 4_000_000
#: Band keys of a bucket on average, and those that a task packs at once.
BUCKET_KEYS = 1_000_000
#: Classes in one band from which its pairs are dealt over the cluster, by parts of half as many.
HOT = 1000
#: Bytes of blocks whose words are sent at once for verification, if four parts suffice.
PART_BYTES = 12_000_000
#: Classes that a task remembers so as to leave out copies.
SEEN = 200_000
#: Words from which a block ends, whatever rows it has.
BLOCK_WORDS = 250_000
#: Points drawn for an entry in each of the first rounds.
STEP = 8
#: Entries that are signed at once, few enough for a processor's cache.
CACHED = 4096
_U = np.uint64
_GAMMA = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def signatures(bag: np.ndarray, word: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash signatures of n bags: (n, m) least values as 64-bit patterns. bag, word, weight: an entry for each
    distinct word of a bag."""
    distinct, index = np.unique(word, return_inverse=True)
    return _signatures(bag, index, distinct, weight, n, m)


def _signatures(bag: np.ndarray, index: np.ndarray, distinct: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """signatures of the words distinct[index]; the points of a word are drawn once for all bags that have it.

    Level 0 of the hierarchy is the range [0, 1) of weights, level l the range [2**(l-1), 2**l): the upper half of all
    weights below 2**l. Each is a Poisson process of its own with its length as rate, and the bits of a point's
    fraction say into which half, quarter and so on of its range it falls; a point counts if it lies below the word's
    weight. Points are drawn in rounds of fixed numbers, for an entry until its next point is larger than every
    component of its bag; as the rounds are the same for every bag, equal points have equal bits."""
    out = np.full(n * m, np.inf)
    weight = weight.astype(np.int64)
    seeds, lows, owners, limits, indices = [], [], [], [], []
    for level in range(int(weight.max()).bit_length() + 1 if len(weight) else 0):
        low = (1 << level) >> 1
        on = weight > low
        if on.any():
            with np.errstate(over="ignore"):
                seeds.append(_mix(distinct ^ _U(level)))
            indices.append(index[on] + (len(seeds) - 1) * len(distinct))
            lows.append(np.full(len(distinct), low))
            owners.append(bag[on])
            limits.append(weight[on])
    if not seeds:
        return out.view(np.uint64).reshape(n, m)
    seed, low, owner, limit, index = map(np.concatenate, (seeds, lows, owners, limits, indices))
    rate = np.maximum(low, 1).astype(np.float64)
    plain = int(weight.max()) == 1
    reached = np.zeros(len(seed))
    first, step = 0, STEP
    with np.errstate(over="ignore"):
        while len(index):
            if len(index) < len(seed):
                left, index = np.unique(index, return_inverse=True)
                seed, low, rate, reached = seed[left], low[left], rate[left], reached[left]
            j = np.arange(first + 1, first + step + 1, dtype=np.uint64)
            draw = _mix(seed[:, None] + j * _GAMMA)
            gap = -np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            value = np.cumsum(gap, axis=1) / rate[:, None] + reached[:, None]
            more = _mix(draw ^ _U(0xD6E8FEB86659FD93))
            place = (more % _U(m)).astype(np.int64)
            if not plain:
                # the bits above the component's give the point's place in its range, halving by halving
                at = np.floor((more >> _U(32)).astype(np.float64) * 2.0**-32 * rate[:, None] + low[:, None])
            for some in (slice(k, k + CACHED) for k in range(0, len(index), CACHED)):
                which = index[some]
                to, what = place.take(which, axis=0), value.take(which, axis=0)
                to += owner[some, None] * m
                if plain:
                    np.minimum.at(out, to.ravel(), what.ravel())
                else:
                    ok = at[which] < limit[some, None]
                    np.minimum.at(out, to[ok], what[ok])
            reached = value[:, -1]
            go = reached[index] < out.reshape(n, m).max(axis=1)[owner]
            index, owner, limit = index[go], owner[go], limit[go]
            first += step
            step = min(2 * step, 64) if first >= 24 else step
    return out.view(np.uint64).reshape(n, m)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def lines(r: int, p: int, slopes: int) -> np.ndarray:
    """(slopes * p, r): the components of each band of a plane; component x * p + y is the point (x, y)."""
    x = np.arange(r)
    return np.array([x * p + (m * x + b) % p for m in range(slopes) for b in range(p)])


def _bands(block: Block, plane: int, r: int) -> np.ndarray:
    """(n, bands): a 64-bit key for each band of a plane; the band's number is mixed in."""
    p, slopes, _ = PLANES[r]
    n = len(block.tags)
    with np.errstate(over="ignore"):
        sig = _signatures(np.repeat(np.arange(n), block.sizes), block.index, _mix(block.distinct ^ _U(plane + 1) * _GAMMA), block.weights, n, r * p)
        point = _mix(sig + np.arange(1, r * p + 1, dtype=np.uint64) * _GAMMA)
        band = lines(r, p, slopes)
        key = np.broadcast_to(np.arange(plane * len(band), (plane + 1) * len(band), dtype=np.uint64) * _GAMMA, (n, len(band))).copy()
        for x in range(r):
            key += point[:, band[:, x]]
        return _mix(key)


def band_length(n: int) -> int:
    """Components of a band for a table of n records."""
    return min(max(round(10 + math.log(max(n, 1) / 100_000, 4)), min(PLANES)), max(PLANES))


class Block(NamedTuple):
    """Classes packed by one task: digests, tags (40 bits of them), and the words distinct[index], sizes of each class
    in turn and in ascending order, with their weights."""

    digests: list[bytes]
    tags: np.ndarray
    sizes: np.ndarray
    index: np.ndarray
    distinct: np.ndarray
    weights: np.ndarray

    def packed(self) -> bytes:
        wide = pa.int16() if len(self.distinct) < 1 << 15 else pa.int32()
        words = pa.DictionaryArray.from_arrays(pa.array(self.index).cast(wide), pa.array(self.distinct))
        ends = pa.array(np.append(0, np.cumsum(self.sizes)), pa.int32())
        counts = pa.nulls(len(self.digests), pa.list_(pa.int32())) if (self.weights == 1).all() else pa.ListArray.from_arrays(ends, pa.array(self.weights, pa.int32()))
        batch = pa.RecordBatch.from_arrays([pa.array(self.digests, pa.binary(16)), pa.ListArray.from_arrays(ends, words), counts], names=["cls", "words", "counts"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def unpacked(data: bytes) -> Block:
        batch = pa.ipc.open_stream(data).read_next_batch()
        words = batch.column(1).flatten()
        index = words.indices.to_numpy().astype(np.int64)
        counts = batch.column(2).flatten().to_numpy()
        digests = batch.column(0).to_pylist()
        return Block(digests, tags_of(digests), np.diff(batch.column(1).offsets.to_numpy()), index, words.dictionary.to_numpy(), counts if len(counts) else np.ones(len(index), np.int32))


def tags_of(digests: list[bytes]) -> np.ndarray:
    return (np.frombuffer(b"".join(digests), ">u8")[::2] >> _U(24)).astype(np.int64)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for data in batch.column(0):
            yield Block.unpacked(data.as_py())


def bags(df: DataFrame, id_col: str, text_col: str, weights: str = "set", balance: bool = True) -> DataFrame:
    """(id, cls, block) of every row with at least one word.

    cls is a digest of the bag: rows with the same bag are one class. A task packs the classes that it has not just had
    into blocks, which stand beside one row each and else are null; so a class is in one block at least. Their words are
    64-bit digests in ascending order, their weights counts, or 1 for weights="set"."""
    if weights not in ("set", "count"):
        raise ValueError("weights must be set or count")
    kind = df.schema[id_col].dataType.simpleString()

    def block(digests, word, count):
        distinct, index = np.unique(np.concatenate(word), return_inverse=True)
        return Block(digests, tags_of(digests), np.array([len(w) for w in word]), index, distinct.view(np.uint64), np.concatenate(count)).packed()

    def run(batches):
        had: set[bytes] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                keep, digests, blocks, fresh, word, count, held = [], [], [], [], [], [], 0
                for k, text in enumerate(batch.column(1).to_pylist()):
                    words = words_of(text or "")
                    if not words:
                        continue
                    if weights == "set":
                        codes = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, set(words)), np.uint64).view(np.int64))
                        n = np.ones(len(codes), np.int32)
                    else:
                        hashes: Counter[int] = Counter()
                        for w, times in Counter(words).items():
                            hashes[xxhash.xxh3_64_intdigest(w)] += times
                        codes = np.fromiter(hashes, np.uint64, len(hashes)).view(np.int64)
                        order = np.argsort(codes)
                        codes, n = codes[order], np.fromiter(hashes.values(), np.int32, len(codes))[order]
                    digest = xxhash.xxh3_128_digest(codes.tobytes() + n.tobytes())
                    keep.append(k)
                    digests.append(digest)
                    blocks.append(None)
                    if digest not in had:
                        if len(had) >= SEEN:
                            had.clear()
                        had.add(digest)
                        fresh.append(digest)
                        word.append(codes)
                        count.append(n)
                        held += len(codes)
                    if held >= BLOCK_WORDS:
                        blocks[-1] = block(fresh, word, count)
                        fresh, word, count, held = [], [], [], 0
                if held:
                    # a full block went with the row of its last class, so the last row has none yet
                    blocks[-1] = block(fresh, word, count)
                if keep:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(digests, pa.binary()), pa.array(blocks, pa.binary())], names=["id", "cls", "block"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return (spread(source) if balance else source).mapInArrow(run, f"id {kind}, cls binary, block binary")


def _cells(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of binaries, all of them and where the cells end."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data.view(kind), (ends - ends[0]) // np.dtype(kind).itemsize


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """A column of binaries from numbers; ends in bytes, from 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def band_keys(blocks: DataFrame, planes: range, r: int, buckets: int) -> DataFrame:
    """(bucket, keys, tags): the band keys of these planes, packed: 32 bits of each key and the 40 of its class's tag.

    The first 32 bits of a key give its bucket, 32 of its first 40 bits are kept; keys that are equal by chance only add
    candidates. blocks: (block)."""
    bands = len(planes) * PLANES[r][0] * PLANES[r][1]
    rows = max(1, BUCKET_KEYS // bands)

    def packed(keys, tags):
        tags = np.concatenate(tags)
        # sorted by the first 40 bits of the key; the other 24 hold the row
        row = np.repeat(np.arange(len(tags), dtype=np.uint64), bands)
        order = np.concatenate(keys).ravel() >> _U(24) << _U(24) | row
        order.sort()
        bucket = (order >> _U(32)) * _U(buckets) >> _U(32)
        starts = np.searchsorted(bucket, np.arange(buckets, dtype=np.uint64))
        full = np.flatnonzero(np.diff(np.append(starts, len(order))))
        ends = np.append(starts[full], len(order))
        short = (order >> _U(24)).astype(np.uint32)
        tag = tags.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5][(order & _U(0xFFFFFF)).astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), _binary(ends * 4, short), _binary(ends * 5, tag)], names=["bucket", "keys", "tags"])

    def run(batches):
        keys, tags, held = [], [], 0
        for block in blocks_of(batches):
            keys.append(np.concatenate([_bands(block, k, r) for k in planes], axis=1))
            tags.append(block.tags)
            held += len(block.tags)
            if held + BATCH_ROWS > rows:
                yield packed(keys, tags)
                keys, tags, held = [], [], 0
        if held:
            yield packed(keys, tags)

    return blocks.select("block").mapInArrow(run, "bucket int, keys binary, tags binary")


def runs_of(keys: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tags, place, size): the tags that share a key, by key and in ascending order, each once for a key, with their
    places in the run of the key and the size of the run."""
    order = keys.astype(np.uint64) << _U(32) | np.arange(len(keys), dtype=np.uint64)
    order.sort()
    key = order >> _U(32)
    same = key[1:] == key[:-1]
    shared = (np.append(same, False) | np.append(False, same))[: len(keys)]
    key, tag = key[shared], tags[(order[shared] & _U(0xFFFFFFFF)).astype(np.int64)]
    by = np.lexsort((tag, key))
    key, tag = key[by], tag[by]
    new = np.append(True, (key[1:] != key[:-1]) | (tag[1:] != tag[:-1]))[: len(key)]
    key, tag = key[new], tag[new]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    sizes = np.diff(np.append(starts, len(key)))
    return tag, np.arange(len(key)) - np.repeat(starts, sizes), np.repeat(sizes, sizes)


def bucket_pairs(packed: DataFrame) -> DataFrame:
    """(tag_a, tag_b, xs, ys): the pairs that share a key in a bucket, each once. For keys of more than HOT classes there
    are lists xs and ys instead, whose pairs are meant (x < y). packed: band_keys, with one bucket a partition."""
    listed = pa.list_(pa.int64())

    def plain(a, b):
        by = np.lexsort((b, a))
        a, b = a[by], b[by]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        none = pa.nulls(int(new.sum()), listed)
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), none, none], names=["tag_a", "tag_b", "xs", "ys"])

    def run(batches):
        keys, tags = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for batch in batches:
            keys.append(_cells(batch.column(1), np.uint32)[0])
            five = _cells(batch.column(2), np.uint8)[0].reshape(-1, 5)
            eight = np.zeros((len(five), 8), np.uint8)
            eight[:, :5] = five
            tags.append(eight.view("<i8").ravel())
        tag, place, size = runs_of(np.concatenate(keys), np.concatenate(tags))
        del keys, tags
        a, b, held = [], [], 0
        here, d = np.flatnonzero((size > 1) & (size <= HOT)), 1
        while len(here := here[place[here] + d < size[here]]):
            a.append(tag[here])
            b.append(tag[here + d])
            held += len(here)
            if held >= BUCKET_KEYS:
                yield plain(np.concatenate(a), np.concatenate(b))
                a, b, held = [], [], 0
            d += 1
        if held:
            yield plain(np.concatenate(a), np.concatenate(b))
        for start in np.flatnonzero((size > HOT) & (place == 0)):
            parts = [tag[at : min(at + HOT // 2, start + size[start])] for at in range(start, start + size[start], HOT // 2)]
            for k, left in enumerate(parts):
                right = parts[k:]
                xs, ys = pa.array([left] * len(right), listed), pa.array(right, listed)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(right), pa.int64()), pa.nulls(len(right), pa.int64()), xs, ys], names=["tag_a", "tag_b", "xs", "ys"])

    return packed.mapInArrow(run, "tag_a bigint, tag_b bigint, xs array<bigint>, ys array<bigint>")


def candidate_pairs(blocks: DataFrame, n: int) -> DataFrame:
    """(tag_a, tag_b) of the pairs of about n records that agree in a band, each once; written in rounds."""
    r = band_length(n)
    p, slopes, planes = PLANES[r]
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    at_once = min(planes, max(1, ROUND_KEYS // (max(n, 1) * p * slopes)))
    found = []
    for first in range(0, planes, at_once):
        these = range(first, min(first + at_once, planes))
        buckets = max(2 * cores, math.ceil(n * len(these) * p * slopes / BUCKET_KEYS))
        dealt = band_keys(blocks, these, r, buckets).repartitionById(buckets, "bucket")
        met = materialise(bucket_pairs(dealt), "met", tidy=True)
        hot = met.where("xs IS NOT NULL").select("xs", "ys").repartition(buckets).select(F.explode("xs").alias("tag_a"), "ys").select("tag_a", F.explode("ys").alias("tag_b"))
        pairs = met.where("xs IS NULL").select("tag_a", "tag_b").unionByName(hot.where("tag_a < tag_b"))
        found.append(materialise(pairs.distinct(), "candidates", tidy=True))
        discard(met)
    if len(found) == 1:
        return found[0]
    every = materialise(reduce(DataFrame.unionByName, found).distinct(), "candidates", tidy=True)
    discard(*found)
    return every


def words_of_part(blocks: DataFrame, parts: int, k: int) -> DataFrame:
    """(tag, cls, words, counts) of the classes whose tag leaves the rest k by parts, words and counts as binaries."""

    def run(batches):
        for block in blocks_of(batches):
            on = block.tags % parts == k
            if not on.any():
                continue
            each = np.repeat(on, block.sizes)
            ends = np.append(0, np.cumsum(block.sizes[on]))
            columns = [pa.array(block.tags[on]), pa.array([block.digests[i] for i in np.flatnonzero(on)], pa.binary()), _binary(ends * 8, block.distinct[block.index[each]]), _binary(ends * 4, block.weights[each].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["tag", "cls", "words", "counts"])

    once = blocks.select("block").mapInArrow(run, "tag bigint, cls binary, words binary, counts binary").repartition("tag")
    return once.groupBy("tag", "cls").agg(F.first(F.struct("words", "counts")).alias("s")).select("tag", "cls", "s.words", "s.counts")


def similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """(cls_a, cls_b, similarity) of the pairs (cls_a, words_a, counts_a, cls_b, words_b, counts_b) that reach the
    threshold: the sum of the smaller over the sum of the larger weights, which for weights of 1 is the one of sets."""

    def run(batches):
        for batch in batches:
            (x, x_ends), (v, _) = _cells(batch.column(1), np.int64), _cells(batch.column(2), np.int32)
            (y, y_ends), (w, _) = _cells(batch.column(4), np.int64), _cells(batch.column(5), np.int32)
            before_v, before_w = np.append(0, np.cumsum(v, dtype=np.int64)), np.append(0, np.cumsum(w, dtype=np.int64))
            a_sum, b_sum = np.diff(before_v[x_ends]), np.diff(before_w[y_ends])
            both = np.zeros(batch.num_rows, np.int64)
            for i in np.flatnonzero(np.minimum(a_sum, b_sum) / np.maximum(a_sum, b_sum) >= threshold):
                a, b = x[x_ends[i] : x_ends[i + 1]], y[y_ends[i] : y_ends[i + 1]]
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                hit = b[at] == a
                both[i] = np.minimum(v[x_ends[i] : x_ends[i + 1]][hit], w[y_ends[i] : y_ends[i + 1]][at[hit]]).sum()
            share = both / (a_sum + b_sum - both)
            on = pa.array(np.flatnonzero(share >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(on), batch.column(3).take(on), pa.array(share).take(on)], names=["cls_a", "cls_b", "similarity"])

    return pairs.select("cls_a", "words_a", "counts_a", "cls_b", "words_b", "counts_b").mapInArrow(run, "cls_a binary, cls_b binary, similarity double")


def class_links(blocks: DataFrame, n: int, threshold: float) -> DataFrame:
    """(cls_a, cls_b, similarity) of all linked pairs of different classes, each once. blocks: (block), of n records.

    A candidate pair is verified once, however many bands it shares: the words of its first class are written beside it,
    then those of the second come to it, both in as many parts of the tags as the words need. Equal tags of different
    classes only add candidates."""
    parts = min(4, 1 + (blocks.agg(F.sum(F.length("block"))).first()[0] or 0) // PART_BYTES)
    candidates = candidate_pairs(blocks, n)

    def part(df: DataFrame, tag: str, k: int) -> DataFrame:
        return df.where(F.col(tag) % parts == k)

    def words(side: str, k: int) -> DataFrame:
        return words_of_part(blocks, parts, k).toDF(f"tag_{side}", f"cls_{side}", f"words_{side}", f"counts_{side}")

    half = [materialise(part(candidates, "tag_a", k).join(words("a", k), "tag_a").drop("tag_a"), "half", tidy=True) for k in range(parts)]
    discard(candidates)
    links = [materialise(similar(part(reduce(DataFrame.unionByName, half), "tag_b", k).join(words("b", k), "tag_b"), threshold), "links", tidy=True) for k in range(parts)]
    discard(*half)
    return reduce(DataFrame.unionByName, links)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float, weights: str = "set") -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, cls) of every id with words, and (cls_a, cls_b, similarity) between classes.

    Deliveries of an id with one bag count once; an id delivered with two different bags is a member of both classes.
    Null and blank texts belong to no class. Records with the same bag are similar by 1 and share a class."""
    filled = materialise(bags(df, id_col, text_col, weights), "bags", tidy=True)
    members = filled.select("id", "cls").distinct()
    links = class_links(filled.where("block IS NOT NULL").select("block"), filled.count(), threshold)
    return members.withColumnRenamed("id", id_col) if id_col != "id" else members, links


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float, a: str, b: str, **options) -> DataFrame:
    """Every pair of different ids whose similarity reaches the threshold, the smaller id first."""
    members, links = near_duplicates(df, id_col, text_col, threshold, **options)
    return pairs_of_classes(members, links.select("cls_a", "cls_b"), id_col, a, b).distinct()
