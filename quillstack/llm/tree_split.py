"""Problem 1: splitting oversized items at natural boundaries.

The text is read as a tree whose levels are headings (by depth), blocks, list items and table rows (by indentation),
sentences, words, and single tokens or characters. A node within the limit stays whole; only oversized nodes are
opened. On the way back up, neighbouring parts are merged as long as they stay within the limit. A heading stays with
the block below it. Each piece after the first begins exactly the stated overlap before the end of the piece before.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from quillstack.llm.common import BATCH_ROWS

#: One to four letters or digits in a row, or any one other character that is not white space.
COUNTER = r"[\p{L}\p{N}]{1,4}|[^\p{IsWhite_Space}\p{L}\p{N}]"
_COUNTER = regex.compile(r"[\p{L}\p{N}]{1,4}|[^\p{White_Space}\p{L}\p{N}]")
_LINE = regex.compile(r"[^\n  \f]*(?:\r?\n|[  \f]|\Z)")
_MARKDOWN = regex.compile(r"\s*(#{1,6})\s+\S")
_MARKUP = regex.compile(r"\s*<h([1-6])\b", regex.I)
_NUMBERED = regex.compile(r"\s*(\d+(?:\.\d+)*)\.?\s+\p{Lu}[^.!?;,]{0,80}$")
_NAMED = regex.compile(r"\s*(?:§+\s*\d+|(?:Kapitel|Teil|Abschnitt|Anlage|Anhang|Artikel|Chapter|Part|Section|Annex|Appendix)\s+[\dA-Z]+)\b[^.!?;]{0,90}$")
_ITEM = regex.compile(r"(\s*)(?:[-*•–▪]|\(?\d{1,3}[.)]|\(?[a-z][.)]|\||<(?:li|tr|p|div|td)\b)\s*\S?")
_SENTENCE = regex.compile(r"[.!?…؟।]+[\"'”“»«’\)\]]*\s+|[。！？]+[」』”’）]*\s*")
_GAP = regex.compile(r"\s+")
#: Levels of list items by indentation below the top one; lines that are no items lie on the last.
DEEPEST = 5


@dataclass(frozen=True)
class Piece:
    start: int  # with the overlap
    core: int  # without it
    end: int
    size: int
    overlap: int


class _Measure:
    """Sizes and cutting places in one unit: characters (code points) or counter tokens."""

    def __init__(self, text: str, unit: str):
        self.text = text
        self.starts = [m.start() for m in _COUNTER.finditer(text)] if unit == "counter_tokens" else None

    def size(self, a: int, b: int) -> int:
        return b - a if self.starts is None else bisect_left(self.starts, b) - bisect_left(self.starts, a)

    def back(self, at: int, units: int) -> int:
        """The place that lies so many units before `at`."""
        if self.starts is None:
            return max(0, at - units)
        k = bisect_left(self.starts, at) - units
        return self.starts[k] if k > 0 else 0

    def forward(self, a: int, units: int, b: int) -> int:
        """The last place up to which [a, place) has at most so many units; never inside a token or before a mark."""
        if self.starts is None:
            at = min(a + units, b)
            k = at
            while k > a + 1 and k < b and regex.match(r"[\p{M}‍️]", self.text[k]):
                k -= 1
            return k if k > a + 1 else at
        k = bisect_left(self.starts, a) + units
        return min(self.starts[k], b) if k < len(self.starts) else b


def _levels(text: str) -> list[list[int]]:
    """Cutting places by level, from headings of depth 1 to words; each level has those of the levels above."""
    headings: dict[int, list[int]] = {d: [] for d in range(1, 7)}
    blocks: list[int] = []
    items: dict[int, list[int]] = {d: [] for d in range(DEEPEST + 1)}
    blank_before, heading_before = False, False
    for m in _LINE.finditer(text):
        a, line = m.start(), m.group().rstrip()
        if not line.strip():
            blank_before = True
            continue
        depth = None
        if len(line) <= 160:
            if h := _MARKDOWN.match(line):
                depth = len(h.group(1))
            elif h := _MARKUP.match(line):
                depth = int(h.group(1))
            elif _NAMED.match(line):
                depth = 2
            elif (h := _NUMBERED.match(line)) and (blank_before or a == 0):
                depth = min(6, 2 + h.group(1).count("."))
        if depth:
            headings[depth].append(a)
        elif blank_before and not heading_before:
            blocks.append(a)
        if not heading_before and not depth:
            h = _ITEM.match(line)
            items[min(DEEPEST, len(h.group(1).expandtabs(4)) // 2) if h else DEEPEST].append(a)
        blank_before, heading_before = False, depth is not None
    levels: list[list[int]] = []
    known: set[int] = set()
    inner = ({m.end() for m in _SENTENCE.finditer(text)}, {m.end() for m in _GAP.finditer(text)})
    for more in (*headings.values(), blocks, *items.values(), *inner):
        if more:
            known |= set(more)
            levels.append(sorted(known))
    return levels


def split_text(text: str, unit: str, limit: int, overlap: int) -> list[Piece]:
    """Pieces of one text in order. A text within the limit is one piece; an empty text has none."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    if not text:
        return []
    measure = _Measure(text, unit)
    whole = measure.size(0, len(text))
    if whole <= limit:
        return [Piece(0, 0, len(text), whole, 0)]
    room = limit - overlap
    levels = _levels(text)

    def pack(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if measure.size(a, b) <= room:
            return [(a, b)]
        while level < len(levels):
            cuts = levels[level]
            inside = cuts[bisect_right(cuts, a) : bisect_left(cuts, b)]
            level += 1
            if inside:
                parts: list[tuple[int, int]] = []
                for x, y in zip([a, *inside], [*inside, b], strict=True):
                    parts += pack(x, y, level)
                return merge(parts)
        out = []
        while a < b:
            end = measure.forward(a, room, b)
            out.append((a, end))
            a = end
        return out

    def merge(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out = [parts[0]]
        for a, b in parts[1:]:
            if measure.size(out[-1][0], b) <= room:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    cores = pack(0, len(text), 0)
    # the first piece must be long enough to hold the overlap of the second
    if len(cores) > 1 and measure.size(*cores[0]) < overlap:
        gaps = levels[-1] if levels else []
        at = measure.forward(0, max(room, overlap), len(text))
        k = bisect_right(gaps, at) - 1
        if k >= 0 and gaps[k] > 0 and measure.size(0, gaps[k]) >= overlap:
            at = gaps[k]
        cores = [(0, at), *[(max(a, at), b) for a, b in cores if b > at]]
    pieces = []
    for k, (a, b) in enumerate(cores):
        start = measure.back(a, overlap) if k else a
        pieces.append(Piece(start, a, b, measure.size(start, b), measure.size(start, a)))
    return pieces


def size_of(text: Column, unit: str) -> Column:
    """Size of a text in a unit, as a column."""
    return F.length(text) if unit == "characters" else F.regexp_count(text, F.lit(COUNTER))


SCHEMA = "item_kind string, item_id string, piece_index int, n_pieces int, start_pos int, core_pos int, end_pos int, size int, overlap_size int, piece string"


def split_items(df: DataFrame, kind: str, id_col: str, text_col: str, unit: str, limit: int, overlap: int | None, only_oversized: bool = False) -> DataFrame:
    """Pieces of every item (see SCHEMA), of oversized items only if so asked.

    Ids come out as strings. Deliveries of an id count once: should they differ, an oversized one before others, and of
    several the smallest text. Null and empty
    texts give no piece; an item exactly at the limit is one piece. Sizes are measured on the text: a stored size is
    never read. Items within the limit never leave the JVM."""
    if unit not in ("characters", "counter_tokens"):
        raise ValueError(f"unknown unit {unit!r}")
    overlap = overlap or 0
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    items = df.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id IS NOT NULL AND length(text) > 0")
    size = size_of(F.col("text"), unit)
    # a text has at least as many characters as tokens, so most texts are settled by their length
    long = (F.length("text") > limit) & (size > limit)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS // 10):
                ids, texts = (c.to_pylist() for c in batch.slice(at, BATCH_ROWS // 10).columns)
                rows = []
                for item, text in zip(ids, texts, strict=True):
                    pieces = split_text(text, unit, limit, overlap)
                    rows += [(kind, item, k, len(pieces), p.start, p.core, p.end, p.size, p.overlap, text[p.start : p.end]) for k, p in enumerate(pieces)]
                cols = list(zip(*rows, strict=True)) or [()] * 10
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW, strict=True)], names=_NAMES)

    once = items.where(long).groupBy("item_id").agg(F.min("text").alias("text"))
    pieces = once.mapInArrow(run, SCHEMA)
    if only_oversized:
        return pieces
    cut = items.where(long).select("item_id").distinct()
    short = items.where(~long).join(cut, "item_id", "left_anti").groupBy("item_id").agg(F.min("text").alias("text"))
    n = F.length("text")
    return pieces.unionByName(
        short.select(
            F.lit(kind).alias("item_kind"), "item_id", F.lit(0).alias("piece_index"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_pos"), F.lit(0).alias("core_pos"),
            n.alias("end_pos"), size.alias("size"), F.lit(0).alias("overlap_size"), F.col("text").alias("piece"),
        )
    )


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_ARROW = [pa.string(), pa.string(), *[pa.int32()] * 7, pa.string()]


def limits(size_limits: DataFrame) -> dict[str, tuple[str, int, int | None]]:
    """The limits by kind of item; a fixed table of a few rows."""
    return {r.item_kind: (r.unit, r.max_size, r.overlap_size) for r in size_limits.select("item_kind", "unit", "max_size", "overlap_size").limit(100).collect()}
