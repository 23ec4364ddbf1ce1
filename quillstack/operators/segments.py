"""From pages to overlapping segments of whole sentences.

Everything is keyed so that no document has to fit in a task. Pages are cut into sentences in the JVM and come together
in buckets of neighbouring pages, where sentences are joined over page ends and placed relative to the bucket; a row for
each bucket then gives the running sums, and only sentences at the edges of buckets may have to be joined. Packing works
on blocks of sentences, each of which makes its segments from its sorted rows in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstack.functions import text as tx
from quillstack.functions.tokens import Counter, count_tokens
from quillstack.operators.ordered import latest, running_sum
from quillstack.schemas import SegmentConfig
from quillstack.session import materialise

#: Pages of a bucket, and sentences of a packing block.
PAGE_BUCKET, SENTENCE_BLOCK = 256, 4096


def current_pages(pages: DataFrame) -> DataFrame:
    """One row for each page of each file: the latest delivery of the latest extraction."""
    return latest(pages, ["source_file", "page_number"], ["ingested_at", "page_id"])


def current_documents(documents: DataFrame) -> DataFrame:
    """One row for each file: the latest delivery."""
    return latest(documents, ["source_file"], ["ingested_at"])


def _bodies(pages: DataFrame) -> DataFrame:
    return pages.select("source_file", "page_number", tx.strip("content").alias("body")).where(F.length("body") > 0)


def merge_pages(pages: DataFrame) -> DataFrame:
    """(source_file, page_number, start_pos, end_pos): the place of each non-blank page in its document's merged text.

    The merged text joins the stripped pages by a blank line; that separator belongs to the page before it. pages:
    (source_file, page_number, content), one row for each page."""
    sizes = _bodies(pages).select("source_file", "page_number", F.length("body").alias("n"))
    return _placed(sizes).select("source_file", "page_number", "start_pos", (F.col("start_pos") + F.col("n") + 2).alias("end_pos"))


def _placed(sizes: DataFrame) -> DataFrame:
    return running_sum(sizes, ["source_file"], _page_bucket(), ["page_number"], F.col("n") + 2, "start_pos")


def _page_bucket() -> Column:
    return F.floor(F.col("page_number") / PAGE_BUCKET)


_CUT = (
    ("source_file", pa.string()), ("bucket", pa.int64()), ("variant", pa.int8()), ("rel", pa.int32()), ("sentence", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("page_numbers", pa.list_(pa.int32())),
    ("first", pa.bool_()), ("last", pa.bool_()), ("n_rows", pa.int32()), ("size", pa.int64()), ("head_open", pa.bool_()), ("head_digit", pa.bool_()), ("stops", pa.bool_()), ("refers", pa.bool_()),
)
_CUT_SCHEMA = (
    "source_file string, bucket bigint, variant tinyint, rel int, sentence string, start_pos bigint, end_pos bigint, page_numbers array<int>, first boolean, last boolean, n_rows int, size bigint, "
    "head_open boolean, head_digit boolean, stops boolean, refers boolean"
)


def _opens(stops, refers, head_open, head_digit):
    """Whether a page opens a new sentence, by the end of the page before; for columns and for plain values."""
    return stops & head_open & ~(refers & head_digit) if isinstance(stops, Column) else stops and head_open and not (refers and head_digit)


def _bucket_rows(source: str, bucket: int, pages: list[dict], variant: int) -> list[tuple]:
    """Rows of _CUT for a bucket of pages in order, with places and numbers counted from its beginning. Variant 1 takes
    the first page for its document's first, 0 for another one, -1 stands where both are the same."""
    rows: list[list] = []
    at, end = 0, None
    for k, p in enumerate(pages):
        side = p["alone"] if not k and variant == 1 else p["inner"]
        new = end is None or _opens(end["stops"], end["refers"], p["head_open"], p["head_digit"])
        place = at
        for part in side["parts"]:
            start = place + part["lead"]
            if new:
                rows.append([[part["text"]], start, start + len(part["text"]), [p["page_number"]]])
            else:
                rows[-1][0].append(part["text"])
                rows[-1][2] = start + len(part["text"])
                rows[-1][3].append(p["page_number"])
            place += part["n"]
            new = True
        at += p["n"] + 2
        end = side
    out = []
    for i, (texts, start, stop, numbers) in enumerate(rows):
        ends = (len(rows), at, pages[0]["head_open"], pages[0]["head_digit"], end["stops"], end["refers"]) if i == len(rows) - 1 else (None,) * 6
        out.append((source, bucket, variant, i, "\n\n".join(texts), start, stop, numbers, i == 0, i == len(rows) - 1, *ends))
    return out


def page_sentences(pages: DataFrame, counter: Counter = count_tokens, bucket: int = PAGE_BUCKET) -> DataFrame:
    """(source_file, sentence_no, sentence, start_pos, end_pos, page_numbers, tokens): the sentences of each document.

    Numbers and places count from 0 in the merged text. A sentence may run over page ends; page_numbers are the pages
    that it touches. The texts go through one exchange, by file and bucket of pages."""
    body = _bodies(pages)

    def side(before: str) -> Column:
        """Parts by the boundaries inside a page, as if other pages (or, with nothing before, only later ones) lay around it."""
        whole = F.concat(F.lit(before), F.col("body"), F.lit("\n\n"))
        parts = F.split(tx.mark_boundaries(F.substring(tx.protect(whole), F.lit(len(before) + 1), F.length("body"))), tx.BOUNDARY)
        tail = F.element_at(parts, -1)
        lead = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"(?U)^\s+", ""))
        clean = F.transform(parts, lambda x: F.struct(tx.strip(tx.restore(x)).alias("text"), F.length(x).alias("n"), lead(x).alias("lead")))
        return F.struct(clean.alias("parts"), tail.rlike(r"[.!?]$").alias("stops"), tail.rlike(r"(?iU)§\s*\d+\s+Satz\.$").alias("refers"))

    numbered = F.col("body").rlike(r"(?U)^\d{1,3}\.(\s|$)")  # only then it matters whether a page is a document's first
    cut = body.select(
        "source_file", F.floor(F.col("page_number") / bucket).cast("bigint").alias("bucket"), "page_number", F.length("body").alias("n"), F.col("body").rlike(f"^[{tx.OPENING}]").alias("head_open"), F.col("body").rlike("^[0-9]").alias("head_digit"),
        side("\n\n").alias("inner"), F.when(numbered, side("")).alias("alone"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def flush() -> None:
            for variant in (0, 1) if held[0]["alone"] is not None else (-1,):
                out.extend(_bucket_rows(*key, held, variant))

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for row in batch.slice(at, 500).to_pylist():
                    if key != (row["source_file"], row["bucket"]):
                        if held:
                            flush()
                        key, held = (row["source_file"], row["bucket"]), []
                    held.append(row)
                if len(out) >= 2000:
                    yield _batch(out, _CUT)
                    out = []
        if held:
            flush()
        if out:
            yield _batch(out, _CUT)

    ordered = cut.repartition("source_file", "bucket").sortWithinPartitions("source_file", "bucket", "page_number")
    raw = materialise(ordered.mapInArrow(run, _CUT_SCHEMA).withColumn("tokens", counter(F.col("sentence"))), "cut")
    # a row for each bucket: where it begins, whether it opens a sentence, and whether the next one does
    file = Window.partitionBy("source_file")
    order = file.orderBy("bucket")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = raw.where("last").withColumn("_first", F.min("bucket").over(file) == F.col("bucket")).where("variant < 0 OR (variant = 1) = _first")
    before = F.lag(F.struct("stops", "refers")).over(order)
    ends = ends.withColumn("opens", before.isNull() | _opens(before["stops"], before["refers"], F.col("head_open"), F.col("head_digit")))
    goes_on = (~F.col("opens")).cast("int")
    ends = ends.withColumns({"_rows": F.col("n_rows") - goes_on})
    places = ends.select(
        "source_file", "bucket", "variant", "opens", F.coalesce(F.lead("opens").over(order), F.lit(True)).alias("next_opens"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("_at"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - goes_on).alias("_no"),
    )
    rows = raw.join(materialise(places, "places"), ["source_file", "bucket", "variant"])
    complete = ~((F.col("first") & ~F.col("opens")) | (F.col("last") & ~F.col("next_opens")))
    rows = rows.select("source_file", (F.col("_no") + F.col("rel")).alias("sentence_no"), "sentence", (F.col("_at") + F.col("start_pos")).alias("start_pos"), (F.col("_at") + F.col("end_pos")).alias("end_pos"), "page_numbers", "tokens", complete.alias("_complete"))
    inside = rows.where("_complete").drop("_complete")
    ordered = F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "sentence", "page_numbers")))
    across = rows.where("NOT _complete").groupBy("source_file", "sentence_no").agg(ordered.alias("o"))
    across = across.select(
        "source_file", "sentence_no", F.array_join(F.transform("o", lambda x: x["sentence"]), "\n\n").alias("sentence"), F.element_at("o", 1)["start_pos"].alias("start_pos"), F.element_at("o", -1)["end_pos"].alias("end_pos"),
        F.sort_array(F.array_distinct(F.flatten(F.transform("o", lambda x: x["page_numbers"])))).alias("page_numbers"),
    )
    return inside.unionByName(across.withColumn("tokens", counter(F.col("sentence"))))


def pages_of_spans(spans: DataFrame, merged: DataFrame, key: str = "source_file", width: int = 4096) -> DataFrame:
    """spans with page_numbers: the ascending pages that each span [start_pos, end_pos) touches (interval join).

    Both sides are cut at multiples of width, so that the join is by equality on (key, cell) and then by range."""
    cells = lambda: F.explode(F.sequence(F.floor(F.col("start_pos") / width), F.floor((F.greatest(F.col("end_pos"), F.col("start_pos") + 1) - 1) / width)))
    left = spans.select("*", cells().alias("_cell"))
    right = merged.select(F.col(key), F.col("page_number").alias("_page"), F.col("start_pos").alias("_a"), F.col("end_pos").alias("_b"), cells().alias("_cell"))
    touching = left.join(right, [key, "_cell"], "left").where("_page IS NULL OR (_a < end_pos AND _b > start_pos)")
    return touching.groupBy(*spans.columns).agg(F.sort_array(F.collect_set("_page")).alias("page_numbers"))


def _follow(tokens: np.ndarray, config: SegmentConfig, starts: int, complete: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first `starts` places: the last sentence of the segment that starts there and the next start.

    The next start is -1 if the segment ends with the document's last sentence (complete says that the last of the
    tokens is that one)."""
    sums = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
    s = np.arange(starts)
    n = len(tokens)
    last = np.maximum(np.searchsorted(sums, sums[s] + config.max_tokens, side="right") - 2, s)
    # the first sentence from which the rest of the segment has at least the overlap, going back from its end
    back = np.searchsorted(sums, sums[last + 1] - config.overlap_tokens, side="right") - 1
    back = np.minimum(back, last)
    has = (sums[last + 1] - config.overlap_tokens >= 0) & (back >= s)
    after = np.maximum(np.where(has, back, last + 1), s + 1)
    return last, np.where((last == n - 1) & complete, -1, after)


def _home(config: SegmentConfig, block: int) -> tuple[Column, int, int]:
    """(blocks that need a sentence `no`, block size, reach): its own block and, as look-ahead, the block before."""
    reach = config.max_tokens + 2
    block = max(block, 2 * reach)
    own = F.floor(F.col("no") / block).cast("bigint")
    return F.explode(F.when((F.col("no") % block < reach) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))).alias("block"), block, reach


def _size() -> Column:
    return F.greatest(F.col("tokens"), F.lit(1)).cast("int").alias("tokens")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
    """Runs of rows with one (source_file, block) of sorted batches: both, and the rows."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        source, block_no = batch.column(batch.schema.get_field_index("source_file")).to_numpy(zero_copy_only=False), batch.column(batch.schema.get_field_index("block")).to_numpy()
        edges = np.flatnonzero((source[1:] != source[:-1]) | (block_no[1:] != block_no[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(source)], strict=True):
            if key != (source[a], block_no[a]):
                if held:
                    yield *key, pa.Table.from_batches(held)
                key, held = (source[a], block_no[a]), []
            held.append(batch.slice(a, b - a))
    if held:
        yield *key, pa.Table.from_batches(held)


def block_entries(tokens: DataFrame, config: SegmentConfig, block: int = SENTENCE_BLOCK) -> DataFrame:
    """(source_file, block, entry): the sentence of each block, counted from its beginning, at which the chain of segments
    enters it; blocks that it passes over are left out.

    A block of sentences, with the few of the next block that its last segment can reach, says for every place in its
    beginning where the chain leaves it; one light pass over the blocks of a document finds where each is entered."""
    home, block, reach = _home(config, block)
    light = tokens.select("source_file", F.col("sentence_no").cast("bigint").alias("no"), _size()).select("source_file", home, "no", "tokens")
    keyed = light.repartition("source_file", "block").sortWithinPartitions("source_file", "block", "no")

    def exits(batches):
        out = []
        for source, b, rows in _groups(batches):
            sizes = rows.column("tokens").to_numpy()
            starts = min(block, len(sizes))
            _, after = _follow(sizes, config, starts, len(sizes) < block + reach)
            leave = np.empty(starts, np.int64)
            for s in range(starts - 1, -1, -1):
                leave[s] = after[s] if after[s] < 0 or after[s] >= block else leave[after[s]]
            entry = leave[: min(reach, starts)]
            change = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
            out.append((source, int(b), change.tolist(), entry[change].tolist()))
            if len(out) >= 500:
                yield _batch(out, _EXITS)
                out = []
        if out:
            yield _batch(out, _EXITS)

    def chase(batches):
        source, at, expected, out = None, 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["source_file"] != source:
                    source, at, expected = row["source_file"], 0, 0
                if at is None or row["block"] != expected:
                    continue
                out.append((source, expected, at))
                k = int(np.searchsorted(row["entry_from"], at, side="right")) - 1
                leave = row["leaves"][k]
                at, expected = (None, expected) if leave < 0 else (leave - block, expected + 1)
            if out:
                yield _batch(out, _ENTRIES)
                out = []

    maps = keyed.mapInArrow(exits, "source_file string, block bigint, entry_from array<int>, leaves array<bigint>")
    return maps.repartition("source_file").sortWithinPartitions("source_file", "block").mapInArrow(chase, "source_file string, block bigint, entry bigint")


def _spans(sizes: np.ndarray, entry: int, config: SegmentConfig, block: int, reach: int) -> Iterator[tuple[int, int, bool]]:
    """(first, last, is the document's last) of the segments that begin in a block, counted from its beginning."""
    starts = min(block, len(sizes))
    last, after = _follow(sizes, config, starts, len(sizes) < block + reach)
    s = entry
    while 0 <= s < starts:
        yield s, int(last[s]), bool(after[s] < 0)
        s = int(after[s])


def pack_sentences(tokens: DataFrame, config: SegmentConfig, block: int = SENTENCE_BLOCK) -> DataFrame:
    """(source_file, first_no, last_no, is_last): segments of each document, greedily filled, with overlap.

    tokens: (source_file, sentence_no, tokens), numbered from 0 without gaps. A sentence counts as at least one token."""
    home, size, reach = _home(config, block)
    entries = materialise(block_entries(tokens, config, block), "entries")
    light = tokens.select("source_file", F.col("sentence_no").cast("bigint").alias("no"), _size()).select("source_file", home, "no", "tokens")

    def run(batches):
        out = []
        for source, b, rows in _groups(batches):
            out += [(source, int(b * size + a), int(b * size + z), end) for a, z, end in _spans(rows.column("tokens").to_numpy(), rows.column("entry")[0].as_py(), config, size, reach)]
            if len(out) >= 5000:
                yield _batch(out, _SEGMENTS)
                out = []
        if out:
            yield _batch(out, _SEGMENTS)

    entered = light.join(entries, ["source_file", "block"]).repartition("source_file", "block").sortWithinPartitions("source_file", "block", "no")
    return entered.mapInArrow(run, "source_file string, first_no bigint, last_no bigint, is_last boolean")


_EXITS = (("source_file", pa.string()), ("block", pa.int64()), ("entry_from", pa.list_(pa.int32())), ("leaves", pa.list_(pa.int64())))
_ENTRIES = (("source_file", pa.string()), ("block", pa.int64()), ("entry", pa.int64()))
_SEGMENTS = (("source_file", pa.string()), ("first_no", pa.int64()), ("last_no", pa.int64()), ("is_last", pa.bool_()))
_ROWS = (("source_file", pa.string()), ("block", pa.int64()), *_SEGMENTS[1:], ("text", pa.string()), ("page_numbers", pa.list_(pa.int32())))


def _batch(rows: list[tuple], fields: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def segment_rows(sentences: DataFrame, config: SegmentConfig, counter: Counter = count_tokens, block: int = SENTENCE_BLOCK) -> DataFrame:
    """(source_file, block, first_no, last_no, is_last, text, page_numbers, token_count) of each segment.

    sentences: page_sentences, written. The chain of segments is found on the token counts alone; then the texts go
    through one exchange, by file and block, and each block makes its segments in order."""
    home, size, reach = _home(config, block)
    entries = materialise(block_entries(sentences, config, block), "entries")
    whole = sentences.select("source_file", F.col("sentence_no").cast("bigint").alias("no"), _size(), "sentence", "page_numbers").select("source_file", home, "no", "tokens", "sentence", "page_numbers")

    def run(batches):
        out = []
        for source, b, rows in _groups(batches):
            texts, pages = rows.column("sentence").to_pylist(), rows.column("page_numbers").to_pylist()
            for a, z, end in _spans(rows.column("tokens").to_numpy(), rows.column("entry")[0].as_py(), config, size, reach):
                out.append((source, int(b), int(b * size + a), int(b * size + z), end, " ".join(texts[a : z + 1]), sorted({n for p in pages[a : z + 1] for n in p})))
                if len(out) >= 2000:
                    yield _batch(out, _ROWS)
                    out = []
        if out:
            yield _batch(out, _ROWS)

    entered = whole.join(entries, ["source_file", "block"]).repartition("source_file", "block").sortWithinPartitions("source_file", "block", "no")
    made = entered.mapInArrow(run, "source_file string, block bigint, first_no bigint, last_no bigint, is_last boolean, text string, page_numbers array<int>")
    return made.withColumn("token_count", counter(F.col("text")))


def drop_small(rows: DataFrame, config: SegmentConfig) -> DataFrame:
    """Without segments below the minimum; a document's last segment stays however small it is."""
    return rows.where((F.col("token_count") >= config.min_tokens) | F.col("is_last"))


def number_segments(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Segments with index, total, ids of their neighbours and the fields of their document.

    rows: segment_rows, written. documents: (source_file, context). A segment without a document row keeps nulls in its
    fields. Blocks are numbered on a row for each block, and segments inside their block."""
    file = Window.partitionBy("source_file")
    counts = rows.groupBy("source_file", "block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("source_file", "block", before.alias("_before"), F.sum("_n").over(file).alias("total_chunks"))
    inside = F.row_number().over(Window.partitionBy("source_file", "block").orderBy("first_no")) - 1
    numbered = rows.withColumn("_inside", inside).join(counts, ["source_file", "block"]).withColumn("chunk_index", F.col("_before") + F.col("_inside"))
    fields = documents.select(
        "source_file", F.col("context.title").alias("document_title"), F.col("context.document_type").alias("document_type"), F.coalesce("context.institution", F.lit("")).alias("institution"),
        F.coalesce("context.degree_program", F.lit("")).alias("degree_program"),
    )
    out = numbered.join(fields, "source_file", "left")
    document, index = tx.document_id(F.col("source_file")), F.col("chunk_index")
    return out.select(
        "source_file", tx.chunk_id(document, index).alias("chunk_id"), "text", "token_count", document.alias("document_id"), "document_title", "document_type", "institution", "degree_program",
        "page_numbers", index.cast("int").alias("chunk_index"), F.col("total_chunks").cast("int").alias("total_chunks"),
        F.when(index > 0, tx.chunk_id(document, index - 1)).alias("prev_chunk_id"), F.when(index < F.col("total_chunks") - 1, tx.chunk_id(document, index + 1)).alias("next_chunk_id"),
    )


def segment_documents(pages: DataFrame, documents: DataFrame, config: SegmentConfig | None = None, counter: Counter = count_tokens) -> DataFrame:
    """Pages to numbered segments, all documents at once. pages: one row for each page of each file."""
    return segments_of(page_sentences(pages, counter), documents, config or SegmentConfig(), counter)


def segments_of(sentences: DataFrame, documents: DataFrame, config: SegmentConfig, counter: Counter = count_tokens) -> DataFrame:
    """Sentences (page_sentences) to numbered segments."""
    rows = materialise(segment_rows(sentences, config, counter), "segments")
    return number_segments(drop_small(rows, config), documents)


def segment_stats(chunks: DataFrame, sentences: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """A row for each document: counts and token sizes; all zero for a document without segments."""
    by_chunk = chunks.groupBy("source_file").agg(
        F.count("*").alias("total_chunks"), F.sum("token_count").alias("total_tokens"), F.avg("token_count").alias("avg_chunk_tokens"), F.min("token_count").alias("min_chunk_tokens"), F.max("token_count").alias("max_chunk_tokens"),
    )
    by_sentence = sentences.groupBy("source_file").agg(F.count("*").alias("total_sentences"))
    by_page = pages.groupBy("source_file").agg(F.count("*").alias("total_pages_processed"))
    out = documents.select("source_file").join(by_chunk, "source_file", "left").join(by_sentence, "source_file", "left").join(by_page, "source_file", "left")
    none = F.col("total_chunks").isNull()
    zero = lambda c, kind: F.when(none, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).cast(kind).alias(c)
    return out.select(
        "source_file", zero("total_chunks", "bigint"), zero("total_tokens", "bigint"), zero("avg_chunk_tokens", "double"), zero("min_chunk_tokens", "int"), zero("max_chunk_tokens", "int"), zero("total_sentences", "bigint"), zero("total_pages_processed", "bigint"),
    )


def segment_results(chunks: DataFrame, stats: DataFrame, config: SegmentConfig) -> DataFrame:
    """Rows in the form of a chunking result, one for each file, for writing as JSON (sources.json_results.write_json)
    and reading with read_chunks; a document becomes one row. chunks: segment_documents; stats: segment_stats."""
    meta = ("document_id", "document_title", "document_type", "institution", "degree_program", "page_numbers", "chunk_index", "total_chunks", "prev_chunk_id", "next_chunk_id")
    row = F.struct("chunk_index", F.struct("chunk_id", "text", "token_count", F.struct(*meta).alias("metadata")).alias("c"))
    nested = chunks.groupBy("source_file").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["c"]).alias("chunks"))
    sizes = F.struct(F.lit(config.max_tokens).alias("max_chunk_tokens"), F.lit(config.overlap_tokens).alias("overlap_tokens"), F.lit(config.min_tokens).alias("min_chunk_tokens"))
    return stats.join(nested, "source_file", "left").select(
        "source_file", tx.document_id(F.col("source_file")).alias("document_id"), sizes.alias("config"), F.coalesce("chunks", F.array()).alias("chunks"),
        F.struct("total_chunks", "total_tokens", "avg_chunk_tokens", "min_chunk_tokens", "max_chunk_tokens", "total_sentences", "total_pages_processed").alias("stats"),
        F.current_timestamp().cast("timestamp_ntz").alias("created_at"),
    )
