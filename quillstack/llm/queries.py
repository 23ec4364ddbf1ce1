"""The pN_ queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillstack.llm import bagminhash, corpus_ids, groups, lookalike, packing, repetition, residue, sentences, tree_split
from quillstack.session import materialise, ship_package
from quillstack.sources.tables import table

#: Similarity from which chunks are near-duplicates in this project's data.
CHUNK_SIMILARITY = 0.75
#: White space of any kind, for a class of a regular expression in Java and in DuckDB.
_SPACE = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _pieces(spark: SparkSession, folder: str, only_oversized: bool) -> DataFrame:
    limit = tree_split.limits(table(spark, folder, "size_limits"))
    pages = tree_split.split_items(table(spark, folder, "extracted_pages"), "page", "page_id", "content", *limit["page"], only_oversized=only_oversized)
    chunks = tree_split.split_items(table(spark, folder, "chunks"), "chunk", "chunk_id", "text", *limit["chunk"], only_oversized=only_oversized)
    return pages.unionByName(chunks)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every item that the splitter had to cut."""
    return _pieces(spark, folder, only_oversized=True).where("piece_index = 0 AND n_pieces > 1").select("item_kind", "item_id")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every page and chunk."""
    return _pieces(spark, folder, only_oversized=False)


def p1_cover(spark: SparkSession, folder: str) -> DataFrame:
    """For every item: the characters that its pieces cover, and whether they are in order, within the limit and overlap as stated."""
    limit = tree_split.limits(table(spark, folder, "size_limits"))
    room = F.create_map(*[F.lit(x) for k in ("page", "chunk") for x in (k, limit[k][1])])[F.col("item_kind")]
    shared = F.create_map(*[F.lit(x) for k in ("page", "chunk") for x in (k, limit[k][2] or 0)])[F.col("item_kind")]
    sound = (F.col("size") <= room) & (F.col("overlap_size") == F.when(F.col("piece_index") > 0, shared).otherwise(0)) & (F.length("piece") == F.col("end_pos") - F.col("start_pos")) & (F.col("core_pos") >= F.col("start_pos"))
    by = _pieces(spark, folder, only_oversized=False).groupBy("item_kind", "item_id").agg(
        F.sum(F.col("end_pos") - F.col("core_pos")).cast("bigint").alias("n_chars"), F.min("core_pos").alias("_a"), F.max("end_pos").alias("_z"), F.count_distinct("core_pos").alias("_cores"), F.count("*").alias("_n"), F.every(sound).alias("_sound"),
    )
    whole = F.col("_sound") & (F.col("_a") == 0) & (F.col("_z") == F.col("n_chars")) & (F.col("_cores") == F.col("_n"))
    return by.select("item_kind", "item_id", "n_chars", whole.alias("sound"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of near-duplicate chunks."""
    return bagminhash.near_duplicate_pairs(table(spark, folder, "chunks"), "chunk_id", "text", CHUNK_SIMILARITY, "chunk_id_a", "chunk_id_b")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk with its class of equal bags, the number of linked classes and its group of linked classes."""
    members, links = bagminhash.near_duplicates(table(spark, folder, "chunks"), "chunk_id", "text", CHUNK_SIMILARITY)
    return groups.membership(members, links, "chunk_id")


def p2_multiset(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks whose words with their counts overlap by as much: the hierarchy over weights at work."""
    return bagminhash.near_duplicate_pairs(table(spark, folder, "chunks"), "chunk_id", "text", CHUNK_SIMILARITY, "chunk_id_a", "chunk_id_b", weights="count")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of which at least 30 % is repeated. The distances say nothing about that and are left to p3_profile."""
    profile = repetition.repetition_profile(table(spark, folder, "extracted_pages"), "page_id", "content", with_divergence=False)
    return profile.where(F.col("repeated_share") >= repetition.THRESHOLD).select("page_id")


def p3_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Share of repetition and divergence of every page."""
    return repetition.repetition_profile(table(spark, folder, "extracted_pages"), "page_id", "content")


def p3_share(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of every page and how many of them are repeated."""
    return repetition.repetition_profile(table(spark, folder, "extracted_pages"), "page_id", "content", with_divergence=False).select("page_id", "n_chars", "repeated_chars")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Start of every unit on the pages to be compared."""
    wanted = table(spark, folder, "sentence_check").select("page_id")
    pages = table(spark, folder, "extracted_pages").select("page_id", "content").join(wanted, "page_id", "left_semi")
    return sentences.sentence_units(pages, "page_id", "content", with_text=False).select("page_id", "start_pos")


def p4_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence units of every page."""
    return sentences.sentence_units(table(spark, folder, "extracted_pages"), "page_id", "content")


def p4_cover(spark: SparkSession, folder: str) -> DataFrame:
    """For every page with units: its visible characters that lie in units, and whether these come in order without overlap."""
    units = sentences.sentence_units(table(spark, folder, "extracted_pages"), "page_id", "content")
    visible = F.length(F.regexp_replace("sentence", f"[{_SPACE}]", ""))
    place = Window.partitionBy("page_id").orderBy("unit_no")
    after = units.withColumns({"_visible": visible, "_apart": F.coalesce(F.col("start_pos") >= F.lag("end_pos").over(place), F.lit(True)) & (F.length("sentence") == F.col("end_pos") - F.col("start_pos"))})
    return after.groupBy("page_id").agg(F.sum("_visible").alias("n_visible"), (F.every("_apart") & (F.max("unit_no") == F.count("*") - 1)).alias("in_order"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that hold residue instead of text, or unfilled slots amid text."""
    return residue.judge(table(spark, folder, "extracted_pages"), "page_id", "content").select("page_id")


def p5_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The same pages with the verdicts."""
    return residue.judge(table(spark, folder, "extracted_pages"), "page_id", "content")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return corpus_ids.encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def _containers(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, int]]:
    room = {k: size for k, (unit, size, _) in tree_split.limits(table(spark, folder, "size_limits")).items() if unit == "tokenizer_ids"}
    sized = corpus_ids.measure_corpus(table(spark, folder, "documents"), "doc_id", "text")
    return packing.fill_all(sized, "doc_id", room), room


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every part of every document, for each capacity."""
    return _containers(spark, folder)[0]


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers are filled."""
    return packing.fill_report(*_containers(spark, folder))


def p7_sound(spark: SparkSession, folder: str) -> DataFrame:
    """For each capacity: no container holds more, every text is there whole, and only larger ones are split."""
    parts, room = _containers(spark, folder)
    parts = materialise(parts, "containers")
    sized = corpus_ids.measure_corpus(table(spark, folder, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.max("size").alias("size"))
    capacity = F.create_map(*[F.lit(x) for pair in sorted(room.items()) for x in pair])[F.col("container_kind")]
    full = parts.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("container_kind").agg(F.every(F.col("n") <= capacity).alias("_room"))
    by = parts.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    wanted = sized.withColumn("container_kind", F.explode(F.array(*map(F.lit, sorted(room))))).join(by, ["container_kind", "doc_id"], "left")
    whole = wanted.groupBy("container_kind").agg(F.every(F.coalesce((F.col("n") == F.col("size")) & (F.col("k") == F.greatest(F.lit(1), F.ceil(F.col("size") / capacity))), F.lit(False))).alias("_whole"))
    return full.join(whole, "container_kind").select("container_kind", (F.col("_room") & F.col("_whole")).alias("sound"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that look the same but are written differently."""
    return lookalike.lookalike_pairs(table(spark, folder, "documents"), "doc_id", "text", "doc_id_a", "doc_id_b")


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in its one form."""
    return lookalike.unify(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "form")


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs in compact form: each document with its form, its spelling and the number of other spellings."""
    return lookalike.lookalike_classes(table(spark, folder, "documents"), "doc_id", "text")


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p1_pieces, p1_cover, p2_found, p2_groups, p2_multiset, p3_found, p3_profile, p3_share, p4_found, p4_sentences, p4_cover, p5_found, p5_kinds, p6_ids, p7_containers, p7_fill, p7_sound, p8_found, p8_classes, p8_forms)
    return {f.__name__: _shipped(f) for f in every}


#: White space of any kind, as a class of a regular expression in DuckDB.
_WS = f"[{_SPACE}]+"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
            WITH items AS (
                SELECT 'page' AS item_kind, CAST(page_id AS VARCHAR) AS item_id, length(content) AS n FROM extracted_pages
                UNION
                SELECT 'chunk', chunk_id, len(regexp_extract_all(text, '[\p{L}\p{N}]{1,4}|[^\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\p{L}\p{N}]')) FROM chunks)
            SELECT DISTINCT item_kind, item_id FROM items JOIN size_limits USING (item_kind) WHERE n > max_size""",
        "p2_found": f"""
            WITH once AS (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1),
            words AS (SELECT DISTINCT chunk_id, unnest(string_split(trim(regexp_replace(lower(text), '{_WS}', ' ', 'g'), ' '), ' ')) AS word FROM once WHERE text IS NOT NULL),
            real AS (SELECT * FROM words WHERE word <> ''),
            sizes AS (SELECT chunk_id, count(*) AS n FROM real GROUP BY 1),
            common AS (SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, count(*) AS n FROM real a JOIN real b ON a.word = b.word AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
            SELECT chunk_id_a, chunk_id_b FROM common JOIN sizes x ON x.chunk_id = chunk_id_a JOIN sizes y ON y.chunk_id = chunk_id_b
            WHERE common.n >= {CHUNK_SIMILARITY} * (x.n + y.n - common.n)""",
        "p2_multiset": f"""
            WITH once AS (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1),
            words AS (SELECT chunk_id, unnest(string_split(trim(regexp_replace(lower(text), '{_WS}', ' ', 'g'), ' '), ' ')) AS word FROM once WHERE text IS NOT NULL),
            real AS (SELECT chunk_id, word, count(*) AS k FROM words WHERE word <> '' GROUP BY 1, 2),
            sizes AS (SELECT chunk_id, sum(k) AS n FROM real GROUP BY 1),
            common AS (SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, sum(least(a.k, b.k)) AS n FROM real a JOIN real b ON a.word = b.word AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
            SELECT chunk_id_a, chunk_id_b FROM common JOIN sizes x ON x.chunk_id = chunk_id_a JOIN sizes y ON y.chunk_id = chunk_id_b
            WHERE common.n >= {CHUNK_SIMILARITY} * (x.n + y.n - common.n)""",
        "p3_found": f"""
            WITH once AS (SELECT page_id, min(content) AS content FROM extracted_pages GROUP BY 1),
            texts AS (SELECT page_id, trim(regexp_replace(lower(content), '{_WS}', ' ', 'g'), ' ') AS t FROM once WHERE content IS NOT NULL),
            starts AS (SELECT page_id, length(t) AS n, unnest(generate_series(1, length(t) - {repetition.WINDOW - 1})) AS i, t FROM texts WHERE length(t) > {repetition.WINDOW}),
            again AS (SELECT page_id, n, i, row_number() OVER (PARTITION BY page_id, substr(t, i, {repetition.WINDOW}) ORDER BY i) > 1 AS later FROM starts),
            steps AS (SELECT page_id, n, i, lag(i) OVER (PARTITION BY page_id ORDER BY i) AS before FROM again WHERE later)
            SELECT page_id FROM steps GROUP BY page_id, n
            HAVING sum(CASE WHEN before IS NULL OR i - before >= {repetition.WINDOW} THEN {repetition.WINDOW} ELSE i - before END) >= {repetition.THRESHOLD} * n""",
        "p1_cover": """
            SELECT 'page' AS item_kind, CAST(page_id AS VARCHAR) AS item_id, length(min(content)) AS n_chars, true AS sound FROM extracted_pages WHERE content <> '' GROUP BY page_id
            UNION ALL SELECT 'chunk', chunk_id, length(min(text)), true FROM chunks WHERE text <> '' GROUP BY chunk_id""",
        "p3_share": f"""
            WITH once AS (SELECT page_id, min(content) AS content FROM extracted_pages GROUP BY 1),
            texts AS (SELECT page_id, coalesce(trim(regexp_replace(lower(content), '{_WS}', ' ', 'g'), ' '), '') AS t FROM once),
            starts AS (SELECT page_id, unnest(generate_series(1, length(t) - {repetition.WINDOW - 1})) AS i, t FROM texts WHERE length(t) > {repetition.WINDOW}),
            again AS (SELECT page_id, i, row_number() OVER (PARTITION BY page_id, substr(t, i, {repetition.WINDOW}) ORDER BY i) > 1 AS later FROM starts),
            steps AS (SELECT page_id, i, lag(i) OVER (PARTITION BY page_id ORDER BY i) AS before FROM again WHERE later),
            shares AS (SELECT page_id, sum(CASE WHEN before IS NULL OR i - before >= {repetition.WINDOW} THEN {repetition.WINDOW} ELSE i - before END) AS n FROM steps GROUP BY 1)
            SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, CAST(coalesce(n, 0) AS INTEGER) AS repeated_chars FROM texts LEFT JOIN shares USING (page_id)""",
        "p4_cover": f"""
            WITH once AS (SELECT page_id, min(content) AS content FROM extracted_pages WHERE content IS NOT NULL GROUP BY 1), seen AS (SELECT page_id, length(regexp_replace(content, '{_WS}', '', 'g')) AS n_visible FROM once)
            SELECT page_id, n_visible, true AS in_order FROM seen WHERE n_visible > 0""",
        "p7_sound": "SELECT item_kind AS container_kind, true AS sound FROM size_limits WHERE unit = 'tokenizer_ids'",
    }
