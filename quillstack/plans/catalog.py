"""All queries on the core operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstack.adapters import EchoModel, PlainTextRenderer, hash_embedding
from quillstack.functions import prompts, text as tx
from quillstack.functions.tokens import count_tokens, count_tokens_batch
from quillstack.functions.where import apply_where
from quillstack.operators import collection as col, documents as docs, extraction as ext, responses as resp, retrieval as ret, segments as seg
from quillstack.operators.ordered import latest, running_sum
from quillstack.plans.sql import SQL
from quillstack.schemas import SegmentConfig, StoreConfig, valid_context, valid_page
from quillstack.session import application_folder, discard, materialise, ship_package, spread
from quillstack.sources import json_results as js
from quillstack.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: Sizes of the packing queries; the SQL uses the same.
CONFIG = SegmentConfig(max_tokens=120, overlap_tokens=30, min_tokens=50)
BUDGET, TOP = 300, 5


def query(f: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return f(spark, folder)

    _QUERIES[f.__name__] = run
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _pages(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    raw = table(spark, folder, "extracted_pages")
    keys = ("source_file", "page_number", "ingested_at", "page_id")
    return seg.current_pages(raw.select(*keys, *[c for c in columns if c not in keys]))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return seg.current_documents(table(spark, folder, "extraction_results").select("source_file", "context", "ingested_at"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "chunks"), ["chunk_id"], ["ingested_at", "token_count"])


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def _csv(column: str):
    return F.concat_ws(",", column).alias(column)


@query
def page_merge(spark, folder):
    """Place of every non-blank page in its document's merged text."""
    return seg.merge_pages(_pages(spark, folder, "content")).select("source_file", "page_number", "start_pos", "end_pos")


@query
def page_stats(spark, folder):
    return docs.all_page_stats(_documents(spark, folder), _pages(spark, folder, "content", "has_table", "has_list", "extraction_confidence"))


@query
def full_content(spark, folder):
    return docs.full_content(_pages(spark, folder, "content"))


@query
def all_sections(spark, folder):
    return docs.all_sections(_pages(spark, folder, "sections"))


@query
def document_id(spark, folder):
    return table(spark, folder, "extraction_results").select("source_file").distinct().withColumn("document_id", tx.document_id(F.col("source_file")))


@query
def abbreviation_map(spark, folder):
    return _documents(spark, folder).select("source_file", F.explode(docs.abbreviation_map(F.col("context.abbreviations"))).alias("short", "long"))


@query
def failed_pages(spark, folder):
    """Pages to look at again: low confidence or a refusal."""
    pages = _pages(spark, folder, "content", "extraction_confidence")
    return docs.failed_pages(pages, resp.is_refusal(F.col("content"))).select("source_file", _csv("failed"), F.array_join("errors", "; ").alias("errors"))


@query
def refusal_filter(spark, folder):
    """Refusals among replies and pages, and among replies that are refusals because such a phrase is put before them."""
    raw = table(spark, folder, "raw_responses")
    pages = table(spark, folder, "extracted_pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("content").alias("text"))
    replies = raw.select(F.lit("reply").alias("kind"), F.col("response_id").alias("id"), F.col("response_text").alias("text"))
    made = replies.select(F.lit("made").alias("kind"), "id", F.concat(F.lit("Sorry, i am UNABLE to read this. "), F.coalesce("text", F.lit(""))).alias("text"))
    return replies.unionByName(pages).unionByName(made).where(resp.is_refusal(F.col("text"))).select("kind", "id").distinct()


@query
def page_validation(spark, folder):
    """Rows outside their domains, by table, of the rows as they are and of rows moved out of range."""
    p = table(spark, folder, "extracted_pages").select("page_number", F.col("extraction_confidence").alias("confidence"))
    moved = p.select((F.col("page_number") - 1).alias("page_number"), (F.col("confidence") + 0.25).alias("confidence"))
    bad_pages = [x.where(~valid_page(F.col("page_number"), F.col("confidence"))).select(F.lit(kind).alias("kind")) for kind, x in (("page", p), ("moved_page", moved))]
    d = table(spark, folder, "extraction_results").select("context.document_type", "context.title", "context.total_pages", "context.language")
    changed = d.select("document_type", "title", (F.col("total_pages") - 20).alias("total_pages"), F.upper("language").alias("language"))
    bad = [x.where(~valid_context(F.col("document_type"), F.col("title"), F.col("total_pages"), F.col("language"))).select(F.lit(kind).alias("kind")) for kind, x in (("document", d), ("changed_document", changed))]
    return reduce(DataFrame.unionByName, [*bad_pages, *bad]).groupBy("kind").agg(F.count("*").alias("n"))


@query
def sample_pages(spark, folder):
    return _documents(spark, folder).select("source_file", F.array_join(docs.sample_pages(F.col("context.total_pages")), ",").alias("pages"))


@query
def context_string(spark, folder):
    return _documents(spark, folder).select("source_file", prompts.context_string(F.col("context")).alias("context_string"))


@query
def page_prompt(spark, folder):
    """Prompts of every page, with its document's lines."""
    known = _documents(spark, folder).select("source_file", F.col("context.total_pages").alias("total_pages"), prompts.page_system_prompt(F.col("context")).alias("system_prompt"))
    out = _pages(spark, folder).select("source_file", "page_number").join(known, "source_file")
    return out.select("source_file", "page_number", F.md5("system_prompt").alias("system_md5"), prompts.page_user_prompt(F.col("page_number"), F.col("total_pages")).alias("user_prompt"))


@query
def token_usage(spark, folder):
    return docs.token_usage(table(spark, folder, "raw_responses"))


@query
def json_extract(spark, folder):
    return table(spark, folder, "raw_responses").select("response_id", resp.find_json(F.col("response_text")).alias("found"))


@query
def page_parse(spark, folder):
    p = table(spark, folder, "raw_responses").select("response_id", resp.parse_page(F.col("response_text"), F.col("page_number")).alias("p"))
    return p.select(
        "response_id", "p.page_number", "p.content", F.size("p.sections").alias("n_sections"), F.array_join("p.sections.number", "|").alias("numbers"), F.array_join(F.transform("p.sections.title", lambda t: F.coalesce(t, F.lit("-"))), "|").alias("titles"),
        F.array_join("p.content_types", ",").alias("content_types"), "p.has_table", "p.has_list", "p.has_figure", "p.continues_from_previous", "p.continues_to_next", "p.extraction_confidence",
        *[F.array_join(f"p.{c}", "|").alias(c) for c in ("paragraph_numbers", "internal_references", "external_references")], F.col("p.extraction_notes").isNotNull().alias("noted"),
    )


@query
def context_parse(spark, folder):
    """Contexts written as fenced replies and parsed back."""
    fields = F.struct(*[F.col(f"context.{f}").alias(f) for f in ("document_type", "title", "institution", "faculty", "version_date", "version_info", "degree_program", "chapters", "main_topics", "abbreviations", "key_terms", "referenced_documents", "legal_basis")])
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(fields), F.lit("\n```"))
    c = _documents(spark, folder).select("source_file", resp.parse_context(reply, F.col("context.total_pages")).alias("c"))
    return c.select(
        "source_file", "c.document_type", "c.title", "c.institution", "c.faculty", "c.version_date", "c.version_info", "c.degree_program", "c.legal_basis", "c.language", "c.total_pages",
        *[F.array_join(f"c.{x}", "|").alias(x) for x in ("chapters", "main_topics", "key_terms", "referenced_documents")],
        F.array_join(F.transform("c.abbreviations", lambda a: F.concat(a["short"], F.lit("="), a["long"])), "|").alias("abbreviations"),
    )


@query
def json_roundtrip(spark, folder):
    """Documents with their pages, written as JSON and read again."""
    names = ("page_number", "content", "sections", "paragraph_numbers", "content_types", "has_table", "has_list", "has_figure", "internal_references", "external_references", "continues_from_previous", "continues_to_next", "extraction_confidence", "extraction_notes")
    pages = _pages(spark, folder, *names).groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("pages"))
    path = f"{application_folder(spark)}/json-{uuid.uuid4().hex}"
    js.write_json(latest(table(spark, folder, "extraction_results"), ["source_file"], ["ingested_at"]).drop("ingested_at").join(pages, "source_file", "left"), path)
    back = js.read_extractions(spark, path, multi_line=False)
    total = F.aggregate("pages", F.lit(0), lambda s, p: s + F.length(F.coalesce(p["content"], F.lit(""))))
    return back.select("source_file", F.col("context.title").alias("title"), "processed_at", F.coalesce(F.size("pages"), F.lit(0)).alias("n_pages"), F.coalesce(total, F.lit(0)).alias("n_chars"))


@query
def sentence_split(spark, folder):
    return _texts(spark, folder).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("position", "sentence"))


@query
def sentence_count(spark, folder):
    return _texts(spark, folder).select("doc_id", F.size(tx.sentences(F.col("text"))).alias("n_sentences"))


@query
def token_count(spark, folder):
    text = F.col("text")
    return _texts(spark, folder).select("doc_id", count_tokens(text).alias("tokens"), F.aggregate(count_tokens_batch(tx.sentences(text)), F.lit(0), lambda s, x: s + x).alias("sentence_tokens"))


def _sentences(spark, folder):
    return seg.page_sentences(_pages(spark, folder, "content"))


@query
def sentence_pages(spark, folder):
    """Sentences of the merged documents with the pages that they touch."""
    return _sentences(spark, folder).select("source_file", "sentence_no", "sentence", "start_pos", "end_pos", _csv("page_numbers"), "tokens")


@query
def sentence_pages_join(spark, folder):
    """The same pages by an interval join of spans and pages."""
    spans = _sentences(spark, folder).select("source_file", "sentence_no", "start_pos", "end_pos")
    return seg.pages_of_spans(spans, seg.merge_pages(_pages(spark, folder, "content"))).select("source_file", "sentence_no", "start_pos", "end_pos", _csv("page_numbers"))


@query
def chunk_pack(spark, folder):
    return seg.pack_sentences(_sentences(spark, folder), CONFIG).select("source_file", "first_no", "last_no", "is_last")


def _segments(spark, folder):
    return seg.segment_documents(_pages(spark, folder, "content"), _documents(spark, folder), CONFIG)


@query
def micro_chunk_filter(spark, folder):
    rows = seg.drop_small(materialise(seg.segment_rows(_sentences(spark, folder), CONFIG), "segments"), CONFIG)
    return rows.select("source_file", "first_no", "last_no", "token_count")


@query
def chunk_metadata(spark, folder):
    """Pages to numbered segments with neighbours."""
    return _segments(spark, folder).withColumn("page_numbers", F.concat_ws(",", "page_numbers"))


@query
def chunk_stats(spark, folder):
    chunks = materialise(_segments(spark, folder), "segments")
    return seg.segment_stats(chunks, _sentences(spark, folder), _pages(spark, folder), _documents(spark, folder))


def vector_collection(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings as a collection: a label is a document, its vectors in order of id are its chunks."""
    vectors = table(spark, folder, "embeddings")
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = running_sum(vectors, ["label"], F.floor(F.col("vec_id") / 4096), ["vec_id"], F.lit(1), "chunk_index").withColumn("chunk_index", F.col("chunk_index").cast("int"))
    sizes = vectors.groupBy("label").agg((F.count("*") - 1).alias("_last"))
    rows = numbered.join(sizes, "label").join(texts, "vec_id", "left")
    document, i, last = F.concat(F.lit("label_"), F.col("label").cast("string")), F.col("chunk_index"), F.col("_last")
    return rows.select(
        "vec_id", tx.chunk_id(document, i).alias("chunk_id"), document.alias("document_id"), "label", "chunk_index", F.coalesce("text", F.lit("")).alias("text"), "embedding",
        F.when(i > 0, tx.chunk_id(document, i - 1)).alias("prev_chunk_id"), F.when(i < last, tx.chunk_id(document, i + 1)).alias("next_chunk_id"),
    )


def _probe(corpus: DataFrame) -> list[float]:
    """The vector of the smallest id, as the query of the single searches."""
    return corpus.select("vec_id", "embedding").orderBy("vec_id").first().embedding


def _nearest(spark, folder, metric, where=None, k=10):
    corpus = vector_collection(spark, folder).select("vec_id", "chunk_id", "label", "embedding")
    return ret.search(corpus, _probe(table(spark, folder, "embeddings")), k, metric, where).select("chunk_id", "distance", "similarity")


@query
def knn_cosine(spark, folder):
    return _nearest(spark, folder, "cosine")


@query
def knn_l2(spark, folder):
    return _nearest(spark, folder, "l2")


@query
def knn_ip(spark, folder):
    return _nearest(spark, folder, "ip")


@query
def knn_filtered(spark, folder):
    return _nearest(spark, folder, "cosine", {"$and": [{"label": {"$in": [1, 2, 3]}}, {"vec_id": {"$gte": 100}}]})


def _hits(corpus: DataFrame) -> DataFrame:
    """Searches for every row whose id is divisible by 50, against all rows."""
    queries_ = corpus.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    return ret.search_many(corpus, queries_, TOP)


@query
def knn_batched(spark, folder):
    return _hits(materialise(vector_collection(spark, folder), "corpus"))


#: Lists of the index and lists that a search looks into. The vectors of the test tables have hardly any clusters, hence so many.
LISTS, PROBES = 16, 12


def _index_hits(spark, folder, probes):
    corpus = vector_collection(spark, folder).select("vec_id", "chunk_id", "embedding")
    corpus = materialise(corpus, "corpus")
    queries_ = corpus.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    return ret.search_index(corpus, queries_, ret.fit_index(corpus, LISTS), TOP, probes), ret.search_many(corpus, queries_, TOP)


@query
def knn_index_all(spark, folder):
    """The index with all lists looked into: every row is in it, so the result is exact."""
    return _index_hits(spark, folder, LISTS)[0]


@query
def knn_index_recall(spark, folder):
    """Share of the exact hits that the index finds with its usual number of lists, as reached or not."""
    found, exact = _index_hits(spark, folder, PROBES)
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.agg(F.count("*").alias("n_hits"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


def _expanded(spark, folder):
    corpus = materialise(vector_collection(spark, folder), "corpus")
    return ret.expand_neighbours(materialise(_hits(corpus), "hits"), corpus)


@query
def neighbor_expand(spark, folder):
    """Rows that are only neighbours of hits."""
    return _expanded(spark, folder).where("NOT is_hit").select("query_id", "chunk_id", "distance", "similarity")


@query
def hit_neighbor_union(spark, folder):
    return _expanded(spark, folder).select("query_id", "chunk_id", "document_id", "chunk_index", "is_hit", "distance")


@query
def context_budget(spark, folder):
    return ret.budget(_expanded(spark, folder), BUDGET).select("query_id", "chunk_id", "position", "tokens", "separated", "included")


@query
def context_text(spark, folder):
    return ret.context_text(ret.budget(_expanded(spark, folder), BUDGET)).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query
def retrieve_context(spark, folder):
    """Flagship: batched search, neighbours, document order, budget, context text."""
    corpus = materialise(vector_collection(spark, folder), "corpus")
    return ret.retrieve(corpus, materialise(_hits(corpus), "hits"), BUDGET).select("query_id", "context_text", "token_count", "total_results")


@query
def metadata_flatten(spark, folder):
    return col.flatten_chunk(_chunks(spark, folder))


@query
def collection_count(spark, folder):
    return _chunks(spark, folder).agg(F.count("*").alias("n"))


@query
def document_ids(spark, folder):
    return table(spark, folder, "chunks").select(F.col("metadata.document_id").alias("document_id")).distinct()


@query
def chunk_lookup(spark, folder):
    """The first chunk of the catalogue, by id."""
    return col.lookup(_chunks(spark, folder), ["mhb_gesamtkatalog_chunk_0000"]).select("chunk_id", "text", "distance", "similarity")


@query
def chunk_multi_lookup(spark, folder):
    ids = [f"mhb_gesamtkatalog_chunk_{i:04d}" for i in (0, 1, 2, 3, 5, 8, 999_999)]
    return col.lookup(_chunks(spark, folder), ids).select("chunk_id", "distance", "similarity")


@query
def chunk_neighbors(spark, folder):
    flat = col.flatten_chunk(_chunks(spark, folder))
    return col.neighbours_of(flat, "mhb_gesamtkatalog_chunk_0001")


@query
def where_filter(spark, folder):
    flat = col.flatten_chunk(_chunks(spark, folder))
    where = {"$or": [{"document_type": "pruefungsordnung", "chunk_index": {"$lte": 2}}, {"$and": [{"document_type": {"$nin": ["faq", "website"]}}, {"total_chunks": {"$gt": 10}}, {"chunk_index": {"$ne": 0}}]}]}
    return apply_where(flat, where).select("chunk_id")


def _store(spark) -> col.Collection:
    """A fresh collection in the application's folder."""
    return col.Collection(spark, StoreConfig(f"{application_folder(spark)}/store-{uuid.uuid4().hex}", buckets=8))


def _stored(store: col.Collection) -> DataFrame:
    return store.read().withColumn("dimensions", F.size("embedding")).drop("embedding")


@query
def upsert(spark, folder):
    """A collection of the first deliveries of all chunks, into which the later ones are upserted."""
    raw = table(spark, folder, "chunks")
    first = raw.groupBy("chunk_id").agg(F.min("ingested_at").alias("ingested_at"))
    store = _store(spark)
    store.upsert(col.flatten_chunk(raw.join(first, ["chunk_id", "ingested_at"], "left_semi")))
    store.upsert(col.flatten_chunk(raw.join(first, ["chunk_id", "ingested_at"], "left_anti")))
    return _stored(store)


@query
def delete_document(spark, folder):
    """A collection of all chunks without its largest document."""
    store = _store(spark)
    store.upsert(col.flatten_chunk(_chunks(spark, folder)))
    store.delete_document("mhb_gesamtkatalog")
    return _stored(store)


@query
def extract_document(spark, folder):
    """Every document as a file of pages, in parts, rendered, asked for and parsed by the offline stand-ins."""
    pages = _pages(spark, folder, "content").select("source_file", "page_number", F.replace(F.coalesce("content", F.lit("")), F.lit("\f"), F.lit(" ")).alias("content"))
    part = F.coalesce(F.floor(F.col("page_number") / docs.PART_PAGES).cast("int"), F.lit(2**31 - 1)).alias("part")
    ordered = F.sort_array(F.collect_list(F.struct(F.col("page_number").isNull().alias("late"), "page_number", "content")))
    files = pages.groupBy(F.col("source_file").alias("path"), part).agg(F.array_join(F.transform(ordered, lambda p: p["content"]), "\f").cast("binary").alias("content"))
    files = materialise(files, "files", tidy=True)
    _, found = ext.extract_documents(files, PlainTextRenderer, EchoModel, wait=lambda s: None)
    discard(files)
    return found.select("source_file", "page_number", "content", "extraction_confidence", F.array_join("content_types", ",").alias("content_types"))


@query
def chunk_results(spark, folder):
    """Chunking results of all documents, written as JSON and read again, and what their chunks add up to."""
    pages, documents = _pages(spark, folder, "content"), _documents(spark, folder)
    sentences = seg.page_sentences(pages)
    chunks = materialise(seg.segments_of(sentences, documents, CONFIG), "chunks")
    path = f"{application_folder(spark)}/json-{uuid.uuid4().hex}"
    js.write_json(seg.segment_results(chunks, seg.segment_stats(chunks, sentences, pages, documents), CONFIG), path)
    back = js.read_chunks(spark, path, multi_line=False)
    total = lambda f: F.aggregate("chunks", F.lit(0), lambda n, c: n + f(c))
    return back.select(
        "source_file", "document_id", F.col("config.max_chunk_tokens").alias("max_chunk_tokens"), F.col("stats.total_chunks").alias("total_chunks"), F.size("chunks").alias("n_chunks"),
        total(lambda c: c["token_count"]).alias("n_tokens"), total(lambda c: F.length(c["text"])).alias("n_chars"), total(lambda c: F.size(c["metadata"]["page_numbers"])).alias("n_pages"),
    )


@query
def embed_batch(spark, folder):
    """Size and length of the vectors of texts by the offline stand-in; blank texts get an empty one."""
    vectors = table(spark, folder, "documents").select("doc_id", hash_embedding(F.col("text")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.select("doc_id", F.size("v").alias("dimensions"), F.round(F.sqrt(square), 4).alias("norm"))
