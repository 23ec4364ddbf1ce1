"""Row types, value domains and checked configurations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

#: Domains of the text columns.
DOCUMENT_TYPES = ("pruefungsordnung", "modulhandbuch", "studienordnung", "allgemeine_bestimmungen", "praktikumsordnung", "zulassungsordnung", "satzung", "website", "faq", "other")
CONTENT_TYPES = (
    "section", "subsection", "article", "definition", "regulation", "procedure", "deadline", "requirement", "table", "list", "grade_scale", "metadata", "reference", "overview",
)
LANGUAGES = ("de", "en")

ABBREVIATION = "struct<short:string,long:string>"
SECTION = "struct<number:string,title:string,level:int,starts_on_page:boolean>"
CONTEXT = (
    "struct<document_type:string,title:string,institution:string,faculty:string,version_date:string,version_info:string,degree_program:string,total_pages:int,"
    f"chapters:array<string>,main_topics:array<string>,abbreviations:array<{ABBREVIATION}>,key_terms:array<string>,referenced_documents:array<string>,legal_basis:string,language:string>"
)
PAGE = (
    f"struct<page_number:int,content:string,sections:array<{SECTION}>,paragraph_numbers:array<string>,content_types:array<string>,has_table:boolean,has_list:boolean,has_figure:boolean,"
    "internal_references:array<string>,external_references:array<string>,continues_from_previous:boolean,continues_to_next:boolean,extraction_confidence:double,extraction_notes:string>"
)
EXTRACTION_RESULT = (
    f"source_file string, context {CONTEXT}, pages array<{PAGE}>, processing_time_seconds double, total_input_tokens bigint, total_output_tokens bigint, "
    "estimated_cost_usd double, errors array<string>, warnings array<string>, processed_at timestamp_ntz"
)
CHUNK = (
    "struct<chunk_id:string,text:string,token_count:int,metadata:struct<document_id:string,document_title:string,document_type:string,institution:string,degree_program:string,"
    "page_numbers:array<int>,chunk_index:int,total_chunks:int,prev_chunk_id:string,next_chunk_id:string>>"
)
CHUNKING_RESULT = (
    f"source_file string, document_id string, config struct<max_chunk_tokens:int,overlap_tokens:int,min_chunk_tokens:int>, chunks array<{CHUNK}>, "
    "stats struct<total_chunks:bigint,total_tokens:bigint,avg_chunk_tokens:double,min_chunk_tokens:int,max_chunk_tokens:int,total_sentences:bigint,total_pages_processed:bigint>, created_at timestamp_ntz"
)


def _between(name: str, value: float, low: float, high: float = float("inf")) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")


@dataclass(frozen=True)
class SegmentConfig:
    """Sizes of segments in tokens."""

    max_tokens: int = 512
    overlap_tokens: int = 100
    min_tokens: int = 50

    def __post_init__(self):
        _between("max_tokens", self.max_tokens, 50, 4096)
        _between("overlap_tokens", self.overlap_tokens, 0)
        _between("min_tokens", self.min_tokens, 1)
        if self.overlap_tokens >= self.max_tokens:
            raise ValueError("overlap_tokens must be less than max_tokens")


@dataclass(frozen=True)
class ModelConfig:
    """Settings of a model call; the last five are carried along and change nothing here."""

    model: str = "gpt-4o"
    max_tokens_per_request: int = 4096
    temperature: float = 0.0
    max_retries: int = 3
    expand_abbreviations: bool = True
    include_page_context: bool = True
    merge_cross_page_content: bool = True
    output_format: str = "json"
    language: str = "de"

    def __post_init__(self):
        _between("max_tokens_per_request", self.max_tokens_per_request, 100, 100_000)
        _between("temperature", self.temperature, 0, 2)
        _between("max_retries", self.max_retries, 1, 10)
        if self.language not in LANGUAGES:
            raise ValueError("unknown language")


@dataclass(frozen=True)
class RenderConfig:
    """How pages become images."""

    dpi: float = 150
    image_format: str = "png"
    max_dimension: int = 2048

    def __post_init__(self):
        _between("dpi", self.dpi, 1, 2400)
        _between("max_dimension", self.max_dimension, 1)


@dataclass(frozen=True)
class StoreConfig:
    """Where a collection lies and how its vectors compare."""

    path: str
    collection: str = "documents"
    model: str = "hash-64"
    metric: str = "cosine"
    #: Parts by hash of chunk_id, of which a write replaces only those it touches, and versions that stay readable.
    buckets: int = 32
    keep_versions: int = 3

    def __post_init__(self):
        _between("buckets", self.buckets, 1, 100_000)
        _between("keep_versions", self.keep_versions, 1)
        if self.metric not in ("cosine", "l2", "ip"):
            raise ValueError("metric must be cosine, l2 or ip")


def valid_page(page_number: Column, confidence: Column) -> Column:
    """True if a page's number and confidence are in range; null counts as missing, hence valid."""
    return F.coalesce(page_number >= 1, F.lit(True)) & F.coalesce(confidence.between(0.0, 1.0), F.lit(True))


def valid_context(document_type: Column, title: Column, total_pages: Column, language: Column) -> Column:
    """True if a context has a known type and language, a title, and no negative page count."""
    return (
        F.coalesce(document_type.isin(*DOCUMENT_TYPES), F.lit(False)) & (F.length(F.coalesce(title, F.lit(""))) > 0)
        & F.coalesce(total_pages >= 0, F.lit(True)) & F.coalesce(language.isin(*LANGUAGES), F.lit(True))
    )
