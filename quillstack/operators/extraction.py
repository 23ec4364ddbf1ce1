"""From files to extraction results: sample pages, context, prompts, model, parsed pages.

Rendering and the model are adapters. Images stay in the partition that made them: what a page's prompt needs from its
document travels with the list of wanted pages, before anything is rendered.

files are (path, content), or (path, part, content) where a file comes in parts: each is a file of its own, with at least
one page, and in order of part their pages are those of the file. A growing file never has to be one value that way.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstack import adapters
from quillstack.functions import prompts, text as tx
from quillstack.operators.documents import sample_pages
from quillstack.operators.responses import accept_page, is_refusal, parse_context, parse_page
from quillstack.schemas import CONTEXT, ModelConfig, RenderConfig
from quillstack.session import materialise

#: Rows of files, images and replies that a Python worker gets at once; several workers share an executor.
BATCH = 1_000

Progress = Callable[[int, int, str], None]
_PAGE_FIELDS = (
    "page_number", "content", "sections", "paragraph_numbers", "content_types", "has_table", "has_list", "has_figure", "internal_references", "external_references",
    "continues_from_previous", "continues_to_next", "extraction_confidence", "extraction_notes",
)


def unknown_context(source_file: Column, total_pages: Column) -> Column:
    """The context of a document whose analysis failed: its name and its number of pages."""
    known = {"document_type": F.lit("other"), "title": tx.document_id(source_file), "institution": F.lit("Unknown"), "total_pages": total_pages, "language": F.lit("de")}
    lists = ("chapters", "main_topics", "abbreviations", "key_terms", "referenced_documents")
    names = [f.split(":")[0] for f in CONTEXT.removeprefix("struct<").replace("struct<short:string,long:string>", "pair").split(",")]
    fields = [known.get(n, F.array() if n in lists else F.lit(None)).alias(n) for n in names]
    return F.struct(*fields).cast(CONTEXT)


def page_places(files: DataFrame, make_renderer) -> DataFrame:
    """(source_file[, part], page_count, before, total_pages) of files or their parts: before counts the pages of earlier
    parts. A part without a byte is an empty page, unless it is the whole file."""
    info = adapters.pdf_info(files, make_renderer)
    if "part" not in info.columns:
        return info.select("source_file", "page_count", F.lit(0).alias("before"), F.col("page_count").alias("total_pages"))
    own = Window.partitionBy("source_file")
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = info.select("source_file", "part", F.when(F.count("*").over(own) > 1, F.greatest("page_count", F.lit(1))).otherwise(F.col("page_count")).alias("page_count"))
    total = lambda w: F.coalesce(F.sum("page_count").over(w), F.lit(0)).cast("int")
    return counted.select("*", total(earlier).alias("before"), total(own).alias("total_pages"))


def _lists(places: DataFrame, numbers: Column, *keep: str) -> DataFrame:
    """What render_lists takes: of the given numbers of a document's pages, those that lie in a part."""
    keys = [c for c in ("source_file", "part") if c in places.columns]
    return places.select(*keys, "page_count", *keep, F.transform(numbers, lambda n: F.struct(n.alias("position"), (n - F.col("before")).alias("page_number"))).alias("pages"))


def analyse_contexts(
    files: DataFrame, make_renderer, make_model, config: ModelConfig, render: RenderConfig, wait: Callable[[float], None] = time.sleep, places: DataFrame | None = None
) -> DataFrame:
    """(source_file, total_pages, context, error, input_tokens, output_tokens) of files.

    The model sees the sample pages of a document, at most five images, in one call. If the call fails, the context is
    that of an unknown document and error says why. A file without pages is not sent."""
    places = places or materialise(page_places(files, make_renderer), "places", tidy=True, batch=BATCH)
    info = places.where("before = 0").select("source_file", "total_pages")
    inside = F.filter(sample_pages(F.col("total_pages")), lambda n: (n > F.col("before")) & (n <= F.col("before") + F.col("page_count")))
    images = adapters.render_lists(files, _lists(places, inside).where(F.size("pages") > 0), make_renderer, render.dpi, render.image_format, render.max_dimension)
    url = prompts.data_url(F.col("mime_type"), F.col("image_base64"))
    asked = images.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("position", url.alias("url")))).alias("o"))
    asked = asked.select("source_file", F.lit(prompts.CONTEXT_SYSTEM).alias("system_prompt"), F.lit(prompts.CONTEXT_USER).alias("user_prompt"), F.transform("o", lambda x: x["url"]).alias("images"))
    replies = adapters.ask_model(asked, ["source_file"], make_model, 1, wait)
    out = info.join(replies, "source_file", "left")
    failed = F.when(F.col("total_pages") > 0, F.col("error"))
    context = F.when(F.col("reply").isNull(), unknown_context(F.col("source_file"), F.col("total_pages"))).otherwise(parse_context(F.col("reply"), F.col("total_pages")))
    return out.select("source_file", "total_pages", context.alias("context"), failed.alias("error"), F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"))


def extract_pages(
    files: DataFrame, contexts: DataFrame, make_renderer, make_model, config: ModelConfig, render: RenderConfig, wait: Callable[[float], None] = time.sleep, places: DataFrame | None = None
) -> DataFrame:
    """(source_file, page fields, input_tokens, output_tokens) of all pages of all files.

    A refused or unreadable reply is asked again with growing waits; if that does not help, the last reply counts. A
    page for which every attempt raised an error is kept, with confidence 0 and a note."""
    places = places or materialise(page_places(files, make_renderer), "places", tidy=True, batch=BATCH)
    known = contexts.select("source_file", prompts.page_system_prompt(F.col("context")).alias("system_prompt"))
    numbers = F.sequence(F.col("before") + 1, F.col("before") + F.col("page_count"))
    lists = _lists(places.where("page_count > 0").join(known, "source_file"), numbers, "total_pages", "system_prompt")
    images = adapters.render_lists(files, lists, make_renderer, render.dpi, render.image_format, render.max_dimension, keep=("total_pages", "system_prompt"))
    images = images.withColumn("page_number", F.col("position"))
    url = prompts.data_url(F.col("mime_type"), F.col("image_base64"))
    asked = images.select("source_file", "page_number", "system_prompt", prompts.page_user_prompt(F.col("page_number"), F.col("total_pages")).alias("user_prompt"), F.array(url).alias("images"))
    replies = adapters.ask_model(asked, ["source_file", "page_number"], make_model, config.max_retries, wait, accept_page)
    parsed = replies.withColumn("p", parse_page(F.col("reply"), F.col("page_number")))
    lost = F.col("reply").isNull()
    # Text and note of a page that could not be extracted.
    text = F.format_string("[Extraction failed after %d attempts: %s]", "attempts", "error")
    note = F.format_string("Failed after %d retries: %s", "attempts", "error")
    changed = {"content": text, "content_types": F.array().cast("array<string>"), "extraction_confidence": F.lit(0.0), "extraction_notes": note}
    fields = [F.when(lost, changed[n]).otherwise(F.col(f"p.{n}")).alias(n) if n in changed else F.col(f"p.{n}").alias(n) for n in _PAGE_FIELDS]
    return parsed.select("source_file", *fields, "input_tokens", "output_tokens")


def extract_documents(
    files: DataFrame, make_renderer, make_model, config: ModelConfig | None = None, render: RenderConfig | None = None, wait: Callable[[float], None] = time.sleep, progress: Progress | None = None
) -> tuple[DataFrame, DataFrame]:
    """(contexts, pages) of files, each written once: no page is asked for twice. progress gets (done, all, what) between
    the phases."""
    config, render = config or ModelConfig(), render or RenderConfig()
    say = progress or (lambda *_: None)
    say(0, 0, "Analysing documents")
    places = materialise(page_places(files, make_renderer), "places", tidy=True, batch=BATCH)
    contexts = materialise(analyse_contexts(files, make_renderer, make_model, config, render, wait, places), "contexts", tidy=True, batch=BATCH)
    total = contexts.agg(F.coalesce(F.sum("total_pages"), F.lit(0))).first()[0]
    say(0, total, "Reading pages")
    pages = materialise(extract_pages(files, contexts, make_renderer, make_model, config, render, wait, places), "pages", tidy=True, batch=BATCH)
    say(total, total, "Done")
    return contexts, pages


def extraction_results(contexts: DataFrame, pages: DataFrame, seconds: float = 0.0) -> DataFrame:
    """Rows in the form of an extraction result, one for each file, for writing as JSON; a document becomes one row.

    A page with low confidence or a refusal is an error of its document."""
    failed = (F.coalesce("extraction_confidence", F.lit(1.0)) < 1.0) | F.coalesce(is_refusal(F.col("content")), F.lit(False))
    by_file = pages.groupBy("source_file").agg(
        F.sort_array(F.collect_list(F.struct(*_PAGE_FIELDS))).alias("pages"), F.sort_array(F.collect_list(F.when(failed, F.col("page_number")))).alias("failed"),
        F.sum("input_tokens").alias("page_in"), F.sum("output_tokens").alias("page_out"),
    )
    out = contexts.join(by_file, "source_file", "left")
    bad = F.coalesce("failed", F.array().cast("array<int>"))
    errors = F.concat(F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("Context: "), F.col("error")))).otherwise(F.array().cast("array<string>")), F.transform(bad, lambda n: F.format_string("Page %d: extraction incomplete", n)))
    warnings = F.when(F.size(bad) > 0, F.array(F.concat(F.lit("Pages not extracted: "), F.array_join(bad.cast("array<string>"), ", ")))).otherwise(F.array().cast("array<string>"))
    return out.select(
        "source_file", "context", F.coalesce("pages", F.array()).alias("pages"), F.lit(seconds).alias("processing_time_seconds"), (F.col("input_tokens") + F.coalesce("page_in", F.lit(0))).cast("bigint").alias("total_input_tokens"),
        (F.col("output_tokens") + F.coalesce("page_out", F.lit(0))).cast("bigint").alias("total_output_tokens"), F.lit(None).cast("double").alias("estimated_cost_usd"), errors.alias("errors"), warnings.alias("warnings"),
        F.current_timestamp().cast("timestamp_ntz").alias("processed_at"),
    )
