"""Document-level views of extracted pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def page_stats(pages: DataFrame) -> DataFrame:
    """A row for each document that has pages. failed_pages counts confidences below 1 only; null counts as 1."""
    n = F.length(F.coalesce("content", F.lit("")))
    return pages.groupBy("source_file").agg(
        F.count("*").alias("total_pages"), F.count_if(F.coalesce("has_table", F.lit(False))).alias("pages_with_tables"), F.count_if(F.coalesce("has_list", F.lit(False))).alias("pages_with_lists"),
        F.avg(n).alias("avg_content_length"), F.min(n).alias("min_content_length"), F.max(n).alias("max_content_length"),
        F.count_if(F.coalesce("extraction_confidence", F.lit(1.0)) < 1.0).alias("failed_pages"),
    )


def all_page_stats(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """The same for every document: without pages the counts and the average are 0, the extremes null."""
    out = documents.select("source_file").join(page_stats(pages), "source_file", "left")
    return out.fillna(0, ["total_pages", "pages_with_tables", "pages_with_lists", "failed_pages"]).fillna(0.0, ["avg_content_length"])


#: Pages of one part of a document's content.
PART_PAGES = 256


def full_content(pages: DataFrame, separator: str = "\n\n", part_pages: int = PART_PAGES) -> DataFrame:
    """(source_file, part, content): page contents as stored, blank ones too, joined in page order.

    A document comes in parts of part_pages page numbers each, so that a growing one never becomes one value; joined by
    the separator in order of part, the parts are the document."""
    ordered = F.sort_array(F.collect_list(F.struct("page_number", F.coalesce("content", F.lit("")).alias("content"))))
    part = F.floor(F.col("page_number") / part_pages).cast("int").alias("part")
    return pages.groupBy("source_file", part).agg(F.array_join(F.transform(ordered, lambda p: p["content"]), separator).alias("content"))


def all_sections(pages: DataFrame) -> DataFrame:
    """(source_file, page_number, position, number, title, level, starts_on_page), positions from 0 inside the page."""
    return pages.select("source_file", "page_number", F.posexplode("sections").alias("position", "s")).select("source_file", "page_number", "position", "s.*")


def abbreviation_map(abbreviations: Column) -> Column:
    """Map of short to long forms; of a repeated short form the last counts. Entries without a short form are dropped."""
    named = F.reverse(F.filter(abbreviations, lambda a: a["short"].isNotNull()))
    shorts = F.transform(named, lambda a: a["short"])
    # reversed, the first place of a short form is its last: one lookup in a list of different forms for each entry
    return F.map_from_arrays(F.array_distinct(shorts), F.transform(F.array_distinct(shorts), lambda k: F.element_at(named, F.array_position(shorts, k).cast("int"))["long"]))


def failed_pages(pages: DataFrame, refused: Column) -> DataFrame:
    """(source_file, failed, errors): ascending numbers of pages with low confidence or a refusal, and a message for each."""
    bad = pages.where((F.coalesce("extraction_confidence", F.lit(1.0)) < 1.0) | F.coalesce(refused, F.lit(False)))
    numbers = F.sort_array(F.collect_list("page_number"))
    out = bad.groupBy("source_file").agg(numbers.alias("failed"))
    return out.withColumn("errors", F.transform("failed", lambda n: F.format_string("Page %d: extraction incomplete", n)))


def token_usage(responses: DataFrame) -> DataFrame:
    """(source_file, input_tokens, output_tokens): sums over all calls for a document; null counts as 0."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c)
    return responses.groupBy("source_file").agg(total("input_tokens"), total("output_tokens"))


def sample_pages(total_pages: Column) -> Column:
    """Pages that stand for a document: the first three, one from the middle of a long one, and the last."""
    n = total_pages.cast("int")
    picked = F.array(F.lit(1), F.when(n >= 2, 2), F.when(n >= 3, 3), F.when(n > 10, F.floor(n / 2).cast("int")), F.when(n > 3, n))
    return F.array_distinct(F.filter(picked, lambda p: p.isNotNull()))
