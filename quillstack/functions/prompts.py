"""Texts for model calls, as columns. The wording is our own; the fields asked for are the contract of `responses`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


CONTEXT_SYSTEM = (
    "You look at sample pages of one document and say what kind of document it is. Answer with one JSON object with the keys document_type, title, institution, faculty, version_date, "
    "version_info, degree_program, chapters, main_topics, abbreviations, key_terms, referenced_documents, legal_basis. Use null or an empty list for what the pages do not tell."
)
CONTEXT_USER = "Describe the document that these pages are taken from."
PAGE_SYSTEM = (
    "You transcribe one page of a document into plain text and report its structure as JSON.\n\nDocument:\n{document_context}\n\n"
    "Write tables and lists as sentences, keep the page's own wording, invent nothing."
)
PAGE_USER = (
    "Page {page_number} of {total_pages}. Answer with one JSON object with the keys content, section_numbers, section_titles, paragraph_numbers, has_table, has_list, has_image, "
    "internal_references, external_references, continues_from_previous, continues_to_next."
)


# The German labels of the lines that describe a document.
def context_string(context: Column, max_chapters: int = 8) -> Column:
    """The lines that describe a document: kind, title, institution, and what else is known. context: a struct."""
    named = lambda label, field: F.concat(F.lit(label), F.coalesce(context[field], F.lit("Unbekannt")))
    given = lambda label, field: F.when(F.length(F.coalesce(context[field], F.lit(""))) > 0, F.concat(F.lit(label), context[field]))
    pairs = F.transform(context["abbreviations"], lambda a: F.concat(F.coalesce(a["short"], F.lit("")), F.lit("="), F.coalesce(a["long"], F.lit(""))))
    short = F.when(F.size(context["abbreviations"]) > 0, F.concat(F.lit("Abkürzungen: "), F.array_join(pairs, ", ")))
    outline = F.when(F.size(context["chapters"]) > 0, F.concat(F.lit("Gliederung: "), F.array_join(F.slice(context["chapters"], 1, max_chapters), ", ")))
    return F.concat_ws(
        "\n", named("Dokumenttyp: ", "document_type"), named("Titel: ", "title"), named("Institution: ", "institution"), given("Fachbereich: ", "faculty"),
        given("Studiengang: ", "degree_program"), short, outline,
    )


def page_system_prompt(context: Column) -> Column:
    return F.replace(F.lit(PAGE_SYSTEM), F.lit("{document_context}"), context_string(context))


def page_user_prompt(page_number: Column, total_pages: Column) -> Column:
    text = F.replace(F.lit(PAGE_USER), F.lit("{page_number}"), page_number.cast("string"))
    return F.replace(text, F.lit("{total_pages}"), total_pages.cast("string"))


def data_url(mime: Column, base64_text: Column) -> Column:
    """data:<mime>;base64,<data> of an image that is base64 text already."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), base64_text)


def abbreviation_list(short_to_long: Column) -> Column:
    """A map of abbreviations in the list form that context_string reads."""
    return F.transform(F.map_entries(short_to_long), lambda e: F.struct(e["key"].alias("short"), e["value"].alias("long")))
