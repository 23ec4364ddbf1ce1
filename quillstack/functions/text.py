"""Text columns with Unicode semantics: stripping, sentence splitting with protected points, ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Private-use stand-ins: a point that ends no sentence, and a sentence boundary.
POINT, BOUNDARY = "\ue000", "\ue001"

#: Abbreviations whose point ends no sentence (any case).
ABBREVIATIONS = (
    "abs", "nr", "art", "lit", "bst",
    "bzw", "usw", "etc", "vgl", "ggf", "ca", "inkl", "exkl", "evtl", "bzgl", "betr", "gem", "sog", "insb", "zzgl",
    "dr", "prof", "dipl", "ing", "med", "phil", "rer", "nat",
    "jan", "feb", "mär", "apr", "jun", "jul", "aug", "sep", "sept", "okt", "nov", "dez",
    "std", "tel", "fax", "str", "max", "min", "orig",
)
#: Letters of multi-part abbreviations, and characters that may open a sentence.
LETTER, OPENING = "a-zäöüA-ZÄÖÜ", 'A-ZÄÖÜ0-9„"(§'

# Each pattern starts at the point itself and looks back from there, so that other characters cost one comparison.
_MULTI = rf"(?U)\.(?<=\b[{LETTER}]\.)(?=[{LETTER}]\.)|\.(?<=\b[{LETTER}][.{POINT}][{LETTER}]\.)"
_REFERENCE = r"(?iU)(§\s*\d+\s+(?:Abs|Nr|Satz))\.(?=\s*\d)"
_SHORT = rf"(?iU)\.(?<=(?<!\w)(?:{'|'.join(ABBREVIATIONS)})\.)(?=\s)"
_ORDINAL = r"(?U)\.(?<=\s\d{1,3}\.)(?=\s)"
_GAP = rf"(?U)(?<=[.!?])(\s+)(?=[{OPENING}])"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def protect(text: Column) -> Column:
    """Points inside multi-part abbreviations, paragraph references, known abbreviations and ordinals become POINT.

    Each replacement is one character for one, so places in the text stay as they are."""
    text = F.regexp_replace(text, _MULTI, POINT)
    text = F.regexp_replace(text, _REFERENCE, f"$1{POINT}")
    text = F.regexp_replace(text, _SHORT, POINT)
    return F.regexp_replace(text, _ORDINAL, POINT)


def restore(text: Column) -> Column:
    return F.replace(text, F.lit(POINT), F.lit("."))


def mark_boundaries(protected: Column) -> Column:
    """BOUNDARY before the white space between two sentences; nothing is removed."""
    return F.regexp_replace(protected, _GAP, f"{BOUNDARY}$1")


def sentences(text: Column) -> Column:
    """Array of the sentences of a text; empty for null and blank texts."""
    parts = F.split(mark_boundaries(protect(strip(text))), BOUNDARY)
    clean = F.filter(F.transform(parts, lambda p: strip(restore(p))), lambda p: F.length(p) > 0)
    return F.coalesce(clean, F.array().cast("array<string>"))


def document_id(source_file: Column) -> Column:
    """Stem of a path with either separator; only the last extension goes."""
    name = F.element_at(F.split(F.replace(source_file, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def chunk_id(document: Column, index: Column) -> Column:
    """`<document>_chunk_<index>`, the index with at least four digits."""
    return F.format_string("%s_chunk_%04d", document, index)


def preview(text: Column, length: int = 150) -> Column:
    """The first characters on one line."""
    return F.replace(F.substring(text, 1, length), F.lit("\n"), F.lit(" "))
