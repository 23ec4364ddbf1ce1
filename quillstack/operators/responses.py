"""Model replies to typed rows: finding the JSON, parsing pages and contexts, refusals."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F

from quillstack.schemas import CONTEXT, DOCUMENT_TYPES, PAGE

#: Phrases of a reply that refuses the work.
REFUSALS = (
    "I'm sorry, I can't assist", "I cannot assist", "I'm not able to", "I am not able to", "I cannot help", "I'm unable to", "I am unable to",
    "cannot process this", "can't process this",
)


def is_refusal(content: Column) -> Column:
    """True if a phrase of refusal occurs, in any case; null for null."""
    low = F.lower(content)
    out = F.lit(False)
    for phrase in REFUSALS:
        out = out | F.contains(low, F.lit(phrase.lower()))
    return out


def needs_retry(content: Column, confidence: Column) -> Column:
    """True for a page with low confidence or a refusal."""
    return (F.coalesce(confidence, F.lit(1.0)) < 1.0) | F.coalesce(is_refusal(content), F.lit(False))


def find_json(reply: Column) -> Column:
    """The JSON part of a reply: the first closed json fence, else the first closed fence, else the first braces that
    balance (braces inside strings count), else the reply. Null for null."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    def fenced(mark: str) -> Column:
        """What stands between the first such mark and the next fence; null if nothing does."""
        begin = F.locate(mark, reply) + len(mark)
        end = F.locate("```", F.substring(reply, begin, F.length(reply)))
        return F.when(F.contains(reply, F.lit(mark)) & (end > 1), strip(F.substring(reply, begin, end - 1)))

    rest = F.substring(reply, F.locate("{", reply), F.length(reply))
    # only braces matter for the balance: their places and a running depth, without a row for each character
    marks = F.regexp_extract_all(rest, F.lit(r"([^{}]*[{}])"), 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    step = lambda a, m: F.struct(
        (a["depth"] + F.when(F.endswith(m, F.lit("{")), 1).otherwise(-1)).alias("depth"), (a["at"] + F.length(m)).alias("at"),
        F.when((a["end"] == 0) & F.endswith(m, F.lit("}")) & (a["depth"] == 1), a["at"] + F.length(m)).otherwise(a["end"]).alias("end"),
    )
    end = F.aggregate(marks, start, step)["end"]
    balanced = F.when(F.contains(reply, F.lit("{")) & (end > 0), F.substring(rest, F.lit(1), end))
    return F.coalesce(fenced("```json"), fenced("```"), balanced, reply)


def json_part(reply: str) -> str:
    """find_json for one string, for use inside a model's task."""
    for mark in ("```json", "```"):
        begin = reply.find(mark) + len(mark)
        if begin >= len(mark) and (end := reply.find("```", begin)) > begin:
            return reply[begin:end].strip()
    start, depth = reply.find("{"), 0
    for k in range(start, len(reply)) if start >= 0 else ():
        depth += (reply[k] == "{") - (reply[k] == "}")
        if not depth:
            return reply[start : k + 1]
    return reply


def accept_page(reply: str | None) -> bool:
    """True for a reply that is a page and no refusal; others are worth asking again."""
    data = _object(json_part(reply)) if reply else None
    content = _text(data.get("content"), "").lower() if data is not None else ""
    return data is not None and not any(phrase.lower() in content for phrase in REFUSALS)


def _object(text: str | None) -> dict | None:
    try:
        data = json.loads(text)
    except (TypeError, ValueError):
        return None
    return data if isinstance(data, dict) else None


def _text(value, default: str | None = None) -> str | None:
    return default if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _texts(value) -> list[str]:
    return [_text(v) for v in value if v is not None] if isinstance(value, list) else []


def _page(found: pd.Series, reply: pd.Series, number: pd.Series) -> pd.DataFrame:
    rows = []
    for text, raw, n in zip(found, reply, number, strict=True):
        data = _object(text)
        base = {
            "page_number": n, "content": _text(raw, ""), "sections": [], "paragraph_numbers": [], "content_types": [], "has_table": False, "has_list": False, "has_figure": False,
            "internal_references": [], "external_references": [], "continues_from_previous": False, "continues_to_next": False, "extraction_confidence": 0.5, "extraction_notes": "reply is not a JSON object",
        }
        if data is not None:
            titles = _texts(data.get("section_titles"))
            numbers = _texts(data.get("section_numbers"))
            flags = {k: bool(data.get(f)) for k, f in (("has_table", "has_table"), ("has_list", "has_list"), ("has_figure", "has_image"), ("continues_from_previous",) * 2, ("continues_to_next",) * 2)}
            kinds = [k for k, f in (("table", "has_table"), ("list", "has_list")) if flags[f]]
            base |= flags | {
                "content": _text(data.get("content"), ""), "content_types": kinds or ["section"], "extraction_confidence": 1.0, "extraction_notes": None,
                "sections": [{"number": x, "title": titles[i] if i < len(titles) else None, "level": 1, "starts_on_page": True} for i, x in enumerate(numbers)],
            } | {k: _texts(data.get(k)) for k in ("paragraph_numbers", "internal_references", "external_references")}
        rows.append(base)
    return pd.DataFrame(rows)


def parse_page(reply: Column, page_number: Column) -> Column:
    """Reply to a page (struct). A reply without a JSON object keeps its raw text with confidence 0.5 and a note.

    Nulls and values of a wrong type count as missing: text "", flags false, lists empty."""
    return F.pandas_udf(_page, PAGE)(find_json(reply), reply, page_number.cast("int"))


def _pairs(value) -> list[dict]:
    if isinstance(value, dict):
        found = [(k, v) for k, v in value.items()]
    else:
        found = [(x.get("short", x.get("abbr")), x.get("long", x.get("full"))) for x in value if isinstance(x, dict)] if isinstance(value, list) else []
    return [{"short": _text(a), "long": _text(b)} for a, b in found if a and b]


def _context(found: pd.Series, total: pd.Series) -> pd.DataFrame:
    rows = []
    for text, n in zip(found, total, strict=True):
        data = _object(text) or {}
        kind = (_text(data.get("document_type"), "other") or "other").lower()
        rows.append(
            {"document_type": kind if kind in DOCUMENT_TYPES else "other", "title": _text(data.get("title"), "Unknown"), "institution": _text(data.get("institution"), "Unknown")}
            | {k: _text(data.get(k)) for k in ("faculty", "version_date", "version_info", "degree_program")}
            | {"total_pages": n}
            | {k: _texts(data.get(k)) for k in ("chapters", "main_topics")}
            | {"abbreviations": _pairs(data.get("abbreviations"))}
            | {k: _texts(data.get(k)) for k in ("key_terms", "referenced_documents")}
            | {"legal_basis": _text(data.get("legal_basis")), "language": "de"}
        )
    return pd.DataFrame(rows)


def parse_context(reply: Column, total_pages: Column) -> Column:
    """Reply about a document (struct). Without a JSON object: type other, title and institution "Unknown"."""
    return F.pandas_udf(_context, CONTEXT)(find_json(reply), total_pages.cast("int"))
