"""Problem 3: repetition inside one document.

The named method compares the document's character-class and common-word histograms with references by the
Jensen-Shannon distance, with guards for short texts. The operator computes these distances, but they cannot give the
share of repeated characters: a passage given twice has the histogram of the passage given once. The share itself is
therefore measured exactly, by equal windows found through rolling hashes and confirmed character by character. The
length guard is exact too: a text shorter than a window and one character cannot repeat.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache
from math import log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstack.llm.common import arrow_map, first_delivery, spread

WINDOW = 40
THRESHOLD = 0.30
#: Texts with fewer visible characters or words get no distance: their histograms are noise.
MIN_CHARS, MIN_WORDS = 60, 12
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Usual shares of character classes (vowel-like and other letters apart by case, digits, marks, blanks).
CLASS_REFERENCE = {
    "lower": 0.775, "upper": 0.060, "other_letter": 0.0, "digit": 0.015, "mark": 0.0, "end": 0.012, "punct": 0.018, "symbol": 0.002, "blank": 0.118,
}
#: The same for scripts without case, in which letters carry marks or stand without blanks.
CASELESS_REFERENCE = {
    "lower": 0.01, "upper": 0.005, "other_letter": 0.745, "digit": 0.02, "mark": 0.09, "end": 0.02, "punct": 0.02, "symbol": 0.002, "blank": 0.088,
}
#: Shares of common words among all words of running text, by language.
WORD_REFERENCE = {
    "de": {"der": 0.036, "die": 0.035, "und": 0.024, "in": 0.016, "den": 0.013, "das": 0.014, "zu": 0.012, "im": 0.010, "von": 0.009, "mit": 0.009, "ist": 0.011, "des": 0.008, "auf": 0.007, "für": 0.007, "nicht": 0.007, "durch": 0.004, "nach": 0.004, "dem": 0.007, "bei": 0.004, "wird": 0.005},
    "en": {"the": 0.062, "of": 0.032, "and": 0.028, "to": 0.025, "in": 0.020, "a": 0.021, "is": 0.011, "for": 0.010, "by": 0.006, "with": 0.007, "be": 0.007, "on": 0.007, "are": 0.005, "not": 0.005, "has": 0.004},
    "fr": {"le": 0.030, "la": 0.032, "de": 0.048, "et": 0.023, "les": 0.022, "un": 0.012, "est": 0.011, "pour": 0.008, "en": 0.014, "au": 0.007},
    "es": {"el": 0.030, "la": 0.034, "de": 0.055, "en": 0.025, "y": 0.024, "los": 0.016, "se": 0.014, "un": 0.010, "del": 0.013, "no": 0.009},
}


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def repeated_share(text: str | None, window: int = WINDOW) -> tuple[int, int]:
    """(repeated characters, all characters) of the lower-cased text with single blanks."""
    s = normal(text)
    n = len(s)
    if n <= window:
        return 0, n
    codes = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)
    with np.errstate(over="ignore"):
        # mixed codes, times powers of an odd base; windows are compared after division by the base's power
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        powers, inverse = _powers(1 << (n - 1).bit_length())
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * powers[:n], out=sums[1:])
        keys = (sums[window:] - sums[:-window]) * inverse[: n - window + 1]
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    earliest = first[back]
    later = np.flatnonzero(earliest < np.arange(len(keys)))
    if not len(later):
        return 0, n
    steps = np.arange(window)
    for at in range(0, len(later), 65536):
        part = later[at : at + 65536]
        if not (codes[part[:, None] + steps] == codes[earliest[part][:, None] + steps]).all():
            return _by_slices(s, window), n
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, later, 1)
    np.add.at(edges, later + window, -1)
    return int((np.cumsum(edges[:n]) > 0).sum()), n


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        inverse = pow(int(_ODD), -1, 1 << 64)
        up, down = np.full(n, _ODD), np.full(n, np.uint64(inverse))
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def _by_slices(s: str, window: int) -> int:
    """The same without hashes of our own, should two windows ever collide."""
    seen, end, total = set(), 0, 0
    for i in range(len(s) - window + 1):
        w = s[i : i + window]
        if w in seen:
            total += i + window - max(end, i)
            end = i + window
        else:
            seen.add(w)
    return total


@lru_cache(maxsize=70_000)
def _kind(c: str) -> str:
    k = unicodedata.category(c)
    if c.isspace():
        return "blank"
    if c in ".!?。！？।؟…":
        return "end"
    return {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Lo": "other_letter", "Lm": "other_letter", "M": "mark", "N": "digit", "P": "punct"}.get(k if k[0] == "L" else k[0], "symbol")


def js_distance(p: dict[str, float], q: dict[str, float]) -> float:
    """Jensen-Shannon distance (base 2) of two histograms, each brought to a sum of one; 1 where one is empty."""
    a, b = sum(p.values()), sum(q.values())
    if a <= 0 or b <= 0:
        return 1.0
    total = 0.0
    for k in p.keys() | q.keys():
        x, y = p.get(k, 0.0) / a, q.get(k, 0.0) / b
        m = (x + y) / 2
        total += (x * log2(x / m) if x > 0 else 0.0) + (y * log2(y / m) if y > 0 else 0.0)
    return sqrt(max(total, 0.0) / 2)


def divergence(text: str | None) -> tuple[float | None, float | None]:
    """Distances of (character classes, common words) from the nearest reference; None below the length guards.

    Words count in the class "other" unless the language's reference has them. A caseless script has no reference of
    common words here, hence no word distance."""
    s = " ".join((text or "").split())
    if len(s) < MIN_CHARS:
        return None, None
    classes: dict[str, float] = {}
    for c, n in Counter(s).items():
        k = _kind(c)
        classes[k] = classes.get(k, 0) + n
    chars = min(js_distance(classes, CLASS_REFERENCE), js_distance(classes, CASELESS_REFERENCE))
    words = Counter(s.lower().split())
    total = sum(words.values())
    if total < MIN_WORDS or classes.get("other_letter", 0) > classes.get("lower", 0):
        return chars, None
    distances = []
    for reference in WORD_REFERENCE.values():
        seen = {w: words[w] / total for w in reference if w in words}
        distances.append(js_distance(seen | {"other": 1 - sum(seen.values())}, reference | {"other": 1 - sum(reference.values())}))
    return chars, min(distances)


def repetition_profile(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, with_divergence: bool = True, balance: bool = True) -> DataFrame:
    """(id, n_chars, repeated_chars, repeated_share, class_distance, word_distance), one row for each id.

    Null and blank texts have share 0 and no distance. Deliveries of an id with the same values count once. Other
    columns are dropped unread."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            repeated, n = repeated_share(text, window)
            rows.append((n, repeated, repeated / n if n else 0.0, *(divergence(text) if with_divergence else (None, None))))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["id", *FIELDS])

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = arrow_map(spread(source) if balance else source, run, f"id {kind}, n_chars int, repeated_chars int, repeated_share double, class_distance double, word_distance double")
    out = first_delivery(out, "id", *FIELDS)
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


FIELDS = ("n_chars", "repeated_chars", "repeated_share", "class_distance", "word_distance")
