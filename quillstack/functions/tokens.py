"""Token counts.

The default counter stays in the JVM: one to four letters or digits in a row count one, any other character that is
not white space counts one. It is no subword tokenizer; `rank_counter` counts by a public rank file where one is given.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

Counter = Callable[[Column], Column]
PATTERN = r"[\p{L}\p{N}]{1,4}|[^\p{IsWhite_Space}\p{L}\p{N}]"


def count_tokens(text: Column) -> Column:
    """Counter tokens of a text; 0 for null and empty."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERN)), F.lit(0))


def count_tokens_batch(texts: Column) -> Column:
    """The same for each element of an array of texts."""
    return F.transform(texts, count_tokens)


def rank_counter(path: str, pattern: str) -> Counter:
    """Counter by a tiktoken rank file (vectorised; one encoder a worker). Text that looks special is ordinary text."""
    known: dict[str, object] = {}

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        if path not in known:
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            known[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return texts.map(lambda t: len(known[path].encode_ordinary(t)) if t else 0).astype("int32")

    return count
