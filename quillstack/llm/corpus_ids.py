"""Problem 6: token ids of every text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstack.llm.common import arrow_map, spread
from quillstack.llm.encoder import encoder, vocabulary


def encode_corpus(df: DataFrame, id_col: str, text_col: str, path: str | None = None, balance: bool = True) -> DataFrame:
    """(id, ids array<int>) of every row by the rank file at `path`, without special tokens.

    Rows map one to one: repeated rows come out repeated, null ids stay null. Empty and null texts have the ids [].
    Strings that look like special tokens are ordinary text. Other columns of df are dropped unread."""
    path = path or vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        ends, values = [0], []
        for text in batch.column(1).to_pylist():
            ids = np.asarray(enc.encode(text), dtype=np.int32)
            values.append(ids)
            ends.append(ends[-1] + len(ids))
        flat = np.concatenate(values) if values else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "ids"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = arrow_map(spread(source) if balance else source, run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def measure_corpus(df: DataFrame, id_col: str, text_col: str, path: str | None = None, balance: bool = True) -> DataFrame:
    """(id, size int): only the number of ids of each text; 0 for empty and null texts."""
    path = path or vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        sizes = pa.array([enc.count(t) for t in batch.column(1).to_pylist()], pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), sizes], names=["id", "size"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = arrow_map(spread(source) if balance else source, run, f"id {kind}, size int")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
