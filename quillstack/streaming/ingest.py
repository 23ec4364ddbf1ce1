"""A stream of chunk files into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillstack.operators.collection import Collection, flatten_chunk
from quillstack.schemas import CHUNKING_RESULT
from quillstack.sources.json_results import chunk_rows


def ingest_stream(spark: SparkSession, folder: str, collection: Collection, checkpoint: str, max_files: int = 1000) -> StreamingQuery:
    """Upsert the chunks of every new JSON file (one result a line) in `folder`. Stops when the files there are read.

    A batch that is run again after a failure writes the same rows again, so the result does not change."""
    files = spark.readStream.schema(CHUNKING_RESULT).option("maxFilesPerTrigger", max_files).json(folder)

    def store(batch: DataFrame, _: int) -> None:
        collection.upsert(flatten_chunk(chunk_rows(batch)))

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
