"""A collection of segments with vectors, kept as parquet in buckets and versions.

Rows lie in buckets by hash of chunk_id. A write makes new folders for the buckets that it touches and then a version
file with the next number, which names the folder of every bucket. Version files are never changed, made without
overwriting, and count only with their last line, so a reader sees one whole state, whenever a writer stops. Of two
writers with the same number one fails and begins again. Folders stay until no kept version names them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillstack.schemas import StoreConfig
from quillstack.session import hadoop_path, materialise

FIELDS = (
    "chunk_id string, text string, document_id string, document_title string, document_type string, institution string, degree_program string, chunk_index int, total_chunks int, token_count int, "
    "page_numbers string, prev_chunk_id string, next_chunk_id string, embedding array<float>"
)
Progress = Callable[[int, int, str], None]


def flatten_chunk(chunks: DataFrame) -> DataFrame:
    """Nested chunk rows to flat ones: scalars stay, lists become comma-joined text, null stays null."""
    return chunks.select(
        "chunk_id", "text", *[F.col(f"metadata.{c}").alias(c) for c in ("document_id", "document_title", "document_type", "institution", "degree_program", "chunk_index", "total_chunks")],
        "token_count", F.concat_ws(",", "metadata.page_numbers").alias("page_numbers"), F.col("metadata.prev_chunk_id").alias("prev_chunk_id"), F.col("metadata.next_chunk_id").alias("next_chunk_id"),
    )


def merge_rows(target: DataFrame, new: DataFrame) -> DataFrame:
    """target with the rows of new inserted or replaced by chunk_id. Rows that new lacks stay. In new, of rows with one
    id the one with the greatest values wins."""
    columns = target.columns
    picked = new.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max(F.struct(*[c for c in columns if c != "chunk_id"])).alias("r"))
    once = picked.select("chunk_id", "r.*").select(*columns)
    return target.join(once.select("chunk_id"), "chunk_id", "left_anti").select(*columns).unionByName(once)


class Collection:
    """One collection under StoreConfig.path."""

    def __init__(self, spark: SparkSession, config: StoreConfig, embed: Callable[[Column], Column] | None = None):
        self.spark, self.config = spark, config
        self.root = f"{config.path.rstrip('/')}/{config.collection}"
        if embed is None:
            from quillstack.adapters import hash_embedding

            embed = hash_embedding
        self.embed = embed

    def _numbers(self) -> list[int]:
        """Numbers of all version files, complete or not, ascending."""
        place, fs = hadoop_path(self.spark, f"{self.root}/versions")
        if not fs.exists(place):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(place) if f.getPath().getName().endswith(".json"))

    def _buckets(self, number: int) -> dict[str, str] | None:
        """Folder by bucket in a version; None if its file is not complete."""
        place, fs = hadoop_path(self.spark, f"{self.root}/versions/{number:012d}.json")
        stream = fs.open(place)
        try:
            lines = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        finally:
            stream.close()
        return json.loads(lines[0]) if len(lines) == 2 and lines[1] == "end" else None

    def _current(self) -> dict[str, str]:
        """Folder by bucket in the newest complete version; empty before the first write."""
        return next((b for n in reversed(self._numbers()) if (b := self._buckets(n)) is not None), {})

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], FIELDS)
        return self.spark.read.schema(FIELDS).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self) -> DataFrame:
        """All rows of the newest version."""
        return self._rows(list(self._current().values()))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("chunk_id"), F.lit(self.config.buckets)).cast("int").alias("bucket")

    def _replace(self, touched: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame]) -> None:
        """Write a version in which the buckets that hold rows of touched(all rows) are replaced by change(their rows)."""
        for _ in range(5):
            numbers, current = self._numbers(), self._current()
            wanted = sorted(str(r.bucket) for r in touched(self._rows(list(current.values()))).select(self._bucket()).distinct().collect())
            if not wanted:
                return
            rows = change(self._rows([current[b] for b in wanted if b in current])).withColumn("bucket", self._bucket())
            folder = f"data/{uuid.uuid4().hex}"
            rows.where(F.col("bucket").isin([int(b) for b in wanted])).repartition(len(wanted), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
            place, fs = hadoop_path(self.spark, f"{self.root}/{folder}")
            filled = {f.getPath().getName().removeprefix("bucket=") for f in fs.listStatus(place) if f.getPath().getName().startswith("bucket=")}
            buckets = {b: p for b, p in current.items() if b not in wanted} | {b: f"{folder}/bucket={b}" for b in wanted if b in filled}
            if self._publish(numbers[-1] + 1 if numbers else 1, buckets):
                self._tidy()
                return
        raise RuntimeError("other writers came first five times")

    def _publish(self, number: int, buckets: dict[str, str]) -> bool:
        """Make a version file; False if another writer has taken the number."""
        place, fs = hadoop_path(self.spark, f"{self.root}/versions/{number:012d}.json")
        if fs.exists(place):
            return False
        try:
            stream = fs.create(place, False)
        except Exception as e:  # noqa: BLE001  the class of the Java exception depends on the file system
            if "exist" in str(e).lower():
                return False
            raise
        stream.write(bytearray(json.dumps(buckets, sort_keys=True) + "\nend\n", "utf-8"))
        stream.close()
        return True

    def _tidy(self) -> None:
        """Remove versions beyond the kept ones and the folders that no kept version names."""
        numbers = self._numbers()
        complete = [n for n in numbers if self._buckets(n) is not None]
        kept = complete[-self.config.keep_versions :]
        old = [n for n in numbers if n < kept[0]]
        gone = {p for n in old for p in (self._buckets(n) or {}).values()} - {p for n in kept for p in self._buckets(n).values()}
        for path in [*gone, *[f"versions/{n:012d}.json" for n in old]]:
            place, fs = hadoop_path(self.spark, f"{self.root}/{path}")
            fs.delete(place, True)

    def upsert(self, chunks: DataFrame, progress: Progress | None = None, replace_document: bool = False) -> dict:
        """Insert or update flat chunk rows; their vectors come from the embedding function. Blank texts get no vector.

        Rows without an id are skipped. replace_document=True also removes rows of the same documents that the new rows
        lack. Only buckets that hold new or removed rows are written again."""
        began = time.monotonic()
        say = progress or (lambda *_: None)
        say(0, 1, "Embedding")
        vector = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0, self.embed(F.col("text"))).otherwise(F.array().cast("array<float>"))
        new = materialise(chunks.withColumn("embedding", vector).select(*[f.split()[0] for f in FIELDS.split(", ")]), "embedded")
        embedded = time.monotonic()
        facts = new.agg(F.count_distinct("chunk_id").alias("stored"), F.count_if(F.col("chunk_id").isNull()).alias("skipped"), F.min("document_id").alias("a"), F.max("document_id").alias("b")).first()
        documents = new.select("document_id").distinct()
        say(0, facts.stored, "Storing")

        def touched(rows: DataFrame) -> DataFrame:
            ids = new.where("chunk_id IS NOT NULL").select("chunk_id")
            return ids.unionByName(rows.join(documents, "document_id", "left_semi").select("chunk_id")) if replace_document else ids

        def change(rows: DataFrame) -> DataFrame:
            return merge_rows(rows.join(documents, "document_id", "left_anti").select(*new.columns) if replace_document else rows, new)

        if facts.stored:
            self._replace(touched, change)
        say(facts.stored, facts.stored, "Done")
        now = time.monotonic()
        return {
            "document_id": facts.a if facts.a == facts.b else None, "chunks_stored": facts.stored, "chunks_skipped": facts.skipped,
            "embedding_time_seconds": round(embedded - began, 2), "total_time_seconds": round(now - began, 2),
        }

    def delete_document(self, document_id: str) -> int:
        """Remove the rows of a document; the number removed (0 if there are none)."""
        n = self.read().where(F.col("document_id") == document_id).count()
        if n:
            self._replace(lambda rows: rows.where(F.col("document_id") == document_id), lambda rows: rows.where(~F.col("document_id").eqNullSafe(document_id)))
        return n

    def count(self) -> int:
        return self.read().count()

    def document_ids(self) -> DataFrame:
        return self.read().select("document_id").distinct().orderBy("document_id")

    def lookup(self, chunk_ids: list[str]) -> DataFrame:
        """The rows of given ids that exist, with distance 0 and similarity 1."""
        return lookup(self.read(), chunk_ids)

    def health(self, embedder: dict | None = None) -> dict:
        """State of the collection, with that of an embedding service (see adapters.embedder_health) where one is given."""
        state = {"healthy": True, "collection": self.config.collection, "total_chunks": self.count(), "total_documents": self.document_ids().count(), "model": self.config.model}
        if embedder is None:
            return state
        return state | {"healthy": bool(embedder.get("healthy")), "embedder": embedder, "error": embedder.get("error")}


def lookup(rows: DataFrame, chunk_ids: list[str]) -> DataFrame:
    """Rows by id as search results; the ids reach the scan as a filter."""
    return rows.where(F.col("chunk_id").isin(list(chunk_ids))).withColumns({"distance": F.lit(0.0), "similarity": F.lit(1.0)})


def neighbours_of(rows: DataFrame, chunk_id: str) -> DataFrame:
    """(side, chunk_id, text) of the rows before and after a given one; no rows for an unknown id."""
    one = rows.where(F.col("chunk_id") == chunk_id).select(F.explode(F.array(F.struct(F.lit("prev").alias("side"), F.col("prev_chunk_id").alias("chunk_id")), F.struct(F.lit("next").alias("side"), F.col("next_chunk_id").alias("chunk_id")))).alias("n")).select("n.*")
    return one.where("chunk_id IS NOT NULL").join(rows.select("chunk_id", "text"), "chunk_id").select("side", "chunk_id", "text")
