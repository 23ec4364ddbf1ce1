"""Pipeline results as JSON files: reading with a declared schema, and writing with nulls kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillstack.schemas import CHUNKING_RESULT, EXTRACTION_RESULT


def read_extractions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Extraction results, one JSON document a file (multi_line) or a line. Malformed files fail the read."""
    return spark.read.schema(EXTRACTION_RESULT).option("mode", "FAILFAST").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path, multiLine=multi_line)


def read_chunks(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Chunking results; see `chunk_rows`."""
    return spark.read.schema(CHUNKING_RESULT).option("mode", "FAILFAST").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path, multiLine=multi_line)


def page_rows(results: DataFrame) -> DataFrame:
    """(source_file, position, page fields): a row for each page in list order."""
    return results.select("source_file", F.posexplode("pages").alias("position", "p")).select("source_file", "position", "p.*")


def chunk_rows(results: DataFrame) -> DataFrame:
    """(chunk_id, text, token_count, metadata): a row for each chunk."""
    return results.select(F.explode("chunks").alias("c")).select("c.*")


def to_json(row: Column, pretty: bool = False) -> Column:
    """JSON of a struct with nulls written out."""
    return F.to_json(row, {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {}))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON document a line, nulls written out."""
    df.write.mode(mode).option("ignoreNullFields", "false").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content) of files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
