"""Two steps from files to files: `python -m quillstack.scripts extract IN OUT` and `... chunk IN OUT`.

extract reads a folder of page files with the offline stand-ins (put a renderer and a model of your own in a script like
this one); chunk reads extraction results. Both write JSON, one result a line, and print a line for each document.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from quillstack.adapters import EchoModel, PlainTextRenderer
from quillstack.operators import extraction as ext, segments as seg
from quillstack.schemas import SegmentConfig
from quillstack.session import local_session, materialise, ship_package
from quillstack.sources import json_results as js


def extract_files(spark: SparkSession, folder: str, target: str, pattern: str = "*.pdf", make_renderer=PlainTextRenderer, make_model=EchoModel) -> DataFrame:
    """Extraction results of the files in a folder, written to target and returned."""
    began = time.monotonic()
    contexts, pages = ext.extract_documents(js.read_binary(spark, folder, pattern), make_renderer, make_model, progress=lambda i, n, what: print(f"{what}: {i}/{n}"))
    js.write_json(ext.extraction_results(contexts, pages, round(time.monotonic() - began, 2)), target)
    return js.read_extractions(spark, target, multi_line=False)


def chunk_file(spark: SparkSession, path: str, target: str | None = None, config: SegmentConfig | None = None, multi_line: bool = True) -> DataFrame:
    """Chunking results of a file (or folder) of extraction results, written to target if there is one."""
    config = config or SegmentConfig()
    results = materialise(js.read_extractions(spark, path, multi_line), "results")
    pages, documents = js.page_rows(results), results.select("source_file", "context")
    sentences = seg.page_sentences(pages)
    chunks = materialise(seg.segments_of(sentences, documents, config), "chunks")
    out = seg.segment_results(chunks, seg.segment_stats(chunks, sentences, pages, documents), config)
    if target:
        js.write_json(out, target)
        return js.read_chunks(spark, target, multi_line=False)
    return out


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillstack.scripts")
    parser.add_argument("step", choices=("extract", "chunk"))
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--pattern", default="*.pdf")
    args = parser.parse_args(argv)
    spark = local_session("*")
    ship_package(spark)
    if args.step == "extract":
        extract_files(spark, args.source, args.target, args.pattern).selectExpr("source_file", "size(pages) AS pages", "errors").show(truncate=80)
    else:
        chunk_file(spark, args.source, args.target, multi_line=False).selectExpr("source_file", "stats.*").show(truncate=80)


if __name__ == "__main__":
    main()
