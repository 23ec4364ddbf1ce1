"""Command line: store chunk files and ask a collection. `python -m quillstack.cli --help`."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, functions as F

from quillstack.adapters import HashEmbedder
from quillstack.functions.text import preview
from quillstack.operators.collection import Collection, flatten_chunk
from quillstack.operators.retrieval import retrieve, search
from quillstack.schemas import StoreConfig
from quillstack.session import local_session, ship_package
from quillstack.sources.json_results import chunk_rows, read_chunks


def ask(rows: DataFrame, question: str, k: int, max_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(hits, context) for a question, by the offline embedding."""
    vector = HashEmbedder().embed([question])[0]
    hits = search(rows.where(F.size("embedding") == len(vector)), vector, k).withColumn("query_id", F.lit("q"))
    return hits, retrieve(rows, hits.select("query_id", "chunk_id", "distance", "similarity"), max_tokens)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillstack")
    parser.add_argument("chunks", nargs="?", help="chunk result (JSON) to store first")
    parser.add_argument("-q", "--question")
    parser.add_argument("-n", "--results", type=int, default=3)
    parser.add_argument("--max-tokens", type=int, default=1024)
    parser.add_argument("--store", default="quillstack-store", help="folder of the collection")
    parser.add_argument("--search-only", action="store_true", help="store nothing, even if a file is given")
    args = parser.parse_args(argv)
    spark = local_session("*")
    ship_package(spark)
    collection = Collection(spark, StoreConfig(args.store))
    if args.chunks and not args.search_only:
        print(collection.upsert(flatten_chunk(chunk_rows(read_chunks(spark, args.chunks))), progress=lambda i, n, what: print(f"{what}: {i}/{n}")))
    print(collection.health())
    if args.question:
        hits, context = ask(collection.read(), args.question, args.results, args.max_tokens)
        hits.select("chunk_id", "similarity", preview(F.col("text")).alias("text")).show(args.results, truncate=80)
        for row in context.collect():
            print(row.context_text)


if __name__ == "__main__":
    main()
