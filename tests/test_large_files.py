import json

import duckdb
import pytest
from compare import against_sql
from pyspark.sql import functions as F

from quillstack import adapters
from quillstack.operators import extraction as ext, responses as resp
from quillstack.plans import catalog


class Counting(adapters.PlainTextRenderer):
    """The image of a page is how many files have been opened before it."""

    opened = 0

    def info(self, data):
        self.opened += 1
        return super().info(data)

    def render(self, data, page_number, zoom):
        return str(self.opened).encode(), 1, 1


def test_a_file_is_opened_once_for_all_its_pages(spark):
    files = spark.createDataFrame([("a", bytearray("\f".join("x" * 40).encode()))], "path string, content binary")
    wanted = spark.range(1, 41).select(F.lit("a").alias("source_file"), F.col("id").alias("page_number")).coalesce(1)
    images = adapters.render_pages(files.coalesce(1), wanted, Counting).select(F.unbase64("image_base64").cast("string").alias("n"), "page_number").collect()
    assert sorted(r.page_number for r in images) == list(range(1, 41)) and {r.n for r in images} == {"1"}


def test_more_images_than_one_frame_holds(spark, monkeypatch):
    monkeypatch.setattr(adapters, "IMAGE_ROWS", 7)
    files = spark.createDataFrame([(n, bytearray("\f".join(f"{n}{i}" for i in range(1, 31)).encode())) for n in "abc"], "path string, content binary")
    wanted = files.select(F.col("path").alias("source_file"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("page_number"))
    images = adapters.render_pages(files, wanted, adapters.PlainTextRenderer).select("source_file", "page_number", F.unbase64("image_base64").cast("string")).collect()
    assert sorted(images) == sorted((n, i, f"{n}{i}") for n in "abc" for i in range(1, 31))


def test_files_in_parts_give_what_whole_files_give(spark):
    pages = {"a": ["1", "2", "", "4", ""], "b": [""], "c": ["", ""], "d": ["eins"]}
    whole = spark.createDataFrame([(n, bytearray("\f".join(p).encode())) for n, p in pages.items()], "path string, content binary")
    cuts = {"a": [(0, 2), (2, 3), (3, 4), (4, 5)], "b": [(0, 1)], "c": [(0, 1), (1, 2)], "d": [(0, 1)]}
    parts = [(n, k, bytearray("\f".join(pages[n][i:j]).encode())) for n, c in cuts.items() for k, (i, j) in enumerate(c)]
    both = [ext.extract_documents(f, adapters.PlainTextRenderer, adapters.EchoModel, wait=lambda s: None) for f in (whole, spark.createDataFrame(parts, "path string, part int, content binary"))]
    for a, b in zip(*both, strict=True):
        assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str) and a.count()
    assert sorted((r.source_file, r.page_number, r.content) for r in both[1][1].collect()) == sorted((n, i, t) for n, p in pages.items() if n != "b" for i, t in enumerate(p, 1))


@pytest.mark.parametrize("text", ["a }} b", "{{c", "```json {} ```", '"}"', "\\u007b }", "", "ä\n\t`"])
def test_replies_of_the_stand_in_hold_any_text(text):
    reply, *_ = adapters.EchoModel().answer("", "", [adapters.base64.b64encode(text.encode()).decode()])
    assert json.loads(reply) == {"content": text} and resp.json_part(reply) == reply and resp.accept_page(reply)


def test_extract_document_equals_sql_over_several_parts(spark, data, tmp_path):
    """Long documents, gaps and empty pages where parts begin, a page without a number, documents of empty pages only, signs of JSON."""
    columns = "source_file, page_number, content, page_id, TIMESTAMP '2024-01-01' AS ingested_at"
    duckdb.sql(f"""COPY (SELECT {columns} FROM (
        SELECT 'long' AS source_file, i::INT AS page_number, 'Seite ' || i AS content, i AS page_id FROM range(1, 1001) t(i)
        UNION ALL SELECT 'edge', i::INT, CASE WHEN i < 512 THEN 'p' || i ELSE '' END, 2000 + i FROM range(1, 513) t(i)
        UNION ALL SELECT 'gaps', n::INT, CASE WHEN n = 300 THEN NULL ELSE 'g' || n END, 4000 + n FROM (VALUES (1), (300), (900), (901)) t(n)
        UNION ALL SELECT * FROM (VALUES ('lone', 1, '', 6001), ('two', 1, '', 6002), ('two', 2, NULL, 6003), ('late', NULL, 'last', 6004), ('late', 1, 'first', 6005), ('feed', 1, 'a' || chr(12) || 'b', 6006), ('signs', 1, 'a }}}} b {{{{c', 6007), ('signs', 2, '```json {{"x": 1}} ``` "q" `', 6008))
    )) TO '{tmp_path}/extracted_pages.parquet' (FORMAT parquet)""")
    found = catalog.queries()["extract_document"](spark, str(tmp_path))
    assert found.where("source_file = 'long'").count() == 1000
    against_sql(found, catalog.oracle_sql()["extract_document"], str(tmp_path))
