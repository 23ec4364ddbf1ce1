import json

from pyspark.sql import functions as F

from quillstack.functions import prompts
from quillstack.operators import documents as docs, responses as resp


def test_find_json(spark):
    cases = [
        ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ("```\n{}\n```", "{}"), ("```json\n{1", "```json\n{1"), ('say {"a": {"b": 2}} now {', '{"a": {"b": 2}}'), ('{"s": "}"} t', '{"s": "}'),
        ("none", "none"), ("{ open", "{ open"), ("} {}", "{}"), (None, None), ("", ""), ("```json``` {2}", "json"), ("```json``` x ``` {2}", "json"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", resp.find_json(F.col("t")).alias("f")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, (cases[i], got[i])


def test_parse_page(spark):
    full = {"content": "T", "section_numbers": ["1", "2"], "section_titles": ["A"], "has_table": True, "has_list": True, "has_image": True, "continues_to_next": True}
    rows = [(1, json.dumps(full)), (2, "no json"), (3, None), (4, '{"content": null, "section_numbers": null}'), (5, "[1]"), (6, '{"content": 5}')]
    df = spark.createDataFrame(rows, "n int, r string")
    got = {r.n: r.p for r in df.select("n", resp.parse_page(F.col("r"), F.col("n")).alias("p")).collect()}
    assert [tuple(s) for s in got[1].sections] == [("1", "A", 1, True), ("2", None, 1, True)]
    assert got[1].content_types == ["table", "list"] and got[1].has_figure and got[1].continues_to_next and got[1].extraction_confidence == 1.0
    assert got[2].content == "no json" and got[2].extraction_confidence == 0.5 and got[2].extraction_notes
    assert got[3].content == "" and got[4].content == "" and got[4].content_types == ["section"] and got[5].extraction_confidence == 0.5 and got[6].content == "5"


def test_parse_context(spark):
    rows = [
        (1, json.dumps({"document_type": "FAQ", "title": "T", "abbreviations": {"LP": "Leistungspunkte", "X": ""}, "chapters": ["a"]})),
        (2, json.dumps({"document_type": "unknown", "abbreviations": [{"abbr": "AB", "full": "ab"}, "x", {"short": "C"}]})), (3, "nothing"), (4, None),
    ]
    df = spark.createDataFrame(rows, "n int, r string")
    got = {r.n: r.c for r in df.select("n", resp.parse_context(F.col("r"), F.col("n")).alias("c")).collect()}
    assert got[1].document_type == "faq" and [tuple(a) for a in got[1].abbreviations] == [("LP", "Leistungspunkte")] and got[1].institution == "Unknown" and got[1].total_pages == 1
    assert got[2].document_type == "other" and [tuple(a) for a in got[2].abbreviations] == [("AB", "ab")]
    assert got[3].title == "Unknown" and got[4].title == "Unknown"


def test_refusals(spark):
    rows = [("I'm SORRY, I can't assist with that", 1.0), ("Ein normaler Text", 1.0), ("Text", 0.5), (None, None)]
    df = spark.createDataFrame(rows, "c string, k double")
    assert [r[0] for r in df.select(resp.needs_retry(F.col("c"), F.col("k"))).collect()] == [True, False, True, False]


def test_documents(spark):
    pages = spark.createDataFrame([("a", 1, "xy", True, None, 1.0), ("a", 2, None, False, True, 0.4), ("a", 3, "I cannot help", None, None, None)], "source_file string, page_number int, content string, has_table boolean, has_list boolean, extraction_confidence double")
    known = spark.createDataFrame([("a",), ("b",)], "source_file string")
    stats = {r.source_file: tuple(r)[1:] for r in docs.all_page_stats(known, pages).collect()}
    assert stats == {"a": (3, 1, 1, 5.0, 0, 13, 1), "b": (0, 0, 0, 0.0, None, None, 0)}
    assert docs.full_content(pages, "|").first().content == "xy||I cannot help"
    failed = docs.failed_pages(pages, resp.is_refusal(F.col("content"))).first()
    assert failed.failed == [2, 3]
    m = spark.createDataFrame([([("A", "1"), ("B", "2"), ("A", "3"), (None, "4")],)], "a array<struct<short:string,long:string>>").select(docs.abbreviation_map(F.col("a")).alias("m")).first().m
    assert m == {"A": "3", "B": "2"}


def test_sample_pages(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 10, 11, 56)], "n int")
    assert [r[0] for r in df.select(docs.sample_pages(F.col("n"))).collect()] == [[1], [1, 2], [1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 10], [1, 2, 3, 5, 11], [1, 2, 3, 28, 56]]


def test_context_string(spark):
    schema = "c struct<document_type:string,title:string,institution:string,faculty:string,degree_program:string,abbreviations:array<struct<short:string,long:string>>,chapters:array<string>>"
    df = spark.createDataFrame([((None, "T", "I", "", "D", [("LP", "Punkte")], [str(i) for i in range(12)]),)], schema)
    assert df.select(prompts.context_string(F.col("c"))).first()[0] == "Dokumenttyp: Unbekannt\nTitel: T\nInstitution: I\nStudiengang: D\nAbkürzungen: LP=Punkte\nGliederung: 0, 1, 2, 3, 4, 5, 6, 7"
