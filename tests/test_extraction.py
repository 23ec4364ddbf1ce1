import json

from pyspark.sql import functions as F

from quillstack import adapters, scripts
from quillstack.functions import prompts
from quillstack.operators import extraction as ext, responses as resp
from quillstack.schemas import ModelConfig
from quillstack.sources import json_results as js


class Moody:
    """Refuses the second page once, never reads the third, answers the fourth in plain words, fails on contexts of b."""

    calls: dict = {}

    def answer(self, system_prompt, user_prompt, images):
        reply, a, b = adapters.EchoModel().answer(system_prompt, user_prompt, images)
        text = json.loads(reply)["content"]
        n = Moody.calls[text] = Moody.calls.get(text, 0) + 1
        if system_prompt == prompts.CONTEXT_SYSTEM:
            if text.startswith("b"):
                raise OSError("no answer")
            return "```json\n" + json.dumps({"title": f"Titel {len(images)}", "document_type": "FAQ"}) + "\n```", 5, 7
        if "zwei" in text and n == 1:
            return json.dumps({"content": "I'm sorry, I can't assist with that."}), 1, 1
        if "drei" in text:
            raise ConnectionError("refused")
        return ("plain words" if "vier" in text else reply), 1, 2


def test_documents_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, pages in (("a.v1", ["eins", "zwei", "drei", "vier", *map(str, range(5, 41))]), ("b", ["b1"])):
        (tmp_path / "in" / f"{name}.pdf").write_bytes("\f".join(pages).encode())
    Moody.calls.clear()
    said = []
    contexts, pages = ext.extract_documents(js.read_binary(spark, str(tmp_path / "in")).coalesce(1), adapters.PlainTextRenderer, Moody, ModelConfig(max_retries=2), wait=lambda s: None, progress=lambda *x: said.append(x))
    assert said[0][:2] == (0, 0) and said[-1] == (41, 41, "Done")
    by = {r.source_file.rsplit("/", 1)[-1]: r for r in contexts.collect()}
    assert (by["a.v1.pdf"].context.title, by["a.v1.pdf"].context.document_type, by["a.v1.pdf"].total_pages) == ("Titel 5", "faq", 40)
    assert (by["b.pdf"].context.title, by["b.pdf"].context.institution, by["b.pdf"].error) == ("b", "Unknown", "OSError: no answer")
    got = {r.page_number: r for r in pages.where("source_file LIKE '%a.v1.pdf'").collect()}
    assert sorted(got) == list(range(1, 41)) and got[1].content == "eins" and got[2].content == "zwei" and got[2].extraction_confidence == 1.0
    assert got[3].extraction_confidence == 0.0 and got[3].content == "[Extraction failed after 2 attempts: ConnectionError: refused]" and "2 retries" in got[3].extraction_notes and got[3].content_types == []
    assert got[4].extraction_confidence == 0.5 and got[4].content == "plain words"
    results = {r.source_file.rsplit("/", 1)[-1]: r for r in ext.extraction_results(contexts, pages).collect()}
    a = results["a.v1.pdf"]
    assert [p.page_number for p in a.pages] == list(range(1, 41)) and len(a.errors) == 2 and a.warnings == ["Pages not extracted: 3, 4"] and a.total_input_tokens == 5 + 39
    assert results["b.pdf"].errors == ["Context: OSError: no answer"]


def test_json_part_equals_the_column(spark):
    replies = ["```json\n{\"a\": 1}\n```", "``` {} ```", "x {\"a\": {\"b\": 2}} y", "none", "", "{ open", "```json```{}", "} {\"a\": 1}"]
    rows = spark.createDataFrame([(r,) for r in replies], "r string").select("r", resp.find_json(F.col("r")).alias("j")).collect()
    assert [resp.json_part(r.r) for r in rows] == [r.j for r in rows]
    assert resp.accept_page('{"content": "Text"}') and not resp.accept_page("Text") and not resp.accept_page(None) and not resp.accept_page('{"content": "I am unable to read it"}')


def test_scripts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(("Erster Satz der Seite. " * 30 + "\f" + "Zweite Seite mit Text. " * 30).encode())
    done = scripts.extract_files(spark, str(tmp_path / "in"), f"file://{tmp_path}/out")
    assert done.selectExpr("size(pages)").first()[0] == 2
    back = scripts.chunk_file(spark, f"file://{tmp_path}/out", f"file://{tmp_path}/chunks", multi_line=False).collect()
    (r,) = back
    assert r.document_id == "a" and r.stats.total_chunks == len(r.chunks) >= 1 and r.chunks[0].metadata.page_numbers == [1, 2] and r.chunks[0].metadata.prev_chunk_id is None and r.config.max_chunk_tokens == 512
    assert js.chunk_rows(js.read_chunks(spark, f"file://{tmp_path}/chunks", multi_line=False)).count() == len(r.chunks)


def test_abbreviations_as_a_map(spark):
    df = spark.sql("SELECT named_struct('document_type', 'faq', 'title', 'T', 'institution', 'I', 'faculty', '', 'degree_program', '', 'chapters', array('x'), 'abbreviations', map('PO', 'Ordnung')) AS c")
    pairs = prompts.abbreviation_list(F.col("c.abbreviations"))
    assert prompts.context_string(F.col("c").withField("abbreviations", pairs)) is not None
    assert "Abkürzungen: PO=Ordnung" in df.select(prompts.context_string(F.col("c").withField("abbreviations", pairs))).first()[0]
