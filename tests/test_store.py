import json

import pytest
from pyspark.sql import functions as F

from quillstack import adapters
from quillstack.operators.collection import Collection, flatten_chunk, neighbours_of
from quillstack.schemas import CHUNK, ModelConfig, StoreConfig
from quillstack.sources import json_results as js
from quillstack.streaming.ingest import ingest_stream


def chunk(doc, i, n, text="Text"):
    name = lambda k: f"{doc}_chunk_{k:04d}" if 0 <= k < n else None
    meta = {"document_id": doc, "document_title": "T", "document_type": "faq", "institution": "", "degree_program": "", "page_numbers": [4, 5], "chunk_index": i, "total_chunks": n, "prev_chunk_id": name(i - 1), "next_chunk_id": name(i + 1)}
    return {"chunk_id": name(i), "text": f"{text} {i}", "token_count": 2, "metadata": meta}


def frame(spark, chunks):
    return spark.read.schema(f"c {CHUNK}").json(spark.sparkContext.parallelize([json.dumps({"c": c}) for c in chunks])).select("c.*")


def test_collection(spark, tmp_path):
    store = Collection(spark, StoreConfig(f"file://{tmp_path}"))
    assert store.count() == 0 and store.document_ids().count() == 0
    seen = []
    flat = flatten_chunk(frame(spark, [chunk("a", i, 3) for i in range(3)]))
    assert flat.first().page_numbers == "4,5"
    assert store.upsert(flat, progress=lambda *x: seen.append(x))["chunks_stored"] == 3 and seen[-1][2] == "Done"
    store.upsert(flatten_chunk(frame(spark, [chunk("a", 0, 3, "Neu"), chunk("b", 0, 1, "")])))
    assert store.count() == 4  # updated, not doubled; rows that the new batch lacks stay
    rows = {r.chunk_id: r for r in store.read().collect()}
    assert rows["a_chunk_0000"].text == "Neu 0" and len(rows["a_chunk_0000"].embedding) == 64
    assert [r.document_id for r in store.document_ids().collect()] == ["a", "b"]
    got = store.lookup(["a_chunk_0001", "nope"]).collect()
    assert [(r.chunk_id, r.distance, r.similarity) for r in got] == [("a_chunk_0001", 0.0, 1.0)]
    assert {(r.side, r.chunk_id) for r in neighbours_of(store.read(), "a_chunk_0001").collect()} == {("prev", "a_chunk_0000"), ("next", "a_chunk_0002")}
    assert neighbours_of(store.read(), "nope").count() == 0
    store.upsert(flatten_chunk(frame(spark, [chunk("a", 0, 1)])), replace_document=True)
    assert store.count() == 2
    assert store.delete_document("a") == 1 and store.delete_document("a") == 0 and store.count() == 1
    assert store.health() == {"healthy": True, "collection": "documents", "total_chunks": 1, "total_documents": 1, "model": "hash-64"}
    down = store.health(adapters.embedder_health(lambda: [], "m"))
    assert not down["healthy"] and down["total_chunks"] == 1 and down["error"] == "model m is not installed"
    stats = store.upsert(flatten_chunk(frame(spark, [chunk("c", 0, 1)])))
    assert stats["document_id"] == "c" and stats["chunks_skipped"] == 0 and stats["embedding_time_seconds"] <= stats["total_time_seconds"]


def test_a_stopped_write_changes_nothing(spark, tmp_path):
    """Whatever step of a write fails, readers see the state before, and the next write goes on from there."""
    flat = lambda *chunks: flatten_chunk(frame(spark, chunks))
    store = Collection(spark, StoreConfig(f"file://{tmp_path}", buckets=4, keep_versions=2))
    store.upsert(flat(*[chunk("a", i, 6) for i in range(6)]))
    reader = store.read()
    folders = store._current()

    class Stopped(Exception):
        pass

    def stop(*_):
        raise Stopped

    for step in ("_publish", "_tidy"):
        broken = Collection(spark, store.config)
        setattr(broken, step, stop)
        with pytest.raises(Stopped):
            broken.upsert(flat(chunk("a", 0, 6, step)))
        assert store.count() == 6 and reader.count() == 6
    assert store.lookup(["a_chunk_0000"]).first().text == "_tidy 0"  # published before it stopped
    (tmp_path / "documents" / "versions" / "000000000009.json").write_text("{")  # a writer that died while it wrote
    assert store.count() == 6
    assert store.upsert(flat(chunk("a", 1, 6, "Neu")))["chunks_stored"] == 1
    assert store._numbers()[-1] == 10 and store.lookup(["a_chunk_0001"]).first().text == "Neu 1" and store.count() == 6
    changed = [b for b, p in store._current().items() if folders.get(b) != p]
    assert 1 <= len(changed) <= 2  # only the buckets of the two chunks were written again
    taken = Collection(spark, store.config)
    publish, calls = taken._publish, []
    taken._publish = lambda n, b: calls.append(n) or (len(calls) > 1 and publish(n, b))
    taken.upsert(flat(chunk("b", 0, 1)))
    assert len(calls) == 2 and store.count() == 7


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, doc in enumerate(("a", "b")):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"source_file": doc, "chunks": [chunk(doc, i, 2) for i in range(2)]}), encoding="utf-8")
    store = Collection(spark, StoreConfig(f"file://{tmp_path}/store"))
    for _ in range(2):  # the second run finds nothing new
        ingest_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "check")).awaitTermination()
    assert store.count() == 4


def test_json_files(spark, tmp_path):
    result = {"source_file": "a.pdf", "context": {"title": "Ä", "faculty": None}, "pages": [{"page_number": 1, "content": "x"}, {"page_number": 2, "content": None}], "errors": [], "processed_at": "2024-01-02T03:04:05.000006"}
    (tmp_path / "a.json").write_text(json.dumps(result, indent=2, ensure_ascii=False), encoding="utf-8")
    back = js.read_extractions(spark, str(tmp_path / "a.json"))
    assert [(r.position, r.page_number, r.content) for r in js.page_rows(back).orderBy("position").collect()] == [(0, 1, "x"), (1, 2, None)]
    text = back.select(js.to_json(F.struct("context"))).first()[0]
    assert '"faculty":null' in text and "Ä" in text
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    with pytest.raises(Exception):  # noqa: B017  Spark's error for a malformed file
        js.read_extractions(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "c.json").write_text(json.dumps({"source_file": "a", "chunks": [chunk("a", 0, 1)]}), encoding="utf-8")
    assert js.chunk_rows(js.read_chunks(spark, str(tmp_path / "c.json"))).first().metadata.page_numbers == [4, 5]


class Flaky:
    calls = 0

    def answer(self, system_prompt, user_prompt, images):
        Flaky.calls += 1
        if user_prompt == "fail":
            raise ConnectionError("refused")
        return ("" if user_prompt == "empty" else "ok"), 1, 2


def test_adapters(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes("eins\fzwei\fdrei".encode())
    files = js.read_binary(spark, str(tmp_path))
    info = adapters.pdf_info(files, adapters.PlainTextRenderer)
    assert info.first().page_count == 3 and info.first().title == ""
    wanted = adapters.wanted_pages(info, 2)
    images = adapters.render_pages(files, wanted, adapters.PlainTextRenderer).orderBy("page_number").collect()
    assert [(r.page_number, r.mime_type) for r in images] == [(2, "image/png"), (3, "image/png")]
    name = info.first().source_file
    outside = spark.createDataFrame([(name, 3), (name, 9), (name, 0)], "source_file string, page_number int")
    assert [r.page_number for r in adapters.render_pages(files, outside, adapters.PlainTextRenderer).collect()] == [3]
    assert adapters.wanted_pages(info, 1, 0).count() == 3 and adapters.wanted_pages(info, 1, 2).count() == 2 and adapters.wanted_pages(info, 7).count() == 0
    prompts = adapters.render_pages(files, wanted, adapters.PlainTextRenderer).select("page_number", F.lit("s").alias("system_prompt"), F.lit("u").alias("user_prompt"), F.array("image_base64").alias("images"))
    replies = adapters.ask_model(prompts, ["page_number"], adapters.EchoModel).orderBy("page_number").collect()
    assert [json.loads(r.reply)["content"] for r in replies] == ["zwei", "drei"] and replies[0].attempts == 1


def test_model_is_asked_again(spark):
    df = spark.createDataFrame([(1, "s", "fail", None), (2, "s", "empty", None), (3, "s", "fine", None)], "id int, system_prompt string, user_prompt string, images array<string>")
    got = {r.id: r for r in adapters.ask_model(df, ["id"], Flaky, 2, wait=lambda s: None).collect()}
    assert got[1].reply is None and got[1].error == "ConnectionError: refused" and got[1].attempts == 2
    assert got[2].reply == "" and got[2].attempts == 2 and got[3].reply == "ok" and got[3].attempts == 1


def test_embedding(spark):
    df = spark.createDataFrame([("Ein Wort",), ("ein WORT",), (" ",), (None,)], "t string")
    a, b, c, d = (r[0] for r in df.coalesce(1).select(adapters.hash_embedding(F.col("t"))).collect())
    assert a == b and len(a) == 64 and abs(sum(x * x for x in a) - 1) < 1e-6 and c == [] and d == []


def test_zoom():
    assert adapters.fit_zoom(600, 800, 144, 2000) == 2.0 and adapters.fit_zoom(600, 4000, 144, 2000) == 0.5 and adapters.fit_zoom(600, 4000, 144, None) == 2.0


def test_pages_in_request_order_limits_and_thumbnails(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes("eins\fzwei\fdrei".encode())
    files = js.read_binary(spark, str(tmp_path))
    name = files.first().path
    wanted = spark.createDataFrame([(name, 3, 0), (name, 9, 1), (name, 1, 2), (name, 3, 3)], "source_file string, page_number int, position int")
    got = adapters.render_pages(files, wanted, adapters.PlainTextRenderer, max_dimension=421).orderBy("position").collect()
    assert [(r.position, r.page_number) for r in got] == [(0, 3), (2, 1), (3, 3)] and {(r.width, r.height) for r in got} == {(298, 421)}
    with pytest.raises(Exception, match="out of range"):
        adapters.render_pages(files, wanted, adapters.PlainTextRenderer, strict=True).collect()
    (small,) = adapters.thumbnails(files, adapters.PlainTextRenderer, 400).collect()
    assert (small.page_number, small.width, small.height) == (1, 283, 400)


class Broken:
    def __init__(self, error):
        self.error = error

    def embed(self, texts):
        raise self.error


def test_embedding_errors():
    with pytest.raises(ValueError):
        adapters.embed_text(adapters.HashEmbedder(), " \n")
    assert len(adapters.embed_text(adapters.HashEmbedder(8), "Wort")) == 8
    for error, kind in ((OSError("Connection refused"), ConnectionError), (type("ConnectionLost", (Exception,), {})("x"), ConnectionError), (KeyError("model"), RuntimeError)):
        with pytest.raises(kind):
            adapters.embed_text(Broken(error), "Wort")


def test_configs():
    for bad in (dict(max_retries=0), dict(temperature=3), dict(max_tokens_per_request=1), dict(language="fr")):
        with pytest.raises(ValueError):
            ModelConfig(**bad)
    assert (ModelConfig().model, ModelConfig().max_retries) == ("gpt-4o", 3)
    with pytest.raises(ValueError):
        StoreConfig("x", metric="manhattan")
