import json

from test_store import chunk

from quillstack import cli
from quillstack.adapters import embedder_health


def test_store_and_ask(spark, tmp_path, capsys, monkeypatch):
    texts = ["Die Prüfung dauert zwei Stunden.", "Das Praktikum ist im Sommer.", "Die Gebühr beträgt zehn Euro."]
    chunks = [chunk("a", i, 3) | {"text": t} for i, t in enumerate(texts)]
    (tmp_path / "c.json").write_text(json.dumps({"source_file": "a", "chunks": chunks}), encoding="utf-8")
    monkeypatch.setattr(cli, "local_session", lambda *_: spark)
    cli.main([str(tmp_path / "c.json"), "--store", f"file://{tmp_path}/store", "-q", "Wann ist das Praktikum im Sommer?", "-n", "1"])
    out = capsys.readouterr().out
    assert "'total_chunks': 3" in out and "a_chunk_0001" in out and "\n\n".join(texts) in out


def test_health():
    assert embedder_health(lambda: ["nomic:latest"], "nomic")["healthy"]
    assert embedder_health(lambda: [], "nomic") == {"healthy": False, "running": True, "model_available": False, "model": "nomic", "error": "model nomic is not installed"}

    def down():
        raise ConnectionError("refused")

    assert embedder_health(down, "x")["error"] == "ConnectionError: refused" and not embedder_health(down, "x")["running"]
