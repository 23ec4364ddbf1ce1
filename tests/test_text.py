import pytest
from pyspark.sql import functions as F

from quillstack.functions import text as tx
from quillstack.functions.tokens import count_tokens, count_tokens_batch

CASES = [
    (None, []),
    ("", []),
    ("  \n", []),
    ("Ein Satz.", ["Ein Satz."]),
    ("Eins. Zwei! Drei? Vier", ["Eins.", "Zwei!", "Drei?", "Vier"]),
    ("Gemäß Abs. 2 gilt das. Ende.", ["Gemäß Abs. 2 gilt das.", "Ende."]),
    ("Im MÄR. Danach ist Schluss.", ["Im MÄR. Danach ist Schluss."]),
    ("Es gilt z.B. Folgendes. Und i.d.R. Anderes.", ["Es gilt z.B. Folgendes.", "Und i.d.R. Anderes."]),
    ("Siehe z. B. Seite 3.", ["Siehe z.", "B.", "Seite 3."]),
    ("Der B.Sc. Die Prüfung.", ["Der B.Sc.", "Die Prüfung."]),
    ("Nach § 5 Satz. 2 folgt nichts.", ["Nach § 5 Satz. 2 folgt nichts."]),
    ("Das sind 180. Die Zahl zählt.", ["Das sind 180. Die Zahl zählt."]),
    ("Im Jahr 2023. Die Zahl zählt.", ["Im Jahr 2023.", "Die Zahl zählt."]),
    ("1. Anfang ist hier. Ende.", ["1.", "Anfang ist hier.", "Ende."]),
    ("Wort. Weiter geht es. Ende.", ["Wort.", "Weiter geht es.", "Ende."]),
    ("klein. danach bleibt es.", ["klein. danach bleibt es."]),
    ('Er sagte "ja." Dann ging er.', ['Er sagte "ja." Dann ging er.']),
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", tx.sentences(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]


@pytest.mark.parametrize(
    ("path", "stem"), [("path/to/my_document.pdf", "my_document"), ("a\\b\\x.y.pdf", "x.y"), ("plain", "plain"), (".hidden", ".hidden"), (None, None)]
)
def test_document_id(spark, path, stem):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(tx.document_id(F.col("p"))).first()[0] == stem


def test_chunk_id_keeps_long_numbers(spark):
    df = spark.createDataFrame([("d", 7), ("d", 12345)], "d string, i int")
    assert [r[0] for r in df.select(tx.chunk_id(F.col("d"), F.col("i"))).collect()] == ["d_chunk_0007", "d_chunk_12345"]


def test_tokens(spark):
    df = spark.createDataFrame([(None,), ("",), ("Prüfungsordnung 2023!",), ("a b　c",), ("漢字かな交じり文",)], "t string")
    assert [r[0] for r in df.select(count_tokens(F.col("t"))).collect()] == [0, 0, 6, 3, 2]
    one = spark.createDataFrame([(["ab cd", "", None],)], "t array<string>")
    assert one.select(count_tokens_batch(F.col("t"))).first()[0] == [2, 0, 0]


def test_preview(spark):
    df = spark.createDataFrame([("a\nb" + "c" * 300,)], "t string")
    assert df.select(tx.preview(F.col("t"))).first()[0] == "a b" + "c" * 147
