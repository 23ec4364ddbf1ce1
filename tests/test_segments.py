import random
import re

import pytest
from pyspark.sql import functions as F

from quillstack.functions.text import ABBREVIATIONS
from quillstack.operators import segments as seg
from quillstack.operators.ordered import beside, latest, running_sum
from quillstack.schemas import SegmentConfig


def greedy(tokens, most, overlap):
    start, out = 0, []
    while start < len(tokens):
        end, total = start, tokens[start]
        while end + 1 < len(tokens) and total + tokens[end + 1] <= most:
            end += 1
            total += tokens[end]
        out.append((start, end))
        if end == len(tokens) - 1:
            break
        back, total = None, 0
        for j in range(end, start - 1, -1):
            total += tokens[j]
            if total >= overlap:
                back = j
                break
        start = max(end + 1 if back is None else back, start + 1)
    return out


@pytest.mark.parametrize(("most", "overlap"), [(60, 15), (100, 0), (50, 49), (64, 60)])
def test_packing_equals_brute_force(spark, most, overlap):
    rnd = random.Random(most)
    docs = {f"d{d}": [rnd.choice([1, 2, 3, 10, 40, 90]) for _ in range(rnd.choice([1, 2, 5, 40]) if d > 1 else 1500)] for d in range(20)}
    df = spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "source_file string, sentence_no bigint, tokens int")
    got = {}
    for r in seg.pack_sentences(df, SegmentConfig(most, overlap, 1), block=256).collect():
        got.setdefault(r.source_file, []).append((r.first_no, r.last_no))
        assert r.is_last == (r.last_no == len(docs[r.source_file]) - 1)
    assert {d: sorted(v) for d, v in got.items()} == {d: greedy(t, most, overlap) for d, t in docs.items()}


def split_plain(text):
    stop = "\0"
    low = "a-zäöüA-ZÄÖÜ"
    text = re.sub(rf"\b[{low}]\.(?:[{low}]\.)+", lambda m: m[0].replace(".", stop), text)
    text = re.sub(r"§\s*\d+\s+(?:Abs|Nr|Satz)\.\s*\d+", lambda m: m[0].replace(".", stop), text, flags=re.I)
    text = re.sub(rf"(?<!\w)(?:{'|'.join(ABBREVIATIONS)})\.(?=\s)", lambda m: m[0].replace(".", stop), text, flags=re.I)
    text = re.sub(r"(?<=\s)\d{1,3}\.(?=\s)", lambda m: m[0].replace(".", stop), text)
    out, at = [], 0
    for part in re.split(r'(?<=[.!?])(?=\s+[A-ZÄÖÜ0-9„"(§])', text):
        body = part.replace(stop, ".")
        lead = len(body) - len(body.lstrip())
        out.append((at + lead, body.strip()))
        at += len(part)
    return out


@pytest.mark.parametrize("bucket", [1, 3, 256])
def test_page_sentences_equal_brute_force(spark, bucket):
    rnd = random.Random(3)
    bits = ["Ein Satz endet. ", "Noch einer! ", "ohne Ende", "z.B. ", "§ 5 Satz. ", "2 Dinge. ", "Abs. ", "17. ", "Wie bitte? ", "\n", "(Klammer) ", "§ 3 gilt. ", "  "]
    docs = {f"f{d}": ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(1, 9))] for d in range(60)}
    df = spark.createDataFrame([(d, n + 1, t) for d, ts in docs.items() for n, t in enumerate(ts)], "source_file string, page_number int, content string")
    got = {}
    for r in seg.page_sentences(df, bucket=bucket).collect():
        got.setdefault(r.source_file, []).append((r.sentence_no, r.start_pos, r.end_pos, r.sentence, r.page_numbers))
    for d, ts in docs.items():
        pages, at = [], 0
        for n, t in enumerate(ts):
            if t.strip():
                pages.append((n + 1, at, at + len(t.strip()) + 2))
                at += len(t.strip()) + 2
        merged = "\n\n".join(t.strip() for t in ts if t.strip())
        want = [
            (i, a, a + len(s), s, [n for n, x, y in pages if x < a + len(s) and y > a])
            for i, (a, s) in enumerate(split_plain(merged) if merged else [])
        ]
        assert sorted(got.get(d, [])) == want, d


def test_chain_of_segments(spark):
    pages = spark.createDataFrame(
        [("p/a.pdf", n, " ".join(f"Satz Nummer {n * 100 + k} steht hier." for k in range(20))) for n in (1, 2, 3)] + [("b.pdf", 1, "  "), ("c.pdf", 1, "Kurz.")],
        "source_file string, page_number int, content string",
    )
    documents = spark.createDataFrame([("p/a.pdf", ("T", "faq", None, None)), ("b.pdf", ("U", "faq", "I", "D")), ("c.pdf", ("V", "faq", "I", None))], "source_file string, context struct<title:string,document_type:string,institution:string,degree_program:string>")
    config = SegmentConfig(80, 20, 10)
    chunks = seg.segment_documents(pages, documents, config)
    rows = sorted(chunks.where("source_file = 'p/a.pdf'").collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and len(rows) > 3
    assert {r.total_chunks for r in rows} == {len(rows)} and {r.document_id for r in rows} == {"a"}
    assert rows[0].prev_chunk_id is None and rows[-1].next_chunk_id is None
    assert all(a.next_chunk_id == b.chunk_id and b.prev_chunk_id == a.chunk_id for a, b in zip(rows, rows[1:], strict=False))
    assert all(r.token_count <= 90 for r in rows) and rows[0].chunk_id == "a_chunk_0000" and rows[0].institution == "" and rows[0].degree_program == ""
    assert any(set(a.text.split(". ")) & set(b.text.split(". ")) for a, b in zip(rows, rows[1:], strict=False))
    stats = {r.source_file: r for r in seg.segment_stats(chunks, seg.page_sentences(pages), pages, documents).collect()}
    assert stats["p/a.pdf"].total_sentences == 60 and stats["p/a.pdf"].total_pages_processed == 3
    assert tuple(stats["b.pdf"])[1:] == (0, 0, 0.0, 0, 0, 0, 0)
    assert stats["c.pdf"].total_chunks == 1  # the last segment stays though it is small


def test_segments_over_block_ends(spark):
    """Segments whose sentences lie in two blocks, numbered over blocks, equal the plain greedy loop."""
    lines = [f"Satz {i} hat Worte." if i % 7 else "Kurz." for i in range(900)]
    pages = spark.createDataFrame([("d", n, " ".join(lines[n * 9 : n * 9 + 9])) for n in range(100)], "source_file string, page_number int, content string")
    config = SegmentConfig(50, 12, 1)
    sentences = seg.page_sentences(pages, bucket=4)
    rows = sorted(seg.segment_rows(sentences, config, block=110).collect(), key=lambda r: r.first_no)
    by = {r.sentence_no: r for r in sentences.collect()}
    assert [(r.first_no, r.last_no) for r in rows] == greedy([by[i].tokens for i in range(len(by))], 50, 12)
    assert all(r.text == " ".join(by[i].sentence for i in range(r.first_no, r.last_no + 1)) for r in rows) and rows[-1].is_last and len({r.block for r in rows}) > 3
    documents = spark.createDataFrame([("d", ("T", "faq", None, None))], "source_file string, context struct<title:string,document_type:string,institution:string,degree_program:string>")
    numbered = {r.text: r for r in seg.number_segments(spark.createDataFrame(rows), documents).collect()}
    assert [numbered[r.text].chunk_index for r in rows if r.text in numbered][-1] == len(rows) - 1


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "source_file string, page_number int, content string")
    documents = spark.createDataFrame([], "source_file string, context struct<title:string,document_type:string,institution:string,degree_program:string>")
    assert seg.segment_documents(pages, documents).count() == 0


def test_pages_of_spans_without_page(spark):
    spans = spark.createDataFrame([("a", 0, 5), ("a", 5, 12), ("x", 0, 1)], "source_file string, start_pos bigint, end_pos bigint")
    merged = spark.createDataFrame([("a", 1, 0, 6), ("a", 2, 6, 99999)], "source_file string, page_number int, start_pos bigint, end_pos bigint")
    got = {(r.source_file, r.start_pos): r.page_numbers for r in seg.pages_of_spans(spans, merged, width=4).collect()}
    assert got == {("a", 0): [1], ("a", 5): [1, 2], ("x", 0): []}


def test_running_sum_and_neighbours(spark):
    df = spark.createDataFrame([("g", i, i * 10) for i in range(50)] + [("h", 7, 1)], "g string, i int, v int")
    got = {(r.g, r.i): (r.s, r.b, r.a) for r in beside(beside(running_sum(df, ["g"], F.floor(F.col("i") / 8), ["i"], F.col("v"), "s"), ["g"], F.floor(F.col("i") / 8), "i", "v", "b"), ["g"], F.floor(F.col("i") / 8), "i", "v", "a", ahead=True).collect()}
    assert got == {("g", i): (sum(range(i)) * 10, (i - 1) * 10 if i else None, (i + 1) * 10 if i < 49 else None) for i in range(50)} | {("h", 7): (0, None, None)}


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", None, "only")], "k string, t int, v string")
    assert {r.k: r.v for r in latest(df, ["k"], ["t"]).collect()} == {"a": "new", "b": "only"}


def test_bad_sizes():
    for args in ((512, 512, 50), (40, 10, 5), (512, -1, 50), (512, 100, 0), (5000, 1, 1)):
        with pytest.raises(ValueError):
            SegmentConfig(*args)
    assert SegmentConfig() == SegmentConfig(512, 100, 50)
