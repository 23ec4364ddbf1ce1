import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quillstack.llm.corpus_ids import encode_corpus, measure_corpus
from quillstack.llm.encoder import PATTERN, PairEncoder, encoder, vocabulary


@pytest.fixture(scope="module")
def own() -> PairEncoder:
    return encoder(vocabulary())


@pytest.fixture(scope="module")
def other(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_pattern_is_the_public_one():
    assert PATTERN == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_equals_library(own, other, text):
    assert own.encode(text) == other.encode_ordinary(text)
    assert own.count(text) == len(own.encode(text)) and own.decode(own.encode(text)) == text


def test_hard_texts(own, other):
    rnd = random.Random(1)
    texts = ["a" * 50_000, " " * 3000 + "x", "漢" * 3000, "<|endoftext|>", "\0\n\r\n\t", "'s 're", "👩‍🎓", "é", "ﬁ"]
    texts += ["".join(rnd.choice("aeiourstnlm zäö漢字\n  0123") for _ in range(rnd.randint(0, 80))) for _ in range(3000)]
    assert [own.encode(t) for t in texts] == [other.encode_ordinary(t) for t in texts]
    same = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    same.encode_special_tokens = True
    assert [own.encode(t) for t in texts[:500]] == [e.ids for e in same.encode_batch(texts[:500], add_special_tokens=False)]


def test_other_vocabulary():
    path = vocabulary("byte_bpe_multi_50k")
    e = encoder(path)
    lib = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    for t in ("Die Prüfungsordnung gilt für 12 Semester.", "Το μητρώο εγκρίθηκε.", "学生は第19週までに"):
        assert e.encode(t) == lib.encode_ordinary(t)


def test_every_token_encodes_to_itself(own):
    assert all(own.encode_piece(t) == [i] for i, t in enumerate(own.tokens) if t)


def test_corpus(spark, own):
    df = spark.createDataFrame([(1, "Hallo Welt", "x"), (2, "", "y"), (3, None, None), (1, "Hallo Welt", "x"), (None, "a", "z")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id or 0, r.ids) for r in encode_corpus(df, "doc_id", "text").collect())
    assert got == sorted([(1, own.encode("Hallo Welt"))] * 2 + [(2, []), (3, []), (0, own.encode("a"))])
    assert encode_corpus(df, "doc_id", "text").dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r.doc_id or 0, r.size) for r in measure_corpus(df, "doc_id", "text").collect()) == sorted((d, len(i)) for d, i in got)
    assert encode_corpus(df.where("false"), "doc_id", "text").count() == 0


def test_whole_table(spark, data, other):
    from quillstack.llm.queries import p6_ids

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = p6_ids(spark, data).collect()
    assert len(got) == len(texts) and all(r.ids == other.encode_ordinary(texts[r.doc_id] or "") for r in got)
