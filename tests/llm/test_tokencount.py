"""Token counts against the tokenizer library's own unigram search on the same pieces."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as pb

from punctual.llm import tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def unigram():
    model = pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    worst = min(p.score for p in model.pieces if p.score > tokencount.PLACEHOLDER)
    for piece in model.pieces:
        piece.score = max(piece.score, worst)
    return SentencePieceProcessor(model_proto=model.SerializeToString())


COUNTER = tokencount.Counter(PATH)
ODD = ["", " ", "a", "  two  spaces ", "line\nline\r\n\tx", "漢字かな交じり", "é é 𝔘nicode", "▁literal ▁ mark", "ABCabc!!! ### $$$", "the " * 50]


def test_odd_texts(unigram):
    for text in ODD:
        assert COUNTER.text(text)[0] == len(unigram.encode(text)), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aeiourstnlth ouEé\n.,#漢"), max_size=60))
def test_like_the_library(unigram, text):
    assert COUNTER.text(text)[0] == len(unigram.encode(text))


def test_documents(spark, unigram):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = tokencount.count_tokens(docs, PATH).collect()
    short = [r for r in got if r.n_chars < 1500]
    assert len(got) == 60 and len(short) > 10
    assert all(r.n_tokens == len(unigram.encode(texts[r.doc_id])) for r in short)


def test_rows(spark):
    rows = [(None, None), (1, ""), (1, "a b"), (1, "a b"), (2, "x" * 300_000)]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_tokens int")
    got = tokencount.count_tokens(frame, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_chars, r.n_tokens > 0) for r in got) == [(0, 0, False), (1, 0, False), (1, 3, True), (1, 3, True), (2, 300_000, True)]
    assert tokencount.count_tokens(frame.where("doc_id = 7"), PATH).count() == 0
