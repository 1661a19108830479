"""Language identification: sums over segmentations, learning, held-out accuracy, odd inputs."""

import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from punctual.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def pieces():
    return langid.Pieces(PATH)


def names_of(pieces):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PATH)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p for p in map(model.id_to_piece, usual) if "▁" not in p[1:]]


def segmentations(word, number):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        head = word[:n]
        if head in number or n == 1:
            for rest in segmentations(word[n:], number):
                yield [number.get(head, len(number)), *rest]


def test_sums_over_all_segmentations(pieces):
    number = {n: i for i, n in enumerate(names_of(pieces))}
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(pieces.count), 2).T
    names = ["the", "a", "", "reading", "ünï𝔘x", "ou"]
    got = langid.log_scores(names, pieces, p)
    used = langid.expected_counts(names, np.arange(1.0, 7), pieces, p[:, 0].copy())
    expected_used = np.zeros(pieces.count)
    for k, name in enumerate(names):
        ways = list(segmentations("▁" + name, number))
        weights = np.array([[math.prod(p[i, g] for i in way) for g in range(2)] for way in ways])
        assert np.allclose(got[k], np.log(weights.sum(0)))
        for way, w in zip(ways, weights[:, 0] / weights[:, 0].sum()):
            for i in way:
                expected_used[i] += w * (k + 1)
    assert np.allclose(used, expected_used)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SMALL)
    got = langid.identify(docs, PATH).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    assert got.where("score < 0 or score > 1").count() == 0


def test_odd_texts(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)]
    odd = [(None, None, "en"), (900, "", "de"), (901, "12 34 %%%", None), (902, "漢字 " * 3, None), (903, "x" * 200_000, None)]
    odd += [(904, "der und die", "xx"), (904, "der und die", "xx"), (905, "THE AND THE", None)]
    frame = spark.createDataFrame([(*r, 1.0, "y") for r in rows + odd], "doc_id long, text string, lang string, score double, word string")
    got = {r.doc_id: r for r in langid.identify(frame, PATH).collect()}
    assert [got[k].lang_pred for k in (None, 900, 901)] == ["und"] * 3 and got[901].score == 0
    assert got[905].lang_pred == "en" and got[902].lang_pred in ("de", "en", "xx")
    assert langid.identify(frame, PATH).count() == len(rows) + len(odd)


def test_nothing_to_learn(spark):
    frame = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(frame, PATH).collect()] == ["und"]
    assert langid.identify(frame.where("doc_id > 5"), PATH).count() == 0
