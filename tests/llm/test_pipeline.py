"""The pipeline's stages, each on its own input, against plain versions; the driver's registrations."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_substring import brute as brute_kept
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SMALL).collect()
        out.append((docs.collect(), made))
        if name != "best_fit_packing":
            assert made[0].__fields__ == docs.columns
            docs = spark.createDataFrame(made, docs.schema)
    return out


def test_language_stage_keeps_clean_documents(steps):
    before, after = steps[0]
    kept = {r.doc_id for r in after}
    lettered = [r for r in before if re.search(r"[^\W\d_]", r.text or "")]
    assert kept <= {r.doc_id for r in lettered} and len(kept) > 0.98 * len(lettered)


def shingles(text):
    """Word runs of five of the lower-cased text, or the whole of a shorter one."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_one_of_each_group_stays(steps):
    """Of documents joined by a Jaccard of 0.8 or more of 5-word shingles, the smallest id stays."""
    before, after = steps[1]
    sets = {r.doc_id: shingles(r.text) for r in before}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    assert sorted(r.doc_id for r in after) == sorted({find(d) for d in sets})


def test_repeated_passages_go(steps):
    before, after = steps[2]
    expected = {d: (n, gone) for d, n, gone, _ in brute_kept([(r.doc_id, r.text) for r in before])}
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        n, gone = expected[r.doc_id]
        assert len(r.text.split()) == n - gone and r.n_chars == len(r.text)
        assert gone or r.text == texts[r.doc_id]


def test_mixing_takes_from_its_input(steps):
    before, after = steps[3]
    rows = {tuple(r) for r in before}
    assert 0 < len(after) < len(before) and all(tuple(r) in rows for r in after)


def test_packing_places_all_tokens(steps):
    before, after = steps[4]
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r.doc_id: len(encoder.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}
    got: dict[int, int] = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == sizes


def test_registrations():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_columns_of_any_name_stay(spark):
    names = ["score", "lang_pred", "_hash", "_n", "_key", "_topic", "_weight", "_kept", "_tokens", "row", "a.b"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SMALL)
        assert made.columns == docs.columns, name
        got = made.collect()
        assert got and all(r[n] == f"{n}-{r.doc_id}" for r in got for n in names), name


def test_stages_on_no_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
