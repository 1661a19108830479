"""Near copies by Jaccard against every pair: planted copies at 0.8 to 0.95, common passages, odd inputs."""

import re

import numpy as np
import pytest

import corpus_pipeline
from punctual.llm import nearcopies


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else {()}


def brute(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    alike = []
    for i in range(len(rows)):
        for j in range(i):
            share = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if share >= 0.8:
                alike.append(share)
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values()), alike


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    vocabulary = [f"W{i}" for i in range(900)]
    rows = [(1, None), (2, ""), (3, "One two"), (4, "one  TWO"), (5, "x" * 100_000), (6, "É é e f g h"), (7, "é É E F G H")]
    line = " ".join(rng.choice(vocabulary, 12))
    for g in range(30):
        base = rng.choice(vocabulary, 200)
        for k in range(8):
            own = base.copy()
            for at in rng.choice(200, k, replace=False):
                own[at] = rng.choice(vocabulary)
            rows.append((1000 - g * 8 - k, f"{line} {' '.join(own)}"))
    for k in range(20):  # a chain: neighbours are alike, its ends are not
        rows.append((2000 + k, " ".join(f"c{i}" for i in range(10 * k, 10 * k + 100))))
    return rows


def test_planted_copies_go(spark, rows):
    expected, alike = brute(rows)
    assert sum(0.8 <= s <= 0.85 for s in alike) > 20 and sum(0.85 < s <= 0.95 for s in alike) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == expected


def test_found_without_proposals(spark, rows, monkeypatch):
    monkeypatch.setattr(nearcopies, "_proposed", lambda prints: prints.select(prints.fp.alias("x"), prints.fp.alias("y")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.representatives(docs).collect()) == brute(rows)[0]


def test_documents_against_every_pair(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in nearcopies.representatives(docs).collect()) == brute(rows)[0]
