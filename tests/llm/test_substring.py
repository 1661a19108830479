"""Substring dedup against every window, the index against plain search, odd inputs."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from punctual.llm import fmindex, substring


def brute(rows, window=50):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), ws in zip(rows, texts):
        for i in range(len(ws) - window + 1):
            if d is not None:
                key = tuple(ws[i : i + window])
                least[key] = min(d, least.get(key, d))
    out = []
    for (d, _), ws in zip(rows, texts):
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if d is not None and least.get(tuple(ws[i : i + window]), d) < d:
                gone[i : i + window] = [True] * window
        left = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((d, len(ws), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed):
    rng = np.random.default_rng(seed)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    passage, line, rows = fresh(140), fresh(30), []
    for d in range(60):
        ws = fresh(rng.integers(0, 120))
        if d % 3 == 0:
            a = rng.integers(0, 60)
            ws += passage[a : a + rng.integers(45, 80)]
        if d % 2:
            ws += line
        ws += fresh(rng.integers(0, 60))
        rows.append((int(d * 7 % 61) - 5, "  ".join(ws) + "\n"))
    base = fresh(400)
    for d in range(100, 108):  # near copies
        own = list(base)
        own[rng.integers(0, 400)] = "other"
        rows.append((d, " ".join(own)))
    rows += [(99, " ".join(base)), (200, " ".join(base)), (300, " ".join(base)), (300, " ".join(base))]
    rows += [(400, "a " * 300), (401, "a " * 200), (402, "a b " * 150), (403, "b a " * 100)]
    rows += [(None, " ".join(base)), (500, None), (501, ""), (502, "Base " + " ".join(base[:49])), (503, "x" * 200_000)]
    return rows


def test_against_every_window(spark, monkeypatch):
    rows = rows_of(1)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, anchor int, marks int")
    expected = brute(rows)
    assert sorted(map(tuple, substring.dedup(frame).collect()), key=repr) == expected
    monkeypatch.setattr(substring, "SHARD_WORDS", 500)
    monkeypatch.setattr(substring, "BLOCK", 2)
    assert sorted(map(tuple, substring.dedup(frame).collect()), key=repr) == expected
    kept = substring.remove(frame)
    assert kept.columns == frame.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[500] is None and texts[99] == dict(rows)[99] and texts[300] == ""


def test_empty_table(spark):
    assert substring.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_against_plain_search():
    rng = np.random.default_rng(2)
    passages = [rng.integers(0, 4, rng.integers(6, 40)).astype(np.uint64) for _ in range(30)]
    documents = rng.integers(0, 1000, 30)
    index = fmindex.FMIndex(passages, documents, 6)
    streamed = passages + [rng.integers(0, 6, rng.integers(6, 50)).astype(np.uint64) for _ in range(30)]
    for text, found in zip(streamed, index.least_documents(streamed)):
        expected = []
        for i in range(len(text) - 5):
            own = [d for p, d in zip(passages, documents) if any((p[j : j + 6] == text[i : i + 6]).all() for j in range(len(p) - 5))]
            expected.append(min(own, default=fmindex.NONE))
        assert found.tolist() == expected


def test_passages_cover_every_window():
    rng = np.random.default_rng(3)
    hashed = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    hashed[300:500] = hashed[300]
    offsets = np.array([0, 20, 90, 90, 640, 700])
    of, first, count, _, _ = substring.passages_of(hashed, offsets)
    got = sorted((int(o), int(f) + i) for o, f, c in zip(of, first, count) for i in range(c))
    assert got == [(t, i) for t, (a, b) in enumerate(zip(offsets, offsets[1:])) for i in range(b - a - 49)]
    assert count.max() <= 41
