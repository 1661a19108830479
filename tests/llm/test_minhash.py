"""MinHash fingerprints: the order of documents, estimates against exact shares, odd inputs."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from punctual.llm import minhash


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edits(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 2
        out[d] = (t, t[: len(t) - k] + following[:k], following)
    return out


def check(spark, rows, tolerance):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, hash string, bucket int")
    got = {r.doc_id: r for r in minhash.compare_edits(frame).collect()}
    expected = edits(rows)
    assert got.keys() == expected.keys()
    off = []
    for d, (text, edited, following) in expected.items():
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, following)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert abs(np.mean(off)) < tolerance / 4 and max(map(abs, off)) < tolerance
    return got


def test_against_exact_shares(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 500, 600)]
    rows = []
    for i in range(120):
        own = list(base)
        for j in rng.integers(0, 600, i):
            own[j] = f"é{rng.integers(0, 99999)}"
        rows.append((int(i * 37 % 121), "  ".join(own)))
    check(spark, rows, 0.25)
    monkeypatch.setattr(minhash, "BUCKET_ROWS", 1)
    monkeypatch.setattr(minhash, "QUANTILES", 6)
    rows += [(10**15 + i, f"far {i} away") for i in range(5)] + [(-(10**12), "a b c d e f")]
    check(spark, rows, 0.25)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "one"), (6, "𝔘nicode é"), (None, "one two three"), (7, "x " * 100_000), (-3, "a")]
    got = check(spark, rows, 0.2)
    assert got[4].fingerprint == got[5].fingerprint != got[6].fingerprint
    assert got[1].fingerprint == got[3].fingerprint == ""
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, None), (None, "z")], "doc_id long, text string")
    assert minhash.compare_edits(twice).count() == 5
    one = minhash.compare_edits(twice.where("doc_id = 1 and text = 'c'")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(1, 1.0)]
    assert minhash.compare_edits(twice.where("doc_id = 9")).count() == 0


def test_no_python_in_the_plan(spark):
    frame = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    plan = minhash.compare_edits(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
