"""Raking against a plain version, shares of the sample, odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.llm import mixing


def test_marginals_like_plain_raking(spark):
    rng = np.random.default_rng(4)
    table = rng.integers(1, 500, (6, 3, 4)).astype(float)
    table[0, 1:, :] = 0
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", k, int(table[i, j, k])) for i, j, k in np.ndindex(table.shape)], "source string, lang string, topic int, tokens long")
    got = mixing.rake(cells)
    goals = [x / x.sum() for x in (table.sum(tuple({0, 1, 2} - {a})) ** 0.7 for a in range(3))]
    plain = table / table.sum()
    for _ in range(500):
        for axis, goal in enumerate(goals):
            shape = [1, 1, 1]
            shape[axis] = -1
            plain = plain * (goal / plain.sum(tuple({0, 1, 2} - {axis}))).reshape(shape)
    f = {r.source: r.factor for r in got.sources.collect()}
    fitted = np.array([[[table[i, j, k] * f[f"s{i}"] * got.languages[f"l{j}"] * got.topics[k] for k in range(4)] for j in range(3)] for i in range(6)])
    assert np.allclose(fitted, plain, atol=1e-6)
    weights = fitted[table > 0] / table[table > 0]
    assert got.largest == pytest.approx(weights.max())


def test_sample_has_the_shares(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", *[F.concat(F.lit("wordword"), (F.xxhash64("id", F.lit(i)) % 50)) for i in range(9)]).alias("text"),
        F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("source"),
        F.when(F.col("id") % 7 > 0, "x").otherwise(None).alias("lang"),
    )
    goal = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.9)], "source string, target double")
    got = mixing.mixture(docs, source_targets=goal, languages={"x": 0.7, "": 0.3})
    kept = got.where("kept")
    total = kept.agg(F.sum("n_tokens")).first()[0]
    shares = {r.source: r.n / total for r in kept.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert abs(shares["a"] - 0.5) < 0.04
    assert got.count() == 6000 and got.agg(F.max("probability")).first()[0] == pytest.approx(1)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, "", "a", "x"), (2, "aaaaaaaa b", "a", "x"), (2, "aaaaaaaa b", "a", "x"), (3, "c " * 90_000, None, "y")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, lang string, topic int, weight int")
    got = mixing.mixture(frame).collect()
    assert len(got) == 5 and all(0 <= r.probability <= 1 for r in got)
    assert len({r.kept for r in got if r.doc_id == 2}) == 1
    assert mixing.mixture(frame.where("doc_id = 9")).count() == 0
