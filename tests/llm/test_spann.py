"""Nearest neighbours against every pair: recall, exact scores and order, odd vectors."""

import numpy as np
import pytest

from punctual.llm import spann


def brute(rows, step=20, k=20):
    rows = list(dict.fromkeys(rows))
    ids, own = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for q, v in zip(ids, own):
        if q % step == 0:
            score = (own * v).sum(1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
            out[int(q)] = [(int(ids[j]), score[j]) for j in order]
    return out


def frame_of(spark, rows):
    return spark.createDataFrame([(i, list(map(float, v)), 1, 0.5) for i, v in rows], "vec_id long, embedding array<double>, list int, score double")


def test_recall(spark):
    rows = [(r.vec_id, tuple(map(float, r.embedding))) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    expected = brute(rows)
    got = {}
    for r in spann.search(frame_of(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == expected.keys() and all(len(x) == 20 for x in got.values())
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    for found in got.values():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_copies_and_norms(spark, monkeypatch):
    monkeypatch.setattr(spann, "PART", 50)
    rng = np.random.default_rng(8)
    rows = [(i, tuple(rng.normal(size=8) * rng.uniform(0.1, 3))) for i in range(500)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [rows[40]]
    expected = brute(rows)
    got = {}
    for r in spann.search(frame_of(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, pytest.approx(r.score)))
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    copies = got[1000]  # nearest first, ties to the smaller id
    assert [a for a, _ in copies if a >= 1000] == sorted(a for a, _ in copies if a >= 1000)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0])]
    rows += [(5, None), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (40, None)]
    got = spann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 8, 2.0), (0, 2, 20, 0.5), (20, 1, 8, 1.0), (20, 2, 0, 0.5)]
    assert spann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_graph_finds_the_nearest():
    rng = np.random.default_rng(1)
    graph = spann.Graph(rng.normal(size=(300, 16)))
    asked = rng.normal(size=(50, 16))
    exact = np.sqrt(((asked[:, None] - graph.centroids) ** 2).sum(2))
    met = graph.search(asked, 1.2, 16)
    wanted = exact <= 1.2 * exact.min(1, keepdims=True)
    assert np.isfinite(met[wanted]).mean() > 0.97
    assert np.allclose(met[np.isfinite(met)], exact[np.isfinite(met)])


def test_centroids_without_clusters_are_all_met():
    rng = np.random.default_rng(3)
    centroids = rng.normal(size=(600, 65)) * 0.3
    asked = rng.normal(size=(200, 65))
    exact = np.sqrt(((asked[:, None] - centroids) ** 2).sum(2))
    met = spann.Graph(centroids).search(asked, 1.05, 8)
    wanted = exact <= 1.05 * exact.min(1, keepdims=True) - 1e-9
    assert np.isfinite(met[wanted]).all()
