"""Approximate nearest neighbours by balanced posting lists.

Vectors go to the lists of their nearest centroids, those near a boundary to several. Centroids are few enough
to be held in memory and all measured; a query reads the lists whose centroids are at most a fixed ratio farther
than its nearest one. The ratio is set from exact neighbours of some queries.
Largest inner products become smallest distances by one more coordinate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.common import partitions, store

#: Centroids are fitted on about this many vectors chosen by a hash of the id; every vector is indexed.
SAMPLE = 20_000
#: About so many vectors a list, at most so many lists, and lists that a boundary vector goes to.
LIST_SIZE, MOST_LISTS, COPIES, BOUNDARY = 100, 2048, 4, 1.15
#: Rows of a list that a task scores at once; longer lists are dealt out in parts.
PART = 4000
#: Queries whose exact neighbours set the ratio, and the share of those neighbours it must reach.
CALIBRATION, REACH = 128, 0.97
#: Neighbours found that a task holds before it keeps the best of each query.
HELD = 400_000
_LISTS = "list int, part int, vec_id long, query boolean, vec array<double>"


def usable(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, vec)``: distinct rows with an id and a finite vector that is not zero, of the most common length."""
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    rows = rows.where("vec_id is not null and vec is not null").where(finite & F.exists("vec", lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("vec") == (size["size"] if size else 0)).distinct()


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds in which a centroid with more than its share of the sample is farther away."""
    rng = np.random.default_rng(11)
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    sizes = np.full(lists, len(sample) / lists)
    spread = sample.var(0).sum() or 1.0
    for _ in range(rounds):
        penalty = 0.1 * spread * (sizes * lists / len(sample) - 1)
        nearest = np.concatenate([
            ((centroids**2).sum(1) + penalty - 2 * sample[at : at + 2000] @ centroids.T).argmin(1) for at in range(0, len(sample), 2000)
        ])
        sizes = np.bincount(nearest, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


class Centroids:
    """Centroids in memory, all of them measured in one product of matrices.

    They are at most MOST_LISTS. A walk along links from centroid to centroid ends in valleys where the centroids lie
    without clusters, and the lists it does not meet are lost to the query.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.norms = (centroids**2).sum(1)

    def search(self, vectors: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Distances to all centroids within ``ratio`` of the nearest and to the ``least`` nearest; others are inf."""
        squares = (vectors**2).sum(1)[:, None] + self.norms - 2 * vectors @ self.centroids.T
        d = np.sqrt(np.maximum(squares, 0))
        least = min(least, d.shape[1])
        nearest = np.partition(d, least - 1, axis=1)
        reach = np.maximum(ratio * nearest[:, :least].min(1), nearest[:, least - 1])
        return np.where(d <= reach[:, None], d, np.inf)


#: The name from when centroids were met along links.
Graph = Centroids


def _home(centroids: Centroids, vectors: np.ndarray) -> list[np.ndarray]:
    """The lists of each vector: its nearest centroids, up to COPIES, within BOUNDARY of the nearest."""
    out = []
    for at in range(0, len(vectors), 500):
        d = centroids.search(vectors[at : at + 500], BOUNDARY, 16)
        order = np.argsort(d, axis=1)[:, :COPIES]
        sorted_ = np.take_along_axis(d, order, 1)
        out += [o[s <= BOUNDARY * s[0]] for o, s in zip(order, sorted_)]
    return out


def _lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """One more coordinate, so that all have the same length and nearest means largest inner product."""
    rest = np.sqrt(np.maximum(largest**2 - (vectors**2).sum(1), 0))
    return np.hstack([vectors, rest[:, None]])


def _query(vectors: np.ndarray) -> np.ndarray:
    return np.hstack([vectors, np.zeros((len(vectors), 1))])


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query id, vec_id, score, row) of the k best of each query among these vectors, but for its own id.

    A product of matrices tells which can be among the best; scores are then summed alike for every pair.
    """
    rough = queries @ vectors.T
    slack = 1e-9 * (1 + np.abs(rough).max(initial=0))
    rough[query_ids[:, None] == ids] = -np.inf
    keep = np.isfinite(rough)
    if rough.shape[1] > k:
        keep &= rough >= np.partition(rough, rough.shape[1] - k, axis=1)[:, -k, None] - slack
    q, v = np.nonzero(keep)
    pieces = [(queries[q[at : at + 50_000]] * vectors[v[at : at + 50_000]]).sum(1) for at in range(0, len(q), 50_000)]
    score = np.concatenate(pieces) if pieces else np.zeros(0)
    first = _best(q, ids[v], score, k)
    return query_ids[q[first]], ids[v[first]], score[first], v[first]


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, an id once: largest score first, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    new = np.r_[True, query[order][1:] != query[order][:-1]] if len(order) else np.zeros(0, bool)
    # copies of one id under several lists have equal scores and stand side by side
    again = np.r_[False, (ids[order][1:] == ids[order][:-1]) & ~new[1:]] if len(order) else new
    order, new = order[~again], new[~again]
    starts = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


_FOUND = "query_id long, vec_id long, score double"


class _Best:
    """The best of each query that a task has met so far; given up in parts once they are too many to hold."""

    def __init__(self, k: int):
        self.k, self.held, self.size = k, [], 0

    def add(self, found: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        self.held.append(found[:3])
        self.size += len(found[0])
        if self.size > HELD:
            query, ids, score = self._reduced()
            self.held, self.size = [(query, ids, score)], len(query)
            if self.size > HELD // 2:
                yield from self.rest()

    def _reduced(self) -> tuple[np.ndarray, ...]:
        query, ids, score = (np.concatenate(c) for c in zip(*self.held))
        first = _best(query, ids, score, self.k)
        return query[first], ids[first], score[first]

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self._reduced()], ["query_id", "vec_id", "score"])
        self.held, self.size = [], 0


def _top(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _calibrated(vectors: DataFrame, queries: DataFrame, centroids: Centroids, largest: float, k: int) -> float:
    """The least ratio at which REACH of the exact neighbours of some queries are in the lists read."""
    some = queries.orderBy(F.xxhash64(F.lit("calibrate"), "vec_id"), "vec_id").limit(CALIBRATION).collect()
    if not some:
        return 1.0
    ids, asked = np.array([r["vec_id"] for r in some]), np.array([r["vec"] for r in some])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = matrix(batch.column("vec"))
            query, _, score, row = best_of(ids, asked, batch.column("vec_id").to_numpy(), own, k)
            vecs = pa.array(list(own[row]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(score), vecs], ["query_id", "score", "vec"])

    found = vectors.mapInArrow(scan, "query_id long, score double, vec array<double>")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    near = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).collect()
    if not near:
        return 1.0
    to_lists = dict(zip(ids.tolist(), np.sqrt(np.maximum(((_query(asked)[:, None] - centroids.centroids) ** 2).sum(2), 0))))
    homes = _home(centroids, _lifted(np.array([r["vec"] for r in near]), largest))
    ratios = [to_lists[r["query_id"]][h].min() / max(to_lists[r["query_id"]].min(), 1e-12) for r, h in zip(near, homes)]
    return float(np.quantile(ratios, REACH)) + 1e-9


def search(embeddings: DataFrame, step: int = 20, k: int = 20) -> DataFrame:
    """``embeddings(vec_id, embedding)`` -> ``(query_id, rank, vec_id, score)``, the k nearest of each query found.

    Queries are the rows whose id divides by ``step``; candidates are all rows but those of the query's id. Ties
    go to the smaller id. Rows without an id and vectors that are null, zero, not finite or not of the most
    common length take no part; repeated rows count once, and an id with several vectors counts with its best.
    A query whose lists hold fewer than k candidates reads all lists.
    """
    spark = embeddings.sparkSession
    vectors = store(usable(embeddings), "vectors")
    # of equal vectors only the k + 1 smallest ids can be among k nearest
    copies = Window.partitionBy("vec").orderBy("vec_id")
    held = store(vectors.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).drop("n"), "held")
    queries = vectors.where(F.col("vec_id") % step == 0)
    n = held.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest = held.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    chosen = held.where(F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1 << 30)) < min(1.0, SAMPLE / n) * float(1 << 30))
    sample = _lifted(np.array([r["vec"] for r in chosen.select("vec").toLocalIterator()] or [held.first()["vec"]]), largest)
    lists = int(max(1, min(MOST_LISTS, n // LIST_SIZE, len(sample))))
    centroids = Centroids(balanced_centroids(sample, lists))
    ratio = _calibrated(held, queries, centroids, largest, k)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes = _home(centroids, _lifted(matrix(batch.column("vec")), largest))
            rows = np.repeat(np.arange(batch.num_rows), [len(h) for h in homes])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(homes).astype(np.int32) if homes else [], pa.int32()), *(batch.column(c).take(pa.array(rows)) for c in ("vec_id", "vec"))],
                ["list", "vec_id", "vec"],
            )

    filed = store(held.mapInArrow(file, "list int, vec_id long, vec array<double>"), "lists")
    parts = np.ones(lists, np.int64)  # a number for each list
    for r in filed.groupBy("list").count().collect():
        parts[r["list"]] = -(-r["count"] // PART)
    of_list = F.array(*[F.lit(int(x)) for x in parts])
    dealt = filed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.element_at(of_list, F.col("list") + 1)).cast("int"))
    postings = dealt.select("list", "part", "vec_id", F.lit(False).alias("query"), "vec")

    def probes(asked: DataFrame, ratio: float) -> DataFrame:
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = matrix(batch.column("vec"))
                for at in range(0, len(own), 200):
                    if np.isinf(ratio):
                        read = [np.arange(lists)] * len(own[at : at + 200])
                    else:
                        d = centroids.search(_query(own[at : at + 200]), ratio, 8)
                        read = [np.flatnonzero(x <= ratio * x.min()) for x in d]
                    pairs = [(i + at, c, p) for i, cs in enumerate(read) for c in cs.tolist() for p in range(parts[c])]
                    rows, lists_, parts_ = zip(*pairs)
                    take = pa.array(rows, pa.int64())
                    columns = [pa.array(lists_, pa.int32()), pa.array(parts_, pa.int32()), batch.column("vec_id").take(take)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([True] * len(rows)), batch.column("vec").take(take)], ["list", "part", "vec_id", "query", "vec"])

        return asked.select("vec_id", "vec").mapInArrow(route, _LISTS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, own, best = None, [], [], _Best(k)
        for batch in batches:
            of = batch.column("list").to_numpy().astype(np.int64) << 32 | batch.column("part").to_numpy()
            asks = batch.column("query").to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(asks.astype(int)) != 0)])
            vec_ids, vecs = batch.column("vec_id").to_numpy(), matrix(batch.column("vec"))
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(of)]):
                if of[a] != key:
                    key, ids, own = of[a], [], []
                if not asks[a]:
                    ids.append(vec_ids[a:b])
                    own.append(vecs[a:b])
                elif ids:
                    ids, own = [np.concatenate(ids)], [np.concatenate(own)]
                    for i in range(a, b, 500):
                        j = min(i + 500, b)
                        yield from best.add(best_of(vec_ids[i:j], vecs[i:j], ids[0], own[0], k))
        yield from best.rest()

    def answers(asked: DataFrame, ratio: float) -> DataFrame:
        order = ("list", "part")
        met = postings.union(probes(asked, ratio)).repartition(partitions(spark), *order).sortWithinPartitions(*order, "query")
        return met.mapInArrow(score, _FOUND)

    found = store(_top(answers(queries, ratio), k), "found")
    candidates = held.select("vec_id").distinct().count()
    enough = found.where(F.col("rank") == min(k, candidates - 1)).select(F.col("query_id").alias("vec_id"))
    short = store(queries.join(enough, "vec_id", "left_anti"), "short")
    if not short.isEmpty():
        rest = _top(answers(short, float("inf")), k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score")
