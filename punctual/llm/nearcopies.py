"""Near copies by the exact Jaccard of word shingles: SimHash proposes links, a prefix index completes them.

Sets of shingles whose Jaccard is at least ``least`` share one of their first ``n - ceil(least * n) + 1`` shingles
in any one order of all shingles. With the rare ones first, few other texts are met. Every link is verified on
the whole sets. Lists are compared inside tasks: bitmaps of the sets bound what two of them can share from above,
so only pairs that may be alike become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm import simhash
from punctual.llm.common import packed, partitions, release, slices, store, unpacked, words
from punctual.llm.components import components

WIDTH, LEAST = 5, 0.8
#: Cells that shingles are counted in to order them by rarity; cells shared by chance cost time only.
CELLS = 1 << 18
#: Rows of a list that a task compares at once; longer lists are compared as pairs of such blocks.
BLOCK = 2048
#: Lists of up to so many rows are compared together, all of a batch at once.
SHORT = 64
#: Bits of a set's bitmap for each shingle, and the fewest and most of a bitmap (powers of two).
BITS, FEWEST, MOST = 4, 256, 1 << 13
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles_of(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``width``-word shingles (fewer words: one for all)."""
    offsets, codes, vocabulary = words(pc.utf8_lower(pc.fill_null(texts, "")))
    names = [w.encode() for w in vocabulary.to_pylist()]
    hashed = np.fromiter((xxhash.xxh64_intdigest(w, simhash.SEED) for w in names), np.uint64, len(names))
    of, n = hashed[codes], max(0, len(codes) - width + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(width):
        runs = (runs ^ of[j : j + n]) * _ODD
        runs ^= runs >> np.uint64(29)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        else:
            line = b" ".join([names[c] for c in codes[a:b].tolist()])
            out.append(np.array([xxhash.xxh64_intdigest(line, simhash.SEED)] if b > a else [], np.uint64))
    return out


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), simhash.SEED)


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts or [np.zeros(0, np.uint64)]).view(np.int64), sizes


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            nodes = _longs([_node(s) for s in shingles_of(texts, width)])
            fps = pa.array(simhash.fingerprints_of(texts, width).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), nodes, fps], ["doc_id", "text_hash", "fp", "print"])

    return run


def _cells(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in slices(batches):
            for own in shingles_of(batch.column("text"), width):
                counts[(own % np.uint64(CELLS)).astype(np.int64)] += 1
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], ["cell", "n"])

    return run


def _postings(width: int, least: float, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own_of = {_node(own): own for own in shingles_of(batch.column("text"), width) if len(own)}
            sizes, parts = [], []
            for own in own_of.values():
                first = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1
                parts.append(own[np.argsort(counts[(own % np.uint64(CELLS)).astype(np.int64)], kind="stable")[:first]])
                sizes.append(len(own))
            tokens, each = _lists(parts)
            places = np.arange(len(tokens)) - np.repeat(np.cumsum(each) - each, each)
            nodes = np.array(list(own_of), np.uint64).view(np.int64)
            columns = [tokens, np.repeat(nodes, each), np.repeat(np.array(sizes, np.int32), each), places.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "size", "place"])

    return run


def _reachable(x: np.ndarray, at: np.ndarray, y: np.ndarray, there: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of sizes ``x`` and ``y`` can be alike if the shingle at these places is the first they share."""
    return np.minimum(x - at, y - there) * (1 + least) >= least * (x + y) - 1e-9


_MET = "token long, node long, size int, place int, low long"


def _met(least: float):
    """Streams postings sorted by token and node: repeated ones and lists of one node go.

    ``low`` is the list's smallest node where that may be alike, else null. Two rows are held, however long a list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = np.zeros((4, 0), np.int64), 0  # first and last row of the open list, and how many are given out
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("token", "node", "size", "place")])
            rows = np.concatenate([held, rows], 1)
            rows = rows[:, np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(0)]]
            token, node, size, place = rows
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            n = np.diff(np.r_[starts, len(token)])
            first = np.repeat(starts, n)
            given = np.repeat(n > 1, n)
            given[:out] = False
            may = _reachable(size, place, size[first], place[first], least) & (node != node[first])
            low = pa.array(node[first][given], mask=~may[given])
            columns = [pa.array(token[given]), pa.array(node[given]), pa.array(size[given].astype(np.int32)), pa.array(place[given].astype(np.int32)), low]
            yield pa.RecordBatch.from_arrays(columns, ["token", "node", "size", "place", "low"])
            out = 0 if n[-1] == 1 else 2
            held = rows[:, [starts[-1], -1][: max(1, out)]]

    return run


def _bitmap(own: np.ndarray) -> bytes:
    width = min(MOST, max(FEWEST, 1 << (BITS * len(own) - 1).bit_length()))
    out = np.zeros(width, np.uint8)
    out[(own % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _bitmaps(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = shingles_of(batch.column("text"), width)
            maps = pa.array([_bitmap(s) for s in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([_longs([_node(s) for s in parts]), maps], ["node", "bits"])

    return run


def _alike(rows: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of other roots (and of other blocks, where there are two) that may be alike.

    Shingles that the one bitmap has and the other has not are in the one set only, so the bound loses no pair.
    """
    size, place, root, block = (rows.column(c).to_numpy().astype(np.int64) for c in ("size", "place", "root", "block"))
    order = np.argsort(size, kind="stable")
    size, place, root, block = size[order], place[order], root[order], block[order]
    maps = [np.frombuffer(m, np.uint64) for m in rows.column("bits").take(pa.array(order)).to_pylist()]
    wide = np.fromiter(map(len, maps), np.int64, len(maps))
    between = block.min() != block.max()
    found_a, found_b = [], []
    for w in np.unique(wide).tolist():
        # sets that may be alike are so near in size that the wider bitmap folds once
        at = np.flatnonzero((wide == w) | (wide == 2 * w))
        here = np.stack([maps[i] if wide[i] == w else maps[i][:w] | maps[i][w:] for i in at.tolist()])
        for k in range(int((wide == w).sum())):
            i = at[k]
            end = int(np.searchsorted(size[at], size[i] / least + 1e-6, side="right"))
            j = at[k + 1 : end]
            may = (root[j] != root[i]) & _reachable(size[j], place[j], size[i], place[i], least)
            if between:
                may &= block[j] != block[i]
            near = np.flatnonzero(may)
            if not len(near):
                continue
            j, other = j[near], here[k + 1 : end][near]
            common = np.minimum(size[i] - np.bitwise_count(here[k] & ~other).sum(1, dtype=np.int64), size[j] - np.bitwise_count(other & ~here[k]).sum(1, dtype=np.int64))
            j = j[common * (1 + least) >= least * (size[i] + size[j]) - 1e-9]
            found_a.append(np.full(len(j), i))
            found_b.append(j)
    none = [np.zeros(0, np.int64)]
    return order[np.concatenate(found_a or none)], order[np.concatenate(found_b or none)]


def _alike_short(rows: pa.Table, of: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_alike`, for many short lists at once; ``of`` is each row's list, equal ones adjoining."""
    size, place, root, block, lower, upper = (rows.column(c).to_numpy().astype(np.int64) for c in ("size", "place", "root", "block", "lower", "upper"))
    found = [np.zeros(0, np.int64)]
    for d in range(1, SHORT):
        i = np.flatnonzero(of[d:] == of[:-d])
        if not len(i):
            break
        j = i + d
        may = (root[i] != root[j]) & _reachable(size[i], place[i], size[j], place[j], least)
        may &= (lower[i] == upper[i]) | (block[i] != block[j])
        found.append(i[may] * SHORT + d)
    i, d = np.divmod(np.concatenate(found), SHORT)
    j = i + d
    used, both = np.unique(np.concatenate([i, j]), return_inverse=True)
    maps = [np.frombuffer(m, np.uint64) for m in rows.column("bits").take(pa.array(used)).to_pylist()]
    kept = np.zeros(len(i), bool)
    for k, (x, y) in enumerate(zip(both[: len(i)].tolist(), both[len(i) :].tolist())):
        x, y = maps[x], maps[y]
        if len(x) > len(y):
            x = x[: len(y)] | x[len(y) :]
        elif len(y) > len(x):
            y = y[: len(x)] | y[len(x) :]
        same = x & y
        n = int(np.bitwise_count(same).sum())
        common = min(size[i[k]] - int(np.bitwise_count(x).sum()), size[j[k]] - int(np.bitwise_count(y).sum())) + n
        kept[k] = common * (1 + least) >= least * (size[i[k]] + size[j[k]]) - 1e-9
    return i[kept], j[kept]


def _spanning(a: list[tuple], b: list[tuple]) -> list[int]:
    """Places of links that connect what all of them connect."""
    root: dict[tuple, tuple] = {}

    def find(x: tuple) -> tuple:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            keep.append(i)
    return keep


def _compared(least: float, spanning: bool):
    """Streams rows sorted by token and pair of blocks; gives pairs of nodes of other roots that may be alike."""

    def given(rows: pa.Table, of: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        node, root = rows.column("node").to_numpy(), rows.column("root").to_numpy()
        if spanning:
            keep = _spanning(list(zip(of[a].tolist(), root[a].tolist())), list(zip(of[b].tolist(), root[b].tolist())))
            a, b = a[keep], b[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], ["a", "b"])

    def pairs(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = np.diff(np.r_[starts, rows.num_rows])
        for s, m in zip(starts[n > SHORT].tolist(), n[n > SHORT].tolist()):
            whole = rows.slice(s, m)
            yield given(whole, np.zeros(m, np.int64), *_alike(whole, least))
        of, short = np.repeat(np.arange(len(n)), n), np.repeat(n <= SHORT, n)
        rows, of = rows.filter(pa.array(short)).combine_chunks(), of[short]
        if len(of):
            yield given(rows, of, *_alike_short(rows, of, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
            if not table.num_rows:
                continue
            of = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("token", "lower", "upper")])
            starts = np.flatnonzero(np.r_[True, (of[:, 1:] != of[:, :-1]).any(0)])
            if len(starts) > 1:
                yield from pairs(table.slice(0, starts[-1]), starts[:-1])
            held = table.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from pairs(held, np.zeros(1, np.int64))

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = shingles_of(batch.column("text"), width)
            flat, sizes = _lists(parts)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([_longs([_node(s) for s in parts]), pa.ListArray.from_arrays(ends, pa.array(flat))], ["node", "own"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` whose sets have a Jaccard of at least ``least``."""
    n = partitions(pairs.sparkSession)
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
    both = left.repartition(n, "b").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return store(both.where(common >= least * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"), "verified")


def _texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of one document for each node wanted."""
    one = nodes.join(wanted, "node", "left_semi").select("one.*")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", simhash.text_hash().alias("text_hash"))
    same = (F.col("t.text_hash") == F.col("o.text_hash")) & F.col("t.doc_id").eqNullSafe(F.col("o.doc_id"))
    return texts.alias("t").join(one.alias("o"), same, "left_semi").dropDuplicates(["text_hash"]).select("text")


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs that are alike, by the whole sets of their nodes, read from one text each."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = store(_texts_of(docs, nodes, wanted).mapInArrow(_sets(width), "node long, own array<long>"), "sets")
    links = _verified(pairs, sets, least)
    release(sets)
    return links


def _labels(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes."""
    roots = components(links)
    return store(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")


def _joined(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes, where further links join the groups: only their roots are looked at."""
    of = lambda end, name: roots.select(F.col("node").alias(end), F.col("root").alias(name))
    between = links.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y").select(*_pair("x", "y"))
    tops = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return store(roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")


def _proposed(prints: DataFrame) -> DataFrame:
    """Pairs of nodes that SimHash links, or whose fingerprints are equal."""
    of = store(prints.select("print", F.col("fp").alias("node")).distinct(), "of")
    first = store(of.groupBy("print").agg(F.min("node").alias("first")), "first")
    # a pair may meet in many of the index's lists
    linked = simhash.links(first.select(F.col("print").alias("fp"))).distinct()
    ends = linked.join(first.select(F.col("print").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("print").alias("b"), F.col("first").alias("y")), "b")
    return ends.select("x", "y").union(of.join(first, "print").select(F.col("first").alias("x"), F.col("node").alias("y")))


def _pair(x: str, y: str) -> list[F.Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _across(docs: DataFrame, nodes: DataFrame, shared: DataFrame, roots: DataFrame, width: int, least: float, spanning: bool) -> DataFrame:
    """Pairs of nodes of other roots that meet in a list and may be alike; ``spanning``: as many as connect the roots."""
    n = partitions(docs.sparkSession)
    rooted = shared.select("token", "node", "size", "place").join(roots, "node")
    mixed = rooted.groupBy("token").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.count("*").alias("n")).where("one < other")
    rooted = store(rooted.join(mixed.select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "token"), "rooted")
    maps = store(_texts_of(docs, nodes, rooted.select("node").distinct()).mapInArrow(_bitmaps(width), "node long, bits binary"), "bitmaps")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rooted.withColumn("block", block).withColumn("beside", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("token", F.least("block", "beside").alias("lower"), F.greatest("block", "beside").alias("upper"), "node", "size", "place", "root", "block")
    order = ["token", "lower", "upper"]
    rows = dealt.join(maps, "node").repartition(n, *order).sortWithinPartitions(*order)
    pairs = store(rows.mapInArrow(_compared(least, spanning), "a long, b long").distinct(), "across")
    release(rooted, maps)
    return pairs


def members(docs: DataFrame, prints: DataFrame, width: int, least: float) -> DataFrame:
    """``(fp, root)`` of all stored sets: those linked by a Jaccard of at least ``least`` share a root."""
    spark, texts = docs.sparkSession, docs.select("text")
    counts = np.zeros(CELLS, np.int64)
    counted = texts.mapInArrow(_cells(width), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    found = texts.mapInArrow(_postings(width, least, counts), "token long, node long, size int, place int")
    lists = found.repartition(partitions(spark), "token").sortWithinPartitions("token", "node")
    shared = store(lists.mapInArrow(_met(least), _MET), "shared")
    nodes = store(prints.groupBy(F.col("fp").alias("node")).agg(F.min(F.struct("text_hash", "doc_id")).alias("one")), "nodes")
    # the first of each list with all others, and what SimHash links
    stars = shared.where("low is not null").select(*_pair("low", "node"))
    pairs = store(_proposed(prints).select(*_pair("x", "y")).union(stars).where("a < b").distinct(), "pairs")
    links = _linked(docs, nodes, pairs, width, least)
    roots = _labels(links, nodes)
    # pairs across groups that meet in a list: first as many as can connect the groups, then all that are left
    for spanning in (True, False):
        met = _across(docs, nodes, shared, roots, width, least, spanning)
        rest = store(met.join(pairs, ["a", "b"], "left_anti"), "rest")
        more, past = _linked(docs, nodes, rest, width, least), (links, pairs, roots, met, rest)
        links, pairs, roots = more, store(pairs.union(rest), "pairs"), _joined(more, roots)
        release(*past)
    release(shared, pairs, nodes)
    return roots.withColumnRenamed("node", "fp")


def representatives(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """One row of each group of near copies, with all its columns: the smallest doc_id, ids before none.

    Words are lower-cased. Texts without words are one group. Rows without an id are told apart by their texts.
    Other columns may have any names and stay as they are.
    """
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", simhash.text_hash().alias("text_hash"))
    prints = store(hashed.mapInArrow(_prints(width), "doc_id long, text_hash long, fp long, print long"), "prints")
    first = simhash.first_of_each(packed(docs, "doc_id", "text"), prints, members(docs, prints, width, least))
    return unpacked(first, docs.columns)
