"""SimHash near-duplicates: fingerprints, and links found by an inverted index of byte positions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.common import partitions, slices, store, words
from punctual.llm.components import components

SEED = 42
BYTES = 8
#: Rows of a posting list that a task compares at once; longer lists are compared as pairs of such blocks.
BLOCK = 4096


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bitwise majority of each run of ``counts`` hashes; a run without hashes gives zero."""
    out = np.zeros(len(counts), np.uint64)
    ends = np.cumsum(counts)
    for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist())):
        if n:
            raw = hashes[end - n : end].view(np.uint8).reshape(-1, 8)
            set_in = np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[i] = np.packbits(2 * set_in > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints_of(texts: pa.Array, width: int) -> np.ndarray:
    """64-bit fingerprints (unsigned) of texts: ``width``-word shingles of the lower-cased (A-Z) words."""
    offsets, codes, vocabulary = words(pc.ascii_lower(pc.fill_null(texts, "")))
    names = [w.encode() for w in vocabulary.to_pylist()]
    sizes = np.fromiter(map(len, names), np.int64, len(names))
    hash64, found, counts = xxhash.xxh64_intdigest, [], np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        own = codes[offsets[i] : offsets[i + 1]]
        if not len(own):
            continue
        line = b" ".join([names[c] for c in own.tolist()])
        if len(own) < width:
            found.append(np.array([hash64(line, SEED)], np.uint64))
        else:
            ends = np.cumsum(sizes[own] + 1) - 1
            starts = (ends - sizes[own])[: len(own) - width + 1]
            spans = zip(starts.tolist(), ends[width - 1 :].tolist())
            found.append(np.fromiter((hash64(line[a:b], SEED) for a, b in spans), np.uint64, len(starts)))
        counts[i] = len(found[-1])
    return _majority(np.concatenate(found) if found else np.zeros(0, np.uint64), counts)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp long)``; null and blank texts have fingerprint 0, other columns are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = fingerprints_of(batch.column("text"), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _position_sets(shared: int) -> list[tuple[int, ...]]:
    return list(combinations(range(BYTES), shared))


def postings(prints: DataFrame, distance: int) -> DataFrame:
    """The inverted index: a posting for each set of byte positions of the guaranteed size, keyed by their bytes.

    Fingerprints that differ in at most ``distance`` bits agree in at least ``8 - distance`` byte positions, so
    they meet in a list of that many positional bytes.
    """
    masks = [sum(255 << (8 * p) for p in chosen) for chosen in _position_sets(BYTES - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)]))
    return prints.select(keys.alias("key"), "fp")


def _linked(left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    """Tallies equal bytes of each pair, keeps pairs that reach the guaranteed minimum, verifies the distance."""
    both = left ^ right
    equal = (both.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
    kept = equal >= BYTES - distance
    kept[kept] = np.bitwise_count(both[kept]) <= distance
    return kept


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect what the given ones connect: a group of m gives fewer than m."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(a) < len(nodes):
        return a, b
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(ends[: len(a)].tolist(), ends[len(a) :].tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
    return a[keep], b[keep]


def _pairs(fps: np.ndarray, blocks: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within a list (or between its two blocks), row against rows, as a forest."""
    found_a, found_b = [], []
    first = np.flatnonzero(blocks == blocks.min()) if blocks is not None and blocks.min() != blocks.max() else None
    for i in first if first is not None else range(len(fps) - 1):
        others = fps[blocks != blocks[i]] if first is not None else fps[i + 1 :]
        near = others[_linked(np.full(len(others), fps[i]), others, distance)]
        found_a.append(np.full(len(near), fps[i]))
        found_b.append(near)
    none = np.zeros(0, np.uint64)
    return _forest(np.concatenate(found_a or [none]), np.concatenate(found_b or [none]))


_LINKS = "kind int, x long, y long, block int"


def _link_batch(kind: int, x: np.ndarray, y: np.ndarray, block: int) -> pa.RecordBatch:
    n = len(x)
    columns = [np.full(n, kind, np.int32), x.astype(np.uint64).view(np.int64), y.astype(np.uint64).view(np.int64), np.full(n, block, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "x", "y", "block"])


def _search(distance: int):
    """Streams postings sorted by key. Short lists give links (kind 0); lists over BLOCK rows are passed on,
    numbered by block (kind 1), without being held."""

    def short(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        two = starts[sizes == 2]
        a, b = fps[two], fps[two + 1]
        kept = _linked(a, b, distance)
        found = [(a[kept], b[kept])]
        found += [_pairs(fps[s : s + n], None, distance) for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist())]
        yield _link_batch(0, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, passed = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0
        for batch in batches:
            keys = np.concatenate([held_k, batch.column("key").to_numpy()])
            fps = np.concatenate([held_f, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            if passed and keys[0] != keys[-1]:  # the end of a long list
                end = int(np.searchsorted(keys, keys[0], side="right"))
                yield _link_batch(1, keys[:end].view(np.uint64), fps[:end], passed)
                keys, fps, passed = keys[end:], fps[end:], 0
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                starts = np.flatnonzero(np.r_[True, keys[1:last] != keys[: last - 1]])
                sizes = np.diff(np.r_[starts, last])
                for s, n in zip(starts[sizes > BLOCK].tolist(), sizes[sizes > BLOCK].tolist()):
                    for i in range(0, n, BLOCK):
                        part = slice(s + i, s + min(i + BLOCK, n))
                        yield _link_batch(1, keys[part].view(np.uint64), fps[part], i // BLOCK)
                usual = np.repeat(sizes <= BLOCK, sizes)
                if usual.any():
                    yield from short(keys[:last][usual], fps[:last][usual])
            held_k, held_f = keys[last:], fps[last:]
            while len(held_k) > BLOCK:
                yield _link_batch(1, held_k[:BLOCK].view(np.uint64), held_f[:BLOCK], passed)
                held_k, held_f, passed = held_k[BLOCK:], held_f[BLOCK:], passed + 1
        if passed:
            yield _link_batch(1, held_k.view(np.uint64), held_f, passed)
        elif len(held_k):
            yield from short(held_k, held_f)

    return run


def _between_blocks(distance: int):
    """Streams rows sorted by (key, low, high): the two blocks of a pair are compared, all others were before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held else table
            if not table.num_rows:
                continue
            of = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "low", "high")])
            starts = np.flatnonzero(np.r_[True, (of[:, 1:] != of[:, :-1]).any(0)]).tolist()
            yield from compare(table, starts[:-1], starts[1:])
            held = table.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from compare(held, [0], [held.num_rows])

    def compare(table: pa.Table, starts: list[int], ends: list[int]) -> Iterator[pa.RecordBatch]:
        fps, blocks = table.column("fp").to_numpy().view(np.uint64), table.column("block").to_numpy()
        for a, b in zip(starts, ends):
            x, y = _pairs(fps[a:b], blocks[a:b], distance)
            yield _link_batch(0, x, y, 0)

    return run


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """``prints(fp long)``, distinct -> ``(a, b)``: links of at most ``distance`` differing bits, as forests.

    Every posting list is compared whole: lists of up to BLOCK rows in the task that reads them, longer ones as
    pairs of blocks dealt over all tasks. Of the links inside one list only a spanning forest is given.
    """
    if not 0 <= distance < BYTES:
        raise ValueError("the index needs a distance of 0 to 7")
    n = partitions(prints.sparkSession)
    sorted_lists = postings(prints, distance).repartition(n, "key").sortWithinPartitions("key")
    found = store(sorted_lists.mapInArrow(_search(distance), _LINKS), "links")
    near = found.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"))
    rest = found.where("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("fp"), "block")
    if not rest.isEmpty():
        number = rest.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
        paired = rest.join(number, "key").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        paired = paired.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp", "block")
        order = ("key", "low", "high")
        more = paired.repartition(n, *order).sortWithinPartitions(*order).mapInArrow(_between_blocks(distance), _LINKS)
        near = near.union(more.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return near


def _members(prints: DataFrame, distance: int) -> DataFrame:
    """``(fp, root)`` of all stored fingerprints."""
    nodes = store(prints.select("fp").distinct(), "nodes")
    roots = components(links(nodes, distance))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return store(placed.select("fp", F.coalesce("root", "fp").alias("root")), "members")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fingerprint, component_id)``, a row for each input row.

    Equal fingerprints are one node, so exact copies cost one row. Null and blank texts share fingerprint zero
    and link like any other. ``component_id`` is the smallest doc_id that is not null (null if there is none);
    repeated rows and ids stay. Other columns are ignored.
    """
    prints = store(fingerprints(docs, width), "prints")
    members = _members(prints, distance)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    least = members.join(first, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    member = store(members.join(least, "root").select("fp", "component_id"), "member")
    return prints.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def representatives(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the smallest doc_id, ids before none.

    Rows without an id are told apart by their texts; of rows equal in both one stays.
    """
    hashed = docs.select("doc_id", "text", text_hash().alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = pa.array(fingerprints_of(batch.column("text"), width).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), prints], ["doc_id", "text_hash", "fp"])

    prints = store(hashed.select(F.col("doc_id").cast("long"), "text", "text_hash").mapInArrow(run, "doc_id long, text_hash long, fp long"), "prints")
    return first_of_each(docs, prints, _members(prints, distance))


def first_of_each(docs: DataFrame, prints: DataFrame, members: DataFrame) -> DataFrame:
    """The first row of each group, from ``prints(doc_id, text_hash, fp)`` and ``members(fp, root)``."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = prints.groupBy("fp").agg(F.min(order).alias("first"))
    chosen = members.join(first, "fp").groupBy("root").agg(F.min("first").alias("first"))
    chosen = store(chosen.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")), "chosen")
    keyed = docs.withColumns({"_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_none": F.col("doc_id").isNull(), "_hash": text_hash()})
    kept = chosen.select(F.coalesce("_id", F.lit(0).cast("long")).alias("_key"), F.col("_id").isNull().alias("_none"), "_hash")
    one = Window.partitionBy("_key", "_none", "_hash").orderBy(F.lit(0))
    rows = keyed.join(kept, ["_key", "_none", "_hash"], "left_semi").withColumn("_n", F.row_number().over(one))
    return rows.where("_n = 1").select(*docs.columns)
