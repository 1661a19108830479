"""Trie of the prefixes of turn sequences, built by van Emde Boas recursion.

Sequences are cut at half their depth, the halves again, down to single turns. From the leaves of this recursion up,
dyadic blocks of turns get names for what they hold; from its root down, each cut prefix is named by the name of the
prefix above it and the block between: all halves of one size at once, so a sequence needs as many steps as the
logarithm of its depth. A node is its prefix's name; its members are counted by name.

Totals go up the same way. The lower forests of height L hang below cut prefixes; what they hold in all is grafted onto
the L nodes of the upper trie that lead to the cut prefix, for L = 1, 2, 4, ... A node knows those ancestors: as
many as the largest power of two that divides its depth, so a round adds a row for each node on such a path.

Segments of 256 turns are named inside tasks; the segments of longer sequences are a trie of their own, whose
nodes are the segments' ends, treated in the same way and then grafted onto the nodes inside segments.

No sequence, node or list of members has to fit one task: turns are numbered in chunks, a segment is one row, a node's
members are combined before they are shuffled, the children of one node look its row up in 64 parts, and digests
over members run over them in order, a row for each 4096 ids. Names are 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from punctual.llm.common import partitions, store

#: Turns named inside one task; a power of two.
SEGMENT = 256
#: Values of ``turn`` in one chunk of the numbering.
CHUNK = 1024
#: Ids in one row of a digest, and parts of the children of one node.
IDS, PARTS = 4096, 64
ROOT = bytes(16)
WORD = r"[^\x20\x09-\x0D]+"


def _name(above: bytes, block: bytes) -> bytes:
    return hashlib.blake2b(above + block, digest_size=16).digest()


def _blocks(items: list[bytes]) -> list[list[bytes]]:
    """Names of the whole dyadic blocks of ``items``: single ones, pairs, fours, ..."""
    levels = [items]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_name(last[i], last[i + 1]) for i in range(0, len(last) - 1, 2)])
    return levels


def prefix_names(root: bytes, items: list[bytes]) -> list[bytes]:
    """Names of the prefixes of no item, one item, ... all items below the prefix named ``root``."""
    levels = _blocks(items)
    names: list[bytes] = [root] + [b""] * len(items)

    def cut(start: int, level: int) -> None:
        if level < 0 or start >= len(items):
            return
        half = start + (1 << level)
        if half <= len(items):
            names[half] = _name(names[start], levels[level][start >> level])
        cut(start, level - 1)
        cut(half, level - 1)

    cut(0, len(levels) - 1)
    return names


def _low(n: int) -> int:
    return n & -n


LIST = "array<binary>"
SPANS = f"conv_id long, segment long, root binary, bottom binary, coarse {LIST}"
PLACES = f"conv_id long, name binary, parent binary, depth long, weight long, up {LIST}, coarse {LIST}, inside {LIST}, ends boolean"


def _contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [_blocks([t["key"] for t in turns])[-1][0] for turns in batch.column("turns").to_pylist()]
        columns = [batch.column("conv_id"), batch.column("segment"), pa.array(made, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "segment", "content"])


def _spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names at the ends of a sequence's whole segments, from the contents of these."""
    for batch in batches:
        out: list[tuple] = []
        for conv_id, contents in zip(batch.column("conv_id").to_pylist(), batch.column("contents").to_pylist(), strict=True):
            names = prefix_names(ROOT, [c["content"] for c in contents])
            for k, root in enumerate(names):
                last = k + 1 == len(names)
                coarse = [] if last else names[k + 1 - _low(k + 1) : k + 2]
                out.append((conv_id, k, root, None if last else names[k + 1], coarse))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
        columns = zip(*out, strict=True) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "segment", "root", "bottom", "coarse"])


def _places(batches: Iterable[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """A row for each turn of a segment: its node, the node above, and the ancestors that totals are grafted onto."""
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), *[pa.list_(pa.binary())] * 3, pa.bool_()]
    fields = [c.split()[0] for c in PLACES.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], fields)

    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            turns, at = row["turns"], row["segment"] * segment
            names = prefix_names(row["root"] or ROOT, [t["key"] for t in turns])
            if len(turns) == segment:
                names[segment] = row["bottom"]
            for i, t in enumerate(turns, 1):
                whole = i == segment
                up = [] if whole else names[i - _low(i) : i + 1]
                inside, coarse = (names, row["coarse"]) if whole else ([], [])
                out.append((row["conv_id"], names[i], names[i - 1], at + i, t["weight"], up, coarse, inside, at + i == row["n_turns"]))
            if len(out) >= 8192:
                yield made(out)
                out = []
        yield made(out)


def _graft(deltas: list[DataFrame], nodes: DataFrame, height: int) -> list[DataFrame]:
    """``deltas(name, parent, depth, leaves, saved)``, to be summed by name; ``nodes(name, depth, up)`` with ``up`` the
    ancestors' names from the parent of the first one on, the node itself last.

    Adds, to every node, what hangs below it within blocks of ``height``; afterwards ``deltas`` sum to subtrees."""
    length = 1
    while length < height:
        tops = deltas[0]
        for d in deltas[1:]:
            tops = tops.unionByName(d)
        below = (
            tops.where((F.col("depth") - 1) % (2 * length) == length)
            .groupBy(F.col("parent").alias("name"))
            .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        )
        cut = nodes.where(F.col("depth") % (2 * length) == length).join(below, "name")
        deltas = [*deltas, store(_onto_path(cut, "up", length), "grafted")]
        length *= 2
    return deltas


def _onto_path(cut: DataFrame, path: str, length: int) -> DataFrame:
    """The totals at each node of ``cut`` added to the last ``length`` nodes of its path."""
    steps = F.transform(
        F.sequence(F.lit(1), F.lit(length)),
        lambda j: F.struct(
            F.get(path, j).alias("name"), F.get(path, j - 1).alias("parent"), (F.col("depth") - length + j).alias("depth")
        ),
    )
    return (
        cut.select(F.explode(steps).alias("s"), "leaves", "saved")
        .groupBy("s.name", "s.parent", "s.depth")
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    )


def _summed(deltas: list[DataFrame]) -> DataFrame:
    out = deltas[0]
    for d in deltas[1:]:
        out = out.unionByName(d)
    return out.groupBy("name", "parent", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _height(nodes: DataFrame) -> int:
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    return 1 << max(deepest - 1, 0).bit_length()


def subtree_totals(nodes: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``nodes(name, parent, depth, leaves, saved, up, coarse, inside)`` -> ``(name, parent, depth, leaves, saved)`` summed
    over each node's subtree."""
    own = nodes.select("name", "parent", "depth", "leaves", "saved")
    height = _height(nodes)
    deltas = _graft([own], nodes.select("name", "depth", "up"), min(height, segment))
    if height <= segment:
        return _summed(deltas)
    # what hangs directly below the ends of segments, then summed over the trie of these ends
    tops = _summed(deltas).where((F.col("depth") > 1) & (F.col("depth") % segment == 1))
    below = tops.groupBy(F.col("parent").alias("name")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    bottoms = nodes.where(F.size("inside") > 0).select(
        "name", F.element_at("inside", 1).alias("parent"), (F.col("depth") / segment).cast("long").alias("depth"), "coarse", "inside"
    )
    hanging = store(bottoms.select("name", "parent", "depth").join(below, "name"), "hanging")
    coarse = _graft([hanging], bottoms.select("name", "depth", F.col("coarse").alias("up")), _height(bottoms))
    ends = bottoms.select("name", (F.col("depth") * segment).alias("depth"), "inside").join(
        _summed(coarse).select("name", "leaves", "saved"), "name"
    )
    return _summed([*deltas, store(_onto_path(ends, "inside", segment), "grafted")])


def _digest_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha, done = None, None, []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["name", "ends_sha256"])

    for batch in batches:
        for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name != now:
                if sha is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = name, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if len(done) > 10_000:
            yield out(done)
            done = []
    if sha is not None:
        done.append((now, sha.hexdigest()))
    yield out(done)


def _ends(ended: DataFrame) -> DataFrame:
    """``ended(name, conv_id)`` -> digest of each name's ids in order, which the last shuffle sees 4096 to a row."""
    rows = ended.groupBy("name", F.floor(F.col("conv_id") / IDS).alias("at")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    return (
        rows.repartition(partitions(ended.sparkSession), "name")
        .sortWithinPartitions("name", "at")
        .select("name", "ids")
        .mapInArrow(_digest_batches, "name binary, ends_sha256 string")
    )


def prefix_trie(sequences: DataFrame, lengths: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``sequences(conv_id, place, key, weight)``, places gapless from 0, ``key`` 16 bytes that tell turns apart, and
    ``lengths(conv_id, n_turns)`` with every sequence once, also those of no turn.

    A row for each distinct prefix, the empty one included: its smallest member, depth, its parent's smallest member,
    members, children, leaves of its subtree, over its subtree the sum of (members - 1) x the weight of the
    node's last turn, and a digest of the members that end at it. No sequences give no rows."""
    lengths = store(lengths.select(F.col("conv_id").cast("long"), F.col("n_turns").cast("long")), "lengths")
    turn = F.struct("place", "key", "weight")
    segments = store(
        sequences.groupBy("conv_id", F.floor(F.col("place") / segment).alias("segment"))
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .join(lengths, "conv_id"),
        "segments",
    )
    whole = segments.where(F.size("turns") == segment).select("conv_id", "segment", "turns")
    contents = whole.mapInArrow(_contents, "conv_id long, segment long, content binary")
    spans = (
        contents.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("segment", "content"))).alias("contents"))
        .mapInArrow(_spans, SPANS)
    )
    places = store(segments.join(spans, ["conv_id", "segment"], "left").mapInArrow(partial(_places, segment=segment), PLACES), "places")

    def same(c: str) -> Column:
        return F.any_value(c).alias(c)  # a name has one prefix, whoever holds it

    nodes = store(
        places.groupBy("name").agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            *map(same, ("parent", "depth", "weight", "up", "coarse", "inside")),
        ),
        "nodes",
    )
    part = F.pmod(F.xxhash64("name"), F.lit(PARTS))
    kids = store(nodes.groupBy("parent", part.alias("part")).agg(F.count(F.lit(1)).alias("kids")), "kids")
    children = kids.groupBy(F.col("parent").alias("name")).agg(F.sum("kids").alias("n_children"))
    counted = store(
        nodes.join(children, "name", "left").select(
            *nodes.columns,
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("weight")).alias("saved"),
        ),
        "counted",
    )
    totals = store(subtree_totals(counted, segment), "totals")
    root = F.lit(ROOT)
    nothing = F.lit(None).cast("long")
    at_root = (  # members and what hangs below, in one aggregation
        lengths.select("conv_id", nothing.alias("child"), nothing.alias("leaves"), nothing.alias("saved"))
        .unionByName(totals.where("depth = 1").select(nothing.alias("conv_id"), F.lit(1).cast("long").alias("child"), "leaves", "saved"))
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.count("conv_id").alias("n_convs"),
            F.count("child").alias("n_children"),
            F.coalesce(F.sum("leaves"), F.lit(1)).alias("leaves"),
            F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"),
        )
        .where("n_convs > 0")
        .select(root.alias("name"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", "n_children", "leaves", "saved",
                nothing.alias("parent_conv_id"))
    )
    ended = places.where("ends").select("name", "conv_id").unionByName(lengths.where("n_turns = 0").select(root.alias("name"), "conv_id"))
    named = nodes.select("name", "conv_id").unionByName(at_root.select("name", "conv_id"))
    above = kids.select(F.col("parent").alias("name"), "part").join(named, "name")
    above = above.select(F.col("name").alias("parent"), "part", F.col("conv_id").alias("parent_conv_id"))
    below_root = (
        counted.select("name", "conv_id", "depth", "n_convs", "n_children", "parent", part.alias("part"))
        .join(totals.select("name", "leaves", "saved"), "name")
        .join(above, ["parent", "part"])
    )
    none = hashlib.sha256().hexdigest()
    return (
        below_root.select(*at_root.columns)
        .unionByName(at_root)
        .join(_ends(ended), "name", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(conv_id, turn, role, text)`` -> turns ``(conv_id, chunk, place, key, weight)`` and chunks ``(conv_id, chunk,
    before, size)``.

    Rows go by turn, null first, equal turns by their content's hash; null roles and texts are empty; rows without a
    ``conv_id`` belong to no conversation; other columns are ignored. A task numbers one chunk of a conversation, that
    is the rows whose turn lies in a range of 1024."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = store(
        rows.where("conv_id is not null").select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.unhex(F.substring(F.sha2(content, 256), 1, 32)).alias("key"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("weight"),
            F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))).alias("chunk"),
        ),
        "turns",
    )
    so_far = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("size"))
    chunks = store(sizes.withColumn("before", F.coalesce(F.sum("size").over(so_far), F.lit(0))), "chunks")
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "key")
    placed = (
        turns.withColumn("rank", F.row_number().over(inside))
        .join(chunks.select("conv_id", "chunk", "before"), ["conv_id", "chunk"])
        .select("conv_id", "chunk", (F.col("before") + F.col("rank") - 1).alias("place"), "key", "weight")
    )
    return placed, chunks


def rebuilt(rows: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: the first h turns of conversation ``c - c % group``, then c's own after its
    first h, h being c's hash modulo ``most + 1``. Gives the arguments of ``prefix_trie``."""
    placed, chunks = numbered(rows)
    placed = store(placed, "placed")
    sizes = chunks.groupBy("conv_id").agg(F.sum("size").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h")
    convs = sizes.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = sizes.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = store(
        convs.join(bases, "base", "left").select("conv_id", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lent")), "convs"
    )
    shifts = chunks.select("conv_id", "chunk").join(convs.select("conv_id", "h", "lent"), "conv_id")
    own = (
        placed.join(shifts, ["conv_id", "chunk"])
        .where("place >= h")
        .select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "key", "weight")
    )
    heads = placed.where((F.col("conv_id") % group == 0) & (F.col("place") < most))
    lent = (
        heads.withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "lent"), "base").where("place < lent").select(*own.columns)
    )
    lengths = convs.select("conv_id", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return own.unionByName(lent), lengths
