"""Best-fit packing of documents into token sequences, after a dominance reduction.

Lengths are whole numbers up to the capacity, so an instance is its histogram: one count for each length,
however many documents there are. The reduction and the best-fit pass run on that histogram and place whole
runs of equal pieces at once; tasks then find each piece's place by its rank among pieces of its length.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.common import slices, store, words

CAPACITY = 4096
#: Words, and parts of words, whose ids a Python worker remembers before it starts afresh.
REMEMBERED, PARTS_REMEMBERED = 1_000_000, 300_000
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"
_BREAK = "<|endoftext|>"


class WordIds:
    """Token ids of words, each computed once as long as it is remembered.

    The vocabulary lower-cases, drops white space and splits letters from punctuation, so a word's ids are
    those of its stem and of the ASCII punctuation behind a letter.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.gap = self.encoder.token_to_id(_BREAK)
        self.known: dict[str, bytes] = {"": b""}
        self._forget()

    def _forget(self) -> None:
        self.names = pa.array([], pa.string())
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, stems: list[str]) -> None:
        for i in range(0, len(stems), 4000):
            part = stems[i : i + 4000]
            ids = self.whole(_BREAK.join(part))
            ends = np.r_[np.flatnonzero(ids == self.gap), len(ids)].tolist()
            if len(ends) != len(part):
                raise ValueError("a word contains the text of a special token")
            at = 0
            for stem, end in zip(part, ends):
                self.known[stem] = ids[at:end].tobytes()
                at = end + 1

    def of(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of remembered words one after another, and where those of each of these distinct words start and how
        many they are. Words met before are looked up all at once."""
        vocabulary = vocabulary.cast(pa.string())
        if len(self.names) > REMEMBERED:
            self._forget()
        place = pc.index_in(vocabulary, value_set=self.names)
        unmet = place.is_null()
        new = vocabulary.filter(unmet)
        place = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            place[unmet.to_numpy(zero_copy_only=False)] = len(self.names) + np.arange(len(new))
            flat, sizes = self._ids(new)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
            self.names = pa.concat_arrays([self.names, new])
        return self.flat, self.starts[place], self.sizes[place]

    def _ids(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct words one after another, and how many each has."""
        if len(self.known) > PARTS_REMEMBERED:
            self.known = {"": b""}
        names = vocabulary.to_pylist()
        stems = pc.ascii_rtrim(vocabulary, characters=_PUNCTUATION).to_pylist()
        parts = [(s, w[len(s) :]) if not s or s[-1].isalpha() or s[-1].isdigit() else (w, "") for s, w in zip(stems, names)]
        missing = {x for p in parts for x in p if x not in self.known}
        self._learn(list(missing))
        known = self.known
        found = [known[a] + known[b] for a, b in parts]
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4


def gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ids of a row of words, in order."""
    starts, n = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
    before = np.cumsum(n) - n
    return flat[np.repeat(starts - before, n) + np.arange(int(n.sum()))]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordIds:
    return WordIds(path)


def token_ids(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Ids (unsigned 32 bit) of each text; a null text has none."""
    ids = _encoder(path)
    texts = pc.fill_null(texts, "")
    special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
    plain = pc.if_else(pa.array(special), "", texts)
    offsets, codes, vocabulary = words(pc.ascii_lower(plain))
    flat, starts, sizes = ids.of(vocabulary)
    n = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    every = flat[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])]
    bounds = ends[offsets].tolist()
    for i in range(len(texts)):
        if special[i]:  # may hold a special token's text, whose letters must keep their case
            yield ids.whole(texts[i].as_py())
        else:
            yield every[bounds[i] : bounds[i + 1]]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """``docs(doc_id, text)`` -> a row for each piece of at most ``capacity`` tokens, stored.

    A document is its ids and then ``end_id`` (a null or blank text: ``end_id`` alone). ``part`` and ``nth``
    number the pieces of a length within the task that made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), token_ids(batch.column("text"), path)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    rows.append((doc_id, k, at, len(piece), zlib.crc32(piece.tobytes()), part, int(seen[len(piece)])))
                    seen[len(piece)] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = re.findall(r"(\w+) \w+(?:, |$)", _PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES), "pieces")


class Plan:
    """Places for runs of equal pieces: (size, first rank, pieces, first sequence, pieces a sequence, offset)."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.left = capacity, counts.astype(np.int64).copy()
        self.rank = np.zeros(capacity + 1, np.int64)
        self.sequences, self.fixed, self.runs = 0, 0, []

    def put(self, size: int, n: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append((size, int(self.rank[size]), n, sequence, each, offset))
        self.rank[size] += n
        self.left[size] -= n

    def fix(self, sizes: list[int], n: int) -> None:
        """n sequences that hold just one piece of each of these sizes."""
        offset = 0
        for size in sizes:
            self.put(size, n, self.sequences, 1, offset)
            offset += size
        self.sequences += n
        self.fixed += n

    def _set_for(self, size: int) -> list[int] | None:
        """Pieces that together with one of ``size`` dominate every other set that fits with it; None if unknown."""
        room, others = self.capacity - size, self.left.copy()
        others[size] -= 1
        there = np.flatnonzero(others[: room + 1])
        if not len(there):
            return []  # nothing fits beside it
        largest = int(there[-1])
        smallest = np.repeat(there[:3], np.minimum(others[there[:3]], 3))[:3]
        if largest == room or len(smallest) < 2 or smallest[:2].sum() > room:
            return [largest]  # fills the sequence, or at most one piece fits beside it
        if len(smallest) == 3 and smallest.sum() <= room:
            return None
        # at most two pieces fit: the best single piece against all pairs
        lower = there[there <= room // 2]
        partner = np.searchsorted(there, room - lower, side="right") - 1
        sums, seconds = [0], [0]
        for low, at in zip(lower.tolist(), partner.tolist()):
            high = int(there[at])
            if high == low and others[low] < 2:
                continue
            if high >= low:
                sums.append(low + high)
                seconds.append(low)
        if largest >= max(sums):
            return [largest]
        others[largest] -= 1
        fits = np.flatnonzero(others[: room - largest + 1])
        if len(fits) and int(fits[-1]) >= max(seconds):
            return [largest, int(fits[-1])]
        return None

    def reduce(self) -> None:
        """Fixes dominating sets, largest pieces first, until none is known."""
        changed = True
        while changed:
            changed = False
            for size in range(self.capacity, 0, -1):
                while self.left[size]:
                    beside = self._set_for(size)
                    if beside is None:
                        break
                    alike = [size, *beside]
                    if len(beside) < 2:
                        n = min(int(self.left[s]) // alike.count(s) for s in alike)
                    else:  # a set is told from counts up to 3 besides the piece itself: the same one while 4 are left
                        n = max(1, min((int(self.left[s]) - 4) // alike.count(s) + 1 for s in alike))
                    self.fix(alike, n)
                    changed = True

    def best_fit(self) -> None:
        """Best-fit decreasing for what is left: into the sequence with the least room that is enough."""
        free: list[list[tuple[int, int]]] = [[] for _ in range(self.capacity + 1)]
        has = np.zeros(self.capacity + 1, bool)

        def release(room: int, first: int, n: int) -> None:
            if n and room:
                free[room].append((first, n))
                has[room] = True

        for size in range(self.capacity, 0, -1):
            while n := int(self.left[size]):
                fitting = int(np.argmax(has[size:])) + size
                if has[fitting]:
                    room = fitting
                    first, bins = free[room].pop()
                    has[room] = bool(free[room])
                else:
                    room, first = self.capacity, self.sequences
                    bins = -(-n // (self.capacity // size))
                    self.sequences += bins
                each = room // size
                full = min(bins, n // each)
                if full:
                    self.put(size, full * each, first, each, self.capacity - room)
                    release(room - each * size, first, full)
                rest = min(n - full * each, each) if full < bins else 0
                if rest:
                    self.put(size, rest, first + full, rest, self.capacity - room)
                    release(room - rest * size, first + full, 1)
                release(room, first + full + bool(rest), bins - full - bool(rest))


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Packs a histogram (``counts[length]``, length 1 to capacity)."""
    made = Plan(counts, capacity)
    made.reduce()
    made.best_fit()
    return made


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored ``pieces`` -> the same with ``sequence_id`` and ``offset``; sequences are gapless from offset 0.

    What reaches the driver is one count for each length. Pieces of a length are ranked by the counts of the
    tasks that made them, so no task gathers a length, however common.
    """
    by_task = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = store(by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))), "base")
    counts = np.zeros(capacity + 1, np.int64)
    for row in base.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    runs = np.array(sorted(plan(counts, capacity).runs), np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = runs[:, 0] * (1 << 48) + runs[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = runs[np.searchsorted(firsts, length * (1 << 48) + rank, side="right") - 1]
            nth, each = rank - run[:, 1], run[:, 4]
            added = [pa.array(run[:, 3] + nth // each), pa.array(run[:, 5] + nth % each * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *added], [x.split()[0] for x in _PLACED.split(", ")])

    ranked = made.join(base.select("length", "part", "base"), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, _PLACED)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``docs(doc_id, text)`` -> a row for each piece with its place.

    Null and blank texts take one token. Repeated rows are packed each; other columns are ignored. No rows in
    give no rows out.
    """
    return pack(pieces(docs, path, capacity), capacity)
