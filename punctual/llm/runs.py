"""Periodic runs in texts, caught online with dyadic catchers.

Words are appended to one stream. Each completed block of ``w`` words (``w`` a power of two, blocks aligned) has a
catcher, its hash. An appended word ends one suffix of each length ``w``; that suffix is compared with the catchers of
the blocks that lie a period before it, for the periods ``w`` answers for. A square of period p has a stretch of at
least p words that equal the words p later, which holds a whole block of ``w`` words where 2w-1 <= p; so the catchers of
block length ``w`` see all squares of their periods, about two comparisons for a word and a length. Blocks met one
after another at one period are a chain; a chain that reaches the last word stays open for the next words. Chains
are lengthened to both sides by hashes of halving lengths, and every end at which a whole square stands is
reported. Reported squares of one period at neighbouring ends merge into runs.

Documents follow each other in a stream with words of their own, so no square reaches over a document's end. Hashes
are of 61 bits, taken modulo a prime; what they say of a run is verified word by word, and where they were wrong
the stream is read again with another base.

Defined results: a null text has no words; rows stay apart though their ids repeat or are null; a table without rows
gives no rows; columns other than the id and the text are ignored; a text is read whole, in pieces, in memory of
some 60 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import per_text, slices, words

#: A run has at least so many words, and at least twice its period.
LEAST = 12
#: Words appended at once, and bytes of text in one stream (a longer text is a stream of its own).
PIECE = 1 << 18
STREAM_BYTES = 2 << 20
_P = (1 << 61) - 1
_M, _M31, _M30 = np.uint64(_P), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_31, _30, _61, _1 = np.uint64(31), np.uint64(30), np.uint64(61), np.uint64(1)
#: Bases of the hash; the next is taken where one failed.
BASES = (0x1B3C5D7E9F1A2B3D, 0x0A1F3E5D7C9B8A67, 0x17E2C4A6B8D0F135)


def _low(x: np.ndarray) -> np.ndarray:
    x = (x & _M) + (x >> _61)
    return np.where(x >= _M, x - _M, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61-1 of numbers below it."""
    al, ah, bl, bh = a & _M31, a >> _31, b & _M31, b >> _31
    mid = al * bh + ah * bl
    return _low(((ah * bh) << _1) + (mid >> _30) + ((mid & _M30) << _31) + al * bl)


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _low((x ^ (x >> _31)) >> np.uint64(3))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = _times(out[:more], np.uint64(step))
        done, step = done + more, step * step % _P
    return out


@dataclass
class _Catchers:
    """The catchers of one block length: its periods, the hashes of its completed blocks, its open chains."""

    w: int
    periods: np.ndarray
    blocks: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    #: period, first block, end of the last block, start and end of the equal stretch
    open: np.ndarray = field(default_factory=lambda: np.empty((0, 5), np.int64))


def _catchers(longest: int, least: int) -> list[_Catchers]:
    """A period belongs to the largest block that its stretches are sure to hold; what needs the fewest words first."""
    periods = np.arange(1, max(longest // 2, 1) + 1)
    stretch = np.maximum(periods, least - periods)
    block = 1 << np.floor(np.log2((stretch + 1) / 2)).astype(np.int64)
    levels = [_Catchers(int(w), periods[block == w]) for w in np.unique(block)]
    return sorted(levels, key=lambda c: c.w + c.periods[0])


class SquareStream:
    """Words appended piece by piece; each append reports the squares that end in the appended words."""

    def __init__(self, longest: int, least: int = LEAST, base: int = BASES[0], room: int = 1024):
        """``longest``: words of the longest document to come; ``room``: words to make room for at first."""
        self.base, self.n = base, 0
        self.levels = _catchers(longest, least)
        self.first_docs: list[np.ndarray] = []
        self._make_room(room)

    def _make_room(self, room: int) -> None:
        n = self.n
        for name, kind, more in (("ids", np.int64, 0), ("first", np.int64, 0), ("sums", np.uint64, 1)):
            grown = np.zeros(room + more, kind)
            if n:
                grown[: n + more] = getattr(self, name)[: n + more]
            setattr(self, name, grown)
        self.powers = _powers(self.base, room + 1)
        self.inverse = _powers(pow(self.base, -1, _P), room + 1)

    def _hash(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Hashes of the ``length`` words from ``start``, equal wherever they stand."""
        return _times(_low(self.sums[start + length] + (_M - self.sums[start])), self.inverse[start])

    def append(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Words and the places among them where documents begin -> rows (first end, last end, period) of squares."""
        old, m = self.n, len(ids)
        if m == 0:
            return np.empty((0, 3), np.int64)
        if old + m > len(self.ids):
            self._make_room(max(2 * len(self.ids), old + m))
        self.n = new = old + m
        self.ids[old:new] = ids
        self.first_docs.append(np.unique(begins[begins < m]) + old)
        first = np.zeros(m, np.int64)
        first[begins[begins < m]] = begins[begins < m] + old
        first[0] = first[0] if first[0] or old == 0 else self.first[old - 1]
        self.first[old:new] = np.maximum.accumulate(first)
        terms = _times(_mixed(ids), self.powers[old:new])
        high, low = np.cumsum(terms >> _31), np.cumsum(terms & _M31)
        self.sums[old + 1 : new + 1] = _low(_low(_times(_low(high), np.uint64(1 << 31)) + _low(low)) + self.sums[old])
        starts = np.concatenate(self.first_docs)
        self.first_docs = [starts]
        ends, found = np.arange(old, new), []
        for level in self.levels:
            # a document must hold a block, and a suffix a period behind it
            ends = ends[ends - self.first[ends] + 1 >= level.w + level.periods[0]]
            if len(ends) == 0:
                break
            found.append(self._advance(level, ends, old, starts))
        return np.concatenate(found) if found else np.empty((0, 3), np.int64)

    def _met(self, level: _Catchers, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Periods and starts of the blocks that equal the suffix at one of ``ends``."""
        w, low, high = level.w, level.periods[0], level.periods[-1]
        whole = len(level.blocks)
        upto = self.n // w
        if upto > whole:
            level.blocks = np.concatenate([level.blocks, self._hash(np.arange(whole, upto) * w, w)])
        suffix = ends - w + 1
        hashed, nearest, doc = self._hash(suffix, w), (suffix - low) // w, self.first[ends]
        periods, blocks = [], []
        for back in range(-(-(high - low + 1) // w) + 1):
            b = nearest - back
            p = suffix - b * w
            at = np.flatnonzero((b * w >= doc) & (p <= high))
            at = at[level.blocks[b[at]] == hashed[at]]
            periods.append(p[at])
            blocks.append(b[at] * w)
        p, b = np.concatenate(periods), np.concatenate(blocks)
        if len(level.periods) != high - low + 1:
            mine = np.isin(p, level.periods)
            p, b = p[mine], b[mine]
        return p, b

    def _advance(self, level: _Catchers, ends: np.ndarray, old: int, starts: np.ndarray) -> np.ndarray:
        w = level.w
        p, b = self._met(level, ends)
        new = np.stack([p, b, b + w, np.full_like(b, -1), np.full_like(b, -1)], axis=1)
        chains = np.concatenate([level.open, new])
        if len(chains) == 0:
            return np.empty((0, 3), np.int64)
        chains = chains[np.lexsort((chains[:, 1], chains[:, 0]))]
        head = np.ones(len(chains), bool)
        head[1:] = (chains[1:, 0] != chains[:-1, 0]) | (chains[1:, 1] != chains[:-1, 2])
        at = np.flatnonzero(head)
        p, begin, l, seen = chains[at, 0], chains[at, 1], chains[at, 3].copy(), chains[at, 4].copy()
        reached = chains[np.r_[at[1:], len(chains)] - 1, 2]
        doc = np.searchsorted(starts, begin, side="right") - 1
        doc_start, doc_end = starts[doc], np.r_[starts[1:], self.n][doc]
        fresh = np.flatnonzero(l < 0)
        l[fresh] = begin[fresh]
        h = w // 2
        while h:
            can = fresh[l[fresh] - h >= doc_start[fresh]]
            can = can[self._hash(l[can] - h, h) == self._hash(l[can] - h + p[can], h)]
            l[can] -= h
            h //= 2
        r, h = reached.copy(), w // 2
        while h:
            can = np.flatnonzero(r + p + h <= doc_end)
            can = can[self._hash(r[can], h) == self._hash(r[can] + p[can], h)]
            r[can] += h
            h //= 2
        seen = np.where(seen < 0, l, seen)
        still = (r + p == self.n) & (doc_end == self.n)
        level.open = np.stack([p, begin, reached, l, r], axis=1)[still]
        squares = np.stack([np.maximum(seen + 1, l + p) + p - 1, r + p - 1, p], axis=1)
        return squares[squares[:, 0] <= squares[:, 1]]

    def merge(self, squares: np.ndarray, least: int = LEAST) -> np.ndarray:
        """All reported squares -> rows (start, length, period) of runs, by start and period.

        Stretches whose smallest period is a part of the reported one are left to that period's own run."""
        if len(squares) == 0:
            return np.empty((0, 3), np.int64)
        s = squares[np.lexsort((squares[:, 0], squares[:, 2]))]
        head = np.ones(len(s), bool)
        head[1:] = (s[1:, 2] != s[:-1, 2]) | (s[1:, 0] != s[:-1, 1] + 1)
        at = np.flatnonzero(head)
        period = s[at, 2]
        start = s[at, 0] - 2 * period + 1
        length = s[np.r_[at[1:], len(s)] - 1, 1] + 1 - start
        keep = length >= least
        start, length, period = start[keep], length[keep], period[keep]
        primitive = np.ones(len(start), bool)
        rest = period.copy()
        divisor = _smallest_divisors(int(period.max(initial=1)))
        while (on := np.flatnonzero(rest > 1)).size:
            q = period[on] // divisor[rest[on]]
            rest[on] //= divisor[rest[on]]
            primitive[on] &= self._hash(start[on], length[on] - q) != self._hash(start[on] + q, length[on] - q)
        runs = np.stack([start, length, period], axis=1)[primitive]
        return runs[np.lexsort((runs[:, 2], runs[:, 0]))]

    def verified(self, runs: np.ndarray) -> bool:
        """Whether every run repeats word by word, and no neighbouring word goes on with it."""
        if len(runs) == 0:
            return True
        start, length, period = runs.T
        starts = self.first_docs[0]
        doc = np.searchsorted(starts, start, side="right") - 1
        doc_end = np.r_[starts[1:], self.n][doc]
        before = np.flatnonzero(start > starts[doc])
        after = np.flatnonzero(start + length < doc_end)
        if np.any(self.ids[start[before] - 1] == self.ids[start[before] - 1 + period[before]]):
            return False
        end = start + length
        if np.any(self.ids[end[after]] == self.ids[end[after] - period[after]]):
            return False
        return all(np.array_equal(self.ids[s : s + n - p], self.ids[s + p : s + n]) for s, n, p in runs)


def _smallest_divisors(n: int) -> np.ndarray:
    out = np.arange(n + 1)
    for d in range(2, int(n**0.5) + 1):
        if out[d] == d:
            multiples = out[d * d :: d]
            multiples[multiples == np.arange(d * d, n + 1, d)] = d
    return out


def runs_of(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST, piece: int = PIECE, bases: tuple[int, ...] = BASES) -> np.ndarray:
    """Runs (start, length, period) of documents given as word codes one after another, places in the whole array."""
    n = len(codes)
    lengths = np.diff(offsets)
    distinct = int(codes.max(initial=0)) + 1
    ids = codes + np.repeat(np.arange(len(lengths)), lengths) * distinct
    begins = offsets[:-1][lengths > 0]
    for base in bases:
        stream = SquareStream(int(lengths.max(initial=0)), least, base, max(n, 1))
        squares = [np.empty((0, 3), np.int64)]
        for at in range(0, n, piece):
            to = min(at + piece, n)
            squares.append(stream.append(ids[at:to], begins[(begins >= at) & (begins < to)] - at))
        runs = stream.merge(np.concatenate(squares), least)
        if stream.verified(runs):
            return runs
    raise ValueError("no base of the hash tells these words apart")


FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find_batches(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=STREAM_BYTES):
        offsets, codes, vocabulary = words(batch.column("text"))
        runs = runs_of(codes, offsets, least)
        start, length, period = runs.T
        doc = np.searchsorted(offsets, start, side="right") - 1
        covered = np.zeros(len(codes) + 1, np.int64)
        np.add.at(covered, start + period, 1)
        np.add.at(covered, start + length, -1)
        kept = np.cumsum(covered[:-1]) == 0
        ends = np.concatenate([[0], np.cumsum(per_text(kept.astype(np.int64), offsets))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), vocabulary.cast(pa.string()).take(pa.array(codes[kept])))
        run_ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        fields = [pa.array(start - offsets[doc]), pa.array(length), pa.array(period)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(offsets)),
                pa.ListArray.from_arrays(pa.array(run_ends), pa.StructArray.from_arrays(fields, fields=list(_RUN))),
                pc.binary_join(lists, " "),
            ],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def find_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Each row's id, number of words, runs by start and period, and its text without what runs repeat: a word is
    dropped where any run holds it after that run's first period."""
    narrow = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(partial(_find_batches, least=least), FOUND)


def _plant_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hashes, texts = batch.column("h").to_pylist(), batch.column("text")
        chosen = np.array([h % 10 == 0 for h in hashes], bool)
        mine = pc.filter(texts, pa.array(chosen))
        offsets, codes, vocabulary = words(mine)
        index = np.arange(len(codes))
        for i, h in enumerate(h for h in hashes if h % 10 == 0):
            n, g = int(offsets[i + 1] - offsets[i]), h // 10
            if n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                from_ = int(offsets[i]) + a
                index[from_ : int(offsets[i + 1])] = from_ + np.arange(n - a) % p
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), vocabulary.cast(pa.string()).take(pa.array(codes[index])))
        changed = pc.binary_join(lists, " ")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pc.replace_with_mask(texts, pa.array(chosen), changed)], ["doc_id", "text"]
        )


def plant_periods(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with a tenth of the texts, told by the id's hash, made periodic from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), h.alias("h"))
    return narrow.mapInArrow(_plant_batches, "doc_id long, text string")


def digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: first, then shortest period) and digests of all runs and of the collapsed text."""
    runs = F.col("runs")
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))

    def sha(c: Column) -> Column:
        return F.sha2(c.cast("binary"), 256)

    return found.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        best["s"].alias("start"),
        (-best["l"]).alias("length"),
        best["p"].alias("period"),
        F.call_function("div", F.lit(1000) * -best["l"], best["p"]).alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
        "n_words",
    )
