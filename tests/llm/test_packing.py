"""Packing: places, the reduction against the best packing, token ids against the tokenizer on whole texts."""

import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from punctual.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def expand(made, capacity):
    bins = {}
    for size, _, n, first, each, offset in made.runs:
        for i in range(n):
            bins.setdefault(first + i // each, []).append((offset + i % each * size, size))
    for held in bins.values():
        end = 0
        for offset, size in sorted(held):
            assert offset == end
            end += size
        assert end <= capacity
    return bins


def fewest(sizes, capacity):
    sizes = sorted(sizes, reverse=True)

    @lru_cache(maxsize=None)
    def best(i, rooms):
        if i == len(sizes):
            return 0
        options = [1 + best(i + 1, tuple(sorted((*rooms, capacity - sizes[i]))))]
        for k, room in enumerate(rooms):
            if room >= sizes[i]:
                options.append(best(i + 1, tuple(sorted((*rooms[:k], room - sizes[i], *rooms[k + 1 :])))))
        return min(options)

    return best(0, ())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_reduction_keeps_the_optimum(sizes):
    counts = np.bincount(sizes, minlength=21) if sizes else np.zeros(21, int)
    part = packing.Plan(counts, 20)
    part.reduce()
    rest = [s for s in range(21) for _ in range(int(part.left[s]))]
    assert part.fixed + fewest(tuple(rest), 20) == fewest(tuple(sizes), 20)
    assert sum(map(len, expand(packing.plan(counts, 20), 20).values())) == len(sizes)


def naive_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fitting = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fitting:
            rooms[min(fitting)[1]] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


class OneByOne(packing.Plan):
    """Fixes one sequence of three pieces at a time."""

    def fix(self, sizes, n):
        super().fix(sizes, 1 if len(sizes) > 2 else n)


def test_triples_are_fixed_at_once():
    rng = np.random.default_rng(8)
    for _ in range(150):
        counts = np.zeros(61, np.int64)
        counts[rng.integers(12, 61, rng.integers(1, 9))] = rng.integers(1, 40)
        made, plain = packing.plan(counts, 60), OneByOne(counts, 60)
        plain.reduce()
        plain.best_fit()
        assert (made.sequences, made.fixed) == (plain.sequences, plain.fixed)
        assert sorted(map(sorted, expand(made, 60).values())) == sorted(map(sorted, expand(plain, 60).values()))
    counts = np.zeros(packing.CAPACITY + 1, np.int64)
    counts[1300] = 1_000_000
    made = packing.plan(counts)
    assert made.sequences == 333_334 and len(made.runs) < 20


def test_large_histogram():
    rng = np.random.default_rng(1)
    sizes = np.minimum(4096, rng.lognormal(6, 1.2, 20_000).astype(int) + 1)
    counts = np.bincount(np.r_[sizes, [700] * 9000], minlength=4097)
    made = packing.plan(counts)
    bins = expand(made, 4096)
    assert sorted(s for b in bins.values() for _, s in b) == sorted([*sizes, *[700] * 9000])
    assert made.fixed > 0 and len(made.runs) < 40_000
    assert len(bins) == made.sequences <= naive_best_fit([*sizes.tolist(), *[700] * 9000], 4096)
    big = packing.plan(counts * 1_000_000)
    assert len(big.runs) < 40_000


def test_documents(spark):
    odd = ["Don't STOP!!! it's “quoted”… x'll 'Tis ÀÉ naïve é.., 漢字! 3.14 a b c\x1cd", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>"]
    rows = [(1, None), (2, ""), (2, ""), (None, "one two"), (3, "the " * 10_000), *((10 + i, t) for i, t in enumerate(odd)), (4, "a b " * 30)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, length int, part string")
    got = packing.pack_documents(docs, PATH).collect()
    encoder = Tokenizer.from_file(PATH)
    expected = []
    for doc_id, text in rows:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            piece = np.array(ids[at : at + 4096], "<u4")
            expected.append((doc_id, k, at, len(piece), zlib.crc32(piece.tobytes())))
    assert sorted(map(repr, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(repr, expected))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
