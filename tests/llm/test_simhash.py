"""SimHash near-duplicates against every pair, long posting lists, and odd inputs."""

import re

import numpy as np
import pytest
import xxhash

from punctual.llm import simhash
from punctual.llm.components import components


def brute_print(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + width]) for i in range(len(ws) - width + 1)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    key = lambda r: tuple((x is None, x or 0) for x in (r[0], r[2])) + (r[1],)
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=key), key


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(7, None), (3, ""), (None, "  \n"), (5, "One two"), (6, "one  TWO"), (8, "É é É"), (9, "x" * 300_000), (9, "x" * 300_000)]
    for g in range(12):
        base = rng.choice(vocabulary, 300)
        for k in range(6):
            own = base.copy()
            own[rng.integers(0, 300, k)] = rng.choice(vocabulary, k)
            rows.append((100 - g * 8 - k, " ".join(own)))
    rows.append((None, rows[-1][1]))
    return rows


def test_against_every_pair(spark, rows):
    docs = spark.createDataFrame([(d, t, "key", 1) for d, t in rows], "doc_id long, text string, fp string, a int")
    expected, key = brute(rows)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=key) == expected
    assert len({r[2] for r in expected}) < len({r[1] for r in expected})


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = np.uint64(0x0123456789ABCDEF)
    fps = {int(base)}
    while len(fps) < 150:  # a dense ball: many long lists
        fps.add(int(base) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5))))
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    monkeypatch.setattr(simhash, "BLOCK", 7)
    frame = spark.createDataFrame([(x,) for x in signed], "fp long").coalesce(1)
    linked = simhash.links(frame, 4).collect()
    for a, b in linked:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    for a in signed:
        for b in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert find(a) == find(b)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
