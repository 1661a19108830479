"""Groups by contraction, near copies proposed once, and words whose ids are worked out once."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa

from punctual.llm import components as parts
from punctual.llm import nearcopies, packing


def smallest(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_a_group_around_one_node_leaves_no_edges_for_a_second_round(spark, monkeypatch):
    written, store = [], parts.store

    def counted(df, name):
        out = store(df, name)
        if name == "edges":
            written.append(out.count())
        return out

    monkeypatch.setattr(parts, "store", counted)
    got = parts.components(spark.createDataFrame([(1, n) for n in range(2, 60)] + [(70, 1)], "a long, b long"))
    assert {r["root"] for r in got.collect()} == {1} and got.count() == 60 and written == [59, 0]


def test_groups_of_chains_and_scattered_edges(spark):
    deal = random.Random(3)
    names = deal.sample(range(-10_000, 10_000), 400)
    edges = [(names[i], names[i + 1]) for i in range(120)] + [(i, i + 1) for i in range(20_000, 20_050)]
    edges += [(deal.choice(names[150:]), deal.choice(names[150:])) for _ in range(150)]
    edges = [(a, b) for a, b in edges if a != b]
    got = parts.components(spark.createDataFrame([*edges, *edges[:9], (5, None), (7, 7)], "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == smallest(edges)
    assert parts.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_later_links_join_groups_by_their_roots(spark):
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6)], "node long, root long")
    got = nearcopies._joined(spark.createDataFrame([(2, 4), (3, 4), (4, 6)], "a long, b long"), roots)
    assert {r["node"]: r["root"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 1}


def test_a_pair_that_meets_in_many_lists_is_proposed_once(spark):
    prints = spark.createDataFrame([(1 << k, k) for k in range(6)], "print long, fp long")
    got = nearcopies._proposed(prints).where("x <> y").collect()
    assert len(got) == len({tuple(r) for r in got}) >= 5


def test_ids_of_words_are_worked_out_once(monkeypatch):
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    worked, inner = [], ids._ids
    monkeypatch.setattr(ids, "_ids", lambda new: worked.append(new.to_pylist()) or inner(new))
    for names in (["one", "two,", "three"], ["three", "four", "one"], ["two,"]):
        flat, starts, sizes = ids.of(pa.array(names))
        for name, at, n in zip(names, starts.tolist(), sizes.tolist()):
            assert flat[at : at + n].tolist() == ids.whole(name).tolist()
    assert worked == [["one", "two,", "three"], ["four"]]
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    assert ids.of(pa.array(["one"]))[2].tolist() and worked[-1] == ["one"] and len(ids.names) == 1
