"""The prefix trie against one built node by node."""

import hashlib
import random
import re
import zlib

import pytest

from punctual.llm import trie


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for turns in convs.values():
        turns.sort()
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c - (abs(c) % 20) * (1 if c > 0 else -1))
        made[c] = [t[2:] for t in convs.get(base, [])[:h] + own[h:]]
    return nodes_of(made)


def nodes_of(made):
    members, ends = {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [totals[k] for k in kids.get(p, [])]
        totals[p] = (sum(b[0] for b in below) or 1, (len(members[p]) - 1) * words + sum(b[1] for b in below))
    out = []
    for p, m in members.items():
        parent = min(members[p[:-1]]) if p else None
        listed = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(m), len(p), parent, len(m), len(kids.get(p, [])), *totals[p], sha(listed)))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, name string, depth int"


def built(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in trie.prefix_trie(*trie.rebuilt(df), **how).collect()), key=repr)


def test_small_alphabet(spark):
    rnd = random.Random(2)
    rows = [
        (c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b c", " d\te ", None, ""]))
        for c in range(-45, 160)
        if c % 40
        for t in range(rnd.randint(1, 9))
    ]
    # a conversation of one turn whose beginning is not there, null turns, rows of no conversation
    rows += [(1000 + c, None, "user", "x") for c in range(40)] + [(None, 0, "user", "x"), (None, None, None, None)]
    rnd.shuffle(rows)
    assert built(spark, rows) == brute(rows)


@pytest.mark.parametrize("segment,chunk", [(4, 8), (256, 1024)])
def test_deep_and_hot(spark, monkeypatch, segment, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "IDS", 8)
    rnd = random.Random(4)
    deep = [("user", rnd.choice("ab")) for _ in range(75)]
    rows = [(c, t, *deep[t]) for c in range(20) for t in range(rnd.choice([3, 4, 8, 16, 17, 32, 64, 75]))]
    rows += [(c, t, "user", rnd.choice("ab") if t > 20 else deep[t][1]) for c in range(20, 40) for t in range(rnd.randint(1, 70))]
    rows += [(c, t, "user", "copy") for c in range(100, 200) for t in range(5)]
    rows += [(c, 0, "user", f"own {c}") for c in range(200, 260)]
    rnd.shuffle(rows)
    assert built(spark, rows, segment=segment) == brute(rows)


def test_ties(spark):
    # which of two equal turns comes first is told by a hash: the digest of members and the counts do not depend on it
    rows = [(c, 0, "user", t) for c in (0, 1, 2) for t in ("same", "same")]
    assert built(spark, rows) == brute(rows)


def test_long_text(spark):
    rows = [(1, 0, "user", "w " * 300_000), (2, 0, "user", "w " * 300_000), (2, 1, "assistant", None)]
    assert built(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, 0, "user", "x")]) == []


def test_one_shape_of_names():
    rnd = random.Random(9)
    for n in range(0, 40):
        items = [rnd.randbytes(16) for _ in range(n)]
        names = trie.prefix_names(trie.ROOT, items)
        assert len(set(names)) == n + 1
        for k in range(n + 1):
            assert trie.prefix_names(trie.ROOT, items[:k]) == names[: k + 1]
