"""Periodic runs against a plain search of every period, however the words are appended."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from punctual.llm import runs as R


def brute_runs(words, least=12):
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(least, 2 * p) and not any(
                all(words[k] == words[k + q] for k in range(i, i + length - q)) for q in range(1, p) if p % q == 0
            ):
                found.append((i, length, p))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def samples():
    rnd = random.Random(11)
    yield [0] * 200
    yield morse(256)
    yield fibonacci(300)
    yield ([0] * 9 + [1]) * 12
    yield [0, 1] * 7 + [2] + [0, 1] * 7
    yield []
    yield [3]
    for k in (2, 2, 2, 3, 4):
        yield [rnd.randrange(k) for _ in range(rnd.randint(20, 400))]
    for _ in range(40):
        out = [rnd.randrange(50) for _ in range(rnd.randint(1, 90))]
        for _ in range(rnd.randint(1, 3)):
            at = rnd.randrange(len(out))
            piece = out[at : at + rnd.randint(1, 60)]
            out[at:at] = piece * rnd.randint(1, 6)
        yield out


def as_stream(docs):
    lengths = [len(d) for d in docs]
    return np.array([w for d in docs for w in d], np.int64), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def shifted(docs, least=12):
    out, at = [], 0
    for d in docs:
        out += [(s + at, n, p) for s, n, p in brute_runs(d, least)]
        at += len(d)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 18])
def test_runs_of_all_documents(piece):
    docs = list(samples())
    codes, offsets = as_stream(docs)
    assert [tuple(r) for r in R.runs_of(codes, offsets, piece=piece)] == shifted(docs)


@pytest.mark.parametrize("least", [2, 5, 30])
def test_other_least_lengths(least):
    docs = list(samples())
    codes, offsets = as_stream(docs)
    assert [tuple(r) for r in R.runs_of(codes, offsets, least)] == shifted(docs, least)


def test_squares_are_reported_when_their_last_word_comes():
    words = np.array([9, 8, *[1, 2, 3, 4, 5, 6, 7] * 3, 5], np.int64)
    stream = R.SquareStream(len(words))
    seen = {}
    for i, w in enumerate(words):
        for first, last, p in stream.append(np.array([w]), np.array([0] if i == 0 else [], np.int64)):
            assert first == last == i
            seen.setdefault(int(p), []).append(i)
    assert seen == {7: list(range(15, 23))}


def test_a_failing_base_is_replaced():
    docs = list(samples())
    codes, offsets = as_stream(docs)
    # with base 1 the hash forgets the order of words
    assert [tuple(r) for r in R.runs_of(codes, offsets, bases=(1, *R.BASES))] == shifted(docs)


def test_products_modulo_a_prime():
    rnd = random.Random(1)
    a = [rnd.randrange(R._P) for _ in range(1000)] + [0, 1, R._P - 1]
    b = [rnd.randrange(R._P) for _ in range(1000)] + [R._P - 1] * 3
    got = R._times(np.array(a, np.uint64), np.array(b, np.uint64))
    assert [int(x) for x in got] == [x * y % R._P for x, y in zip(a, b, strict=True)]


def brute_rows(docs):
    out = []
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute_runs(words)
        dropped = {i for s, m, p in found for i in range(s + p, s + m)}
        best = min(((-m, s, p) for s, m, p in found), default=None)
        top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        out.append((doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), n))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, runs string, n_words string, h int"


def test_rows(spark):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 150)))) for i in range(150)]
    docs += [(i, "\t".join(rnd.choice(["ä", "b", "c d"]) for _ in range(60)) + "\n") for i in range(150, 200)]
    docs += [(7, "same " * 30), (7, "same " * 30), (300, None), (301, ""), (302, " \n"), (None, "a b " * 20), (None, None)]
    docs += [(400, "x y z " * 700), (401, "w" * 100_000)]
    df = spark.createDataFrame([(*d, "clash", "clash", 1) for d in docs], SCHEMA)
    got = R.digests(R.find_runs(R.plant_periods(df))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_rows(docs)


def test_query_on_whole_texts(spark):
    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    short = [d for d in docs if len(d[1]) < 8000]
    got = {tuple(r) for r in __spark_entry__.queries()["op11_periodic_runs"](spark, folder).collect()}
    assert len(got) == len(docs) and set(brute_rows(short)) <= got


def test_no_rows(spark):
    assert R.digests(R.find_runs(R.plant_periods(spark.createDataFrame([], SCHEMA)))).collect() == []
