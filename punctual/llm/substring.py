"""Substring dedup: words covered by long windows that an earlier document also holds.

1. Each window of consecutive words has an anchor, the smallest hash among its short word runs; neighbouring
   windows with the same anchor are a passage of at most as many windows. Equal windows have equal anchors.
2. Passages whose anchor stands in one document only are left; equal passages become one, with the smallest
   document. Where all passages of an anchor are equal, that document answers for all their windows.
3. The others go to shards by anchor, after windows that only one of them holds are cut off. Each shard has a
   compressed index of its passages and streams them through it: backward search gives, for each window, the
   smallest document that holds it.
4. Back at the documents, windows with a smaller document are marked and their words removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import partitions, slices, store, words
from punctual.llm.fmindex import FMIndex

WINDOW = 50
#: Words of an anchor.
GRAM = 10
#: Words in one index, and passages of an anchor beyond which they are dealt as pairs of blocks.
SHARD_WORDS = 600_000
BLOCK = 2000
_BASE = np.uint64(0xD6E8FEB86659FD93)
_UNBASE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any run of words of a sequence, from running sums."""

    def __init__(self, hashed: np.ndarray):
        n = len(hashed)
        powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _BASE)])
        self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _UNBASE)])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashed * powers[:n], dtype=np.uint64)])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and offsets by text; a null text has none."""
    offsets, codes, vocabulary = words(texts)
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))
    return hashed[codes], offsets


def _least_in(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def passages_of(hashed: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Passages of texts: text, first window, windows, anchor, and a hash of all its words."""
    n = len(hashed)
    if n < window:
        return (*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)))
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    hashes, most = Hashes(hashed), window - gram + 1
    at = np.arange(n - gram + 1)
    anchors = _least_in(hashes.run(at, at + gram), most)  # by window start
    inside = np.flatnonzero(of[: n - window + 1] == of[window - 1 :])
    opens = np.r_[True, (np.diff(inside) != 1) | (anchors[inside[1:]] != anchors[inside[:-1]]) | (of[inside[1:]] != of[inside[:-1]])]
    if not len(inside):
        opens = np.zeros(0, bool)
    firsts = np.flatnonzero(opens)
    within = np.arange(len(inside)) - np.repeat(firsts, np.diff(np.r_[firsts, len(inside)]))
    firsts = np.flatnonzero(within % most == 0)  # a repeating text keeps its anchor for long
    start, count = inside[firsts], np.diff(np.r_[firsts, len(inside)])
    whole = hashes.run(start, start + count + window - 1) ^ _mixed(count.astype(np.uint64))
    return of[start], start - offsets[of[start]], count, anchors[start], whole


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_PASSAGE = "doc_id long, text_hash long, first int, windows int, anchor long, whole long"


def passages(docs: DataFrame, window: int) -> DataFrame:
    """``docs(doc_id, text_hash, text)`` -> their passages; documents without an id have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of, first, count, anchor, whole = passages_of(*word_hashes(batch.column("text")), window)
            ids, hashes = (batch.column(c).to_numpy()[of] for c in ("doc_id", "text_hash"))
            found = [pa.array(ids), pa.array(hashes), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), _signed(anchor), _signed(whole)]
            yield pa.RecordBatch.from_arrays(found, [x.split()[0] for x in _PASSAGE.split(", ")])

    return docs.where("doc_id is not null").mapInArrow(run, _PASSAGE)


_WORDS = "anchor long, whole long, least long, words binary, windows array<long>"


def _fetched(docs: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """The words of chosen passages, and a hash of each of their windows, from the documents that hold them."""
    wanted = chosen.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "windows", "anchor", "whole")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashed, offsets = word_hashes(batch.column("text"))
            hashes, rows = Hashes(hashed), []
            for i, (doc_id, wanted) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("wanted").to_pylist())):
                for p in wanted:
                    a = int(offsets[i]) + p["first"]
                    starts = np.arange(a, a + p["windows"])
                    own = hashes.run(starts, starts + window).view(np.int64)
                    rows.append((p["anchor"], p["whole"], doc_id, hashed[a : a + p["windows"] + window - 1].tobytes(), own))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            names = [x.split()[0] for x in _WORDS.split(", ")]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text", "wanted").mapInArrow(run, _WORDS)


def _runs_of(kept: list[int]) -> Iterator[tuple[int, int]]:
    at = np.array(sorted(set(kept)))
    opens = np.flatnonzero(np.r_[True, np.diff(at) != 1])
    yield from zip(at[opens].tolist(), np.diff(np.r_[opens, len(at)]).tolist())


_PART = "anchor long, whole long, least long, at int, words binary, content long"


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Stretches of windows that more than one passage holds."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            own = np.frombuffer(row["words"], np.uint64)
            for first, count in _runs_of(row["kept"]):
                part = own[first : first + count + window - 1].tobytes()
                content = xxhash.xxh64_intdigest(part)
                rows.append((row["anchor"], row["whole"], row["least"], first, part, content - (1 << 64) if content >> 63 else content))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in _PART.split(", ")])


def _shard(window: int):
    """Streams stretches sorted by group: whole groups are gathered up to SHARD_WORDS words, indexed and searched."""

    def search(rows: list[dict]) -> pa.RecordBatch:
        stretches = [np.frombuffer(r["words"], np.uint64) for r in rows]
        index = FMIndex(stretches, np.array([r["least"] for r in rows]), window)
        found = index.least_documents(stretches)
        contents = pa.array([r["content"] for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays([contents, pa.array(found, pa.list_(pa.int64()))], ["content", "documents"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                group = (row["anchor"], row["low"], row["high"])
                if group != last and size >= SHARD_WORDS:
                    yield search(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["words"]) // 8
                last = group
        if held:
            yield search(held)

    return run


def _searched(parts: DataFrame, window: int) -> DataFrame:
    """``parts(anchor, content, least, words)``, distinct -> ``(anchor, content, documents)``."""
    spark = parts.sparkSession
    sizes = parts.groupBy("anchor").agg((F.floor((F.count("*") - 1) / BLOCK) + 1).cast("int").alias("blocks"))
    many = sizes.where("blocks > 1")
    dealt = parts.join(many, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    order = ("anchor", "low", "high")
    dealt = dealt.select("anchor", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "content", "least", "words")
    dealt = dealt.repartition(partitions(spark), *order).sortWithinPartitions(*order)
    found = dealt.mapInArrow(_shard(window), "content long, documents array<long>")
    # a stretch met every block of its anchor: the smallest document over all of them
    both = F.aggregate(
        F.collect_list("documents"),
        F.lit(None).cast("array<long>"),
        lambda a, b: F.when(a.isNull(), b).otherwise(F.zip_with(a, b, lambda x, y: F.least(x, y))),
    )
    return found.groupBy("content").agg(both.alias("documents"))


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text_hash, text)`` -> ``(doc_id, text_hash, marks)``: windows that a smaller doc_id also holds.

    A mark is a first window and 64 bits, one for each window from there.
    """
    if not GRAM <= window <= GRAM + 63:
        raise ValueError(f"windows of {GRAM} to {GRAM + 63} words are marked")
    anchors = passages(docs, window).groupBy("anchor")
    anchors = anchors.agg(F.min("whole").alias("a"), F.max("whole").alias("b"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y"))
    anchors = store(anchors.where("x <> y").select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "anchors")
    found = store(passages(docs, window).join(anchors, "anchor"), "passages")
    key = ["anchor", "whole"]
    first = F.min(F.struct("doc_id", "text_hash", "first")).alias("held")
    distinct = found.groupBy(*key).agg(first, F.first("windows").alias("windows"), F.first("mixed").alias("mixed"))
    distinct = store(distinct.select(*key, "held.*", "windows", "mixed"), "distinct")
    fetched = store(_fetched(docs, distinct.where("mixed"), window), "fetched")
    single = fetched.select(*key, F.posexplode("windows").alias("at", "window"))
    shared = store(single.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"), "windows")
    kept = store(single.join(shared, "window").groupBy(*key).agg(F.collect_list("at").alias("kept")), "kept")
    cut = fetched.join(kept, key).select(*key, "least", "words", "kept").mapInArrow(lambda b: _cut(b, window), _PART)
    cut = store(cut, "stretches")
    parts = store(cut.groupBy("content").agg(F.min("least").alias("least"), F.first("words").alias("words"), F.first("anchor").alias("anchor")), "parts")
    answers = store(_searched(parts, window), "answers")
    by_passage = store(
        cut.join(answers, "content").groupBy(*key).agg(F.collect_list(F.struct("at", "documents")).alias("answers")), "by-passage"
    )
    least = distinct.select(*key, F.col("doc_id").alias("least"))
    answered = store(least.join(by_passage, key, "left"), "answered")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                bits, own = 0, row["doc_id"]
                if row["least"] < own:
                    bits = (1 << row["windows"]) - 1
                else:
                    for part in row["answers"] or ():
                        for i, least in enumerate(part["documents"]):
                            bits |= (least < own) << part["at"] + i
                if bits:
                    rows.append((own, row["text_hash"], row["first"], bits - (1 << 64) if bits >> 63 else bits))
            types, columns = (pa.int64(), pa.int64(), pa.int32(), pa.int64()), list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "text_hash", "first", "bits"])

    marked = found.select("doc_id", "text_hash", "first", "windows", *key).join(answered, key).mapInArrow(mark, "doc_id long, text_hash long, first int, bits long")
    return marked.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "bits")).alias("marks"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _removed(n: int, marks: list[dict] | None, window: int) -> np.ndarray:
    """Which of a text's n words a marked window covers."""
    steps = np.zeros(n + 1, np.int64)
    for mark in marks or ():
        bits = mark["bits"] & (1 << 64) - 1
        while bits:
            low = (bits & -bits).bit_length() - 1
            count = (~(bits >> low) & (bits >> low) + 1).bit_length() - 1  # a run of marked windows
            steps[mark["first"] + low] += 1
            steps[mark["first"] + low + count + window - 1] -= 1
            bits &= ~(((1 << count) - 1) << low)
    return np.cumsum(steps[:n]) > 0


def _with_marks(docs: DataFrame, window: int, *others: Column) -> DataFrame:
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), "text", *others)
    return keyed.join(covered(keyed.select("doc_id", "text_hash", "text"), window), ["doc_id", "text_hash"], "left")


def _kept(text: str | None, marks: list[dict] | None, window: int) -> tuple[int, list[str]]:
    """How many words a text has, and those that no marked window covers."""
    own = _word.findall(text or "")
    if not marks:
        return len(own), own
    return len(own), [w for w, gone in zip(own, _removed(len(own), marks, window).tolist()) if not gone]


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_words, n_removed, kept_sha256)``, a row for each row.

    A null doc_id is never smaller or larger than another, and rows of one id never touch each other. Null and
    blank texts have no words; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [_kept(t, m, window) for t, m in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist())]
            counts = [n for n, _ in found], [n - len(left) for n, left in found]
            digests = [hashlib.sha256(" ".join(left).encode()).hexdigest() for _, left in found]
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    marked = _with_marks(docs, window).select("doc_id", "text", "marks")
    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all their columns; where words are removed, ``text`` is the others joined by one space.

    Texts without a removed word stay as they are, null included. The rules are those of :func:`dedup`.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # other columns may have any names
    renamed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)]).alias("row"))
    kind = renamed.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist())
            texts = [" ".join(_kept(t, m, window)[1]) if m else t for t, m in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("row")], ["text", "row"])

    marked = _with_marks(renamed, window, F.col("row")).select("text", "marks", "row")
    made = marked.mapInArrow(run, f"text string, row {kind}")
    return made.select(*[F.col("text") if c == "text" else F.col("row").getField(n).alias(c) for c, n in zip(docs.columns, names)])


_word = re.compile(r"[^\x20\x09-\x0D]+")
