"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. A word's probability in a
language is the sum over all its segmentations into pieces, which a forward pass gives; a text's is the product
over its words. The piece probabilities are fitted by expectation maximisation on labelled texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import fold, slices, store, words

UNDETERMINED = "und"
#: At most about this many labelled texts of a language are used to fit it, chosen by a hash of the id.
SAMPLE_TEXTS = 600
ROUNDS = 3
#: Letters of a word that are scored together; longer ones are cut, so that no product underflows.
LONGEST = 32
#: Weight of a piece that a language never used, in occurrences.
PRIOR = 0.05
_EDGES = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'0123456789"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 20


def _slot(h: np.ndarray) -> np.ndarray:
    """A place in the table; short prefixes have small hashes, so these are spread first."""
    return ((h ^ h >> np.uint64(32)) * _STEP >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


class Pieces:
    """The vocabulary as a hash table of all prefixes of its pieces, for many words at once."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        usual = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        names = [p for p in map(model.id_to_piece, usual) if "▁" not in p[1:]]
        self.count = len(names) + 1  # the last stands for any single character outside the vocabulary
        prefixes: dict[int, int] = {}
        for number, name in enumerate(names):
            h = 0
            for c in name:
                h = (h * int(_STEP) + ord(c) + 1) & (1 << 64) - 1
                prefixes.setdefault(h, -1)
            prefixes[h] = number
        self.hashes = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.piece = np.full(1 << _SLOT_BITS, -2, np.int32)
        for h, number in prefixes.items():
            slot = int(_slot(np.array([h], np.uint64))[0])
            while self.piece[slot] != -2:
                slot = (slot + 1) % (1 << _SLOT_BITS)
            self.hashes[slot], self.piece[slot] = h, number

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each prefix hash; -1 for a prefix that is no piece, -2 for none."""
        slot = _slot(h)
        found = self.piece[slot]
        wrong = np.flatnonzero((found != -2) & (self.hashes[slot] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) % (1 << _SLOT_BITS)
            found[wrong] = self.piece[slot[wrong]]
            wrong = wrong[(found[wrong] != -2) & (self.hashes[slot[wrong]] != h[wrong])]
        return found

    def steps(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, backward: bool = False) -> Iterator[tuple]:
        """For each start in words sorted longest first: (rows, start, end, pieces), a piece for each row."""
        places = range(int(sizes.max(initial=0)))
        for i in reversed(places) if backward else places:
            rows = np.arange(int(np.searchsorted(-sizes, -i, side="left")))
            h, end = np.zeros(len(rows), np.uint64), i
            while len(rows):
                h = h * _STEP + letters[starts[rows] + end] + np.uint64(1)
                end += 1
                piece = self.find(h)
                if end == i + 1:
                    yield rows, i, end, np.where(piece < 0, self.count - 1, piece)
                elif (whole := piece >= 0).any():
                    yield rows[whole], i, end, piece[whole]
                on = (piece != -2) & (sizes[rows] > end)
                rows, h = rows[on], h[on]


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _ordered(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as code points, longest first: all letters, each word's start and size, and the order."""
    sizes = np.fromiter(map(len, names), np.int64, len(names)) + 1
    letters = np.frombuffer("".join("▁" + n for n in names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    return letters, starts[order], sizes[order], order


def log_scores(names: list[str], pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language: forward sums over all segmentations."""
    out = np.empty((len(names), probability.shape[1]))
    for at in range(0, len(names), 20_000):
        letters, starts, sizes, order = _ordered(names[at : at + 20_000])
        width = int(sizes.max(initial=0)) + 1
        sums = np.zeros((width, len(order), probability.shape[1]))
        sums[0] = 1
        for rows, i, end, piece in pieces.steps(letters, starts, sizes):
            sums[end, rows] += sums[i, rows] * probability[piece]
        out[at + order] = np.log(sums[sizes, np.arange(len(order))])
    return out


def expected_counts(names: list[str], weights: np.ndarray, pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words of one language, each word ``weights`` times."""
    counts = np.zeros(pieces.count)
    for at in range(0, len(names), 20_000):
        letters, starts, sizes, order = _ordered(names[at : at + 20_000])
        width, n = int(sizes.max(initial=0)) + 1, len(order)
        ahead, behind = np.zeros((width, n)), np.zeros((width, n))
        ahead[0] = 1
        behind[sizes, np.arange(n)] = 1
        for rows, i, end, piece in pieces.steps(letters, starts, sizes):
            ahead[end, rows] += ahead[i, rows] * probability[piece]
        for rows, i, end, piece in pieces.steps(letters, starts, sizes, backward=True):
            behind[i, rows] += behind[end, rows] * probability[piece]
        share = weights[at + order] / ahead[sizes, np.arange(n)]
        for rows, i, end, piece in pieces.steps(letters, starts, sizes):
            use = ahead[i, rows] * probability[piece] * behind[end, rows] * share[rows]
            counts += np.bincount(piece, use, pieces.count)
    return counts


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words as they are scored: lower case, without ASCII digits and signs at their ends, cut every LONGEST."""
    offsets, codes, vocabulary = words(texts)
    bare = pc.utf8_trim(pc.utf8_lower(vocabulary), characters=_EDGES).dictionary_encode()
    names = bare.dictionary.to_pylist()
    return offsets, bare.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes], names


def _cut(names: list[str]) -> tuple[list[str], np.ndarray]:
    parts, owner = [], []
    for i, name in enumerate(names):
        for at in range(0, len(name), LONGEST):
            parts.append(name[at : at + LONGEST])
            owner.append(i)
    return parts, np.array(owner, np.int64)


def _normal(counts: np.ndarray) -> np.ndarray:
    return (counts + PRIOR) / (counts + PRIOR).sum(0)


def fit(labelled: DataFrame, path: str, sample: int = SAMPLE_TEXTS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """``labelled(doc_id, text, lang)`` -> languages in order, and piece probabilities (pieces x languages).

    Rows without a language teach nothing. Of each language about ``sample`` whole texts are used, chosen by a
    hash of the id; counting and the expectation step run in tasks, and the driver gets a number for each
    language and piece of the vocabulary.
    """
    labelled = labelled.where("lang is not null").select("doc_id", "text", "lang")
    shares = {r["lang"]: min(1.0, sample / r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(shares)
    pieces = _pieces(path)
    if not languages:
        return [], np.zeros((pieces.count, 0))
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < share * float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tags = np.array(batch.column("lang").to_pylist())
            offsets, codes, names = _letters(batch.column("text"))
            of_word = np.repeat(np.arange(len(tags)), np.diff(offsets))
            for tag in np.unique(tags):
                n = np.bincount(codes[tags[of_word] == tag], minlength=len(names))
                at = np.flatnonzero(n)
                found = [pa.array([str(tag)] * len(at), pa.string()), pa.array([names[i] for i in at], pa.string()), pa.array(n[at])]
                yield pa.RecordBatch.from_arrays(found, ["lang", "word", "n"])

    counted = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = store(counted.where("word <> ''").repartition("lang", "word"), "langid-words")
    probability = np.full((pieces.count, len(languages)), 1 / pieces.count)
    for _ in range(rounds):
        now = probability

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums = {}
            for batch in batches:
                tags, n = np.array(batch.column("lang").to_pylist()), batch.column("n").to_numpy()
                names = batch.column("word").to_pylist()
                for tag in np.unique(tags):
                    own = np.flatnonzero(tags == tag)
                    parts, owner = _cut([names[i] for i in own])
                    used = expected_counts(parts, n[own][owner].astype(float), _pieces(path), now[:, languages.index(tag)].copy())
                    sums[str(tag)] = sums.get(str(tag), 0) + used
            for tag, used in sums.items():
                at = np.flatnonzero(used)
                found = [pa.array([tag] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(used[at])]
                yield pa.RecordBatch.from_arrays(found, ["lang", "piece", "used"])

        used = counted.mapInArrow(expect, "lang string, piece int, used double").groupBy("lang", "piece").agg(F.sum("used").alias("used"))
        counts = np.zeros((pieces.count, len(languages)))
        got = used.toPandas()
        counts[got["piece"], got["lang"].map({x: i for i, x in enumerate(languages)})] = got["used"]
        probability = _normal(counts)
    return languages, probability


PREDICTED = "lang_pred string, score double"


def _predict(texts: pa.Array, languages: list[str], path: str, probability: np.ndarray) -> tuple[list[str], np.ndarray]:
    texts = pc.fill_null(texts, "")
    lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    offsets, codes, names = _letters(texts)
    parts, owner = _cut(names)
    by_word = np.zeros((len(names), len(languages)))
    np.add.at(by_word, owner, log_scores(parts, _pieces(path), probability))
    totals = np.zeros((len(texts), len(languages)))
    for k in range(len(languages)):
        sums = np.concatenate([[0.0], np.cumsum(by_word[codes, k])])
        totals[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
    best = totals.argmax(1)
    score = 1 / np.exp(np.minimum(totals - totals.max(1, keepdims=True), 0)).sum(1)
    return [languages[b] if x else UNDETERMINED for b, x in zip(best, lettered)], np.where(lettered, score, 0.0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (its probability among the languages, equal priors) to ``docs(text, ...)``.

    ``und`` with score 0 for a null text, one without a letter, or a model without languages. Ties go to the
    language that sorts first. Columns of these names are replaced.
    """
    languages, probability = model
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), PREDICTED])
    shared = docs.sparkSession.sparkContext.broadcast(probability)  # vocabulary x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if languages:
                tags, score = _predict(batch.column("text"), languages, path, shared.value)
            else:
                tags, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            added = [pa.array(tags, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, path: str, folds: int = 4, held: int = 2) -> DataFrame:
    """Fits on the labelled documents outside fold ``held`` and predicts every document.

    ``docs(doc_id, text, lang)`` -> ``(doc_id, held_out, lang_pred, score)``, a row for each row; lang and
    doc_id take no part in a prediction. A null doc_id counts as the empty text in folds; other columns are
    ignored.
    """
    held_out = fold("doc_id", folds) == held
    model = fit(docs.where(~held_out), path)
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, path).drop("text")
