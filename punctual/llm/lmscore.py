"""Language-model scores by online logistic context mixing.

A text is a row of tokens: its words, then an end. Tokens are coded in bits: frequent words by a Huffman code of
the training counts, others by an escape and then their own probability (seen counts, spelling for the rest).
Each bit is predicted from several contexts (none, the classes of the two words before, and the most frequent
word that was the commonest of late); the predictions are
mixed in the logistic domain by weights that a gate chooses, learned online over the training texts, and the
mixture is refined by an adaptive map from what was predicted to what came true.

Counts cover all training texts. Word counts grow with the corpus and stay in Spark tables; what tasks hold is
bounded by FREQUENT words. Every other word is rarer than one in FREQUENT tokens.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import fold, new_folder, partitions, slices, store, words
from punctual.llm.packing import gather

FREQUENT = 1 << 15
#: Classes of an earlier word: the most frequent words have one each, others share by their last letters.
CLASSES, OWN_CLASS = 64, 32
CONTEXTS = 3
#: Tokens back over which the commonest of the most frequent words is told.
LATELY, REFRESHED = 48, 8
#: Gates: code depths and confidences; steps of the refining map.
DEPTHS, TRUSTS, STEPS = 8, 4, 33
GATES = DEPTHS * TRUSTS
RATE, BLOCK_BITS = 0.02, 4096
#: Tokens that are expanded to bits at once, and slots of a count table that are merged at once.
CHUNK, MERGED = 60_000, 1 << 16
#: Spelling: hashed contexts of no, one, two, three and four letters; letters (bytes) and the end of a word.
SPELL_SLOTS, LETTERS = (1, 257, 1 << 12, 1 << 14, 1 << 15), 257
#: How much an order of spelling draws on the one below, in letters.
DRAWN = 3.0
_SPELL = CONTEXTS


def _commonest(kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each token the most frequent word that was the commonest of late in its text, told anew every REFRESHED
    tokens; CLASSES - 1 where there was none."""
    n = len(kinds)
    blocks = np.arange(n) // REFRESHED
    counts = np.bincount(blocks * (OWN_CLASS + 1) + np.minimum(kinds, OWN_CLASS), minlength=(n // REFRESHED + 1) * (OWN_CLASS + 1))
    sums = np.zeros((n // REFRESHED + 2, OWN_CLASS), np.int32)
    np.cumsum(counts.reshape(-1, OWN_CLASS + 1)[:, :OWN_CLASS], axis=0, out=sums[1:])
    opens = np.zeros(n, bool)
    opens[::REFRESHED] = True
    opens[offsets[:-1]] = True
    at = np.flatnonzero(opens)
    # whole blocks between the text's start and this one
    starts = np.repeat(offsets[:-1], np.diff(offsets))[at]
    end = at // REFRESHED
    low = np.minimum(np.maximum(end - LATELY // REFRESHED, -(-starts // REFRESHED)), end)
    seen = sums[end] - sums[low]
    best = seen.argmax(1)
    best[seen[np.arange(len(at)), best] == 0] = CLASSES - 1
    return np.repeat(best, np.diff(np.r_[at, n]))


def _shared_classes(names: pa.Array) -> np.ndarray:
    """Classes of words that have none of their own, by their last letters."""
    last = pc.utf8_slice_codeunits(names, -2).dictionary_encode()
    told = np.fromiter((OWN_CLASS + xxhash.xxh32_intdigest(w) % (CLASSES - OWN_CLASS - 1) for w in last.dictionary.to_pylist()), np.int64, len(last.dictionary))
    return told[last.indices.to_numpy(zero_copy_only=False)]


class Code:
    """Huffman code of the frequent words, the escape and the end; built from their training counts."""

    def __init__(self, names: list[str], counts: list[int], escapes: int, ends: int):
        self.names = pa.array(names, pa.string())
        self.escape, self.end = len(names), len(names) + 1
        weights = [max(1, c) for c in [*counts, escapes, ends]]
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        n = len(weights)
        self.nodes = n - 1
        self.children, height = np.empty((self.nodes, 2), np.int64), np.zeros(n + self.nodes, np.int64)
        for k in range(self.nodes):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y] = (k, 0), (k, 1)
            self.children[k], height[n + k] = (x, y), max(height[x], height[y]) + 1
            heapq.heappush(heap, (a + b, n + k))
        nodes, bits, depths, sizes = [], [], [], []
        for i in range(n):
            path = []
            while i in parent:
                k, bit = parent[i]
                path.append((k, bit))
                i = n + k
            path.reverse()
            nodes += [k for k, _ in path]
            bits += [b for _, b in path]
            depths += range(len(path))
            sizes.append(len(path))
        self.sizes = np.array(sizes, np.int64)
        #: nodes of equal height, lowest first
        self.rounds = [np.flatnonzero(height[n:] == h) for h in range(1, int(height.max()) + 1)]
        #: node, bit and depth of every step, packed in one number
        self.steps = np.array(nodes, np.int64) << 16 | np.minimum(np.array(depths, np.int64), DEPTHS - 1) << 1 | np.array(bits, np.int64)
        order = np.argsort([-c for c in counts], kind="stable")[:OWN_CLASS]
        self.kinds = _shared_classes(self.names)
        self.kinds[order] = np.arange(len(order))

    def symbols(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Symbols and the earlier words' classes of all tokens, offsets by text, and each word's code and name."""
        offsets, codes, names = words(pc.ascii_lower(pc.fill_null(texts, "")))
        symbol = pc.fill_null(pc.index_in(names, self.names), self.escape).to_numpy(zero_copy_only=False).astype(np.int64)
        frequent = symbol < self.escape
        kind = _shared_classes(names)
        kind[frequent] = self.kinds[symbol[frequent]]
        n = len(offsets) - 1
        with_ends = offsets + np.arange(n + 1)
        of_end = with_ends[1:] - 1
        all_symbols, all_kinds = np.full(len(codes) + n, self.end), np.full(len(codes) + n, CLASSES - 1)
        inner = np.ones(len(codes) + n, bool)
        inner[of_end] = False
        all_symbols[inner], all_kinds[inner] = symbol[codes], kind[codes]
        before = np.full((CONTEXTS, len(all_kinds)), CLASSES - 1, np.int64)
        place = np.arange(len(all_kinds)) - np.repeat(with_ends[:-1], np.diff(with_ends))
        for k in range(CONTEXTS - 1):
            before[k, k + 1 :] = all_kinds[: -k - 1]
            before[k, place <= k] = CLASSES - 1
        before[CONTEXTS - 1] = _commonest(all_kinds, with_ends)
        return all_symbols, before, with_ends, codes, names

    def bits(self, symbols: np.ndarray, before: np.ndarray) -> Iterator[tuple]:
        """Chunks of (first token, token of each bit, bit, depth, slots in every context, one context at a time)."""
        for at in range(0, len(symbols), CHUNK):
            own = symbols[at : at + CHUNK]
            steps = gather(self.steps, self.sizes, own)
            token = np.repeat(np.arange(len(own)), self.sizes[own])
            yield at, token, steps & 1, (steps & 0xFFFF) >> 1, self._slots(steps >> 16, before[:, at : at + CHUNK], token)

    @staticmethod
    def _slots(node: np.ndarray, before: np.ndarray, token: np.ndarray) -> Iterator[np.ndarray]:
        yield node
        node = node * CLASSES
        for kinds in before:
            yield node + kinds[token]

    def by_node(self, counts: np.ndarray) -> np.ndarray:
        """Zeros and ones at every node (two rows), from the counts of the symbols below; ``counts`` has a row for each
        symbol, or a flat table of all symbols and classes."""
        n = len(self.sizes)
        total = np.concatenate([counts.reshape(n, -1), np.zeros((self.nodes, counts.size // n), counts.dtype)])
        for own in self.rounds:
            total[n + own] = total[self.children[own, 0]] + total[self.children[own, 1]]
        return np.stack([total[below].ravel() for below in self.children.T])

    def tables(self) -> list[int]:
        """Slots of each table."""
        return [self.nodes, *[self.nodes * CLASSES] * CONTEXTS, *[n * LETTERS for n in SPELL_SLOTS]]

    def counted(self) -> list[int]:
        """Sizes of what is counted: symbols by class for each context, letters by their context for each order of spelling."""
        return [*[len(self.sizes) * CLASSES] * CONTEXTS, *[n * LETTERS for n in SPELL_SLOTS]]


_BLOCK = "table int, block int, body binary"


def _blocks(table: int, counts: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Counts in compressed blocks; blocks without counts are left out."""
    for block in range(-(-len(counts) // MERGED)):
        part = counts[block * MERGED : (block + 1) * MERGED]
        if part.any():
            yield table, block, zlib.compress(part.astype(np.int64).tobytes(), 1)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], ["table", "block", "body"])


def _merged(blocks: DataFrame) -> DataFrame:
    """Sums blocks of counts; a task holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            for row in batch.to_pylist():
                part = np.frombuffer(zlib.decompress(row["body"]), np.int64)
                if (row["table"], row["block"]) != key:
                    if key is not None:
                        yield _as_batch([(*key, zlib.compress(held.tobytes(), 1))])
                    key, held = (row["table"], row["block"]), part.copy()
                else:
                    held += part
        if key is not None:
            yield _as_batch([(*key, zlib.compress(held.tobytes(), 1))])

    order = ("table", "block")
    return blocks.repartition(partitions(blocks.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, _BLOCK)


def _tables(folder: str, sizes: list[int], which: range, dtype: type) -> list[np.ndarray]:
    """Merged counts, read by a task from the shared folder."""
    where, base = pafs.FileSystem.from_uri(folder)
    out = [np.zeros(sizes[k], dtype) for k in which]
    files = [f.path for f in where.get_file_info(pafs.FileSelector(base, recursive=True)) if f.path.endswith(".parquet")]
    for path in files:
        with where.open_input_file(path) as f:
            for row in pq.read_table(f).to_pylist():
                if row["table"] in which:
                    part = np.frombuffer(zlib.decompress(row["body"]), np.int64)
                    out[row["table"] - which.start][row["block"] * MERGED : row["block"] * MERGED + len(part)] = part
    return out


def _by_slot(folder: str, code: Code) -> Iterator[np.ndarray]:
    """Zeros and ones by slot as 32-bit floats, without a context and then for each context."""
    tables = _tables(folder, code.counted(), range(_SPELL), np.int64)
    yield code.by_node(tables[0].reshape(-1, CLASSES).sum(1)).astype(np.float32)
    while tables:
        yield code.by_node(tables.pop(0)).astype(np.float32)


#: What a worker holds of the model it used last: predictions of training or of scoring.
_HELD: dict[str, tuple] = {}


def _held(name: str, make: Callable[[], tuple]) -> tuple:
    if name not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[name] = make()
        pa.default_memory_pool().release_unused()
    return _HELD[name]


def _left_out(folder: str, code: Code) -> tuple[list[np.ndarray], np.ndarray]:
    """The contexts' predictions in the logistic domain by slot and bit, without this bit itself, as for a text that was
    not learned; and how far the first context's slots can then be trusted."""

    def make() -> tuple[list[np.ndarray], np.ndarray]:
        stretched = []
        for k, (zeros, own) in enumerate(_by_slot(folder, code)):
            out = np.empty((len(own), 2), np.float32)
            with np.errstate(divide="ignore", invalid="ignore"):  # bits that no text has
                for bit in (0, 1):
                    one = np.float32(bit)
                    out[:, bit] = np.log((own + (np.float32(0.4) - one)) / (zeros + (one - np.float32(0.6))))
            stretched.append(out.ravel())
            if k == 1:
                trusts = _trust(zeros + own - 1).astype(np.uint8)
        return stretched, trusts

    return _held(f"{folder} left out", make)


def _ready(folder: str, code: Code) -> tuple[list[np.ndarray], np.ndarray, Spelling]:
    """The contexts' predictions in the logistic domain, how far the first context's slots can be trusted, and spelling."""

    def make() -> tuple[list[np.ndarray], np.ndarray, Spelling]:
        stretched = []
        for k, (zeros, own) in enumerate(_by_slot(folder, code)):
            stretched.append(np.log((own + np.float32(0.4)) / (zeros + np.float32(0.4))))
            if k == 1:
                trusts = _trust(own + zeros).astype(np.uint8)
        sizes = code.counted()
        return stretched, trusts, Spelling(_tables(folder, sizes, range(_SPELL, len(sizes)), np.float32))

    return _held(f"{folder} ready", make)


def _trust(n: np.ndarray) -> np.ndarray:
    return np.digitize(n, (2, 8, 64))


class Mixer:
    """Gated weights and the refining map."""

    def __init__(self, weights: np.ndarray | None = None, true: np.ndarray | None = None):
        self.weights = np.full((GATES, CONTEXTS + 1), 0.4, np.float32) if weights is None else weights.astype(np.float32)
        steps = np.linspace(-8, 8, STEPS)
        if true is None:
            self.map = np.tile(1 / (1 + np.exp(-steps)), (GATES, 1)).astype(np.float32)
        else:  # counts of zeros and ones, drawn to the step's own value
            own = 1 / (1 + np.exp(-steps))
            self.map = ((true[1] + 20 * own) / (true.sum(0) + 20)).astype(np.float32)

    def mixed(self, gate: np.ndarray, inputs: np.ndarray) -> np.ndarray:
        z = self.weights[:, 0][gate] * inputs[0]
        for k in range(1, len(inputs)):
            z += self.weights[:, k][gate] * inputs[k]
        return np.clip(z, -8, 8, out=z)

    def learn(self, gate: np.ndarray, inputs: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """One online pass: after every few bits the weights take a step. Gives what was predicted before each step."""
        out = np.empty(len(bit), np.float32)
        for at in range(0, len(bit), BLOCK_BITS):
            part = slice(at, at + BLOCK_BITS)
            g, x = gate[part], inputs[:, part]
            z = out[part] = self.mixed(g, x)
            error = bit[part] - 1 / (1 + np.exp(-z))
            n = np.maximum(np.bincount(g, minlength=GATES), 1)
            for k in range(len(x)):
                self.weights[:, k] += (RATE * np.bincount(g, error * x[k], GATES) / n).astype(np.float32)
        return out

    def refined(self, gate: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Probability of a one: the mixture and, between two steps of the map, what came true, half each."""
        at = (z + np.float32(8)) * np.float32((STEPS - 1) / 16)
        low = np.minimum(at.astype(np.int32), STEPS - 2)
        share = at - low.astype(np.float32)
        flat, cell = self.map.ravel(), gate * STEPS + low
        here = flat[cell]
        mapped = here + (flat[cell + 1] - here) * share
        half = np.float32(0.5)
        return np.clip(half / (1 + np.exp(-z)) + half * mapped, np.float32(1e-6), np.float32(1 - 1e-6))


def _spelling_slots(names: list[str] | pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order a slot for each letter of each word and its end; and where the words end."""
    names = pa.array(names, pa.string())
    ends = np.cumsum(pc.binary_length(names).to_numpy(zero_copy_only=False) + 1, dtype=np.int64)
    raw = len(names) > 0
    joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(names)], names), " ")[0].as_buffer().to_pybytes() + b" " if raw else b""
    letter = np.frombuffer(joined, np.uint8).astype(np.int64)
    letter[ends - 1] = LETTERS - 1
    place = np.arange(len(letter)) - np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, ends])) if raw else letter
    context, slots = np.zeros(len(letter), np.int64), []
    for order, size in enumerate(SPELL_SLOTS):
        if order:
            earlier = np.full(len(letter), LETTERS - 1, np.int64)
            earlier[order:] = letter[: max(0, len(letter) - order)]
            earlier[place < order] = LETTERS - 1
            context = context * 1_000_003 + earlier + 1
        slots.append((context * 0x9E3779B1 >> 7) % size * LETTERS + letter if size != LETTERS else earlier * LETTERS + letter)
    return slots, ends


class Spelling:
    """Probability of spelling a rare word: each letter from the four before it, drawing on fewer."""

    def __init__(self, counts: list[np.ndarray]):
        self.counts = counts
        self.totals = [c.reshape(-1, LETTERS).sum(1) for c in counts]

    def of(self, names: list[str] | pa.Array) -> np.ndarray:
        """log10 of each word's probability."""
        slots, ends = _spelling_slots(names)
        p = np.full(len(slots[0]), 1 / LETTERS)
        for counts, totals, slot in zip(self.counts, self.totals, slots):
            p = (counts[slot] + DRAWN * p) / (totals[slot // LETTERS] + DRAWN)
        sums = np.concatenate([[0.0], np.cumsum(np.log10(p))])
        return sums[ends] - sums[np.r_[0, ends[:-1]].astype(np.int64)] if len(names) else np.zeros(0)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, codes, vocabulary = words(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
            yield pa.RecordBatch.from_arrays([vocabulary, pa.array(np.bincount(codes, minlength=len(vocabulary)))], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """A trained model: word counts as a table, the code, a folder of context counts, and the mixer."""

    def __init__(self, vocabulary: DataFrame, texts: int):
        self.vocabulary = vocabulary
        facts = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.ends, self.tokens = texts, (facts["n"] or 0) + texts
        self.distinct = facts["v"] + (texts > 0)
        frequent = vocabulary.where("n > 1").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
        frequent.sort(key=lambda r: (-r["n"], r["word"]))
        self.counts = np.array([r["n"] for r in frequent], np.int64)
        self.rare = self.tokens - texts - int(self.counts.sum())
        times = {r["n"]: r["c"] for r in vocabulary.where("n <= 2").groupBy("n").agg(F.count("*").alias("c")).collect()}
        once, twice = times.get(1, 0), times.get(2, 0)
        #: what each rare word's count gives to words not seen, and their share of the rare tokens
        self.discount = min(0.7, once / (once + 2 * twice)) if once else 0.7
        self.unseen = max(0.01, self.discount * (facts["v"] - len(frequent)) / self.rare) if self.rare else 0.99
        self.code = Code([r["word"] for r in frequent], self.counts.tolist(), self.rare, texts)
        self.folder, self.mixer, self.shared = "", Mixer(), None

    def base(self, count: np.ndarray | float) -> np.ndarray:
        """log10 of the smoothed unigram share."""
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def train(docs: DataFrame) -> Model:
    """Learns from ``docs(text)``: words, then counts of every context, then weights, each over all texts."""
    spark = docs.sparkSession
    docs = docs.select("text")
    model = Model(store(word_counts(docs), "word-counts"), docs.count())
    shared = model.shared = spark.sparkContext.broadcast(model.code)
    sizes = model.code.counted()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole symbols are counted; their bits are told from these counts, once for the whole corpus
        code = shared.value
        held, one = [np.zeros(n, np.uint32) for n in sizes[:_SPELL]], np.uint32(1)
        for batch in slices(batches):
            symbols, before, *_ = code.symbols(batch.column("text"))
            for table, kinds in zip(held, before):
                np.add.at(table, symbols * CLASSES + kinds, one)
        for k, table in enumerate(held):
            yield _as_batch(list(_blocks(k, table)))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # every word once: words not seen yet are spelled like other words, not like frequent ones
        held = [np.zeros(n, np.uint32) for n in sizes[_SPELL:]]
        for batch in batches:
            for table, slot in zip(held, _spelling_slots(batch.column("word"))[0]):
                np.add.at(table, slot, np.uint32(1))
        for k, table in enumerate(held):
            yield _as_batch(list(_blocks(_SPELL + k, table)))

    blocks = docs.mapInArrow(count, _BLOCK).union(model.vocabulary.mapInArrow(spell, _BLOCK))
    model.folder = new_folder(spark, "context-counts")
    _merged(blocks).write.parquet(model.folder)
    folder = model.folder

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, mixer = shared.value, Mixer()
        stretched, trusts = _left_out(folder, code)
        true, seen = np.zeros((2, GATES, STEPS)), 0
        for batch in slices(batches):
            symbols, before, *_ = code.symbols(batch.column("text"))
            for _, _, bit, depth, slots in code.bits(symbols, before):
                inputs = np.empty((CONTEXTS + 1, len(bit)), np.float32)
                for k, slot in enumerate(slots):
                    if k == 1:
                        gate = depth * TRUSTS + trusts[slot]
                    inputs[k] = stretched[k][slot * 2 + bit]
                z = mixer.learn(gate, inputs, bit)
                cell = gate * STEPS + np.rint((z + 8) * ((STEPS - 1) / 16)).astype(np.int64)
                true += np.bincount(cell * 2 + bit, minlength=GATES * STEPS * 2).reshape(GATES, STEPS, 2).transpose(2, 0, 1)
                seen += len(bit)
        values = np.concatenate([(mixer.weights * seen).ravel(), true.ravel(), [seen]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["at", "value"])

    sums = {r["at"]: r["value"] for r in docs.mapInArrow(weigh, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()}
    if sums and sums[max(sums)] > 0:
        values, n = np.array([sums[i] for i in range(len(sums))]), GATES * (CONTEXTS + 1)
        model.mixer = Mixer(values[:n].reshape(GATES, -1) / values[-1], values[n:-1].reshape(2, GATES, STEPS))
    return model


_PARTIAL = "doc long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:string,n:long,spelled:double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, held_out, text)`` -> ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``.

    Frequent words are scored where the text is. Rare ones meet their counts by a join on the word: each is rarer
    than one in FREQUENT training tokens, and a text brings each of its words once.
    """
    spark = docs.sparkSession
    facts = (model.mixer, [float(model.base(c)) for c in model.counts], float(model.base(model.ends)))
    shared, of_code, folder = spark.sparkContext.broadcast(facts), model.shared, model.folder
    ends_known = int(model.ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, (mixer, bases, end_base) = of_code.value, shared.value
        stretched, trusts, spelling = _ready(folder, code)
        base_of = np.array([*bases, 0.0, end_base])
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            symbols, before, offsets, codes, names = code.symbols(batch.column("text"))
            by_token = mixed_scores(code, symbols, before, stretched, trusts, mixer)
            total = np.add.reduceat(by_token, offsets[:-1])
            base = np.add.reduceat(base_of[symbols], offsets[:-1])
            known = np.add.reduceat((symbols != code.escape).astype(np.int64), offsets[:-1]) - 1 + ends_known
            rare = rare_words(code, symbols, offsets, codes, names, spelling)
            columns = [
                pa.array(number + np.arange(batch.num_rows)),
                batch.column("doc_id"),
                batch.column("held_out"),
                *(pa.array(x) for x in (np.diff(offsets), known, base, total)),
                rare,
            ]
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PARTIAL.split(", ")])

    partial = store(docs.mapInArrow(run, _PARTIAL), "partial-scores")
    rare = partial.select("doc", F.explode("rare").alias("r")).select("doc", "r.*")
    met = rare.join(model.vocabulary.withColumnRenamed("n", "seen"), "word", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    share = (F.col("seen") - model.discount) / max(1, model.rare) + F.lit(model.unseen) * F.pow(F.lit(10.0), "spelled")
    logged = F.when(F.col("seen") > 0, F.log10(share)).otherwise(F.col("spelled") + math.log10(model.unseen))
    smooth = F.log10((F.col("seen") + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
    added = met.groupBy("doc").agg(
        F.sum(F.when(F.col("seen") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * smooth).alias("more_base"), F.sum(F.col("n") * logged).alias("more_score")
    )
    joined = partial.drop("rare").join(added, "doc", "left")
    plus = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        plus("n_known", "more_known", 0).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        plus("base", "more_base", 0.0).alias("base_score"),
        plus("score", "more_score", 0.0).alias("score"),
    )


def mixed_scores(code: Code, symbols: np.ndarray, before: np.ndarray, stretched: list[np.ndarray], trusts: np.ndarray, mixer: Mixer) -> np.ndarray:
    """log10 of each token's probability, worked out once for tokens of equal symbol and contexts."""
    key = symbols
    for kinds in before:
        key = key * CLASSES + kinds
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    out = np.zeros(len(first))
    for at, token, bit, depth, slots in code.bits(symbols[first], before[:, first]):
        inputs = np.empty((CONTEXTS + 1, len(bit)), np.float32)
        for k, slot in enumerate(slots):
            if k == 1:
                gate = depth * TRUSTS + trusts[slot]
            inputs[k] = stretched[k][slot]
        p = mixer.refined(gate, mixer.mixed(gate, inputs))
        n = int(token[-1]) + 1
        out[at : at + n] = np.bincount(token, np.log10(np.where(bit == 1, p, 1 - p)), n)
    return out[same]


def rare_words(code: Code, symbols: np.ndarray, offsets: np.ndarray, codes: np.ndarray, names: pa.Array, spelling: Spelling) -> pa.ListArray:
    """The distinct rare words of each text, how often it has them, and how likely they are spelled."""
    inner = np.ones(len(symbols), bool)
    inner[offsets[1:] - 1] = False
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[inner]
    here = symbols[inner] == code.escape
    pairs, n = np.unique(of[here] * len(names) + codes[here], return_counts=True)
    text, word = pairs // max(1, len(names)), pairs % max(1, len(names))
    used, at = np.unique(word, return_inverse=True)
    spelled = spelling.of(names.take(pa.array(used)))
    rows = pa.StructArray.from_arrays([names.take(pa.array(word)), pa.array(n, pa.int64()), pa.array(spelled[at], pa.float64())], ["word", "n", "spelled"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(offsets))), pa.int32()), rows)


def score_documents(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """Learns from the documents outside fold ``held`` and scores all, a row for each row.

    Null texts count as empty: one token, the end. A null doc_id counts as the empty text in folds. Without
    training texts every word is unknown, and the score is that of spelling with no counts. Other columns are
    ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == held).alias("held_out"), "text")
    return score(docs, train(docs.where("not held_out")))
