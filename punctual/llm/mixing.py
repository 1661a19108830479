"""Mixing sources to target weights: raking to source, language and topic marginals, then sampling.

Tokens are summed by (source, language, topic) cell. Iterative proportional fitting finds a factor for each
source, language and topic such that the weighted tokens have the target shares; documents are then sampled with
probabilities in proportion to their cell's weight.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm.common import slices, store, words

TOPICS = 8
#: Letters from which a word says something about a topic.
TOPICAL = 7
#: Targets are the tokens' own shares to this power, normalised, unless others are given.
FLATTEN = 0.7
ROUNDS, TOLERANCE = 60, 1e-9
#: Sources up to which their factors are sent to every task; beyond it they are joined.
SENT_SOURCES = 50_000
SEED = "mix"


def with_topics(docs: DataFrame) -> DataFrame:
    """Adds ``_tokens`` (words) and ``_topic``: the part of the vocabulary that most of a text's longer words are in.

    Parts are equal shares of the word hashes; ties go to the smaller number, and a text without longer words
    (a null one too) has topic 0.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "_tokens long", "_topic int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            offsets, codes, vocabulary = words(batch.column("text"))
            part = np.array([xxhash.xxh64_intdigest(w.lower()) % TOPICS if len(w) >= TOPICAL else -1 for w in vocabulary.to_pylist()], np.int64)
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            said = part[codes] >= 0
            counts = np.bincount(of[said] * TOPICS + part[codes][said], minlength=batch.num_rows * TOPICS)
            topic = counts.reshape(-1, TOPICS).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(offsets)), pa.array(topic)], [*batch.schema.names, "_tokens", "_topic"])

    return docs.mapInArrow(run, schema)


def _class(name: str) -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _target(own: Mapping, given: Mapping | None, power: float) -> dict:
    shares = {k: float(given.get(k, 0.0)) if given is not None else v**power if v else 0.0 for k, v in own.items()}
    total = sum(shares.values())
    return {k: v / total for k, v in shares.items()} if total else dict.fromkeys(shares, 0.0)


class Weights:
    """Factors of a fitted mixture; a document's weight is their product."""

    def __init__(self, sources: DataFrame, languages: dict[str, float], topics: np.ndarray, largest: float, rounds: int):
        self.sources, self.languages, self.topics, self.largest, self.rounds = sources, languages, topics, largest, rounds


def rake(cells: DataFrame, source_targets: DataFrame | None = None, languages: Mapping | None = None, topics: Mapping | None = None, power: float = FLATTEN) -> Weights:
    """``cells(source, lang, topic, tokens)`` -> factors that give the weighted tokens the target marginals.

    Targets are shares: ``source_targets(source, target)`` and mappings by language and by topic; classes that a
    given target leaves out get nothing, and those without tokens are left out. Sources may be many: each
    round is one aggregation over the cells, which solves every source's factor where its cells are, and the
    driver only sees a number for each language and topic. Ends when the marginals hold, or after ROUNDS
    (empty cells can make targets impossible to meet together).
    """
    cells = store(cells.where("tokens > 0"), "cells")
    tokens = {(r["lang"], r["topic"]): float(r["n"]) for r in cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("n")).collect()}
    own_l, own_t = {}, {}
    for (lang, topic), n in tokens.items():
        own_l[lang], own_t[topic] = own_l.get(lang, 0) + n, own_t.get(topic, 0) + n
    names, numbers = sorted(own_l), sorted(own_t)
    target_l = np.array([_target(own_l, languages, power)[x] for x in names])
    target_t = np.array([_target(own_t, topics, power)[x] for x in numbers])
    by_source = cells.groupBy("source").agg(F.sum("tokens").alias("n"))
    if source_targets is None:
        by_source = by_source.withColumn("target", F.pow("n", F.lit(power)))
    else:
        by_source = by_source.join(source_targets.select("source", "target"), "source", "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    by_source = store(by_source.select("source", F.col("target").cast("double")), "sources")
    total = by_source.agg(F.sum("target")).first()[0] or 1.0
    # a row for each source: its target and its tokens by language and topic
    rows = cells.groupBy("source").agg(F.collect_list(F.struct("lang", "topic", "tokens")).alias("cells"))
    rows = store(rows.join(by_source, "source").select("source", (F.col("target") / total).alias("target"), "cells"), "by-source")
    g, h = np.ones(len(names)), np.ones(len(numbers))

    def factors(g: np.ndarray, h: np.ndarray) -> DataFrame:
        if not names:
            return rows.select("source", F.lit(0.0).alias("factor"), "cells")
        of_l = F.create_map(*[F.lit(x) for p in zip(names, g.tolist()) for x in p])
        of_t = F.create_map(*[F.lit(x) for p in zip(numbers, h.tolist()) for x in p])
        weighted = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["tokens"] * of_l[c["lang"]] * of_t[c["topic"]])
        return rows.select("source", F.coalesce(F.try_divide("target", weighted), F.lit(0.0)).alias("factor"), "cells")

    done = 0
    for done in range(1, ROUNDS + 1):
        each = factors(g, h).select("factor", F.explode("cells").alias("c")).groupBy("c.lang", "c.topic")
        held = np.zeros((len(names), len(numbers)))
        for r in each.agg(F.sum(F.col("factor") * F.col("c.tokens")).alias("n")).collect():
            held[names.index(r["lang"]), numbers.index(r["topic"])] = r["n"]
        now = held * g[:, None] * h
        off = max(np.abs(now.sum(1) - target_l).max(initial=0), np.abs(now.sum(0) - target_t).max(initial=0))
        if off < TOLERANCE:
            break
        for _ in range(200):  # with the sources' factors held
            g = np.divide(target_l, held @ h, out=np.zeros_like(g), where=held @ h > 0)
            h = np.divide(target_t, g @ held, out=np.zeros_like(h), where=g @ held > 0)
            if np.abs(g * (held @ h) - target_l).max(initial=0) < TOLERANCE / 10:
                break
    fitted = store(factors(g, h), "fitted")
    of_l, of_t = dict(zip(names, g.tolist())), dict(zip(numbers, h.tolist()))
    largest = 0.0
    if names:
        maps = [F.create_map(*[F.lit(x) for p in m.items() for x in p]) for m in (of_l, of_t)]
        weight = F.array_max(F.transform("cells", lambda c: maps[0][c["lang"]] * maps[1][c["topic"]]))
        largest = fitted.agg(F.max(F.col("factor") * weight)).first()[0] or 0.0
    return Weights(fitted.select("source", "factor"), of_l, np.array([of_t.get(t, 0.0) for t in range(max(of_t, default=0) + 1)]), largest, done)


def sample(docs: DataFrame, **targets) -> DataFrame:
    """``docs(doc_id, text, source, lang, ...)`` with ``_tokens``, ``_topic``, ``_weight``, ``_probability``, ``_kept``.

    Probabilities are weights over the largest one, so the kept tokens have the target shares in expectation. A
    document is kept by a hash of its id: repeated rows share their fate, and so do rows without an id. Null
    sources and languages count as the empty text; texts without words are kept with probability of their cell,
    or 0 where it has no tokens.
    """
    docs = with_topics(docs)
    keyed = docs.select(_class("source").alias("source"), _class("lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"))
    weights = rake(keyed.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), **targets)
    sources = weights.sources.select(F.col("source").alias("_source"), F.col("factor").alias("_factor"))
    if sources.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES:
        sources = F.broadcast(sources)
    joined = docs.join(sources, _class("source") == F.col("_source"), "left")
    pairs = [F.lit(x) for p in weights.languages.items() for x in p]
    of_l = F.create_map(*pairs)[_class("lang")] if pairs else F.lit(0.0)
    of_t = F.try_element_at(F.array(*[F.lit(float(x)) for x in weights.topics]), F.col("_topic") + 1)
    weight = F.coalesce(F.col("_factor") * of_l * of_t, F.lit(0.0))
    chance = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(1 << 53)) / float(1 << 53)
    out = joined.withColumn("_weight", weight).withColumn("_probability", F.col("_weight") / F.lit(weights.largest or 1.0))
    return out.withColumn("_kept", chance < F.col("_probability")).drop("_source", "_factor")


def mixture(docs: DataFrame, **targets) -> DataFrame:
    """A row for each document: ``doc_id, source, lang, topic, n_tokens, weight, probability, kept``."""
    got = sample(docs.select("doc_id", "text", "source", "lang"), **targets)
    return got.select("doc_id", "source", "lang", *[F.col(a).alias(b) for a, b in (("_topic", "topic"), ("_tokens", "n_tokens"), ("_weight", "weight"), ("_probability", "probability"), ("_kept", "kept"))])
