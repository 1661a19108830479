"""One-permutation MinHash fingerprints, in DataFrame functions only.

Each word shingle is hashed once; the top bits of a hash choose its bin and a bin keeps its smallest hash. An
empty bin takes the value of another, drawn again and again by a fixed rule until one is filled (optimal
densification). The low bits of all bins are packed into a text of hexadecimal digits, and the share of equal
digits, less what chance gives, estimates how alike two texts are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm.common import store

SHINGLE = 5
#: Bins, as a power of two, and kept bits of each, one hexadecimal digit.
BIN_BITS, BITS = 7, 4
BINS = 1 << BIN_BITS
#: Draws of an empty bin before its whole order of bins is looked through.
DRAWS = 16
#: Rows that share a window partition, about, and the shares of the ids that are told apart by quantiles.
BUCKET_ROWS, QUANTILES = 1000, 256
_WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """A hash for each run of five words (fewer words: one for all; none: an empty array)."""
    trimmed = F.btrim(text, F.lit(_WHITE))
    hashed = F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))
    runs = let(
        hashed,
        lambda h: F.when(
            F.size(h) >= SHINGLE,
            F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)])),
        ).otherwise(F.array(F.xxhash64(h))),
    )
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<long>")).otherwise(runs)


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS)


def _digits(filled: Column) -> Column:
    """Packed low bits of all bins; ``filled`` has a hash for each bin, null for an empty one."""

    def donor(j: Column, draws: int) -> Column:
        # an odd step visits every bin; start and step are hashes of the empty one
        first, step = F.pmod(F.xxhash64(j), F.lit(BINS)), F.pmod(F.xxhash64(j, F.lit(1)), F.lit(BINS // 2)) * 2 + 1

        def drawn(a: Column, at: Column) -> Column:
            return F.get(filled, F.pmod(F.get(at, F.lit(0)) + a * F.get(at, F.lit(1)), F.lit(BINS)).cast("int"))

        return let(
            F.array(first, step),
            lambda at: let(
                F.get(F.filter(F.sequence(F.lit(0), F.lit(draws - 1)), lambda a: drawn(a, at).isNotNull()), F.lit(0)),
                lambda a: drawn(a, at),
            ),
        )

    def digit(j: Column) -> Column:
        value = F.coalesce(F.get(filled, j), donor(j, DRAWS), donor(j, BINS))
        # hashed with its bin, so that a value that fills many bins gives each other bits
        low = F.xxhash64(value, j).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
        return F.substring(F.lit("0123456789abcdef"), low + 1, 1)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), digit), "")


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text; a null text or one without words has the empty fingerprint."""

    def firsts(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(ordered, i - 1))))

    def spread(least: Column) -> Column:
        bins = F.transform(least, _bin)
        half = BINS // 2
        return let(
            bins,
            lambda there: F.transform(
                F.sequence(F.lit(-half).cast("long"), F.lit(half - 1).cast("long")), lambda b: F.get(least, F.array_position(there, b).cast("int") - 1)
            ),
        )

    def of(ordered: Column) -> Column:
        return F.when(F.size(ordered) == 0, F.lit("")).otherwise(let(firsts(ordered), lambda least: let(spread(least), _digits)))

    return let(F.sort_array(shingle_hashes(text)), of)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles: equal digits, less those that are equal by chance, from 0 to 1.

    Two empty fingerprints are alike (1); an empty one is like no other (0).
    """
    chance = 1 / (1 << BITS)
    equal = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)))) / BINS
    estimate = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(estimate)


def _bucketed(rows: DataFrame) -> DataFrame:
    """Adds ``quantile`` and ``bucket``, which do not rise along the order (doc_id descending, nulls last, hash descending)."""
    shares = [i / QUANTILES for i in range(1, QUANTILES)]
    facts = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.percentile_approx("doc_id", shares, 10_000).alias("cuts")).first()
    cuts = sorted({facts["low"], *(facts["cuts"] or []), facts["high"]} - {None}) or [0]
    parts = max(1, -(-facts["n"] // (QUANTILES * BUCKET_ROWS)))
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    quantile = F.size(F.filter(edges, lambda c: c <= F.col("doc_id"))) - 1
    low = F.get(edges, F.col("quantile")).cast("double")
    width = F.coalesce(F.get(edges, F.col("quantile") + 1), F.get(edges, F.col("quantile"))).cast("double") - low + 1
    within = F.least(F.lit(parts - 1), F.floor((F.col("doc_id") - low) / width * parts))
    # rows without an id: by their texts' hashes
    alone = F.shiftright("hash", 54) - 512 - 1
    rows = rows.withColumn("quantile", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(quantile))
    return rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), alone).otherwise(F.col("quantile") * parts + within).cast("long"))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, text, fingerprint, next_text, next_fingerprint)``.

    The next document in descending order of ids, nulls last; the last one's next is the first. Rows are dealt to
    buckets along that order, and each bucket also gets the first row of the next one, so texts are shuffled
    once and no task holds more than a bucket.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).withColumn("hash", F.xxhash64("text"))
    rows = _bucketed(rows)
    heads = rows.groupBy("quantile", "bucket").agg(F.max(F.struct("doc_id", "hash")).alias("head"))
    heads = store(heads.select("quantile", "bucket", "head.*"), "heads")
    along = Window.partitionBy("quantile").orderBy(F.desc("bucket"))
    ends = heads.groupBy("quantile").agg(F.min("bucket").alias("least"))
    # a row for each quantile, so the window without a partition is small
    round_ = Window.orderBy(F.desc("quantile"))
    ends = ends.withColumn("prior", F.coalesce(F.lag("least").over(round_), F.min("least").over(Window.partitionBy())))
    heads = heads.withColumn("prior", F.lag("bucket").over(along)).join(ends.select("quantile", F.col("prior").alias("last")), "quantile")
    heads = store(heads.select("bucket", "doc_id", "hash", F.coalesce("prior", "last").alias("to")), "heads")
    same = (F.col("r.bucket") == F.col("h.bucket")) & F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("r.hash") == F.col("h.hash"))
    extra = rows.alias("r").join(heads.alias("h"), same).select("r.doc_id", "r.text", "r.hash", F.col("h.to").alias("bucket"), F.lit(1).alias("extra"))
    every = rows.select("doc_id", "text", "hash", "bucket", F.lit(0).alias("extra")).unionByName(extra)
    every = every.withColumn("fingerprint", fingerprint(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), F.desc("hash"))
    every = every.withColumns({"next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)})
    return every.where("extra = 0").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, a row for each row.

    ``docs(doc_id, text)`` -> ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)``. Null texts count as empty; rows without an id come last in the order, and rows of one id are
    ordered by a hash of their texts. Other columns are ignored.
    """
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    got = with_next(docs).withColumn("edited", edited)
    got = got.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return got.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
