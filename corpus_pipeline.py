"""A training-corpus pipeline of five stages over ``documents``; each works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm import langid, mixing, nearcopies, packing, substring
from punctual.llm.common import fold, packed, read, store, unpacked

#: Probability that a document's language must have to stay.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay: those without a letter, or torn between languages, go."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2), path)
    told = langid.predict(packed(docs, "text"), model, path)
    kept = told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return unpacked(kept, docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word Jaccard of 0.8 or more) the document of smallest id stays."""
    return nearcopies.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that an earlier document holds are cut out of the texts; all documents stay."""
    cut, length = substring.remove(docs), F.char_length("text").cast("long")
    return cut.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to flattened shares of source, language and topic."""
    return unpacked(mixing.sample(packed(docs, "doc_id", "text", "source", "lang")).where("_kept"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a training sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: No SQL expresses the first stage; the stages are tested one by one against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is a written table that the next one reads."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
