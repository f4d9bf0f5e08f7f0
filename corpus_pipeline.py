"""The corpus pipeline: documents in, packed training sequences out.

Quality classifier, toxicity, SimHash near-dedup, temperature mixing, packing. Each stage is
written as Parquet and read again as the next one's documents.

All stages: a null or empty text is a text without words; a null id is no id, and its row stays a
row of its own; repeated rows and ids are rows of their own, unless a stage is there to join them;
texts of any length are read whole; an empty table gives an empty table; other columns, whatever
their names, pass as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxwood.llm import mixing, packing, quality, simhash, toxicity
from boxwood.llm.common import materialise, table
from boxwood.llm.labelled import labelled_sample

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; a text without words is judged as a
    window of spaces."""
    net = quality.fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", quality.PER_CLASS))
    return quality.keep_good(docs, net)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic; a text without words has no hit."""
    lexicon = toxicity.learn(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", toxicity.PER_CLASS))
    return toxicity.drop_toxic(docs, lexicon)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more in five-word shingles: that with
    the least id, one with an id before one without. Texts without words are one group."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight takes them; none is lost. A null source is a
    source of its own; a text without words is one token."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 ids; a text without words is the end id alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifiers, fingerprints and tokenizer have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None
