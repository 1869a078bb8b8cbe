"""A corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes all that its predecessor kept, as Parquet that was written
and read again, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import discard, materialise, table
from rivulet.llm.decontaminate import clean
from rivulet.llm.packing import pack
from rivulet.llm.repeats import cut_repeats
from rivulet.llm.simhash import keep_one
from rivulet.llm.toxicity import keep_civil


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject as toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return keep_civil(docs, docs, labels)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id."""
    return keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words or more that an earlier place has."""
    return cut_repeats(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with the sequence and place of each."""
    return pack(docs)


STAGES = [
    ("toxicity", civil),
    ("near_duplicates", one_of_each),
    ("repeated_passages", without_repeats),
    ("decontamination", without_leaks),
    ("packing", packed),
]

#: No SQL: fingerprints by XXH64, fitted models and token ids aren't SQL's to give.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each one's rows written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
