"""The training-data pipeline: each stage works on what the one before it kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.llm.exact import keep_first_copies
from callsift.llm.minhash import keep_one_per_component
from callsift.llm.packing import pack_documents
from callsift.llm.quality import fit_quality, held_out, keep_quality
from callsift.llm.substring import cut_repeats
from callsift.llm.tables import delete_tables, noting_tables, stored

# The intermediate tables of the stage that ran last.
_tables: list = []


def _stage(function):
    """A stage that first deletes the intermediate tables of the one before it.

    The result of a stage is written before the next stage starts.
    """

    @functools.wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_tables(_tables)
        with noting_tables(_tables):
            return function(spark, docs, sf_dir)

    return staged


# Tells the rows of a stage apart, whatever their ids.
ROW = "__callsift_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own in each row, written once so that all scans see the same."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


@_stage
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_quality(docs, fit_quality(docs, labels.where(~held_out("doc_id", 3, 1))))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: most code points, then smallest id, whatever the ids."""
    return keep_first_copies(_numbered(docs), row_col=ROW).select(docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates (similarity 0.8 or more) stays, the one with the smallest id."""
    return keep_one_per_component(_numbered(docs), row_col=ROW, percent=80).select(docs.columns)


@_stage
def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also stand elsewhere are cut out; every document stays, ``n_chars`` follows its text."""
    cut = cut_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    kind = docs.schema["n_chars"].dataType
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: see :func:`pack_documents`."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeats),
    ("best_fit_packing", pack_sequences),
]

# A trained classifier and a greedy packing cannot be expressed in SQL; the tests
# hold the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the last stage's result is lazy, the others are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if at == len(STAGES) - 1:
            return result
        docs = stored(result, f"pipeline-{name}")
    return docs
