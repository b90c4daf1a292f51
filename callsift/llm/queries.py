"""The registered queries of the operators, and their DuckDB twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callsift.llm import license, oracles
from callsift.llm.bpe import encode_decode
from callsift.llm.clustering import cluster_vectors
from callsift.llm.embedding import embedding_duplicates
from callsift.llm.exact import exact_dedup
from callsift.llm.minhash import near_duplicates
from callsift.llm.packing import pack_documents
from callsift.llm.products import top_products
from callsift.llm.quality import classify_quality
from callsift.llm.resampling import importance_resample
from callsift.llm.sharding import shard_documents
from callsift.llm.substring import substring_dedup
from callsift.llm.toxicity import classify_toxicity

QUERIES = {}
ORACLES = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(function):
    QUERIES[function.__name__] = function
    return function


def vocabulary() -> str:
    """The byte-level BPE file of the installed public tokenizers, which every machine has."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(_table(spark, sf_dir, "documents"))


@_query
def op2_vector_sharding(spark, sf_dir):
    return shard_documents(_table(spark, sf_dir, "documents"))


@_query
def op4_bpe_codec(spark, sf_dir):
    return encode_decode(_table(spark, sf_dir, "documents"), vocabulary())


@_query
def op10_license_scan(spark, sf_dir):
    return license.scan_licenses(_table(spark, sf_dir, "documents"))


@_query
def op1_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


@_query
def op5_best_fit_packing(spark, sf_dir):
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary=vocabulary())


@_query
def op6_quality_classifier(spark, sf_dir):
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_toxicity(spark, sf_dir):
    return classify_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op7_substring_dedup(spark, sf_dir):
    return substring_dedup(_table(spark, sf_dir, "documents"))


@_query
def op8_nn_descent(spark, sf_dir):
    return embedding_duplicates(_table(spark, sf_dir, "embeddings"))


@_query
def op11_importance_resampling(spark, sf_dir):
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op12_centroid_clustering(spark, sf_dir):
    return cluster_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op13_top_products(spark, sf_dir):
    return top_products(_table(spark, sf_dir, "embeddings"))


ORACLES.update(
    op1_minhash_near_dedup=oracles.NEAR_DUPLICATES,
    op3_exact_dedup=oracles.EXACT_DEDUP,
    op7_substring_dedup=oracles.SUBSTRING_DEDUP,
    op8_nn_descent=oracles.EMBEDDING_DUPLICATES,
    op10_license_scan=license.oracle(),
    op11_importance_resampling=oracles.RESAMPLING,
    op12_centroid_clustering=oracles.clustering(),
    op13_top_products=oracles.TOP_PRODUCTS,
)
