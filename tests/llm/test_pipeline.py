from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from callsift.llm.queries import ORACLES, QUERIES
from callsift.llm.tables import stored
from tests.llm import brute
from tests.llm.test_text_operators import exact_expected
from tests.parity import connect, difference

SF_DIR = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = set(queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    assert difference(spark, connect(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR) is None


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, tables = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), name)
        tables.append(docs)
    quality, exact, near, cut, packed = tables
    assert all(t.columns == columns for t in tables[:-1])

    def texts(df):
        return [(r.doc_id, r.text) for r in df.collect()]

    labels = pq.read_table(f"{SF_DIR}/labels.parquet").to_pylist()
    good = {r["doc_id"] for r in labels if r["quality"]}
    kept = {d for d, _ in texts(quality)}
    assert len(good - kept) <= 0.05 * len(good)
    assert sorted(d for d, *_, stays, _ in exact_expected(texts(quality)) if stays) == sorted(d for d, _ in texts(exact))
    groups = brute.near_duplicates(texts(exact), percent=80)
    assert {d for d, (_, c) in groups.items() if d == c} == {d for d, _ in texts(near)}
    plain = {d: (n, gone) for d, n, gone, _ in brute.substring_dedup(texts(near))}
    before = dict(texts(near))
    for row in cut.collect():
        n, gone = plain[row.doc_id]
        assert len(row.text.split()) == n - gone and row.n_chars == len(row.text)
        assert gone or row.text == before[row.doc_id]
    placed = packed.toPandas().groupby("doc_id")["n_tokens"].sum().to_dict()
    assert placed == {d: len(t.split()) for d, t in texts(cut)}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0


def test_stages_leave_one_row_of_copies_whatever_the_ids(spark):
    """A repeated row, a null-id copy, a near copy with a null id, and one id with two texts."""
    text, other, third = (" ".join(f"{letter}{i}" for i in range(80)) for letter in "abc")
    near = text.replace("a40", "changed")
    rows = [(1, text), (1, text), (None, text), (2, other), (2, third), (None, other), (None, near), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    docs = stored(stages["exact_dedup"](spark, docs, SF_DIR), "exact")
    found = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert sorted(found, key=str) == sorted([(1, text), (2, other), (2, third), (None, near), (None, "")], key=str)
    docs = stored(stages["minhash_near_dedup"](spark, docs, SF_DIR), "near")
    assert sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str) == sorted(
        [(1, text), (2, other), (2, third), (None, "")], key=str
    )
    docs = stored(stages["substring_dedup"](spark, docs, SF_DIR), "cut")
    assert docs.columns == columns and sorted(r.text or "" for r in docs.collect()) == sorted([text, other, third, ""])
