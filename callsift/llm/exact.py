"""Exact deduplication by a content sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.llm.tables import SPACES, stored, whole_text

# Characters of the normalised text that enter the splitters; texts are compared whole.
SPLITTER_CHARS = 32

_RUNS = "id long, row long, length long, sha string, part int, run long, edge string"


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal texts in one sorted range.

    A row is compared with its predecessor on the whole text.  The first and
    the last row of the range also return their text (``edge``), since their
    runs may go on in the neighbouring ranges.
    """
    part, run, last = TaskContext.get().partitionId(), -1, None
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        norm = batch.column("norm")
        before = pa.concat_arrays([pa.array([last], pa.string()), norm.slice(0, len(norm) - 1)])
        changed = pc.fill_null(pc.not_equal(norm, before), True).to_numpy(zero_copy_only=False)
        runs = changed.cumsum() + run
        if held is not None:
            yield held.slice(0, held.num_rows)
        edges = [None] * len(norm)
        if last is None:
            edges[0] = norm[0].as_py()
        out = [batch.column(c) for c in ("id", "row", "length", "sha")]
        table = [*out, pa.array([part] * len(norm), pa.int32()), pa.array(runs, pa.int64())]
        run, last = int(runs[-1]), norm[-1].as_py()
        body = pa.RecordBatch.from_arrays([*table, pa.array(edges, pa.string())], names=_NAMES)
        if len(norm) > 1:
            yield body.slice(0, len(norm) - 1)
        held = body.slice(len(norm) - 1)
    if held is not None:
        yield pa.RecordBatch.from_arrays([*held.columns[:6], pa.array([last], pa.string())], names=_NAMES)


_NAMES = [field.split()[0] for field in _RUNS.split(", ")]


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """Group the documents whose texts are equal after deleting white space.

    Content sort: sampled splitters range-partition the normalised texts, each
    range is sorted (spilling to disk), and neighbours are compared on their
    whole texts.  Splitters hold a prefix, a hash and the id, so they stay small
    for long texts, and a text with a third of all rows is spread over many
    ranges.  Runs cut by a range border are put together again by the texts of
    the border rows, of which there are two per range.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``.  The row with the most code points in the original text
    stays, then the smallest id.  Null counts as the empty text; all empty texts
    are one group.  Rows with a null id take part and are kept only if their
    whole group has null ids.  Rows that repeat an id are separate rows; each
    that carries the id of the kept row is marked kept.  ``row_col`` names a
    column of numbers that tell all rows apart: it decides between rows of equal
    length and id, exactly one row of a group is kept, and the column is
    returned too.  Other columns are ignored.  An empty table gives an empty
    result.
    """
    text = whole_text(text_col)
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"),
        F.length(text).cast("long").alias("length"),
        F.translate(text, SPACES, "").alias("norm"),
    ).select(
        "*",
        F.sha2("norm", 256).alias("sha"),
        F.xxhash64("norm").alias("mix"),
        F.substring("norm", 1, SPLITTER_CHARS).alias("head"),
    )
    order = [F.desc("length"), F.asc_nulls_last("id"), *([F.col("row")] if row_col else [])]
    ranges = texts.repartitionByRange("head", "mix", *order)
    ordered = ranges.sortWithinPartitions("head", "mix", "norm", *order)
    rows = stored(ordered.select("id", "row", "length", "sha", "norm").mapInArrow(_mark_runs, _RUNS), "content-sort")

    best = F.min(F.struct((-F.col("length")).alias("rank"), F.col("id").isNull().alias("unnamed"), F.col("id"), F.col("row")))
    runs = rows.groupBy("part", "run").agg(F.count("*").alias("size"), best.alias("best"))
    at = F.struct("part", "run")
    borders = rows.where(F.col("edge").isNotNull()).select("edge", "part", "run").distinct()
    whole = borders.groupBy("edge").agg(F.min(at).alias("whole"))
    joined = borders.join(whole, "edge").select("part", "run", "whole")
    pieces = runs.join(joined, ["part", "run"], "left").withColumn("whole", F.coalesce("whole", at))
    groups = pieces.groupBy("whole").agg(
        F.sum("size").alias("group_size"), F.min("best").alias("first")
    )
    decided = pieces.join(groups, "whole").select(
        "part", "run", "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")
    )
    stays = F.col("row") == F.col("keep_row") if row_col else F.col("id").eqNullSafe(F.col("keep_id"))
    return rows.join(decided, ["part", "run"]).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        stays.alias("kept"),
        F.col("sha").alias("text_sha256"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )


def keep_first_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Without ``row_col`` the ids have to identify a row, and rows with a null id
    stay; with it exactly one row of each group stays, whatever the ids.
    """
    key = row_col or id_col
    found = exact_dedup(docs, id_col, text_col, row_col).where(~F.col("kept"))
    return docs.join(found.select(F.col(row_col or "doc_id").alias(key)), key, "left_anti")
