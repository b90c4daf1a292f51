"""Best-fit packing of documents into training sequences, with conflicts."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.llm.tables import WORD, whole_text
from callsift.llm.token_counts import load_counter

# Tokens of a sequence, and documents that one task packs together about.
CAPACITY = 2048
GROUP_ROWS = 2000


class Bins:
    """Open bins ordered by residual, each with bitmaps of its sources and clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = 0
        self.levels: list[int] = []  # the residuals that some bin has, ascending
        self.at: dict[int, list[tuple[int, int, int]]] = {}  # residual: (bin, sources, clusters), ascending

    def open(self) -> int:
        self.count += 1
        return self.count - 1

    def _keep(self, residual: int, entry: tuple[int, int, int]) -> None:
        if residual:
            if residual not in self.at:
                insort(self.levels, residual)
                self.at[residual] = []
            insort(self.at[residual], entry)

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, tokens already in it) of the tightest compatible bin, or of a new one.

        Successor search from the smallest residual that holds the piece goes on
        until a bin has neither its source nor its cluster.  Ties go to the bin
        opened first.
        """
        for level in range(bisect_left(self.levels, size), len(self.levels)):
            residual = self.levels[level]
            entries = self.at[residual]
            for place, (number, sources, clusters) in enumerate(entries):
                if not (sources & source or clusters & cluster):
                    del entries[place]
                    if not entries:
                        del self.at[residual]
                        del self.levels[level]
                    self._keep(residual - size, (number, sources | source, clusters | cluster))
                    return number, self.capacity - residual
        number = self.open()
        self._keep(self.capacity - size, (number, source, cluster))
        return number, 0


def pack(rows: Iterable[tuple], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``(row, size, source, cluster)``; see :func:`pack_documents`.

    Returns ``(row, piece, tokens, bin, offset)``.  Pieces of a whole capacity
    fill bins of their own; the rest of each document is placed in order of
    decreasing size, then of the rows' order.  A null source or cluster (None)
    conflicts with nothing.
    """
    bins, out, rest, sources, clusters = Bins(capacity), [], [], {}, {}

    def bit(table: dict, key) -> int:
        return 0 if key is None else table.setdefault(key, 1 << len(table))

    for row, size, source, cluster in rows:
        full, left = divmod(size, capacity)
        for piece in range(full):
            out.append((row, piece, capacity, bins.open(), 0))
        if left or not full:
            rest.append((left, row, full, bit(sources, source), bit(clusters, cluster)))
    for left, row, piece, source, cluster in sorted(rest, key=lambda r: -r[0]):
        if left:
            number, offset = bins.put(left, source, cluster)
        else:
            number, offset = -1, 0
        out.append((row, piece, left, number, offset))
    return out


def _token_counts(texts: DataFrame, vocabulary: str) -> DataFrame:
    """``n_words, n_tokens`` in place of ``text``: tokens as the codec of the vocabulary file makes them.

    A null ``cluster`` becomes that of the copies of the text.
    """
    kept = [f for f in texts.schema if f.name != "text"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load_counter(vocabulary)
        for batch in batches:
            words, clusters = [], batch.column("cluster").to_pylist()
            for at, scalar in enumerate(batch.column("text")):
                # Bytes are split at U+0020 and U+0009 to U+000D, as the words of the other operators.
                own = scalar.as_py().lower().encode().split()
                words.append(len(own))
                if clusters[at] is None:
                    clusters[at] = hashlib.md5(b" ".join(own)).hexdigest()
            columns = [pa.array(clusters, pa.string()) if f.name == "cluster" else batch.column(f.name) for f in kept]
            columns += [pa.array(words, pa.int64()), pa.array(counter.count(batch.column("text")), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in kept], "n_words", "n_tokens"])

    return texts.mapInArrow(run, f"{fields}, n_words long, n_tokens long")


def pack_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    vocabulary: str | None = None,
    tokens_col: str | None = None,
) -> DataFrame:
    """Pack documents into bins of ``capacity`` tokens by conflict-constrained best fit.

    Tokens are those of the byte-level BPE file ``vocabulary``, which all
    executors have, or counts that ``tokens_col`` holds already (null: none);
    with neither, words count as tokens.
    No bin holds two documents of one source, nor two of one cluster; each bin
    carries bitmaps of both.  ``cluster_col`` names the clusters, for instance
    the components of near duplicates; without it, and where it is null, a
    cluster is the copies of one text (compared by the MD5 of its words in lower
    case).  Documents are dealt by a hash into groups of about ``group_rows``
    rows, each packed in one task, so memory and the search stay bounded and a
    hot source is spread over all groups.  A document longer than a bin is cut
    into pieces of whole bins and a rest.

    Returns one row per piece: ``doc_id, piece, n_tokens, n_words, bin,
    bin_offset``, with ``bin`` as "group-number".  A document without tokens (an
    empty or null text) has one piece of 0 tokens and a null bin.  Repeated rows
    are separate documents and conflict as copies; null sources conflict with
    nothing.  Other columns are ignored; an empty table gives an empty result.
    """
    text = whole_text(text_col)
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    source = F.col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    copies = F.md5(F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))))
    given = F.concat(F.lit("="), F.col(cluster_col).cast("string")) if cluster_col else F.lit(None).cast("string")
    total = docs.select(F.count("*")).scalar()
    named = [
        F.col(id_col).cast("long").cast("string").alias("doc_id"),
        source.alias("source"),
        F.monotonically_increasing_id().alias("row"),
    ]
    if vocabulary and not tokens_col:
        sized = _token_counts(docs.select(*named, given.alias("cluster"), text.alias("text")), vocabulary)
    else:
        tokens = F.coalesce(F.col(tokens_col).cast("long"), F.lit(0).cast("long")) if tokens_col else words
        sized = docs.select(
            *named, F.coalesce(given, copies).alias("cluster"), words.alias("n_words"), tokens.alias("n_tokens")
        )
    groups = F.greatest(F.lit(1).cast("long"), F.ceil(total / F.lit(group_rows)))
    dealt = sized.withColumn("grp", F.pmod(F.xxhash64("doc_id", "row"), groups))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row").reset_index(drop=True)
        sources = [None if pd.isna(s) else s for s in frame["source"]]
        rows = zip(range(len(frame)), frame["n_tokens"].tolist(), sources, frame["cluster"], strict=True)
        packed = pd.DataFrame(pack(rows, capacity), columns=["at", "piece", "n_tokens", "number", "bin_offset"])
        of = frame.iloc[packed["at"]].reset_index(drop=True)
        packed["doc_id"], packed["n_words"] = of["doc_id"], of["n_words"]
        name = of["grp"].astype("int64").astype(str) + "-" + packed["number"].astype(str)
        packed["bin"] = name.where(packed["number"] >= 0, None)
        return packed[["doc_id", "piece", "n_tokens", "n_words", "bin", "bin_offset"]]

    schema = "doc_id string, piece int, n_tokens long, n_words long, bin string, bin_offset long"
    placed = dealt.groupBy("grp").applyInPandas(place, schema)
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))
