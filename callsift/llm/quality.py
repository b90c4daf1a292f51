"""Quality classifier: naive Bayes features with a linear hinge-loss model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.llm.text import Words, text_blocks

# Hashed n-gram features: a power of two.
FEATURE_BITS = 18
# Labelled rows that the model is fitted on at most, chosen by a hash of the id.
SAMPLE_ROWS = 8_192

# Classes of bytes for the shape n-grams: letters, digits and bytes outside ASCII
# count by kind, every other byte by itself.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[0x41:0x5B] = 0x41
_KIND[0x61:0x7B] = 0x61
_KIND[0x30:0x3A] = 0x30
_KIND[0x80:] = 0x61

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _bucket(codes: np.ndarray, kind: int) -> np.ndarray:
    """Feature numbers of n-gram codes; kinds of n-grams are told apart."""
    mixed = (codes.astype(np.uint64) * np.uint64(8) + np.uint64(kind + 1)) * _GOLD
    return (mixed >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def features(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The distinct features of one text, from its bytes and word hashes.

    N-grams are indicators: three bytes in a row, four runs of byte kinds in a
    row, and which of four words in a row are the same word.
    """
    seen = np.zeros(1 << FEATURE_BITS, dtype=bool)
    if len(data) >= 3:
        wide = data.astype(np.uint64)
        seen[_bucket(wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:], 0)] = True
    kinds = _KIND[data]
    runs = kinds[np.flatnonzero(np.diff(kinds, prepend=np.uint8(0)))].astype(np.uint64) if len(data) else kinds
    if len(runs) >= 4:
        codes = np.zeros(len(runs) - 3, dtype=np.uint64)
        for at in range(4):
            codes = codes << np.uint64(8) | runs[at : at + len(codes)]
        seen[_bucket(codes, 1)] = True
    if len(words) >= 4:
        w = [words[at : len(words) - 3 + at] for at in range(4)]
        same = (w[0] == w[1]) * 1 + (w[1] == w[2]) * 2 + (w[2] == w[3]) * 4 + (w[0] == w[2]) * 8 + (w[1] == w[3]) * 16
        seen[_bucket(same, 2)] = True
    return np.flatnonzero(seen)


def text_features(texts: pa.Array) -> Iterator[np.ndarray]:
    """The features of each text of a batch."""
    for _, data, offsets in text_blocks(texts):
        words = Words(data, offsets)
        hashes = words.hashes()
        for at in range(len(offsets) - 1):
            own = hashes[words.first[at] : words.first[at + 1]]
            yield features(data[offsets[at] : offsets[at + 1]], own)


class NBSVM:
    """Indicators scaled by class log-count ratios, then a linear support vector machine.

    The machine is fitted by dual coordinate descent on the L2-regularised hinge
    loss; its margin becomes a probability by a logistic fit on the same rows.
    """

    def __init__(self, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 30, seed: int = 7):
        self.smoothing, self.cost, self.epochs, self.seed = smoothing, cost, epochs, seed
        self.weights = np.zeros(1 << FEATURE_BITS)
        self.bias, self.slope, self.shift = 0.0, 1.0, 0.0

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> NBSVM:
        """Without rows of both classes the score is the smoothed share of label 1."""
        labels = np.asarray(labels, dtype=bool)
        if labels.all() or not labels.any():
            share = (labels.sum() + 1.0) / (len(labels) + 2.0)
            self.slope, self.shift = 0.0, float(np.log(share / (1 - share)))
            return self
        size = 1 << FEATURE_BITS
        counts = [self._counts([r for r, y in zip(rows, labels, strict=True) if y == side]) for side in (True, False)]
        ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
        # Each row is brought to length one; the constant feature has the value 1.
        # The values of all rows are one array: freed as a whole, it goes back to the system.
        ends = np.cumsum([len(row) for row in rows])
        scaled = np.split(np.empty(ends[-1]), ends[:-1])
        for row, values in zip(rows, scaled, strict=True):
            values[:] = ratio[row]
            norm = np.sqrt(values @ values)
            if norm:
                values /= norm
        signs = np.where(labels, 1.0, -1.0)
        # Both classes get the same total cost.
        caps = self.cost * np.where(labels, len(labels) / (2 * labels.sum()), len(labels) / (2 * (~labels).sum()))
        alpha, weights, bias = np.zeros(len(rows)), np.zeros(size), 0.0
        order, random = np.arange(len(rows)), np.random.default_rng(self.seed)
        for _ in range(self.epochs):
            random.shuffle(order)
            moved = 0.0
            for at in order:
                row, values, sign = rows[at], scaled[at], signs[at]
                gradient = sign * (weights[row] @ values + bias) - 1.0
                new = min(max(alpha[at] - gradient / (values @ values + 1.0), 0.0), caps[at])
                step = (new - alpha[at]) * sign
                if step:
                    weights[row] += step * values
                    bias += step
                    alpha[at] = new
                    moved = max(moved, abs(step))
            if moved < 1e-3:
                break
        self.ratio, self.weights, self.bias = ratio, weights * ratio, bias
        self._calibrate(np.array([self.margin(row) for row in rows]), labels)
        return self

    def _counts(self, rows: list[np.ndarray]) -> np.ndarray:
        """The smoothed number of rows with each feature, a block of rows at a time."""
        total = np.zeros(1 << FEATURE_BITS, dtype=np.int64)
        for at in range(0, len(rows), 256):
            total += np.bincount(np.concatenate(rows[at : at + 256]), minlength=len(total))
        return total + self.smoothing

    def margin(self, row: np.ndarray) -> float:
        values = self.ratio[row] if hasattr(self, "ratio") else np.zeros(len(row))
        norm = np.sqrt(values @ values)
        return float(self.weights[row].sum() / norm + self.bias) if norm else self.bias

    def _calibrate(self, margins: np.ndarray, labels: np.ndarray) -> None:
        """Logistic fit of the labels on the margins by Newton steps, with a small ridge."""
        slope, shift = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
            weight, error = p * (1 - p) + 1e-6, p - labels
            gradient = np.array([error @ margins + 1e-2 * slope, error.sum()])
            cross = weight @ margins
            hessian = np.array([[weight @ margins**2 + 1e-2, cross], [cross, weight.sum()]])
            step = np.linalg.solve(hessian, gradient)
            slope, shift = slope - step[0], shift - step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.slope, self.shift = float(slope), float(shift)

    def score(self, row: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(row) + self.shift, -60, 60))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts of at most ``rows`` labelled documents, chosen by a hash of the id.

    The chosen labels are at most ``rows`` pairs of numbers, so they are sent to
    the scan of the documents.  Of rows with one id the text of the smallest hash
    is taken, so the sample has at most ``rows`` rows however often ids repeat;
    only texts of chosen ids are shuffled, one per id and task.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = F.coalesce("text", F.lit(""))
    one = F.min_by(own, F.struct(F.xxhash64(own), own)).alias("text")
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(one).select("doc_id", "text", "label")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> NBSVM:
    """Fit on a bounded sample: at most ``rows`` feature lists go to the driver."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.astype(np.int32) for f in text_features(batch.column("text"))]
            packed = pa.array([f.tobytes() for f in found], pa.binary())
            arrays = [batch.column("doc_id"), batch.column("label"), packed]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "label", "features"])

    sample = labelled_sample(docs, labels, label, rows)
    table = sample.mapInArrow(extract, "doc_id long, label int, features binary").toArrow()
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    marks = table["label"].to_numpy()
    # Views of the table, without a copy.
    lists = [np.frombuffer(packed.as_buffer(), dtype=np.int32) for packed in table["features"]]
    model = NBSVM().fit([lists[at] for at in order], marks[order])
    del lists, table
    pa.default_memory_pool().release_unused()
    return model


def quality_scores(docs: DataFrame, model: NBSVM, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).

    Only the text enters the score.  Null counts as the empty text, which has no
    features and gets the score of the bias.  Columns of these two names are
    replaced; all others pass.  One pass without a shuffle; the model has a
    fixed size.
    """
    kept = docs.drop("score", "predicted")
    names = kept.columns
    schema = kept.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            scores = np.array([model.score(row) for row in text_features(texts)], dtype=float)
            predicted = pa.array((scores >= threshold).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), predicted], names=schema.names)

    return kept.mapInArrow(run, schema)


def keep_quality(docs: DataFrame, model: NBSVM, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least the threshold, with all their columns."""
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = text_features(batch.column(at).cast(pa.string()))
            keep = pa.array([model.score(row) >= threshold for row in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Score all documents for quality with a model learnt from the labels.

    Rows whose ``crc32(doc_id)`` modulo 3 is 1 are held out of the fit.  Returns
    one row per input row: ``doc_id, held_out, score, predicted``.  Null and empty
    texts have no features and get the score of the bias; a text of any length
    is scored as a whole.  Documents with a null id are scored and not held out;
    labels with nulls or other values are not learnt from, and of repeated labels
    of one id the larger counts.  Repeated ids are scored each, and learnt from
    once.  Without labels every score is 0.5; an empty table gives an empty
    result.  Other columns are ignored.
    """
    model = fit_quality(docs, labels.where(~held_out("doc_id", 3, 1)), rows=rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = quality_scores(texts, model)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether the CRC-32 of the id in decimal has this remainder; false for null ids."""
    checksum = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    return F.coalesce(checksum % modulus == remainder, F.lit(False))
