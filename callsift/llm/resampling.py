"""Importance resampling towards a target: n-gram buckets from running CRCs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.llm.tables import number_rows, stored

# Words of the longest feature, buckets, seed, words that a drawn document has at least, percent drawn.
NGRAM, BUCKETS, SEED, LEAST_WORDS, PERCENT = 2, 10_000, 7, 20, 25
# Bytes of a text that are cut into words at once.
PIECE_BYTES = 1 << 20

# The reversed polynomial of CRC-32 (fixed value).
_POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)
_BYTE = np.uint32(0xFF)

# Lower case for A-Z, a space for all ASCII but digits and letters; other bytes stay.
_NORMAL = bytes(
    b + 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


@lru_cache(maxsize=1)
def _byte_steps() -> np.ndarray:
    """What a register becomes by one zero byte, for the values of its lowest byte."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = (steps >> np.uint32(1)) ^ np.where(steps & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return steps


def _applied(shift: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map, given by its values on each byte of the register, on ``values``."""
    out = shift[0][values & _BYTE]
    for at in (1, 2, 3):
        out = out ^ shift[at][(values >> np.uint32(8 * at)) & _BYTE]
    return out


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """``[level, d]``: the map of a register by ``d * 256 ** level`` zero bytes, on each of its bytes.

    A multiplication by a power of x modulo the polynomial over GF(2), which is
    linear, so its values on single bytes are all that is needed.
    """
    steps = _byte_steps()
    tables = np.empty((4, 256, 4, 256), dtype=np.uint32)
    values = np.arange(256, dtype=np.uint32)
    for level in range(4):
        tables[level, 0] = np.stack([values << np.uint32(8 * at) for at in range(4)])
        for d in range(1, 256):
            before = tables[level, d - 1]
            if level:
                tables[level, d] = _applied(unit, before)
            else:
                tables[level, d] = (before >> np.uint32(8)) ^ steps[before & _BYTE]
        last = tables[level, 255]
        unit = _applied(unit, last) if level else (last >> np.uint32(8)) ^ steps[last & _BYTE]
    return tables


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The part that a prefix with each CRC has in the CRC of a text going on for ``lengths`` bytes."""
    out = crcs.copy()
    for level in range(4):
        digits = (lengths >> (8 * level)) & 0xFF
        at = np.flatnonzero(digits)
        if not len(at):
            if not (lengths >> (8 * level)).any():
                break
            continue
        flat, base, values = _shifts()[level].reshape(-1), digits[at] * 1024, out[at]
        moved = flat.take(base + (values & _BYTE))
        for byte in (1, 2, 3):
            moved ^= flat.take(base + 256 * byte + ((values >> np.uint32(8 * byte)) & _BYTE))
        out[at] = moved
    return out


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` cut at spaces into pieces of about :data:`PIECE_BYTES`."""
    at = 0
    while at < len(data):
        cut = data.find(b" ", at + PIECE_BYTES)
        cut = len(data) if cut < 0 else cut
        yield data[at:cut]
        at = cut


class PrefixCRCs:
    """The running CRC-32 at the end of each word of a normalised text, from one scan.

    Normalised: ``A-Z`` lower-cased, words joined by one space.  Texts follow
    each other in the arrays; each starts with a CRC of its own.
    """

    def __init__(self, texts: list[str | None]):
        ends, sizes, counts = [], [], []
        for text in texts:
            count, running = 0, 0
            for piece in _pieces((text or "").encode("utf-8", "replace").translate(_NORMAL)):
                words = piece.split()
                if not words:
                    continue
                spaced = list(map(b" ".__add__, words))
                if not count:
                    spaced[0] = words[0]
                crcs = list(accumulate(spaced, lambda crc, word: crc32(word, crc), initial=running))
                running = crcs[-1]
                ends.append(np.array(crcs[1:], dtype=np.uint32))
                sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
                count += len(words)
            counts.append(count)
        self.counts = np.array(counts, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.uint32)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        # Before each word: one more space than at the end of the word before; nothing at a text's start.
        register = self.ends ^ _ONES
        spaced = (register >> np.uint32(8)) ^ _byte_steps()[(register ^ np.uint32(0x20)) & _BYTE] ^ _ONES
        self.starts = np.zeros(len(self.ends), dtype=np.uint32)
        self.starts[1:] = spaced[:-1]
        opening = self.first[:-1]
        self.starts[opening[self.counts > 0]] = 0

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(CRC-32 of each run of ``n`` words, index of each text's first run).

        The CRC of a run is that of the text up to its end, less (by exclusive or)
        what the text before its start contributes to it.
        """
        runs = np.maximum(self.counts - n + 1, 0)
        first = np.concatenate([[0], np.cumsum(runs)])
        owner = np.repeat(np.arange(len(runs)), runs)
        at = np.arange(len(owner)) - first[owner] + self.first[owner]
        lengths = self.places[at + n] - self.places[at] - 1
        return self.ends[at + n - 1] ^ shifted(self.starts[at], lengths), first


def _text_blocks(texts: pa.Array) -> Iterator[list[str | None]]:
    block, size = [], 0
    for text in texts.to_pylist():
        block.append(text)
        size += len(text or "")
        if size >= PIECE_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _bucket_type(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def gram_buckets(df: DataFrame, text_col: str, id_col: str | None, ngram: int, buckets: int) -> DataFrame:
    """``doc_id, n_words, n_features, buckets``: each text scanned once, its buckets as packed numbers."""
    kind = _bucket_type(buckets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in _text_blocks(batch.column("text")):
                crcs = PrefixCRCs(block)
                runs = [crcs.grams(n) for n in range(1, ngram + 1)]
                runs = [((found % np.uint32(buckets)).astype(kind), first) for found, first in runs]
                packed = [
                    b"".join(found[first[i] : first[i + 1]].tobytes() for found, first in runs) for i in range(len(block))
                ]
                features = sum(np.diff(first) for _, first in runs)
                ids = batch.column("doc_id").slice(at, len(block))
                columns = [ids, pa.array(crcs.counts), pa.array(features), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "buckets"])
                at += len(block)

    ids = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    narrow = df.select(ids.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(scan, "doc_id long, n_words long, n_features long, buckets binary")


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The packed numbers of a batch, and where those of each row start."""
    kinds = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if kinds else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]].view(kind), (ends - ends[0]) // np.dtype(kind).itemsize


def bucket_counts(packed: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts are in each bucket; every task returns at most one row per bucket."""
    kind = _bucket_type(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            totals += np.bincount(_values(batch.column("buckets"), kind)[0], minlength=buckets)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], names=["bucket", "n"])

    counted = packed.select("buckets").mapInArrow(count, "bucket long, n long")
    counts = np.zeros(buckets, dtype=np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of the smoothed shares of each bucket, rounded down."""
    n = len(corpus)
    have, want = float(corpus.sum() + n), float(target.sum() + n)
    pairs = zip(target.tolist(), corpus.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * have / ((s + 1.0) * want))) for t, s in pairs], dtype=np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise of an id, in thousandths, rounded down; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """Draw the ``percent`` of the documents that are most like ``target``, with Gumbel noise.

    1. Each document is normalised and scanned once, storing the running CRC-32
       at the end of each word.  The CRC of every run of 1 to ``ngram`` words
       follows from two of these prefixes: the earlier one is shifted over the
       run's length by tables of the GF(2) multiplication and cancelled.  The
       buckets (CRC modulo ``buckets``) are written as packed numbers.
    2. Feature counts per bucket of all documents and of all target texts give
       the gain of each bucket.  Only these counts, ``buckets`` numbers for each
       table, go to the driver and back to the tasks.
    3. A document's weight is the floored mean of its features' gains; its score
       adds noise from the id.
    4. Documents with at least ``least_words`` words are ordered by score, then
       smaller id, by sampled ranges; the first ``percent`` are drawn.

    Returns one row per input row: ``doc_id, n_features, weight, score, rank``,
    all long; ``rank`` counts the drawn rows from 1 and is null for all others.
    Null and empty texts have no features and the weight 0, and are not drawn
    (unless ``least_words`` is 0).  A text of any length is worked on in pieces.
    Null ids all get the noise of one empty id and come last among equal scores;
    repeated rows are documents of their own, and which of two with one id and
    score comes first is arbitrary.  Other columns are ignored; an empty table
    gives an empty result, an empty target the gains of no counts.
    """
    if ngram < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("a feature needs a word, there must be a bucket, and the percentage is 0 to 100")
    packed = stored(gram_buckets(docs, text_col, id_col, ngram, buckets), "grams")
    wanted = bucket_counts(gram_buckets(target, target_col, None, ngram, buckets), buckets)
    gains, kind = bucket_gains(bucket_counts(packed, buckets), wanted), _bucket_type(buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, first = _values(batch.column("buckets"), kind)
            sums = np.concatenate([[0], np.cumsum(gains[found])])
            counts = np.diff(first)
            weights = (sums[first[1:]] - sums[first[:-1]]) // np.maximum(counts, 1)
            scores = weights + np.array([noise(seed, i) for i in batch.column("doc_id").to_pylist()], dtype=np.int64)
            columns = [batch.column("doc_id"), batch.column("n_features"), pa.array(weights), pa.array(scores)]
            fit = pa.array(batch.column("n_words").to_numpy() >= least_words)
            yield pa.RecordBatch.from_arrays([*columns, fit], names=["doc_id", "n_features", "weight", "score", "fit"])

    scored = stored(
        packed.mapInArrow(weigh, "doc_id long, n_features long, weight long, score long, fit boolean")
        .withColumn("row", F.monotonically_increasing_id()),
        "scores",
    )
    drawn = percent * scored.where("fit").count() // 100
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    placed = number_rows(scored, order, "at")
    rank = F.when(F.col("at") < drawn, F.col("at") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
