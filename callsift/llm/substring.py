"""Substring deduplication: repeated word windows found with FM-indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.llm.tables import map_groups, stored
from callsift.llm.text import Words, gram_hashes, text_blocks
from callsift.plans.skew import join_many_to_one

WINDOW = 35
# Words of an anchor: the k-gram of the smallest hash in a window.
ANCHOR_WORDS = 12
# Words that the index of one shard holds about.
SHARD_WORDS = 300_000
# Different segments of one anchor beyond which its windows are dealt one by one.
ANCHOR_SEGMENTS = 2048

# Rows of one text beyond which its lookups are split.
PIECE_ROWS = 1_000


class WaveletMatrix:
    """Rank queries on a sequence of integers, one packed bit vector per binary digit."""

    def __init__(self, values: np.ndarray, digits: int):
        self.digits, self.size = digits, len(values)
        self.bits, self.before, self.zeros = [], [], []
        values = values.astype(np.int64)
        for digit in range(digits - 1, -1, -1):
            ones = (values >> digit) & 1 == 1
            packed = np.zeros((len(ones) // 64 + 1) * 8, dtype=np.uint8)
            raw = np.packbits(ones, bitorder="little")
            packed[: len(raw)] = raw
            blocks = packed.view(np.uint64)
            counts = np.bitwise_count(blocks).astype(np.int64)
            self.bits.append(blocks)
            self.before.append(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32))
            self.zeros.append(int(len(ones) - ones.sum()))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position, relative to its run.

        Differences of ranks of one symbol are counts; the start of the run is
        the rank at position 0.
        """
        at = ends
        for level, digit in enumerate(range(self.digits - 1, -1, -1)):
            block, inside = at >> 6, (at & 63).astype(np.uint64)
            mask = (np.uint64(1) << inside) - np.uint64(1)
            ones = self.before[level][block] + np.bitwise_count(self.bits[level][block] & mask)
            at = np.where((symbols >> digit) & 1 == 1, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Backward search over a text of integers above 0 in which 0 separates its parts.

    Suffixes are sorted to a depth no pattern exceeds, which is enough for the
    search; equal prefixes stay in one interval.
    """

    def __init__(self, text: np.ndarray, depth: int):
        size = len(text)
        rank, step = text.astype(np.int64), 1
        while True:
            shifted = np.zeros(size, dtype=np.int64)
            shifted[: size - step] = rank[step:] + 1 if size > step else 0
            key = rank * (int(shifted.max()) + 1) + shifted
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(size, dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            step *= 2
            if step >= depth:
                break
        last = text[order - 1]
        top = int(text.max())
        self.starts = np.searchsorted(text[order], np.arange(top + 2))
        self.wavelet = WaveletMatrix(last, max(1, top.bit_length()))
        self.run = self.wavelet.rank(np.arange(top + 1), np.zeros(top + 1, dtype=np.int64))
        self.size = size

    def whole(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the one-word patterns."""
        return self.starts[symbols], self.starts[symbols + 1]

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more word in front."""
        both = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        base = self.starts[symbols] - self.run[symbols]
        return base + both[: len(low)], base + both[len(low) :]


def repeated_windows(index: FMIndex, text: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Bit masks of the windows of each part ``text[first:last]`` that occur twice or more.

    Matching statistics by backward search: from an end as far left as the
    pattern occurs twice.  A match of m words settles every window inside it at
    once; the next search ends at the end of the rightmost open window.  All
    parts take their steps together.
    """
    masks = np.zeros(len(first), dtype=np.int64)
    end = last.copy()
    # The search of part p has matched text[at:end]; windows from `open` on are settled.
    open_ = last - window + 1
    active = np.flatnonzero(open_ > first)
    at = end - 1
    low, high = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    low[active], high[active] = index.whole(text[at[active]])
    while len(active):
        more = at[active] > first[active]
        new_low, new_high = low[active].copy(), low[active].copy()
        going = active[more]
        if len(going):
            new_low[more], new_high[more] = index.extend(text[at[going] - 1], low[going], high[going])
        grown = more & (new_high - new_low >= 2)
        step = active[grown]
        at[step] -= 1
        low[step], high[step] = new_low[grown], new_high[grown]
        stopped = active[~grown]
        if len(stopped):
            # A one-word pattern that occurs once matches nothing.
            start = np.where(high[stopped] - low[stopped] >= 2, at[stopped], end[stopped])
            found = end[stopped] - start >= window
            hit = stopped[found]
            if len(hit):
                lowest = np.maximum(start[found], first[hit])
                top = open_[hit] - 1
                count = top - lowest + 1
                masks[hit] |= ((np.int64(1) << count) - 1) << (lowest - first[hit])
                open_[hit] = lowest
            missed = stopped[~found]
            open_[missed] -= 1
            again = stopped[open_[stopped] > first[stopped]]
            end[again] = open_[again] - 1 + window
            at[again] = end[again] - 1
            if len(again):
                low[again], high[again] = index.whole(text[at[again]])
        active = active[open_[active] > first[active]]
    return masks


def _minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest hash in each run of ``width`` hashes, the first of equals."""
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    return views.argmin(axis=1) + np.arange(len(views))


def _anchors(texts: pa.Array, window: int) -> Iterator[tuple[Words, int, int, np.ndarray, np.ndarray]]:
    """(words, first word, number of words, anchor of each window, hashes) of each text."""
    for _, data, offsets in text_blocks(texts):
        words = Words(data, offsets)
        grams = gram_hashes(words.hashes(), ANCHOR_WORDS)
        for at in range(len(offsets) - 1):
            first, count = int(words.first[at]), int(words.first[at + 1] - words.first[at])
            if count < window:
                yield words, first, count, np.zeros(0, np.int64), grams[:0]
            else:
                own = grams[first : first + count - ANCHOR_WORDS + 1]
                yield words, first, count, _minimisers(own, window - ANCHOR_WORDS + 1), own


def repeated_segments(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key, mark, start, mask``: windows from word ``start`` on that occur elsewhere, as bits.

    ``keyed`` has ``key``, ``mark`` and ``text``; the first two name the text.  Its
    rows get numbers of their own, which are written once with their anchors.
    """
    numbered = keyed.withColumn("row", F.monotonically_increasing_id())

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, hashes, rows = [], [], []
            for at, (_, _, _, chosen, grams) in enumerate(_anchors(batch.column("text"), window)):
                unique = np.unique(chosen)
                places.append(unique)
                hashes.append(grams[unique].view(np.int64))
                rows.append(np.full(len(unique), at))
            if rows:
                take = pa.array(np.concatenate(rows))
                columns = [batch.column(c).take(take) for c in ("row", "key", "mark")]
                columns += [pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "mark", "anchor", "place"])

    marked = stored(numbered.mapInArrow(anchors, "row long, key long, mark long, anchor long, place int"), "anchors")
    shared = marked.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    # Equal texts have equal places; those of the row with the smallest number stand for all.
    rows = marked.groupBy("row").agg(F.first("key").alias("key"), F.first("mark").alias("mark"))
    texts = rows.groupBy("key", "mark").agg(F.min("row").alias("row"), F.count("*").alias("rows"))
    met = join_many_to_one(marked.select("anchor", "row", "place"), shared, ["anchor"], rows="n")
    places = stored(met.groupBy("row").agg(F.collect_set("place").alias("places")).join(texts, "row").drop("row"), "places")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"key": [], "mark": [], "start": [], "size": [], "anchor": [], "content": [], "body": []}
            sent = set()
            keys, marks, lists = (batch.column(c) for c in ("key", "mark", "places"))
            for at, (words, first, _, chosen, grams) in enumerate(_anchors(batch.column("text"), window)):
                edges = np.flatnonzero(np.diff(chosen)) + 1
                starts = np.concatenate([[0], edges])
                ends = np.concatenate([edges, [len(chosen)]])
                wanted = np.isin(chosen[starts], lists[at].values.to_numpy()) if len(chosen) else np.zeros(0, bool)
                for start, end in zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True):
                    a, b = first + start, first + end - 1 + window - 1
                    body = b" ".join(words.data[words.starts[a] : words.ends[b]].tobytes().split())
                    content = xxhash.xxh3_64_intdigest(body) - (1 << 63)
                    # Copies of a segment in one batch need its words once.
                    out["body"].append(None if content in sent else body)
                    sent.add(content)
                    out["content"].append(content)
                    out["start"].append(start)
                    out["size"].append(end - start)
                    out["anchor"].append(int(grams[chosen[start]].astype(np.int64)))
                    out["key"].append(keys[at].as_py())
                    out["mark"].append(marks[at].as_py())
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=list(out))

    read = join_many_to_one(keyed, places, ["key", "mark"], rows="rows", piece_rows=PIECE_ROWS)
    fields = "key long, mark long, start int, size int, anchor long, content long, body binary"
    found = stored(read.mapInArrow(segments, fields), "segments")

    unique = found.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.max("body").alias("body"))
    # A segment with copies is repeated as a whole; it still is text that others may match.
    busy = unique.groupBy("anchor").agg(F.count("*").alias("segments"))
    busy = busy.where(F.col("segments") > 1)
    indexed = stored(join_many_to_one(unique, busy, ["anchor"], rows="segments"), "segment-texts")
    alone = (F.col("segments") > ANCHOR_SEGMENTS).alias("alone")
    total = indexed.agg(F.sum(F.length("body"))).scalar()
    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce(total, F.lit(0)) / F.lit(6 * SHARD_WORDS)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments as they are, or as their windows where the anchor has very many."""
        for batch in batches:
            rows, shifts, bodies = [], [], []
            for at, (body, single) in enumerate(zip(batch.column("body"), batch.column("alone"), strict=True)):
                words = body.as_py().split(b" ")
                pieces = len(words) - window + 1 if single.as_py() else 1
                for shift in range(pieces):
                    rows.append(at)
                    shifts.append(shift)
                    bodies.append(b" ".join(words[shift : shift + window]) if single.as_py() else body.as_py())
            take = pa.array(rows, pa.int64())
            columns = [batch.column(c).take(take) for c in ("anchor", "content", "copies", "alone")]
            columns += [pa.array(shifts, pa.int32()), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "copies", "alone", "shift", "body"])

    pieces = indexed.select("anchor", "content", "copies", alone, "body").mapInArrow(
        windows, "anchor long, content long, copies long, alone boolean, shift int, body binary"
    )
    # Equal windows of a very frequent anchor meet by their own hash; first they are counted.
    piece_key = F.when(F.col("alone"), F.xxhash64("body")).otherwise(F.xxhash64("anchor"))
    dealt = pieces.withColumn("shard", F.pmod(piece_key, shards))

    def search(group: pa.RecordBatch) -> pa.RecordBatch | None:
        bodies = [b.split(b" ") for b in group.column("body").to_pylist()]
        lengths = np.array([len(b) for b in bodies])
        numbers: dict[bytes, int] = {}
        flat = [numbers.setdefault(word, len(numbers) + 1) for body in bodies for word in body]
        text = np.zeros(int(lengths.sum()) + len(bodies), dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        inside = np.ones(len(text), dtype=bool)
        inside[first + lengths] = False
        text[inside] = flat
        masks = (np.int64(1) << (lengths - window + 1)) - 1
        once = np.flatnonzero(group.column("copies").to_numpy() == 1)
        if len(once):
            index = FMIndex(text, int(lengths.max()))
            masks[once] = repeated_windows(index, text, first[once], first[once] + lengths[once], window)
        masks = masks << group.column("shift").to_numpy().astype(np.int64)
        keep = np.flatnonzero(masks)
        if not len(keep):
            return None
        kept = group.take(pa.array(keep))
        return pa.RecordBatch.from_arrays(
            [kept.column("anchor"), kept.column("content"), pa.array(masks[keep])], names=["anchor", "content", "mask"]
        )

    searched = map_groups(
        dealt.select("shard", "anchor", "content", "copies", "shift", "body"), ["shard"], search,
        "anchor long, content long, mask long",
    )
    # A segment that is alone with its anchor has only its own copies to match.
    bits = F.bit_or("mask").alias("mask")
    masks = searched.groupBy("anchor", "content").agg(bits)
    decided = unique.select("anchor", "content", "copies").join(masks, ["anchor", "content"], "left").where(
        "copies > 1 or mask is not null"
    )
    every = F.expr("shiftleft(1L, size) - 1")
    return (
        join_many_to_one(found.select("key", "mark", "start", "size", "anchor", "content"), decided, ["anchor", "content"], rows="copies")
        .select("key", "mark", "start", F.when(F.col("copies") > 1, every).otherwise(F.col("mask")).alias("mask"))
    )


def _keys(text: Column) -> dict[str, Column]:
    """Two hashes that name a text; different texts share both with a chance of 2^-128 a pair."""
    return {"key": F.xxhash64(text), "mark": F.xxhash64(F.lit(WINDOW), text)}


def _cuts(texts: DataFrame, window: int) -> DataFrame:
    """``key, mark, cuts, rows`` of the texts that lose words; ``rows`` have the text."""
    if not ANCHOR_WORDS <= window <= ANCHOR_WORDS + 50:
        raise ValueError("the window must have 12 to 62 words")
    found = repeated_segments(texts, window)
    cut = found.groupBy("key", "mark").agg(F.collect_set(F.struct("start", "mask")).alias("cuts"), F.count("*").alias("rows"))
    return stored(cut, "cuts")


def _kept_words(texts: pa.Array, cuts: pa.Array, window: int) -> Iterator[tuple[int, int, bytes]]:
    """(words, kept words, kept words joined by a space) of each text."""
    for text, cut in zip(texts, cuts, strict=True):
        # The white space of bytes.split() is that of the contracts.
        words = (text.as_py() or "").encode().split()
        kept = words
        if cut.is_valid:
            keep = bytearray(b"\x01") * len(words)
            for one in cut.as_py():
                start, mask = one["start"], one["mask"]
                while mask:
                    low = (mask & -mask).bit_length() - 1
                    keep[start + low : start + low + window] = bytes(window)
                    mask &= mask - 1
            kept = list(compress(words, keep))
        yield len(words), len(kept), b" ".join(kept)


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Find every word covered by a window of 35 words whose words also start anywhere else.

    1. Each window has an anchor, its 12-gram of the smallest hash, so equal
       windows have equal anchors.  Windows whose anchor occurs once are unique.
    2. Neighbouring windows of one repeated anchor are a segment.  Segments are
       counted, and the different ones dealt to shards by anchor; windows of an
       anchor with very many segments are dealt by their own hash.
    3. Each shard builds an FM-index over a wavelet matrix of its segments and
       streams them through a backward search for matching statistics; matches of
       35 words or more mark their windows.
    4. The marks are joined back to the documents by two 64-bit hashes of the
       whole text; equal texts lose equal words.  Texts with very many rows are
       split in the joins.

    Windows are judged on the input.  Returns one row per input row: ``doc_id,
    n_words, n_removed, kept_sha256`` (of the kept words joined by one space).
    Words are compared unchanged.  Texts of fewer than 35 words lose nothing;
    null counts as no words.  Repeated rows are documents of their own, so they
    lose all their windows.  Other columns are ignored; an empty table gives an
    empty result.
    """
    ids, text = F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    keyed = docs.select(ids, text).select("doc_id", "text", *[c.alias(name) for name, c in _keys(F.col("text")).items()])
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    names = [f.split()[0] for f in fields.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, digests = [], [], []
            for count, kept, words in _kept_words(batch.column("text"), batch.column("cuts"), window):
                counts.append(count)
                gone.append(count - kept)
                digests.append(hashlib.sha256(words).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64())]
            columns += [pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    cuts = _cuts(keyed.drop("doc_id"), window)
    joined = join_many_to_one(keyed, cuts, ["key", "mark"], rows="rows", how="left", piece_rows=PIECE_ROWS)
    return joined.select("doc_id", "text", "cuts").mapInArrow(digest, fields)


def cut_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the words that :func:`substring_dedup` finds.

    A text that loses words becomes its kept words joined by one space; all other
    texts and columns stay as they are, and no row goes.
    """
    keys = _keys(F.col(text_col).cast("string"))
    texts = docs.select(F.col(text_col).cast("string").alias("text"), *[c.alias(name) for name, c in keys.items()])
    own = {name: f"__callsift_{name}" for name in ("key", "mark", "cuts", "rows")}
    wide = docs.withColumns({own[name]: c for name, c in keys.items()})
    cuts = _cuts(texts, window).withColumnsRenamed(own)
    joined = join_many_to_one(wide, cuts, [own["key"], own["mark"]], rows=own["rows"], how="left", piece_rows=PIECE_ROWS)
    at, names = docs.columns.index(text_col), docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            found = _kept_words(texts, batch.column(len(names)), window)
            new = [t.as_py() if kept == count else words.decode() for t, (count, kept, words) in zip(texts, found, strict=True)]
            out = batch.columns[: len(names)]
            out[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(out, names=names)

    return joined.select(*[F.col(f"`{n}`") for n in names], "__callsift_cuts").mapInArrow(rewrite, docs.schema)
