"""Token counts of many texts at once: pieces cut on arrays of bytes, distinct pieces merged in step."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from callsift.llm.bpe import Codec, load_codec

# Bytes of text cut at a time (a longer text is cut alone), and cells of pieces merged at a time.
SLICE_BYTES = 1 << 24
CELLS = 1 << 20
# Pieces of up to so many bytes are merged together, a class of sizes at a time.  Longer ones, whose work would grow
# with their square, and classes of few pieces are encoded one by one.
WIDTHS = np.array([*range(1, 17), 20, 24, 32, 48, 64, 96, 128, 192, 256])
STEP_ROWS = 64

# Kinds of characters in the split pattern.
_OTHER, _LETTER, _NUMBER, _WHITE = range(4)
# No merge: above all ids.
_NONE = np.int32(2**31 - 1)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point, by the properties that the split pattern names."""
    every, kinds = "".join(map(chr, range(0x110000))), np.full(0x110000, _OTHER, np.uint8)
    for kind, name in ((_LETTER, "L"), (_NUMBER, "N"), (_WHITE, "White_Space")):
        for found in regex.finditer(rf"\p{{{name}}}+", every):
            kinds[found.start() : found.end()] = kind
    return kinds


def piece_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pieces of the split pattern start in the UTF-8 bytes ``data``, as one flag per byte.

    ``texts`` holds the start of each text that is not empty; no piece goes over it.
    """
    kinds = _kinds()
    kind = kinds[:256][data]
    wide = np.flatnonzero(data >= 0xC0)
    for low, tail in ((0xC0, 1), (0xE0, 2), (0xF0, 3)):
        # A lead byte of tail + 1 bytes; the bytes after it are of the character's kind too.
        at = wide[(data[wide] >= low) & (data[wide] < (0x100 if tail == 3 else low + (0x40 >> tail)))]
        code = data[at].astype(np.int32) & (0x3F >> tail)
        for step in range(1, tail + 1):
            code = code << 6 | data[at + step] & 0x3F
        for step in range(tail + 1):
            kind[at + step] = kinds[code]
    first = np.zeros(len(data), bool)
    first[texts] = True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last character of white space before others is cut off; a space goes to what follows.
    ends = np.flatnonzero((kind[:-1] == _WHITE) & (kind[1:] != _WHITE) & ~first[1:])
    space = data[ends] == 0x20
    start[ends[space] + 1] = False
    last = ends
    while (inside := data[last] & 0xC0 == 0x80).any():
        last = last - inside
    start[last] = True
    # 's, 't, 'm, 'd, 're, 've and 'll at the start of a piece.
    marks = np.flatnonzero(data == 0x27)
    marks = marks[start[marks]]

    def after(steps: int) -> np.ndarray:
        at = np.minimum(marks + steps, len(data) - 1)
        return np.where((marks + steps < len(data)) & ~first[at], data[at], 0)

    one, two = after(1), after(2)
    short = np.isin(one, list(b"stmd"))
    long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e"))
    long |= (one == ord("l")) & (two == ord("l"))
    for found, size in ((marks[short], 2), (marks[long], 3)):
        start[found + 1] = False
        start[(found + size)[found + size < len(data)]] = True
    return start


class Counter:
    """Counts of tokens by the merges of one vocabulary file.

    The merges stand in a hash table with open addressing, so that many pairs
    are looked up at once.
    """

    def __init__(self, codec: Codec):
        self.codec = codec
        self.bytes = np.array([codec.ids[bytes([b])] for b in range(256)], np.int32)
        # A token that merges with none, before and after each piece.
        self.edge = len(codec.tokens)
        pairs = np.array(list(codec.merged), np.int64).reshape(-1, 2)
        keys = self._key(pairs[:, 0], pairs[:, 1])
        bits = len(keys).bit_length() + 3
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        used = set()
        for slot, key, whole in zip(self._slot(keys).tolist(), keys.tolist(), codec.merged.values(), strict=True):
            while slot in used:
                slot = slot + 1 & len(self.keys) - 1
            used.add(slot)
            self.keys[slot], self.values[slot] = key, whole

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges into, which is the merge's rank too, or ``_NONE``."""
        keys = self._key(left, right)
        slots = self._slot(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], _NONE)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slots[open_] = slots[open_] + 1 & len(self.keys) - 1
            held = self.keys[slots[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.values[slots[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return out

    def _merge(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
        """The number of tokens of the pieces of ``data``, of ``most`` bytes at most.

        In each step every piece does its first merge of least rank.
        """
        rows, width, places = len(starts), most + 2, np.arange(most)
        token = np.full((rows, width), self.edge, np.int32)
        own = self.bytes[data[np.minimum(starts[:, None] + places, len(data) - 1)]]
        token[:, 1:-1] = np.where(places < sizes[:, None], own, self.edge)
        rank = np.full((rows, width), _NONE, np.int32)
        rank[:, :-1] = self.merged(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(rows, width - 1)
        places = np.arange(rows * width, dtype=np.int32)
        token, after, before = token.ravel(), places + 1, places - 1
        counts, live, flat = sizes.astype(np.int64), np.arange(rows), rank.ravel()
        while len(live):
            at = live * width + rank[live].argmin(axis=1)
            found = flat[at] != _NONE
            live, at = live[found], at[found]
            counts[live] -= 1
            whole, gone, prior = flat[at], after[at], before[at]
            following = after[gone]
            token[at], after[at], before[following], flat[gone] = whole, following, at, _NONE
            flat[at] = self.merged(whole, token[following])
            flat[prior] = self.merged(token[prior], whole)
        return counts

    def count_pieces(self, pieces: pa.Array) -> np.ndarray:
        """The number of tokens of each piece; ``pieces`` is binary without nulls."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        data, starts, sizes = np.frombuffer(pieces.buffers()[2], np.uint8), offsets[:-1], np.diff(offsets)
        classes, counts = np.searchsorted(WIDTHS, sizes), np.ones(len(pieces), np.int64)
        for number in np.unique(classes[sizes > 1]).tolist():
            own = np.flatnonzero(classes == number)
            if number == len(WIDTHS) or len(own) < STEP_ROWS:
                counts[own] = [len(self.codec.encode_piece(pieces[at].as_py().decode())) for at in own.tolist()]
                continue
            rows = CELLS // int(WIDTHS[number] + 2)
            for part in (own[at : at + rows] for at in range(0, len(own), rows)):
                counts[part] = self._merge(data, starts[part], sizes[part], int(WIDTHS[number]))
        return counts

    def _count_slice(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        start = piece_starts(data, offsets[:-1][offsets[1:] > offsets[:-1]])
        cuts = np.append(np.flatnonzero(start), len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        counts = self.count_pieces(coded.dictionary)[coded.indices.to_numpy()]
        return np.diff(np.append(0, np.cumsum(counts))[np.searchsorted(cuts, offsets)])

    def _count_plain(self, texts: pa.Array) -> np.ndarray:
        """The counts of large strings without nulls and special tokens, a slice of whole texts at a time."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        out, at = np.zeros(len(texts), np.int64), 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            low, high = int(offsets[at]), int(offsets[end])
            if high > low:
                data = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
                out[at:end] = self._count_slice(data, offsets[at : end + 1] - low)
            at = end
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text (null: none), as :meth:`Codec.count` finds it."""
        texts, kind = pc.fill_null(texts.cast(pa.large_string()), ""), pa.large_string()
        special = np.zeros(len(texts), bool)
        for name in self.codec.special:
            special |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        if not special.any():
            return self._count_plain(texts)
        out = self._count_plain(pc.if_else(pa.array(special), pa.scalar("", kind), texts))
        owners, parts = [], []
        for at in np.flatnonzero(special).tolist():
            split = self.codec.specials.split(texts[at].as_py())
            out[at] = len(split) // 2
            parts += split[::2]
            owners += [at] * len(split[::2])
        np.add.at(out, owners, self._count_plain(pa.array(parts, kind)))
        return out


@lru_cache(maxsize=2)
def load_counter(path: str) -> Counter:
    return Counter(load_codec(path))
