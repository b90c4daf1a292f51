"""Words and their hashes for whole batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

# Multipliers of the 64-bit hashes (fixed values: two odd constants of splitmix64, and a random odd base).
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit over all."""
    values = (values ^ (values >> np.uint64(30))) * _MIX1
    values = (values ^ (values >> np.uint64(27))) * _MIX2
    return values ^ (values >> np.uint64(31))


@lru_cache(maxsize=1)
def _short_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(BLOCK_BYTES + 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts of about a block's size.

    Nulls count as empty texts.
    """
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, raw_offsets, raw = texts.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block.

    ``starts`` and ``ends`` are byte positions, ``first`` the index of each
    text's first word, with the number of all words at its end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        solid = ~_SPACE[data]
        border = np.zeros(len(data) + 1, dtype=bool)
        border[offsets] = True
        before = np.empty_like(solid)
        before[:1] = False
        before[1:] = solid[:-1]
        after = np.empty_like(solid)
        after[-1:] = False
        after[:-1] = solid[1:]
        self.starts = np.flatnonzero(solid & (border[:-1] | ~before))
        self.ends = np.flatnonzero(solid & (border[1:] | ~after)) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        size = len(self.data) + 1
        up, down = _short_powers() if size <= BLOCK_BYTES + 1 else _powers(size)
        sums = np.zeros(size, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: size - 1], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each ``n`` consecutive word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for at in range(n):
        out = mix(out + words[at : at + count])
    return out
