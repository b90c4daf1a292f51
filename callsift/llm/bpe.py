"""Byte-level BPE: exact encoding by backtracking over longest matches, decoding by offsets."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Distinct pieces whose tokens a worker remembers, and the longest piece it remembers.
CACHE_PIECES = 400_000
CACHE_CHARS = 48
# Distinct runs between spaces whose number of tokens a worker remembers.
COUNTED_PIECES = 1_000_000

# The split pattern of the byte-level vocabularies (fixed value); \s is the
# Unicode property, as in the engine that defines the results.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file.

    Printable Latin-1 bytes stand for themselves, the others for U+0100 onwards.
    """
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# The Unicode property White_Space (fixed value).
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Spaces with which white space begins: no piece of the split goes over the place before one.
_BORDER = re.compile(f"(?<=[^{_WHITE}]) ")


class _Counts(dict):
    """The number of tokens of a space and the characters after it up to the next border, found when first asked for."""

    def __init__(self, codec: Codec):
        super().__init__()
        self._codec = codec

    def __missing__(self, run: str) -> int:
        if not run or run[-1] in _WHITE:
            raise _NoBorderError
        codec = self._codec
        if run.isalpha():
            count = len(codec.encode_piece(f" {run}"))
        elif run[-1] in ".,;:!?" and run[:-1].isalpha():
            # A letter run and one mark, which is a token of its own.
            count = self[run[:-1]] + 1
        else:
            count = codec._pieces_of(f" {run}")
        if len(run) <= CACHE_CHARS:
            if len(self) >= COUNTED_PIECES:
                self.clear()
                codec._fits.clear()
            self[run] = count
        return count


class _NoBorderError(Exception):
    """White space goes on after what was taken as the end of a run."""


class Codec:
    """Encoder and decoder of one vocabulary file.

    ``halves`` holds the two tokens that the merge of a token joins, ``merged``
    the token of each pair that merges.  A token's rank is its id, since ids
    follow the order of the merges.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for word, at in vocab.items():
            self.tokens[at] = bytes(letters[c] for c in word)
        for word, at in self.special.items():
            self.tokens[at] = word.encode()
        self.merged, self.halves = {}, {}
        for rule in spec["model"]["merges"]:
            left, right = rule.split(" ") if isinstance(rule, str) else rule
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.merged[pair] = whole
            self.halves[whole] = pair
        special_ids = set(self.special.values())
        self.ids = {t: i for i, t in enumerate(self.tokens) if t and i not in special_ids}
        self.matcher = ahocorasick.Automaton()
        for token, at in self.ids.items():
            self.matcher.add_word(token.decode("latin-1"), (len(token), at))
        self.matcher.make_automaton()
        # The longest token that is a proper prefix of each token, or -1.
        self.shorter = [-1] * size
        for token, at in self.ids.items():
            for end in range(len(token) - 1, 0, -1):
                if (found := self.ids.get(token[:end])) is not None:
                    self.shorter[at] = found
                    break
        lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.pattern = regex.compile(SPLIT)
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self._fits: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._counts = _Counts(self)

    def fits(self, left: int, right: int) -> bool:
        """May the two tokens stand side by side in an exact encoding?

        They may unless some merge across their border comes before the merges
        that built them on that side.  The check undoes the later of the two
        border tokens step by step, so a pair found in ``merged`` with a rank
        below the last undone merge refutes the border.
        """
        known = self._fits.get((left, right))
        if known is None:
            known = self._fits[left, right] = self._check(left, right)
        return known

    def _check(self, left: int, right: int) -> bool:
        bound = len(self.tokens)
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and crossing < bound:
                return False
            # Undo the later merge; on equal ranks the left-hand place merges first.
            if left > right and left in self.halves:
                bound, left = left, self.halves[left][1]
            elif right in self.halves:
                bound, right = right + 1, self.halves[right][0]
            elif left in self.halves:
                bound, left = left, self.halves[left][1]
            else:
                return True

    def longest(self, data: str) -> list[int]:
        """The longest token that starts at each byte; one pass of the automaton."""
        found = [-1] * len(data)
        for end, (size, at) in self.matcher.iter(data):
            found[end - size + 1] = at
        return found

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """The tokens of one piece of the split.

        Takes the longest token at each place.  Where it does not fit its
        predecessor, or leads to a place known as a dead end, the next shorter
        one is tried, and with none left the predecessor is given up.  No place
        is a dead end twice, so the work is linear in the piece.
        """
        data = piece.encode("utf-8")
        whole = self.ids.get(data)
        if whole is not None:
            return (whole,)
        longest, tokens = self.longest(data.decode("latin-1")), self.tokens
        size = len(data)
        alive = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            while token >= 0:
                end = at + len(tokens[token])
                if alive[end] and (not out or self.fits(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == size:
                    return tuple(out)
                token = longest[at]
            else:
                alive[at] = 0
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                last = out.pop()
                at -= len(tokens[last])
                token = self.shorter[last]

    def _piece(self, piece: str) -> tuple[int, ...]:
        found = self._pieces.get(piece)
        if found is None:
            found = self.encode_piece(piece)
            if len(piece) <= CACHE_CHARS:
                if len(self._pieces) >= CACHE_PIECES:
                    self._pieces.clear()
                    self._fits.clear()
                self._pieces[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Token ids of a text; the strings of special tokens become those tokens."""
        out: list[int] = []
        parts = self.specials.split(text) if self.specials else [text]
        for at, part in enumerate(parts):
            if at % 2:
                out.append(self.special[part])
            elif part:
                for ids in map(self._piece, self.pattern.findall(part)):
                    out += ids
        return out

    def count(self, text: str) -> int:
        """The number of tokens of a text, without making them a list."""
        if not any(map(text.__contains__, self.special)):
            return self._count(text)
        return sum(1 if at % 2 else self._count(part) for at, part in enumerate(self.specials.split(text)))

    def _count(self, part: str) -> int:
        """The tokens of a text without special tokens, run by run.

        White space at the end is one piece, as is all of it that goes before the
        last character elsewhere; so the split of a run does not depend on its
        surroundings if it begins where white space does.
        """
        body = part.rstrip(_WHITE)
        total = len(self._piece(part[len(body) :])) if len(body) < len(part) else 0
        if not body:
            return total
        first, *runs = body.split(" ")
        if first and first[-1] not in _WHITE:
            try:
                return total + self._pieces_of(first) + sum(map(self._counts.__getitem__, runs))
            except _NoBorderError:
                pass
        first, *runs = _BORDER.split(body)
        return total + self._pieces_of(first) + sum(map(self._counts.__getitem__, runs))

    def _pieces_of(self, text: str) -> int:
        return sum(len(self._piece(piece)) for piece in self.pattern.findall(text))

    def decode(self, ids: list[int]) -> str:
        """The text of token ids: their byte ranges gathered from the offset table."""
        at = np.asarray(ids, dtype=np.int64)
        starts = self.offsets[at]
        sizes = self.offsets[at + 1] - starts
        ends = np.cumsum(sizes)
        index = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.blob[index].tobytes().decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load_codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Token count and digests of the encoded and again decoded texts.

    ``vocabulary`` is the path of a byte-level BPE file that all executors have.
    Each text is encoded whole, then decoded from its ids.  Returns one row per
    input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` with
    ``with_ids``.  Null counts as the empty text, which has no tokens.  Repeated
    rows are separate rows; other columns are ignored; an empty table gives an
    empty result.  One pass without a shuffle.
    """
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    fields += ", ids array<int>" if with_ids else ""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(vocabulary)
        for batch in batches:
            counts, hashes, decoded, lists = [], [], [], []
            for scalar in batch.column("text"):
                ids = codec.encode(scalar.as_py() or "")
                counts.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                if with_ids:
                    lists.append(ids)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64())]
            columns += [pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            columns += [pa.array(lists, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, fields)
