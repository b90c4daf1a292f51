"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from callsift.llm import resampling
from callsift.llm.resampling import PrefixCRCs, importance_resample, shifted

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHES = ("row", "at", "n_words", "fit", "rank", "score", "weight", "buckets", "n_features", "part")


@pytest.fixture
def table(spark):
    def build(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema).withColumns({c: F.lit("?") for c in CLASHES})

    return build


def words_of(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def grams_of(text, n):
    words = words_of(text)
    return [b" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, n=2, buckets=10000, least=20, percent=25):
    grams = [[crc32(g) % buckets for g in grams_of(text, n)] for _, text in rows]
    have, want = Counter(b for g in grams for b in g), Counter(crc32(g) % buckets for t in target for g in grams_of(t, n))
    s, t = sum(have.values()), sum(want.values())
    out = []
    for (doc, text), found in zip(rows, grams, strict=True):
        gains = [math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((have[b] + 1) * (t + buckets)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(found), weight, score, len(words_of(text)) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): at for at, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted((str(r[0]), r[1], r[2], r[3], str(ranks.get(id(r)))) for r in out)


def found(df):
    return sorted((str(r.doc_id), r.n_features, r.weight, r.score, str(r["rank"])) for r in df.collect())


@pytest.mark.parametrize("piece", [1 << 20, 16])
def test_crcs_of_all_runs(piece, monkeypatch):
    """Every run's CRC from two prefixes equals the CRC of its bytes, in pieces of any size."""
    monkeypatch.setattr(resampling, "PIECE_BYTES", piece)
    r = random.Random(3)
    texts = [None, "", " .,", "Hello, WORLD! é1 x", "x" * 70_000 + " y " + "z" * 300_000, "日本 語x ÄÖ a-b_c"]
    texts += ["".join(r.choice("abZ é.\n9") for _ in range(r.randint(0, 90))) for _ in range(150)]
    crcs = PrefixCRCs(texts)
    for n in (1, 2, 3, 5):
        values, first = crcs.grams(n)
        for at, text in enumerate(texts):
            words = words_of(text)
            want = [crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
            assert values[first[at] : first[at + 1]].tolist() == want


def test_shift_is_the_crc_of_appended_bytes():
    import numpy as np

    for length in (0, 1, 255, 256, 257, 65_536, 1_000_003):
        head, tail = b"prefix", bytes(i % 251 for i in range(length))
        moved = shifted(np.array([crc32(head)], np.uint32), np.array([length]))[0]
        assert int(moved) ^ crc32(tail) == crc32(head + tail)


def test_resampling_equals_plain_version(table):
    r = random.Random(9)
    word = [f"w{i}" for i in range(60)] + ["Ärger", "x.y", "A-B"]
    rows = [(i, " ".join(r.choice(word) for _ in range(r.choice([0, 5, 19, 20, 21, 60])))) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(150)] + [(7, rows[7][1]), (None, rows[8][1]), (None, None), (401, None), (402, "")]
    rows.append((403, " ".join(r.choice(word) for _ in range(40_000))))
    target = [" ".join(r.choice(word[:15]) for _ in range(30)) for _ in range(40)] + [None, ""]
    wanted = table([(i, t) for i, t in enumerate(target)])
    assert found(importance_resample(table(rows).repartition(5), wanted)) == plain(rows, target)
    other = dict(ngram=3, buckets=70_000, percent=100, least_words=1)
    want = plain(rows, target, 3, 70_000, 1, 100)
    assert found(importance_resample(table(rows), wanted, **other)) == want
    assert found(importance_resample(table(rows), table([]))) == plain(rows, [])
    assert importance_resample(table([]), wanted).count() == 0


def test_arguments_are_checked(table):
    for bad in (dict(ngram=0), dict(buckets=0), dict(percent=101)):
        with pytest.raises(ValueError):
            importance_resample(table([]), table([]), **bad)
