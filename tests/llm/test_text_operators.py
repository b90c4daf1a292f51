from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from callsift.llm import minhash, substring
from callsift.llm.exact import exact_dedup, keep_first_copies
from callsift.llm.minhash import keep_one_per_component, near_duplicates
from callsift.llm.sharding import place, shard_documents
from callsift.llm.substring import cut_repeats, substring_dedup
from tests.llm import brute

# Columns of the operators' own intermediate tables.
CLASHES = ("key", "mark", "row", "group", "n", "copies", "size", "hub", "block", "cuts", "anchor", "norm", "sha")


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdeéñ") for _ in range(r.randint(2, 6))) for _ in range(n)]


def edge_rows():
    long = words(1, 20_000)
    other = [*long[:9_999], "changed", *long[10_000:]]
    return [
        (1, "a b c d e f g"), (2, None), (3, ""), (4, "A B\tC D E\nF G"), (5, " \t\n\x0b\x0c\r "), (6, " ".join(long)),
        (7, " ".join(other)), (8, "x"), (9, "X"), (10, "one two three"), (11, "É é"), (12, "é É"), (13, "a bc d efg"),
    ]


@pytest.fixture
def table(spark):
    def build(rows, clashes=True):
        df = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
        return df.withColumns({c: F.lit("?") for c in CLASHES}) if clashes else df

    return build


def near_rows():
    """A base, copies of it at all distances, and copies of copies."""
    r = random.Random(5)
    base = words(2, 160)
    rows = []
    for at in range(700):
        own = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
            own[r.randrange(len(own))] = r.choice("pqrs") * 3 + str(r.randrange(40))
        rows.append((at, " ".join(own)))
    rows += [(1000 + at, " ".join(words(100 + at, 7 + at % 9))) for at in range(60)]
    rows += [(2000 + at, " ".join([*words(100 + at, 7 + at % 9), "end"])) for at in range(60)]
    return rows


@pytest.mark.parametrize("rows", [edge_rows(), near_rows()], ids=["edges", "near"])
def test_near_duplicates_equal_brute_force(table, rows):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(rows)).collect()}
    assert found == brute.near_duplicates(rows)


def test_near_duplicates_nulls_repeats_and_empty(table):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)]
    found = [tuple(r) for r in near_duplicates(table(rows)).collect()]
    assert sorted(found, key=str) == sorted(
        [(None, 2, None, True), (None, 0, None, True), (3, 2, 3, True), (3, 2, 3, True)], key=str
    )
    assert near_duplicates(table([])).count() == 0
    kept = keep_one_per_component(table([(1, "a b c d e f"), (2, "A B C D E F"), (3, None), (None, "z")]))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]
    assert kept.columns == ["doc_id", "text", *CLASHES]


def test_estimate_and_sketch():
    import numpy as np

    r = np.random.default_rng(1)
    pool = np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64) * 2)
    a, b = pool[:3000], pool[300:3300]
    sketches = [minhash.sketch(a)[None, :], minhash.sketch(b)[None, :]]
    sizes = np.array([3000.0]), np.array([3000.0])
    assert abs(minhash.estimate(*sketches, *sizes)[0, 0] - 2700 / 3300) < 0.12
    assert minhash.linked(pool[:85], pool[:100]) and not minhash.linked(pool[:84], pool[:100])


def exact_expected(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc))
    out = []
    for norm, members in groups.items():
        keep = min(members)[1]
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(doc, keep, len(members), doc == keep, digest) for _, doc in members]
    return sorted(out)


def test_exact_dedup_equals_brute_force(table):
    r = random.Random(3)
    rows = edge_rows() + [(100 + i, "same text" + " " * r.randint(0, 3)) for i in range(3000)]
    rows += [(5000 + i, "\x00" * (i % 3) + "z" * (i % 50)) for i in range(400)]
    found = exact_dedup(table(rows).repartition(9))
    assert sorted(tuple(x) for x in found.collect()) == exact_expected(rows)


def test_exact_dedup_nulls_repeats_and_empty(table):
    rows = [(None, "a b"), (2, "ab"), (1, "a  b"), (1, "a  b"), (None, "solo")]
    found = sorted((tuple(r)[:4] for r in exact_dedup(table(rows)).collect()), key=str)
    assert found == sorted(
        [(None, 1, 4, False), (2, 1, 4, False), (1, 1, 4, True), (1, 1, 4, True), (None, None, 1, True)], key=str
    )
    assert exact_dedup(table([])).count() == 0
    assert sorted(r.doc_id for r in keep_first_copies(table(rows[1:4])).collect()) == [1, 1]


def test_sharding_laws(table):
    rows = edge_rows() + [(100 + i, f"text {i % 700} " + "w " * (i % 90)) for i in range(6000)]
    rows += [(10_000 + i, "hot") for i in range(3000)] + [(1, "a b c d e f g")]
    found = shard_documents(table(rows).repartition(7), shards=8).toPandas()
    assert sorted(found.doc_id) == sorted(r[0] for r in rows)
    assert set(found.law) == {"bytes"} and found.grown_shard.isna().all()
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() < 1.2 * sizes.min()
    for _, shard in found.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    texts = dict(rows)
    own = found[(found.doc_id >= 100) & (found.doc_id < 10_000)]
    assert (own.assign(text=own.doc_id.map(texts)).groupby("text")["shard"].nunique() == 1).all()
    empty = found[found.doc_id.isin([2, 3])]
    assert list(empty["size"]) == [16, 16] and list(empty.text_crc32) == [0, 0]
    assert shard_documents(table([])).count() == 0


def test_placing_takes_the_best_fit_with_room():
    import numpy as np

    # The first three open the shards; the fourth has room in the last shard alone.
    items = np.array([[8.0, 2, 1], [6, 6, 1], [5, 1, 1], [4, 4, 1], [1, 1, 1]])
    assert list(place(items, 3, (1, 1, 1))) == [1, 0, 2, 2, 0]


def substring_rows():
    r = random.Random(11)
    passage = words(7, 60)
    rows = [(i, " ".join([*words(20 + i, r.randint(0, 90)), *passage, *words(60 + i, 30)])) for i in range(30)]
    rows += [(100, " ".join(passage[:34])), (101, " ".join(passage[:35])), (102, " ".join(["w"] * 120))]
    rows += [(103, "  ".join([*words(9, 50), "x", *words(9, 50)])), (104, " ".join(words(9, 36))), (105, None), (106, "")]
    rows += [(107, " ".join(words(40, 80))), (108, "\n".join(words(40, 80)))]
    return rows + [(200 + i, " ".join([f"u{i}", *words(77, 40), f"v{i}"])) for i in range(40)]


def test_substring_dedup_equals_brute_force(table, monkeypatch):
    rows = substring_rows()
    expected = sorted(brute.substring_dedup(rows))
    assert sorted(tuple(r) for r in substring_dedup(table(rows)).collect()) == expected
    # Few windows to a shard, and the windows of busy anchors one by one.
    monkeypatch.setattr(substring, "ANCHOR_SEGMENTS", 3)
    monkeypatch.setattr(substring, "SHARD_WORDS", 100)
    assert sorted(tuple(r) for r in substring_dedup(table(rows).repartition(5)).collect()) == expected


def test_substring_dedup_edges(table):
    assert substring_dedup(table([])).count() == 0
    rows = [(1, " ".join(words(3, 40))), (1, " ".join(words(3, 40))), (None, " ".join(words(4, 40))), (5, "short one")]
    found = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(table(rows)).collect()), key=str)
    assert found == sorted([(1, 40, 40), (1, 40, 40), (None, 40, 0), (5, 2, 0)], key=str)
    cut = cut_repeats(table(rows))
    assert cut.columns == ["doc_id", "text", *CLASHES]
    assert sorted(r.text for r in cut.collect()) == sorted(["", "", rows[2][1], "short one"])


def test_substring_rows_of_one_id(table, spark):
    """Texts of null ids or of one id keep their own cuts, also where Spark's 32-bit hashes of them are equal."""
    first, second = (" ".join(f"w{n}x{i}" for i in range(40)) for n in (23147, 205656))
    assert spark.range(1).select((F.hash(F.lit(first)) == F.hash(F.lit(second))).alias("equal")).first().equal
    rows = [(None, first), (None, second), (3, f"a b c {first} d e")]
    rows += [(7, " ".join(words(90 + i, 45))) for i in range(4)] + [(7, " ".join(words(91, 45)[:40]))]
    expected = Counter(brute.substring_dedup(rows))
    assert Counter(tuple(r) for r in substring_dedup(table(rows)).collect()) == expected
    cut = Counter((r.doc_id, r.text) for r in cut_repeats(table(rows)).collect())
    assert cut[(None, second)] == 1 and cut[(None, "")] == 1 and cut[(3, "a b c d e")] == 1


def test_substring_row_repeated_very_often(table, monkeypatch):
    """One row a thousand times, its lookups split into many pieces."""
    monkeypatch.setattr(substring, "PIECE_ROWS", 50)
    hot = " ".join(words(5, 60))
    rows = [(1, hot)] * 1000 + [(2, f"x {hot} y")] + [(10 + i, " ".join(words(200 + i, 50))) for i in range(40)]
    expected = Counter(brute.substring_dedup(rows))
    assert Counter(tuple(r) for r in substring_dedup(table(rows).repartition(4)).collect()) == expected
    assert Counter(r.text for r in cut_repeats(table(rows)).collect())[""] == 1000


def test_index_counts_patterns():
    import numpy as np

    r = np.random.default_rng(4)
    text = r.integers(1, 6, 400)
    text[::57] = 0
    index = substring.FMIndex(text, 12)
    for _ in range(200):
        size = int(r.integers(1, 9))
        pattern = r.integers(1, 6, size)
        low, high = index.whole(pattern[-1:])
        for word in pattern[-2::-1]:
            low, high = index.extend(np.array([word]), low, high)
        views = np.lib.stride_tricks.sliding_window_view(text, size)
        assert int(high[0] - low[0]) == int((views == pattern).all(axis=1).sum())


def test_near_duplicates_take_a_similarity(table):
    """300-word copies with five, six and eight words changed: 0.84, 0.82 and 0.76."""
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for n in (5, 6, 8):
        rows.append((n, " ".join(f"{n}:{w}" if i % 33 == 16 and i // 33 < n else w for i, w in enumerate(base))))
    assert sorted(r.doc_id for r in keep_one_per_component(table(rows), percent=80).collect()) == [0, 8]


def test_tiles_verify_each_text_of_an_id():
    """The second text of id 7 alone is near id 9."""
    import pyarrow as pa

    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(f"x{w}" if i in gone else w for i, w in enumerate(base)) for gone in ((20, 60, 100), (), (150, 190, 230))]
    first, second, third = minhash.shingle_sets(pa.array(texts))
    assert minhash.linked(first, second) and minhash.linked(second, third) and not minhash.linked(first, third)
    for order in ([0, 1, 2], [1, 0, 2], [2, 1, 0]):
        columns = {
            "hub": [7] * 3, "i": pa.array([0] * 3, pa.int32()), "j": pa.array([0] * 3, pa.int32()),
            "block": pa.array([0] * 3, pa.int32()), "class_id": [[7, 7, 9][k] for k in order],
            "mark": [[1, 2, 3][k] for k in order], "text": [texts[k] for k in order],
        }
        links = minhash._verified(pa.RecordBatch.from_pydict(columns), 85)
        assert [{r["a"], r["b"]} for r in links.to_pylist()] == [{7, 9}]


def variants(n, words_each=150, seed=11):
    """Pages of one boilerplate text with up to three words changed, and one in ten with many more."""
    r = random.Random(seed)
    base = words(31, words_each)
    rows = []
    for at in range(n):
        own = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3]) if at % 10 else r.randint(4, 9)):
            own[r.randrange(len(own))] = f"x{r.randrange(30)}"
        rows.append((at * 7 + 1, " ".join(own)))
    return rows


def test_families_of_variants_need_few_tile_rows(table, monkeypatch):
    """3,000 variants of a page: links as a product of incidence matrices finds them, at most 20 tile rows per class."""
    import numpy as np

    rows = variants(3000)
    tile_rows = []

    def counting(df, keys, function, schema):
        if "registers" in df.columns:
            tile_rows.append(df.count())
        return groups(df, keys, function, schema)

    groups = minhash.map_groups
    monkeypatch.setattr(minhash, "map_groups", counting)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(rows)).collect()}

    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for _, t in rows]
    names = {s: at for at, s in enumerate(sorted(set().union(*sets)))}
    incidence = np.zeros((len(sets), len(names)), dtype=np.float32)
    for at, own in enumerate(sets):
        incidence[at, [names[s] for s in own]] = 1
    both, sizes = incidence @ incidence.T, incidence.sum(axis=1)
    a, b = np.nonzero(np.triu(100 * both >= 85 * (sizes[:, None] + sizes[None, :] - both), 1))
    ids = [doc for doc, _ in rows]
    expected = brute.components(ids, [(ids[p], ids[q]) for p, q in zip(a.tolist(), b.tolist(), strict=True)])
    assert found == {doc: (len(s), expected[doc]) for (doc, _), s in zip(rows, sets, strict=True)}
    assert len(set(expected.values())) > 20
    classes = len({frozenset(s) for s in sets})
    assert classes > 1500 and len(tile_rows) == 2 and sum(tile_rows) <= 20 * classes


def test_held_classes_connect_through_the_hub():
    """Held rows are in the hub's tree: a link to one of them is a link to the hub's component."""
    import pyarrow as pa

    texts = [" ".join(f"{k}w{i}" for i in range(40)) for k in "ab"]
    texts += [texts[0] + " end", texts[1] + " end", " ".join(f"cw{i}" for i in range(40))]
    columns = {
        "hub": [1] * 5, "i": pa.array([0] * 5, pa.int32()), "j": pa.array([1] * 5, pa.int32()),
        "block": pa.array([1, 1, 0, 0, 0], pa.int32()), "held": [True, True, False, False, False],
        "class_id": [8, 5, 3, 4, 6], "mark": [0] * 5, "text": texts,
    }
    links = minhash._verified(pa.RecordBatch.from_pydict(columns), 85)
    assert sorted((r["hub"], r["a"], r["b"]) for r in links.to_pylist()) == [(1, 1, 3), (1, 1, 4)]


def test_only_classes_outside_the_largest_component_meet_their_family(spark, monkeypatch):
    """A hub without links: its family is one component by links of other families."""
    monkeypatch.setattr(minhash, "TILE_CLASSES", 4)
    first = spark.createDataFrame([(0, at, 5) for at in range(20)], "hub long, class_id long, blocks int")
    sizes = spark.createDataFrame([(at, 10) for at in range(20)], "class_id long, n long")
    found = spark.createDataFrame([(at, 1) for at in range(1, 20)], "node long, component long")
    rows = minhash._rest_tiles(first, found, sizes).collect()
    # The hub against itself and five blocks of the others, each of which stands in one tile.
    assert sorted(Counter(r.class_id for r in rows).items()) == [(0, 6), *((at, 1) for at in range(1, 20))]
