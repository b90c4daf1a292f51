from __future__ import annotations

import random

from callsift.llm import components, minhash
from callsift.llm.components import connected_components
from callsift.llm.tables import stored
from callsift.plans import skew
from tests.llm import brute


def test_components_of_chains_hubs_and_noise(spark, monkeypatch):
    monkeypatch.setattr(skew, "PIECE_ROWS", 50)
    r = random.Random(1)
    chain = list(range(100, 160))
    r.shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False)) + [(500, 1000 + i) for i in range(400)]
    edges += [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(250)] + [(7, 7), (8, 9), (8, 9), (9, 8)]
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.component for x in found} == brute.components(nodes, [e for e in edges if e[0] != e[1]])
    assert len(found) == len(nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_written_plan_is_large(spark, monkeypatch):
    """The driver plans, and plans anew after every stage, a table at a time: joins of joins made plans of 900 nodes."""
    lines = {}

    def noting(df, label):
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines[label] = max(lines.get(label, 0), len(plan.splitlines()))
        return stored(df, label)

    monkeypatch.setattr(components, "stored", noting)
    monkeypatch.setattr(minhash, "stored", noting)
    texts = [(i, " ".join(f"w{i % 7}-{at}" for at in range(40))) for i in range(30)]
    found = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i % 7 for i, _ in texts}
    assert {"tiles", "survivors", "links", "stars"} <= set(lines) and max(lines.values()) <= 100, lines
