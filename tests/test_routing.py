"""Scores of documents and graphs against all pairs, one by one."""

from __future__ import annotations

import random
from collections import defaultdict
from math import sqrt

import pytest

from weftgraph.operators import routing

LINK = "owner_id long, name string, q_vector array<double>, interest double, professional double"


def plain_scores(docs, graphs):
    """(document, graph) -> score over all pairs with a cosine of 0.01 or more."""
    part, mag = defaultdict(float), defaultdict(float)
    length = lambda v: sqrt(sum(x * x for x in v))
    for d, _, v, di, dp in docs:
        for g, _, w, gi, gp in graphs:
            if v is None or w is None or len(v) != len(w) or min(length(v), length(w)) < 1e-9:
                continue
            cos = sum(x * y for x, y in zip(v, w, strict=True)) / length(v) / length(w)
            if cos >= 0.01:
                m = (di + dp + gi + gp) / 4
                part[d, g] += cos * max(0.0, 1 - (abs(di - gi) + abs(dp - gp)) / 2) * m
                mag[d, g] += m
    return {k: part[k] / mag[k] for k in part}


@pytest.mark.parametrize("block, strip, dense", [(32_768, 128, 4_000_000), (40, 7, 0)])
def test_scores_equal_all_pairs(spark, monkeypatch, block, strip, dense):
    rng = random.Random(5)
    vectors = {f"c{i}": [rng.gauss(0, 1) for _ in range(6)] for i in range(60)} | {"none": None, "zero": [0.0] * 6, "short": [1.0, 2.0]}
    row = lambda owners: (rng.randrange(owners), (n := rng.choice(list(vectors))), vectors[n], rng.randrange(1, 11) / 10, rng.randrange(1, 8) / 10)
    docs, graphs = [row(15) for _ in range(300)], [row(4) for _ in range(200)]  # a name has several owners, a row copies
    monkeypatch.setattr(routing, "BLOCK", block)
    monkeypatch.setattr(routing, "STRIP", strip)
    monkeypatch.setattr(routing, "DENSE", dense)
    monkeypatch.setattr(routing, "BROADCAST_CONCEPTS", block)
    got = {(r["doc_id"], r["kg_id"]): r["score"] for r in routing.concept_scores(spark.createDataFrame(docs, LINK), spark.createDataFrame(graphs, LINK)).collect()}
    want = plain_scores(docs, graphs)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 6e-5 for k in want)


def test_no_links_give_no_scores(spark):
    none = spark.createDataFrame([], LINK)
    assert routing.concept_scores(none, spark.createDataFrame([(1, "a", [1.0], 0.5, 0.5)], LINK)).count() == 0
