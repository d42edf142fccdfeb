"""The best edges of seeds that reach many nodes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import graph


def edges_of(spark, seed):
    rng = random.Random(seed)
    rows = {(rng.randrange(2), f"n{rng.randrange(40)}", rng.choice(["USES", "NEEDS"]), f"n{rng.randrange(40)}", rng.randrange(3)): rng.choice([1, 1, 1, 2, 3]) for _ in range(700)}
    rows |= {(0, "hub", "USES", f"n{i % 40}", i): 1 + i % 2 for i in range(80)} | {(1, "x", "USES", "x", 1): 5}
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], "kg_id long, subject string, rel_type string, object string, source_doc_id long, confidence long")


@pytest.mark.parametrize("hops, limit", [(1, 3), (2, 1), (2, 7), (3, 20)])
def test_best_edges_equal_those_of_all_hits(spark, monkeypatch, hops, limit):
    edges = edges_of(spark, hops).localCheckpoint()
    seeds = edges.select("kg_id", F.col("subject").alias("seed")).where("seed like 'n1%' or seed in ('hub', 'x')").distinct()
    columns = ["kg_id", "seed", *graph.KEY, "confidence", "seed_rank"]
    want = sorted(map(tuple, graph.seed_top(graph.expand(edges, seeds, hops), limit).select(*columns).collect()))
    monkeypatch.setattr(graph, "FEW", 0)
    assert sorted(map(tuple, graph.expand_top(edges, seeds, hops, limit).select(*columns).collect())) == want


def test_few_rows_of_a_seed_reach_its_rank(spark, monkeypatch):
    """A seed beside many nodes is ranked from about `limit` rows, not from `limit` of each node."""
    rows = [(0, "s", "USES", f"p{i:03d}", 1, 1) for i in range(200)] + [(0, f"t{j}", "USES", f"p{i:03d}", 1, 1) for i in range(200) for j in range(10)]
    edges = spark.createDataFrame(rows, "kg_id long, subject string, rel_type string, object string, source_doc_id long, confidence long")
    seen = []
    real = graph.seed_top
    monkeypatch.setattr(graph, "FEW", 0)
    monkeypatch.setattr(graph, "seed_top", lambda hits, *a: seen.append(hits.count()) or real(hits, *a))
    got = graph.expand_top(edges, spark.createDataFrame([(0, "s")], "kg_id long, seed string"), 2, 20)
    assert got.count() == 20 and seen == [20]


@pytest.mark.parametrize("few", [0, 1000])
def test_edges_beside_nodes_come_once_without_a_row_per_node(spark, monkeypatch, few):
    edges = edges_of(spark, 9).localCheckpoint()
    nodes = edges.select("kg_id", F.col("subject").alias("node")).where("node like 'n1%' or node in ('hub', 'x')")
    want = sorted(map(tuple, graph.expand(edges, nodes.withColumnRenamed("node", "seed").distinct(), 1).drop("seed").dropDuplicates(["kg_id", *graph.KEY]).select(*edges.columns).collect()))
    monkeypatch.setattr(graph, "FEW", few)
    got = graph.beside(edges, nodes)
    assert sorted(map(tuple, got.select(*edges.columns).collect())) == want
    if few:  # the edges stay where they are
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_no_edge_is_shuffled_to_be_found_twice(spark):
    rows = [(0, s, "USES", o, 1, 1) for s, o in (("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("c", "d"), ("x", "b"))] + [(0, "a", "USES", "b", 2, 1), (1, "a", "USES", "b", 1, 1)]
    edges = spark.createDataFrame(rows, "kg_id long, subject string, rel_type string, object string, source_doc_id long, confidence long")
    got = graph.expand(edges, spark.createDataFrame([(0, "a"), (0, "c")], "kg_id long, seed string"), 2)
    near = {"a": "ab", "c": "bcd"}
    want = sorted((r[0], seed, *r[1:]) for seed, reached in near.items() for r in rows if r[0] == 0 and (r[1] in reached or r[3] in reached))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
