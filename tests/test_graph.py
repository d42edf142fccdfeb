import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import communities, components, graph, history, store
from weftgraph.streaming.streams import limit_requests

EDGE = "kg_id long, subject string, subject_type string, rel_type string, verb string, object string, object_type string, source_doc_id long, confidence long, created_at timestamp, updated_at timestamp"


def edge(s, o, r="USES", d=0, c=1, kg=0):
    return (kg, s, "概念", r, r.lower(), o, "概念", d, c, None, None)


def trail_edges(edges, seed, hops):
    """Edges on undirected trails (no edge twice) of at most `hops` edges from seed, by enumeration."""
    found = set()

    def walk(node, used):
        for i, (a, b) in enumerate(edges):
            if i not in used and node in (a, b) and len(used) < hops:
                found.add(i)
                walk(b if node == a else a, used | {i})

    walk(seed, frozenset())
    return found


def test_expansion_equals_enumerated_trails(spark):
    rng = random.Random(4)
    for case in range(4):
        pairs = [(f"n{rng.randrange(6)}", f"n{rng.randrange(6)}") for _ in range(8)]
        df = spark.createDataFrame([edge(a, b, d=i, kg=case) for i, (a, b) in enumerate(pairs)], EDGE)
        seeds = spark.createDataFrame([(case, "n0")], "kg_id long, seed string")
        for hops in (1, 2, 3):
            got = {r["source_doc_id"] for r in graph.expand(df, seeds, hops).collect()}
            assert got == trail_edges(pairs, "n0", hops), (case, hops, pairs)


def test_confidence_filters_after_expansion(spark):
    df = spark.createDataFrame([edge("a", "b", c=1), edge("b", "c", c=5)], EDGE)
    seeds = spark.createDataFrame([(0, "a")], "kg_id long, seed string")
    got = graph.seed_top(graph.expand(df, seeds, 2), min_conf=3).collect()
    assert [(r["subject"], r["object"]) for r in got] == [("b", "c")]


@pytest.mark.parametrize("few", [0, 1000])
def test_a_hub_is_spread_and_nothing_changes(spark, monkeypatch, few):
    monkeypatch.setattr(graph.J, "HOT_ROWS", 8)
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(6)
    pairs = [("hub", f"n{i}") for i in range(40)] + [(f"n{rng.randrange(40)}", f"n{rng.randrange(60)}") for _ in range(60)] + [("n1", "n1")]
    rows = [edge(a, b, c=rng.randrange(1, 9), d=i) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, EDGE)
    seeds = spark.createDataFrame([(0, f"n{i}") for i in (1, 2, 3, 50)], "kg_id long, seed string")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for hops in (1, 2, 3):
        for s in ("n1", "n2", "n3", "n50"):
            nodes = {s}
            for _ in range(hops - 1):
                nodes |= {o for n in nodes for o in near.get(n, ())}
            want[hops, s] = {i for i, p in enumerate(pairs) if nodes & set(p)}
        got = graph.expand(df, seeds, hops).collect()
        assert len(got) == sum(len(want[hops, s]) for s in ("n1", "n2", "n3", "n50"))
        assert all(r["source_doc_id"] in want[hops, r["seed"]] for r in got)
        for limit, least in ((3, 1), (5, 4)):
            plain = graph.seed_top(graph.expand(df, seeds, hops), limit, least).select("seed", "source_doc_id", "seed_rank")
            early = graph.expand_top(df, seeds, hops, limit, least).select("seed", "source_doc_id", "seed_rank")
            assert sorted(map(tuple, early.collect())) == sorted(map(tuple, plain.collect()))
    met = graph.Adjacency(graph.undirected(df), 300, ("other",))
    assert [(r["node"], r["parts"]) for r in met.hubs.collect() if r["node"] == "hub"] == [("hub", 5)]


def test_fact_text_and_orphans(spark):
    df = spark.createDataFrame([edge("Transformer", "多頭注意力"), edge("多頭注意力", "長距離依賴建模", "IMPROVES")], EDGE)
    assert df.select(graph.fact_text().alias("f")).first()["f"] == "Transformer(概念) -[使用:uses]→ 多頭注意力(概念)"
    names = spark.createDataFrame([(0, n) for n in ("Transformer", "多頭注意力", "長距離依賴建模", "alone")], "kg_id long, name string")
    assert [r["name"] for r in graph.orphans(names, df).collect()] == ["alone"]


@pytest.mark.parametrize("shape", ["chain", "two", "star"])
def test_components(spark, shape):
    pairs = {"chain": [(i, i + 1) for i in range(300)], "two": [(1, 2), (3, 4), (4, 4)], "star": [(0, i) for i in range(1, 50)]}[shape]
    random.Random(1).shuffle(pairs)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = {"chain": dict.fromkeys(range(301), 0), "two": {1: 1, 2: 1, 3: 3, 4: 3}, "star": dict.fromkeys(range(50), 0)}[shape]
    assert got == want


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_cliques_are_communities(spark):
    clique = lambda p: list(itertools.combinations([f"{p}{i}" for i in range(1, 5)], 2))
    pairs = [*clique("a"), *clique("b"), ("a1", "b1")]
    df = spark.createDataFrame([(0, *p) for p in pairs] + [(1, *p) for p in [*clique("c"), ("x", "y")]], "kg_id long, a string, b string")
    got = {}
    for r in communities.communities(df).collect():
        got.setdefault((r["kg_id"], r["community"]), set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [["a1", "a2", "a3", "a4"], ["b1", "b2", "b3", "b4"], ["c1", "c2", "c3", "c4"]]


def test_merging_counts_and_order(spark):
    rows = spark.createDataFrame([(0, "a", "USES", "b", 1, v, c, i, None) for i, (v, c) in enumerate([("v1", "x"), ("v2", "y"), ("v3", "x"), ("v4", None)])], "kg_id long, subject string, rel_type string, object string, source_doc_id long, verb string, chunk_id string, seq long, ts timestamp")
    r = store.merge_triples(rows).first()
    assert (r["confidence"], r["verb"], r["source_chunk_ids"]) == (4, "v4", ["y", "x"])


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, v string, made long")
    delta = spark.createDataFrame([(2, "B", 9), (3, "c", 9)], "k long, v string, made long")
    once = store.upsert(base, delta, ["k"], keep=("made",))
    twice = store.upsert(once, delta, ["k"], keep=("made",))
    want = [(1, "a", 5), (2, "B", 6), (3, "c", 9)]
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, twice.collect())) == want


def test_history(spark):
    df = spark.sql("select 0L kg_id, 'a' subject, timestamp'2020-01-01' created_at, cast(null as timestamp) updated_at union all select 0L, 'b', timestamp'2019-01-01', timestamp'2021-01-01'")
    since = F.expr("timestamp'2020-06-01'")
    assert [(r["subject"], r["change_type"]) for r in history.diff(df, since, ["subject"]).collect()] == [("b", "updated")]
    assert [r["subject"] for r in history.snapshot(df, since, ["subject"]).collect()] == ["b", "a"]
    assert spark.range(1).select(history.valid_time(F.lit("no time"))).first()[0] is False


def test_limiter_forgets_rejected_requests():
    assert limit_requests([(0, 0), (1, 0), (2, 0), (60.5, 0), (61.5, 0)], limit=2) == [True, True, False, True, True]
    assert all(limit_requests([(0, 0)] * 50, limit=0))


def test_a_short_frontier_writes_no_neighbours_of_all_nodes(spark, monkeypatch):
    """Only what a short frontier meets is shuffled; a longer one needs the neighbours, with the same result."""
    from weftgraph.operators import graph

    rows = [(0, f"s{i % 7}", "USES", f"p{i}", 1, 1) for i in range(40)] + [(0, "s1", "USES", "p0", 2, 1), (0, "s2", "USES", "s2", 3, 1)]
    edges = spark.createDataFrame(rows, "kg_id long, subject string, rel_type string, object string, source_doc_id long, confidence long")
    seeds = spark.createDataFrame([(0, "s1"), (0, "p0"), (0, "absent")], "kg_id long, seed string")
    made = []
    write = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: made.append(name) or write(df, name))
    reached = {k: sorted(map(tuple, graph.reach(edges, seeds, k).collect())) for k in (1, 3)}
    assert "expand-near" not in made
    monkeypatch.setattr(graph, "FEW", 0)
    assert {k: sorted(map(tuple, graph.reach(edges, seeds, k).collect())) for k in (1, 3)} == reached and "expand-near" in made
