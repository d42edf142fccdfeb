import itertools

import numpy as np
import pytest

from weftgraph.operators import cluster, scoring, selfjoin

SCHEMA = "id long, v array<double>"


def brute(rows, least):
    out = {}
    for (a, x), (b, y) in itertools.combinations(sorted((i, v) for i, v in rows if v is not None), 2):
        n = np.linalg.norm(x) * np.linalg.norm(y)
        sim = round(float(np.dot(x, y) / n), 6) if n > 1e-12 else 0.0
        if sim >= least:
            out[a, b] = sim
    return out


def planted(n, dim=16, groups=12, seed=1):
    """Rows about some directions, with repeats, null and zero vectors."""
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(groups, dim))
    rows = [(i, (rng.uniform(0.2, 9) * (mid[i % groups] + rng.normal(size=dim) * 0.2)).tolist()) for i in range(n)]
    return [*rows, *((n + i, rows[5][1]) for i in range(n // 3)), (10**6, None), (10**6 + 1, [0.0] * dim), (10**6 + 2, [0.0] * dim)]


@pytest.mark.parametrize("least", [0.3, 0.9, 0.999])
def test_pairs_equal_all_pairs_and_few_are_examined(spark, least):
    rows = planted(300)
    join = selfjoin.SelfJoin(spark.createDataFrame(rows, SCHEMA), "id", "v", least, block=32, centres=12)
    got = [((r["a"], r["b"]), r["sim"]) for r in join.pairs().collect()]
    want = brute(rows, least)
    assert len(got) == len(dict(got)) and dict(got).keys() == want.keys()
    assert all(abs(s - want[p]) < 2e-6 for p, s in got)
    n = len(rows) - 3
    if least >= 0.9:
        assert join.examined() < 0.4 * n * (n - 1) / 2
    # the repeats of one vector are split over blocks
    assert join.blocks.agg({"n": "max"}).first()[0] <= 64


def test_random_directions_lose_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 8)))]
    for least in (0.2, 0.7):
        join = selfjoin.SelfJoin(spark.createDataFrame(rows, SCHEMA), "id", "v", least, block=40, centres=9)
        assert {(r["a"], r["b"]) for r in join.pairs().collect()} == brute(rows, least).keys()


def test_groups_are_components_of_the_pairs(spark):
    rows = planted(120)
    df = spark.createDataFrame(rows, SCHEMA)
    for least in (0.35, 0.95):
        label = {i: i for i, _ in rows}
        for a, b in sorted(brute(rows, least)):
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
        got = selfjoin.similar_groups(df, "id", "v", least).collect()
        assert len(got) == len(rows) and {r["node"]: r["component"] for r in got} == label


def test_forest_connects_what_the_edges_connect():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        i, j = rng.integers(0, n, (2, int(rng.integers(0, 50))))
        node, root = selfjoin.forest(i, j, n)

        def parts(edges):
            label = list(range(n))
            for a, b in edges:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
            return label

        assert len(node) < n and parts(zip(i, j, strict=True)) == parts(zip(node, root, strict=True))


def test_empty_tables_texts_as_keys_and_bad_limits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert selfjoin.similar_pairs(empty, "id", "v", 0.5).isEmpty() and selfjoin.similar_groups(empty, "id", "v", 0.5).isEmpty()
    named = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), (None, [1.0, 0.0]), ("c", [0.0, 1.0])], "name string, v array<double>")
    assert [tuple(r) for r in selfjoin.similar_pairs(named, "name", "v", 0.5).collect()] == [("a", "b", 1.0)]
    assert sorted(map(tuple, selfjoin.similar_groups(named, "name", "v", 0.5).collect())) == [("a", "a"), ("b", "a"), ("c", "c")]
    with pytest.raises(ValueError):
        selfjoin.SelfJoin(named, "name", "v", 0.0)


def test_unmatched_documents_are_clustered_alone(spark):
    links = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "x"), (5, "z")], "owner_id long, name string")
    scores = spark.createDataFrame([(3, 0.05), (4, 0.04), (5, 0.9)], "owner_id long, score double")
    assert sorted(r[0] for r in cluster.unmatched(links, scores).select("owner_id").distinct().collect()) == [1, 2, 4]
    mean = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.0]), (4, [0.0, 1.0])], "owner_id long, centroid array<double>")
    got = cluster.cluster_documents(mean, "owner_id", cluster.unmatched(links, scores)).collect()
    assert [(r["component"], r["size"], r["similarity"], r["top_concepts"]) for r in got] == [(1, 2, 0.995, "x")]
    assert scoring.pair_similarity(mean, "owner_id", 0.9).count() == 1


def test_blocks_are_sent_in_groups(spark, monkeypatch):
    """A block goes to every group that it meets: under half of the rows, the same pairs."""
    import numpy as np
    from pyspark.sql import functions as F

    from weftgraph.operators import selfjoin

    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(f"v{i:04d}", rng.normal(size=6).tolist()) for i in range(600)], "name string, v array<double>").localCheckpoint()
    plain = selfjoin.SelfJoin(rows, "name", "v", 0.5, block=10)
    monkeypatch.setattr(selfjoin, "TOGETHER", 1)
    want = sorted(map(tuple, plain.pairs().collect()))
    monkeypatch.setattr(selfjoin, "TOGETHER", 8)
    sent = plain.sent()
    assert sent.count() * 2 < 2 * plain.plan.count() and sent.agg(F.sum(F.size("mates"))).first()[0] == plain.plan.count()
    assert len(want) > 1000 and sorted(map(tuple, plain.pairs().collect())) == want
