from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import walks

SQUARE = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("a", "e")]


def test_walks_are_reproducible(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "a string, b string")
    run = lambda **k: sorted(tuple(r["nodes"]) for r in walks.walks(df, per_node=3, length=5, **k).collect())
    assert run() == run() and len(run()) == 12
    assert run(seed=1) != run(seed=2)
    near = {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")}
    for w in run(p=0.5, q=2.0):
        assert len(w) == 5 and all((x, y) in near or (y, x) in near for x, y in zip(w, w[1:], strict=False))


def test_neighbours_are_numbered_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(walks, "BUCKET", 4)
    pairs = [("hub", f"n{i}") for i in range(50)] + [("n1", "n2"), ("n2", "n1"), ("n1", "n2"), (None, "x"), ("x", None), ("own", "own")]
    rows = walks.numbered(spark.createDataFrame(pairs, "a string, b string")).collect()
    near = {}
    for r in rows:
        near.setdefault(r["node"], []).append((r["pos"], r["other"]))
    want = {"hub": {f"n{i}" for i in range(50)}, "n1": {"hub", "n2"}, "n2": {"hub", "n1"}, "own": {"own"}} | {f"n{i}": {"hub"} for i in range(50) if i not in (1, 2)}
    assert {n: {o for _, o in v} for n, v in near.items()} == want
    assert all(sorted(p for p, _ in v) == list(range(len(v))) for v in near.values())
    assert all(r["degree"] == len(want[r["node"]]) and r["other_degree"] == len(want[r["other"]]) for r in rows)


def transitions(pairs, p, q):
    """Probability of each (back, at, to) by the definition of the weights."""
    near = {}
    for x, y in pairs:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    out = {}
    for back in near:
        for at in near[back]:
            weights = {to: 1 / p if to == back else 1.0 if to in near[back] else 1 / q for to in near[at]}
            out |= {(back, at, to): w / sum(weights.values()) for to, w in weights.items()}
    return out


@pytest.mark.parametrize(("p", "q"), [(0.25, 1.0), (4.0, 0.5), (0.5, 3.0)])
def test_steps_follow_their_weights(spark, p, q):
    got = Counter()
    found = walks.walks(spark.createDataFrame(SQUARE, "a string, b string"), per_node=500, length=4, p=p, q=q).collect()
    assert len(found) == 5 * 500 and {len(r["nodes"]) for r in found} == {4}
    for r in found:
        got.update(zip(r["nodes"], r["nodes"][1:], r["nodes"][2:], strict=False))
    want = transitions(SQUARE, p, q)
    assert set(got) == set(want)
    seen = Counter()
    for (back, at, _), n in got.items():
        seen[back, at] += n
    for step, chance in want.items():
        n = seen[step[:2]]
        assert abs(got[step] / n - chance) < 5 * (chance * (1 - chance) / n) ** 0.5, step


def test_walks_of_nothing_and_of_one_node(spark):
    assert walks.walks(spark.createDataFrame([(None, "x")], "a string, b string")).isEmpty()
    alone = walks.walks(spark.createDataFrame([("x", "x")], "a string, b string"), per_node=2, length=3, p=0.5, q=2.0)
    assert [r["nodes"] for r in alone.collect()] == [["x"] * 3] * 2
    short = walks.walks(spark.createDataFrame([("x", "y")], "a string, b string"), per_node=1, length=1)
    assert sorted(r["nodes"] for r in short.collect()) == [["x"], ["y"]]
    assert walks.walk_vectors(short.limit(0)).isEmpty()


@pytest.mark.parametrize("numbers", [walks.NUMBERS, 0])
def test_vectors_of_one_clique_are_near(spark, numbers):
    cliques = [(f"{g}{i}", f"{g}{j}") for g in "xy" for i in range(6) for j in range(i)] + [("x0", "y0")]
    walked = walks.walks(spark.createDataFrame(cliques, "a string, b string"), per_node=20, length=20)
    v = {r["name"]: np.array(r["vector"]) for r in walks.walk_vectors(walked, width=64, numbers=numbers).collect()}
    assert len(v) == 12 and {len(x) for x in v.values()} == {64}
    cos = lambda a, b: float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))
    inner = np.mean([cos(f"{g}{i}", f"{g}{j}") for g in "xy" for i in range(1, 6) for j in range(1, i)])
    assert inner > np.mean([cos(f"x{i}", f"y{j}") for i in range(1, 6) for j in range(1, 6)]) + 0.2


def test_sketch_tasks_follow_the_walks(spark, monkeypatch):
    rows = [(f"w{i}", [f"n{(i * 7 + j * j) % 23}" for j in range(12)]) for i in range(120)] + [("same", [f"n{j * j % 23}" for j in range(12)])]
    walked = spark.createDataFrame(rows, "walk_id string, nodes array<string>")
    vectors = lambda: {r["name"]: np.array(r["vector"]) for r in walks.context_sketch(walked, 16, 3, 42).collect()}
    want, tasks, write = vectors(), {}, walks.materialise

    def noted(df, name):
        tasks[name] = df.rdd.getNumPartitions()
        return write(df, name)

    monkeypatch.setattr(walks, "materialise", noted)
    monkeypatch.setattr(walks, "TASK_WALKS", 10)
    monkeypatch.setattr(walks, "HOT_ROWS", 12)  # nodes with more contexts are summed where they are
    got = vectors()
    assert tasks["walk-contexts"] == 13
    assert want.keys() == got.keys() and all(np.allclose(want[k], got[k]) for k in want)


def test_sketch_writes_no_pairs_and_equals_its_definition(spark, monkeypatch):
    """Numbers as nodes, some of them crowded; a row per pair of a node and its context is never written."""
    rows = [(i, [i % 40] + [(i * 7 + j * j) % 41 if j % 2 else -1 - i % 3 for j in range(i % 11)]) for i in range(300)]
    near, mass = Counter(), Counter()
    for _, w in rows:
        for i, node in enumerate(w):
            for j in range(max(0, i - 3), min(len(w), i + 4)):
                if j != i:
                    near[node, w[j]] += 1
                    mass[node] += 1
    walked, written, write = spark.createDataFrame(rows, "walk_id long, nodes array<long>").repartition(5), {}, walks.materialise

    def noted(df, name):
        out = write(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(walks, "materialise", noted)
    monkeypatch.setattr(walks, "TASK_WALKS", 50)
    monkeypatch.setattr(walks, "HOT_ROWS", 400)
    hashes = {r["context"]: r["h"] for r in spark.createDataFrame([(n,) for n in mass], "context long").select("context", F.xxhash64("context", F.lit(42)).alias("h")).collect()}
    total, want = sum(mass.values()), {n: np.zeros(16) for n in mass}
    for (node, context), n in near.items():
        x = np.log(n * total / mass[node] / mass[context])
        for s in range(walks.SPOTS if x > 0 else 0):
            at, sign = walks.spots(np.array([hashes[context]]), s, 16)
            want[node][int(at[0])] += sign[0] * x / walks.SPOTS**0.5
    for masses in (1 << 20, 0):  # broadcast, or met by a shuffle
        monkeypatch.setattr(walks, "MASSES", masses)
        got = {r["name"]: np.array(r["vector"]) for r in walks.context_sketch(walked, 16, 3, 42).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[n], want[n]) for n in want)
    assert max(mass.values()) > 400 and max(written.values()) < 2 * len(mass) < len(near)


def test_walks_on_numbers_follow_edges(spark):
    near = {(2, 1), (2, 3), (4, 3), (4, -5)}
    found = walks.walks(spark.createDataFrame(sorted(near), "a long, b int"), per_node=3, length=7, p=0.5, q=2.0)
    assert found.schema["nodes"].dataType.elementType.typeName() == "long"
    rows = [r["nodes"] for r in found.collect()]
    assert len(rows) == 15 and all(len(w) == 7 and all((x, y) in near or (y, x) in near for x, y in zip(w, w[1:], strict=False)) for w in rows)
