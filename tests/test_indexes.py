import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import graph as G
from weftgraph.operators import indexes
from weftgraph.operators.indexes import NameIndex, VectorIndex

VECTORS = "name string, q_vector array<double>"


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return 0.0 if na < 1e-9 or nb < 1e-9 else max(-1.0, min(1.0, sum(x * y for x, y in zip(a, b, strict=True)) / na / nb))


def plain(queries, rows, k):
    out = []
    for q, v in queries:
        best = sorted(((round(cosine(w, v), 6), n) for n, w in rows if w is not None), key=lambda x: (-x[0], x[1]))[:k]
        out += [(q, n, c, i) for i, (c, n) in enumerate(best, 1)]
    return sorted(out)


def vectors(n, seed, width=8, groups=6):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(groups)]
    return [(f"v{i:04d}", [m + rng.gauss(0, 0.25) for m in middles[i % groups]]) for i in range(n)]


def test_exact_search_equals_a_scan_and_probes_find_most(spark):
    rows = vectors(600, 1) + [("same-a", [1.0] * 8), ("same-b", [2.0] * 8), ("zero", [0.0] * 8)] + [(f"copy{i}", [0.5, 1.0] * 4) for i in range(200)]
    queries = vectors(12, 2) + [("q-same", [1.0] * 8), ("q-zero", [0.0] * 8), ("q-copy", [0.5, 1.0] * 4)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    asked = spark.createDataFrame(queries, "q_name string, q_vec array<double>")
    index = VectorIndex.build(df)
    assert index.rows().count() == len(rows) and {r["n"] for r in index.cells().where("cell = -1").collect()} == {1}
    want = plain(queries, rows, 7)
    got = sorted((r["q_name"], r["name"], r["cos"], r["rank"]) for r in index.search(asked, 7, probes=2, exact=True).collect())
    assert [(q, n, i) for q, n, _, i in got] == [(q, n, i) for q, n, _, i in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))
    near = {(r["q_name"], r["name"]) for r in index.search(asked.where("q_name <> 'q-zero'"), 7, probes=6).collect()}
    true = {(q, n) for q, n, _, _ in want if q != "q-zero"}
    assert len(near & true) >= 0.95 * len(true)
    shares = [r["share"] for r in index.scanned(asked.where("q_name <> 'q-zero'"), probes=6).collect()]
    assert len(shares) == len(queries) - 1 and sum(shares) / len(shares) < 0.6
    scan = index.search(asked, 7, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in scan


def test_index_of_few_rows(spark):
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "q_name string, q_vec array<double>")
    for rows in ([], [("only", [0.0, 2.0])], [("none", None), ("zero", [0.0, 0.0])]):
        index = VectorIndex.build(spark.createDataFrame(rows, VECTORS))
        assert sorted(r["name"] for r in index.search(asked, 3, exact=True).collect()) == sorted(n for n, _ in rows)


def test_recall_on_the_concepts(spark, data):
    concepts = spark.read.parquet(f"{data}/embeddings.parquet").select(F.concat(F.lit("concept-"), "vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("q_vector"), "vec_id")
    asked = concepts.where("vec_id % 50 = 0").select(F.col("name").alias("q_name"), F.col("q_vector").alias("q_vec"))
    index = VectorIndex.build(concepts)
    pairs = lambda df: {(r["q_name"], r["name"]) for r in df.collect()}
    true = pairs(index.search(asked, 10, exact=True))
    assert len(true & pairs(index.search(asked, 10))) >= 0.9 * len(true)


@pytest.mark.parametrize("terms", [["12", "SUPP"], ["a"], ["zz"], [], ["été", "部"], ["o'"]])
def test_name_index_equals_a_scan(spark, tmp_path, terms):
    names = ["supplier-12", "part-120", "x12", "12 12 supp", "Été-à", "部品 一", "a_b", "", "Supply chain", None, "o'neil", "supplier-12"]
    rows = spark.createDataFrame([(i % 2, n) for i, n in enumerate(names)], "kg_id long, name string")
    index = NameIndex.build(rows, f"file://{tmp_path}/index", parts=3)
    words = [t for t in {t.lower() for t in terms}]
    got = {(r["kg_id"], r["name"]): r["terms"] for r in index.search(terms).collect()}
    want = {(r["kg_id"], r["name"]) for r in G.names_with_prefix(rows, terms).collect()} if terms else set()
    assert set(got) == want
    for (_, n), k in got.items():
        assert k == sum(any(w.startswith(t) for w in "".join(c if c.isalnum() else " " for c in n.lower()).split()) for t in words)
    assert all(r["kg_id"] == 1 for r in index.search(terms, kg=1).collect())


def test_a_prefix_reads_its_range_alone(spark, tmp_path):
    rows = spark.range(20_000).select(F.lit(0).cast("long").alias("kg_id"), F.concat(F.lit("w"), F.lpad("id", 5, "0"), F.lit(" every")).alias("name"))
    index = NameIndex.build(rows, f"file://{tmp_path}/index", parts=8)
    found = index.postings(["w0012"])
    assert found.count() == 10 and "StringStartsWith(word,w0012)" in found._jdf.queryExecution().executedPlan().toString()
    sizes = [r["n"] for r in index.postings(["every"]).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 9_000  # a word of every name is split over files


def test_blocks_find_what_pairs_find(spark, monkeypatch):
    odd = [("null", None), ("zero", [0.0] * 8), (None, [1.0] * 8)]
    rows = vectors(500, 3) + odd + [(f"copy{i}", [0.5, 1.0] * 4) for i in range(150)]
    queries = vectors(30, 4) + [("q-zero", [0.0] * 8), ("q-short", [1.0, 1.0]), ("q-copy", [0.5, 1.0] * 4), ("q-null", None)]
    index = VectorIndex.build(spark.createDataFrame(rows, VECTORS).repartition(5))
    asked = spark.createDataFrame(queries, "q_name string, q_vec array<double>")
    found = lambda **how: sorted((r["q_name"], r["rank"], r["name"] or "", str(r["cos"])) for r in index.search(asked, 7, **how).collect())
    exact, near = found(exact=True), found(probes=3)
    for name, n in (("PRODUCT_PAIRS", 0), ("BLOCK_ROWS", 40), ("BLOCK_QUERIES", 8), ("STRIP", 5)):
        monkeypatch.setattr(indexes, name, n)
    paired, seen = VectorIndex._paired, []
    monkeypatch.setattr(VectorIndex, "_paired", lambda self, rows, asked, *more: seen.append(min(rows.count(), asked.count())) or paired(self, rows, asked, *more))
    assert found(exact=True) == exact and found(probes=3) == near
    assert max(seen, default=0) <= len(odd)  # only odd vectors become pairs


def test_rounding_is_that_of_decimal_digits():
    x = np.array([0.0000005, -0.0000005, 0.1234565, 0.12345649999999999, 1.0, -1.0, 0.0, -1e-9])
    assert indexes.millionths(x).tolist() == [1, -1, 123457, 123456, 1e6, -1e6, 0, 0]
