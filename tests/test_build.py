import random
import re
from collections import Counter
from types import SimpleNamespace

from pyspark.sql import functions as F

from weftgraph.functions import providers
from weftgraph.operators import build
from weftgraph.plans import build_queries, views
from weftgraph.session import scratch_path


def test_build_equals_a_plain_build(spark):
    rng = random.Random(4)
    names, verbs = ["Alpha", "beta", "Gamma-1", "delta", "none"], ["uses", "requires", "sees"]
    texts = {i: "".join(f"So {rng.choice(names)} {rng.choice(verbs)} {rng.choice(names)} here number {i}!" + rng.choice(["", "\n"]) for _ in range(n)) for i, n in enumerate([1, 4, 5, 6, 23, 400])}
    want = Counter()
    for i, text in texts.items():
        parts = re.findall(r"[^!]+!\n?", text)
        for at in range(0, len(parts), 5):
            found = set(re.findall(r"(\S+) (uses|requires) (\S+)", "".join(parts[at : at + 5])))
            want.update((i, s, v.upper(), o) for s, v, o in found if "none" not in (s, o))
    docs = spark.createDataFrame([(i, 0, t) for i, t in texts.items()] + [(90, 0, None), (91, 0, "")], "doc_id long, kg_id long, text string")
    got = {tuple(r)[:4]: r["confidence"] for r in build_queries.built(spark, docs, batches=3).collect()}
    assert got == want and {k[0] for k in got} >= {1, 3, 5}


def test_build_reads_every_documents_text(spark, data):
    class Planted(views.Tables):
        @property
        def docs(self):
            return super().docs.withColumn("content", F.concat(F.coalesce("content", F.lit("")), F.lit("\nHere Zulu uses yankee!")))

    t = Planted(spark, data)
    got = build_queries.build_pipeline(t).where("subject = 'Zulu' and object = 'yankee'").select("source_doc_id")
    got = got.intersectAll(build_queries.build_pipeline(t).where("subject = 'alpha' and object = 'beta'").select("source_doc_id"))
    assert got.count() == t.docs.count() and got.exceptAll(t.docs.select("doc_id")).isEmpty()


def test_communities_use_all_edges_and_walks_their_defaults(spark):
    edges = spark.createDataFrame([(0, s, o, 150) for s, o in ("ab", "bc", "ac")], "kg_id long, subject string, object string, source_doc_id long")
    links = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y")], "owner_id long, name string")
    t = SimpleNamespace(spark=spark, edges=edges, links=links)
    assert {r["node"] for r in build_queries.communities(t).collect()} == {"a", "b", "c"}
    walked = build_queries.walks(t).collect()
    assert len(walked) == 4 * 10 and {len(r["nodes"]) for r in walked} == {40}
    assert {len(r["vector"]) for r in build_queries.graph_vectors(t).collect()} == {384}


def test_a_new_store_costs_no_join_and_texts_without_verbs_no_pattern(spark, monkeypatch):
    store = build.GraphStore(spark, scratch_path(spark, "new-store"))
    docs = spark.range(5).select("id", F.lit(0).cast("long").alias("kg_id"), F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    left = build.without_known(docs, store.read("documents").where("processed"), ("kg_id", "doc_id"))
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "ExistingRDD" not in store.read("progress")._jdf.queryExecution().executedPlan().toString() and left.count() == 5
    rules = providers.RuleLanguage()
    assert rules.triples("Alpha uses beta, so uses\nuses it") == ["Alpha|概念|USES|uses|beta|概念"]
    monkeypatch.setattr(providers.re, "findall", lambda *a: 1 / 0)
    assert rules.triples("Nothing reuses this; he uses. It uses\n") == []
