import io
import os
import threading
import time
import zlib

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import providers
from weftgraph.operators import admin, build, evaluation, routing, services
from weftgraph.sources import files


def models(folder):
    """Two providers that travel to the workers by value: one fails on the first try of a text with `boom`, one always."""

    class Flaky(providers.RuleLanguage):
        def triples(self, text):
            mark = os.path.join(folder, "tried")
            if "boom" in text and not os.path.exists(mark):
                open(mark, "w").close()
                raise ValueError("busy")
            return [*super().triples(text), *(["Alpha|概念|GUARDS|guards|Beta|概念"] if "guards" in text else []), "ghost|概念|USES|uses|phantom|概念"]

    class Dead(providers.RuleLanguage):
        def triples(self, text):
            raise TimeoutError("no model")

    return Flaky, Dead


def test_build_retries_extends_and_resumes(spark, tmp_path):
    store, (Flaky, Dead) = build.GraphStore(spark, f"file://{tmp_path}/g"), models(str(tmp_path))
    docs = spark.createDataFrame([(1, 0, "So Alpha uses Beta here. It is fine!"), (2, 0, "boom Gamma requires Delta here!"), (3, 1, "Alpha guards Beta at night!"), (4, 1, None)], "doc_id long, kg_id long, text string")
    first = build.build_graph(store, docs.coalesce(1), Flaky).first()
    assert (first["chunks"], first["done"], first["failed"], first["new_types"]) == (3, 3, 0, ["GUARDS"])
    edges = {(r["subject"], r["rel_type"], r["object"], r["confidence"]) for r in store.read("edges").collect()}
    assert edges == {("Alpha", "USES", "Beta", 1), ("Gamma", "REQUIRES", "Delta", 1), ("Alpha", "GUARDS", "Beta", 1)}  # what the text doesn't name is refused
    again = build.build_graph(store, docs, Dead).first()  # nothing is left to do, so no model is asked
    assert (again["done"], again["failed"], again["edges"]) == (0, 0, 3)
    more = docs.unionByName(spark.createDataFrame([(5, 0, "Now Alpha uses Beta again!")], docs.schema))
    lost = build.build_graph(store, more, Dead).first()
    assert (lost["done"], lost["failed"], lost["rounds"]) == (0, 1, 3)
    state = {r["doc_id"]: (r["processed"], r["attempt"], r["error"]) for r in store.read("progress").collect()}
    assert state[5] == (False, 3, "TimeoutError: no model") and state[1][0] is True
    assert build.build_graph(store, more).first()["done"] == 1
    assert store.read("edges").count() == 4 and {r["name"] for r in store.entities().collect()} == {"Alpha", "Beta", "Gamma", "Delta"}


def test_route_and_classification(spark):
    link = "owner_id long, name string, q_vector array<double>, interest double, professional double"
    docs = spark.createDataFrame([(1, "a", [1.0, 0.0], 0.5, 0.5), (2, "b", [0.0, 1.0], 0.5, 0.5), (3, "c", [-1.0, 0.0], 0.5, 0.5)], link)
    graphs = spark.createDataFrame([(10, "x", [1.0, 0.0], 0.5, 0.5), (11, "y", [1.0, 0.1], 0.5, 0.5), (12, "z", [0.0, 1.0], 0.0, 0.0)], link)
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc_id long")
    want = {1: (10, "assigned"), 2: (12, "assigned"), 3: (None, "unmatched"), 4: (None, "unmatched")}
    for bound in (routing.BROADCAST_CONCEPTS, 0):  # broadcast, and blocks
        with pytest.MonkeyPatch.context() as m:
            m.setattr(routing, "BROADCAST_CONCEPTS", bound)
            got = {r["doc_id"]: (r["kg_id"], r["status"]) for r in routing.classify_documents(ids, docs, graphs).collect()}
            assert got == want
    linked = routing.assign(spark.createDataFrame([(10, 1)], "kg_id long, doc_id long"), routing.classify_documents(ids, docs, graphs))
    assert sorted(map(tuple, linked.collect())) == [(10, 1), (12, 2)]


def test_contrastive_pairs_fill_up(spark):
    own = spark.createDataFrame([(1, "a"), (1, "b")], "owner_id long, name string")
    kg = spark.createDataFrame([(9, n) for n in "abcd"], "owner_id long, name string")
    pairs = lambda **k: sorted(map(tuple, routing.contrastive_pairs(own, kg, **k).collect()))
    assert pairs(enough=1) == [("a", "b")] and pairs(enough=2, most=3) == [("a", "b"), ("a", "c"), ("a", "d")] and len(pairs()) == 6


def test_housekeeping(spark):
    t = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "kg_id long, community int, node string")
    new = admin.communities_table(t, spark.createDataFrame([(1, i // 3, f"n{i}") for i in range(9)], t.schema))
    assert sorted((r["kg_id"], r["node"]) for r in new.collect()) == [(1, f"n{i}") for i in range(9)] + [(2, "b")]
    assert {(r["kg_id"], r["community"], r["rank"]) for r in admin.top_communities(new, 2).collect()} == {(1, 0, 1), (1, 1, 2), (2, 0, 1)}
    stay, gone = admin.delete_chunks(spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "doc_id long, chunk_id string"), spark.createDataFrame([(1,)], "doc_id long"))
    assert [tuple(r) for r in gone.collect()] == [(1, 2)] and stay.count() == 1
    assert admin.escape_terms(["C++ (x)", 'a"b/c']) == r"C\+\+ \(x\)* OR a\"b\/c*"
    empty = admin.ingest_summary(spark.createDataFrame([], "ok boolean")).first()
    assert (empty["total"], empty["fail_percent"], empty["warning"]) == (0, 0.0, False)
    doc = admin.as_documents(spark.createDataFrame([(1, None)], "doc_id long, title string")).first()
    assert (doc["title"], doc["content"], doc["is_processed"], doc["file_path"]) == ("", "", False, None)
    assert admin.checked("chat", question="q", top_k=10)["svo_hops"] == 2
    for bad in ({"question": ""}, {"question": "q", "svo_hops": 4}, {"question": "q", "history": ["m"] * 51}, {"question": "q", "other": 1}, {}):
        with pytest.raises(ValueError):
            admin.checked("chat", **bad)


def test_judged_metrics():
    say = {"faithfulness": 'ok {"statements": [{"supported": "YES"}, {"supported": "NO"}]}', "relevance": '{"score": 9}', "recall": '{"core_facts": [{"covered": "YES"}]}'}
    assert evaluation.judged("a", ["c"], say) == {"faithfulness": 0.5, "relevance": 0.9, "recall": 1.0}
    assert evaluation.judged("a", ["c"], {k: "garbage" for k in say}) == {"faithfulness": 0.8, "relevance": 0.7, "recall": 0.6}
    assert evaluation.judged("", ["c"], say)["relevance"] == 0 and evaluation.judged("a", [], say) == {"faithfulness": 0.0, "relevance": 0.9, "recall": 0.0}


def test_report(spark, tmp_path):
    scores = spark.createDataFrame([("graph", 0.5, 1.0, 0.0), ("graph", 1.0, 0.5, 0.5), ("hybrid", 1.0, 1.0, 1.0)], "mode string, faithfulness double, relevance double, recall double")
    text = evaluation.report(evaluation.averages(scores), f"file://{tmp_path}/r")
    assert text.splitlines()[2:] == ["| graph | 2 | 0.75 | 0.75 | 0.25 | False |", "| hybrid | 1 | 1.0 | 1.0 | 1.0 | True |"]
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/r").count() == 2


def test_federation():
    guard = services.Breaker(60)
    shards = {"a": lambda t: [f"{x} one" for x in t], "b": lambda t: ["k one", "b"], "slow": lambda t: time.sleep(1) or []}
    facts, results = services.federated_query(shards, ["k"], lambda t: [*t, "kk"], {"a"}, seconds=0.3, breaker=guard)
    assert facts == ["k one", "kk one", "b"] and [r["status"] for r in results] == ["ok", "ok", "timeout"]
    assert guard.open("slow") and services.federated_query({}, ["k"], list, set()) == ([], [])
    rows = services.federation_status([{"kb_id": k} for k in ("a", "b", "slow", "new")], {"a"}, guard, {"a", "b", "slow"})["shards"]
    assert [r["status"] for r in rows] == ["local", "online", "offline", "pending"]


def test_registry_is_stale_while_it_refreshes():
    now, calls, gate = [0.0], [], threading.Event()

    def fetch():
        calls.append(1)
        if len(calls) == 2:
            gate.wait(5)
        if len(calls) >= 3:
            raise OSError
        return [{"kb_id": len(calls)}]

    r = services.Registry(fetch, 10, lambda: now[0])
    assert r.get() == [{"kb_id": 1}] == r.get()
    now[0] = 11
    assert r.get() == [{"kb_id": 1}]
    gate.set()
    r.close()
    assert r.get() == [{"kb_id": 2}]
    now[0] = 30
    r.get(), r.close()
    assert r.get() == [{"kb_id": 2}]  # the failed fetch leaves what is known


def test_subscription_sync(tmp_path):
    store = services.Subscriptions(str(tmp_path / "s.json"))
    for k in ("ok", "bad", "slow"):
        store.add(k, "uri")
    store.add("off", "uri")
    store.set_status("off", "paused")

    def fetch(row):
        if row["kb_id"] == "bad":
            raise OSError("gone")
        if row["kb_id"] == "slow":
            time.sleep(1.0)
        return 7

    got = {r["kb_id"]: (r["status"], r["rows"]) for r in services.sync_subscriptions(store, fetch, "2024-01-01", seconds=0.4)}
    assert got == {"ok": ("ok", 7), "bad": ("error", 0), "slow": ("timeout", 0)}
    assert store.rows["ok"]["last_sync_at"] == "2024-01-01" and store.rows["bad"]["error_msg"] == "OSError: gone"


def test_plans_prompts_and_batches():
    items = [{"id": f"d{i}", "title": str(i)} for i in range(5)]
    plan = services.cluster_plan(items, lambda rows: [{"name": "A", "members": [0, 2, 99, 2]}, {"name": "B", "members": [2, 4]}, {"name": " ", "members": [1]}])
    assert plan == [{"name": "A", "ids": ["d0", "d2"]}, {"name": "B", "ids": ["d4"]}, {"name": "", "ids": ["d1", "d3"]}]
    linked = []
    assert services.confirm_plan(plan, lambda n: n.lower(), lambda kg, ids: linked.append((kg, ids))) == [("A", "a"), ("B", "b")]
    assert linked == [("a", ["d0", "d2"]), ("b", ["d4"])]
    assert services.world_prompt("q", ["f1", "f" * 5000], [("t", "x" * 9000)]).count("x") == 4000 - 3
    edges = [{"verb": "uses", "rel_type": "RELATED_TO"}] * 12
    changes, batches = services.reclassify(edges, lambda part: ["USES", "NOPE"] * 5)
    assert (len(changes), batches) == (6, 2) and services.reclassify(edges, lambda p: ["USES"] * 10, dry=True) == ([], 2)
    assert services.every(6, None, 0) and not services.every(6, 0, 6 * 3600 - 1)
    assert list(providers.until_silent(iter(["a", "找不到", "相關", "b"]))) == ["a", "找不到", "相關"]
    assert providers.title_of(["a", "b", "c", "d"]) == "a、b、c" and providers.title_of([], ["f"]) == "f"


def test_watchers():
    class Query:
        isActive, status = True, {"message": "waiting"}

        def stop(self):
            self.isActive = False

    w = services.Watchers(lambda folder: Query())
    assert w.add("x") and not w.add("x") and w.status() == {"x": {"active": True, "message": "waiting"}}
    assert w.stop() == ["x"] and w.status() == {}


def pdf(content, packed=True):
    body = zlib.compress(content) if packed else content
    out = io.BytesIO()
    out.write(b"%PDF-1.4\n1 0 obj << /Length " + str(len(body)).encode() + (b" /Filter /FlateDecode" if packed else b"") + b" >>\nstream\n" + body + b"\nendstream endobj\n")
    return out.getvalue()


def test_pdf_text():
    content = rb"BT /F1 12 Tf 72 720 Td (Hello \(PDF\) w\157rld) Tj 0 -14 Td [(spl) 20 (it) -300 (gap)] TJ T* <48692021> Tj ET BT (second) Tj ET"
    for packed in (True, False):
        assert files.parse("x.pdf", pdf(content, packed)) == ("Hello (PDF) world\nsplit gap\nHi !\nsecond", None)
    assert files.parse("x.pdf", pdf(b"q 1 0 0 1 0 0 cm Q")) == (None, "no text in the PDF: scanned pages need OCR")
    assert "encrypted" in files.parse("x.pdf", b"%PDF /Encrypt")[1]


def test_long_texts_are_cut_in_linear_time(spark):
    from weftgraph.functions import text as X

    lines = lambda n: "\n".join(f"line number {i} of it" for i in range(n))
    df = spark.createDataFrame([(1, lines(40_000))], "d long, t string")
    began = time.time()
    assert X.chunks(df, "d", "t").count() == 8000
    assert time.time() - began < 20


def test_hops_add_a_constant_to_the_plan(spark):
    from weftgraph.operators import graph as G

    edges = spark.createDataFrame([(0, f"n{i}", "R", f"n{i + 1}", 1, 1) for i in range(9)], "kg_id long, subject string, rel_type string, object string, source_doc_id long, confidence long")
    seeds = spark.createDataFrame([(0, "n0")], "kg_id long, seed string")
    size = []
    for hops in (2, 3, 4):
        hit = G.expand(edges, seeds, hops)
        assert {r["subject"] for r in hit.collect()} == {f"n{i}" for i in range(hops)}
        size.append(hit._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert size[2] - size[1] == size[1] - size[0] <= 4


def test_mean_pair_cosine(spark):
    from weftgraph.operators.scoring import mean_pair_cosine

    rows = [(1, [1.0, 0.0]), (1, [0.0, 2.0]), (1, [3.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (3, [1.0, 0.0])]
    got = {r["g"]: round(r["similarity"], 9) for r in mean_pair_cosine(spark.createDataFrame(rows, "g long, q_vector array<double>"), "g").collect()}
    assert got == {1: round(1 / 3, 9), 3: 0.0}


def test_thresholds(spark):
    got = spark.range(1).select(*[routing.passing(F.lit(0.28), k).alias(k) for k in ("route", "similar", "search", "world", "auto")]).first()
    assert tuple(got) == (True, True, False, True, False)
