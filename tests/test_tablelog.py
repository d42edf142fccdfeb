import pytest
from pyspark.sql import functions as F

from weftgraph.operators import build
from weftgraph.operators import store as M
from weftgraph.operators.tablelog import Change, TableLog
from weftgraph.streaming import streams

DOCS = "doc_id long, kg_id long, text string"
TEXTS = [(1, 0, "So Alpha uses Beta here. It is fine!"), (2, 0, "Then Alpha uses Beta here! Also Gamma requires Delta here!"), (2, 1, "Then Alpha uses Beta here!"), (3, 1, None), (4, 1, "Here Delta causes Alpha now!"), (None, 1, "Here Delta uses Alpha now!")]


def contents(store):
    rows = {t: sorted(str(r.asDict()) for r in store.read(t).collect()) for t in store.schemas}
    return rows | {"entities": sorted(map(str, store.entities().collect()))}


class Cut(Exception):
    pass


def test_a_build_cut_off_after_any_write_ends_like_a_whole_one(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(TEXTS, DOCS)
    clean = build.GraphStore(spark, f"file://{tmp_path}/clean")
    build.build_graph(clean, docs, batches=2)
    want, write, commit = contents(clean), Change.write, Change.commit
    assert {e for e in want["entities"]} and "confidence': 1" in want["edges"][0]
    steps = {"left": None}

    def step(f, after):
        def run(self, *args, **kw):
            out = f(self, *args, **kw) if after else None
            steps["left"] -= 1
            if steps["left"] < 0:
                raise Cut
            return out if after else f(self, *args, **kw)

        return run

    for n, after in ((2, True), (5, False), (5, True)):  # 5 writes and a commit a batch
        store = build.GraphStore(spark, f"file://{tmp_path}/cut-{n}-{after}")
        steps["left"] = n
        with monkeypatch.context() as m:
            m.setattr(Change, "write", step(write, after))
            m.setattr(Change, "commit", step(commit, after))
            with pytest.raises(Cut):
                build.build_graph(store, docs, batches=2)
        build.build_graph(store, docs, batches=2)
        assert contents(store) == want, (n, after)
    before = store.versions()
    again = build.build_graph(store, docs, batches=2).first()  # nothing is left
    assert (again["chunks"], again["edges"]) == (0, len(want["edges"])) and store.versions() == before and contents(store) == want


def test_forced_build_clears_its_graphs_alone(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, DOCS)
    store = build.GraphStore(spark, f"file://{tmp_path}/g")
    build.build_graph(store, docs)
    one = contents(store)
    build.build_graph(store, docs, force=True)
    assert contents(store) == one  # not counted twice
    build.build_graph(store, spark.createDataFrame([(4, 1, "Here Omega uses Alpha now!")], DOCS), force=True)
    edges = {(r["kg_id"], r["subject"], r["object"]) for r in store.read("edges").collect()}
    assert edges == {(0, "Alpha", "Beta"), (0, "Gamma", "Delta"), (1, "Omega", "Alpha")}
    assert {r["name"] for r in store.entities().where("kg_id = 1").collect()} == {"Omega", "Alpha"}
    events = store.events().collect()
    assert {e["event"] for e in events} == {"chunk_done", "done"} and sum(e["triples"] for e in events if e["event"] == "chunk_done") == 4
    for table in store.schemas:
        store.compact(table, fan=2)
    assert store.state()["cleared"] and store.vacuum(keep=1) > 0 and {(r["kg_id"], r["subject"], r["object"]) for r in store.read("edges").collect()} == edges


def triples(spark, rows):
    schema = "kg_id long, subject string, rel_type string, object string, source_doc_id long, verb string, chunk_id string, seq long, ts timestamp"
    return spark.createDataFrame(rows, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))


def test_streams_add_up_and_keep_chunk_ids(spark, tmp_path):
    log = streams.edge_log(spark, f"file://{tmp_path}/edges")
    row = lambda c, n, verb="v": (0, "a", "USES", "b", 1, verb, c, n, f"2020-01-01 00:00:{n:02d}")
    parts = [[row("c1", 1), row("c2", 2)], [row("c1", 3, "w"), (1, "x", "USES", "y", 1, "v", "", 1, "2020-01-01 00:00:00")]]
    for i, rows in enumerate(parts):
        triples(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(triples(spark, rows).schema).parquet(f"{tmp_path}/in")
        streams.upsert_edges(stream, log, f"file://{tmp_path}/mark").awaitTermination()
    got = {r["subject"]: r for r in log.read("edges").collect()}
    assert (got["a"]["confidence"], got["a"]["verb"], got["a"]["source_chunk_ids"]) == (3, "w", ["c2", "c1"]) and str(got["a"]["updated_at"]) == "2020-01-01 00:00:03"
    assert (got["x"]["confidence"], got["x"]["updated_at"], got["x"]["source_chunk_ids"]) == (1, None, [])
    stream = spark.readStream.schema(triples(spark, parts[0]).schema).parquet(f"{tmp_path}/in")
    streams.upsert_edges(stream, log, f"file://{tmp_path}/other").awaitTermination()  # a second stream of the same rows
    assert {r["subject"]: r["confidence"] for r in log.read("edges").collect()} == {"a": 6, "x": 2}
    writer, last = next((w, b) for w, b in log.state()["writers"].items())
    assert log.begin(writer, last) is None and log.begin(writer, last + 1) is not None


def test_compaction_changes_no_row_and_bounds_folders(spark, tmp_path):
    log = TableLog(spark, f"file://{tmp_path}/t", {"edges": (streams.EDGES, M.merge_generations)})
    states = []
    for i in range(9):
        change = log.begin("w", i)
        change.write("edges", M.merge_triples(triples(spark, [(0, "a", "USES", "b", 1, f"v{i}", f"c{i % 4}", i, f"2020-01-01 00:00:{i:02d}"), (0, f"s{i}", "USES", "b", 1, None, None, i, "2020-01-01 00:00:00")])))
        change.commit()
        states.append(log.state())
        before = sorted(map(str, log.read("edges").collect()))
        log.compact("edges", fan=3)
        assert sorted(map(str, log.read("edges").collect())) == before
    a = log.read("edges").where("subject = 'a'").first()
    assert (a["confidence"], a["verb"], a["source_chunk_ids"]) == (9, "v8", ["c1", "c2", "c3", "c0"])
    assert [f["level"] for f in log.state()["tables"]["edges"]] == [2] and log.rows("edges").count() == 10
    assert log.read("edges", states[1]).count() == 3  # an older state is still there
    log.vacuum(keep=1)
    assert log.read("edges").count() == 10


def test_two_writers_of_one_number_both_stay(spark, tmp_path, monkeypatch):
    log = TableLog(spark, f"file://{tmp_path}/t", {"x": ("a long", M.latest_rows(("a",)))})
    first, second = log.begin("one", 0), log.begin("two", 0)
    first.write("x", spark.range(1).toDF("a"))
    second.write("x", spark.range(1, 3).toDF("a"))
    real, seen = TableLog.state, []

    def late(self, version=None):
        out = real(self, version)
        if not seen:  # another writer commits between reading the state and taking the number
            seen.append(1)
            second.commit()
        return out

    monkeypatch.setattr(TableLog, "state", late)
    assert first.commit() == 1 and log.read("x").count() == 3 and first.commit() is None
    assert [r["writer"] for r in log.history().collect()] == ["two", "one"]
