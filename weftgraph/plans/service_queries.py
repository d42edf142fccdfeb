"""Queries of the remaining operators: graph records, chunk store, projections, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.functions import providers as P
from weftgraph.functions import text as X
from weftgraph.operators import build as B
from weftgraph.operators import graph as G
from weftgraph.operators import history as H
from weftgraph.operators import retrieval as R
from weftgraph.operators import scoring as S
from weftgraph.operators import store as M
from weftgraph.plans.graph_queries import FACT_SQL
from weftgraph.plans.registry import query
from weftgraph.plans.retrieval_queries import PARTS, SCORES
from weftgraph.session import scratch_path, ship_package

CHUNKS = PARTS | {"stored": "SELECT doc_id, (rn - 1) // 5 + 1 AS idx, doc_id || '_' || lpad(((rn - 1) // 5 + 1)::VARCHAR, 4, '0') AS chunk_id, string_agg(s, '' ORDER BY rn) AS text FROM sents GROUP BY doc_id, (rn - 1) // 5"}


@query("title_search", "SELECT doc_id, title FROM docs WHERE contains(lower(title), 'src1') ORDER BY doc_id LIMIT 20")
def title_search(t):
    return t.docs.where(F.lower("title").contains("src1")).orderBy("doc_id").limit(20).select("doc_id", "title")


@query("chunk_lookup", "SELECT chunk_id, text FROM stored WHERE chunk_id IN ('3_0001', '5_0002', '7_0001')", **CHUNKS)
def chunk_lookup(t):
    want = t.spark.createDataFrame([("3_0001",), ("5_0002",), ("7_0001",), ("bad",)], "chunk_id string")
    asked = want.withColumn("doc_id", F.regexp_extract("chunk_id", r"^(\d+)_\d+$", 1).try_cast("long")).where("doc_id is not null")
    docs = t.docs.join(F.broadcast(asked.select("doc_id").distinct()), "doc_id", "left_semi")  # only their texts are cut
    return X.chunks(docs, "doc_id", "content").join(F.broadcast(asked.select("chunk_id")), "chunk_id", "left_semi").select("chunk_id", "text")


@query("chunk_store", "SELECT k.kg_id, count(*) AS chunks FROM stored s JOIN kg_documents k ON s.doc_id = k.doc_id GROUP BY k.kg_id", **CHUNKS)
def chunk_store(t):
    """Chunks of all documents; then some documents are written again, which replaces their chunks alone."""
    store = B.GraphStore(t.spark, scratch_path(t.spark, "chunks"))
    rows = X.chunks(t.docs, "doc_id", "content").join(t.kg_documents, "doc_id")
    for batch, some in enumerate((rows, rows.where("doc_id % 5 = 0"))):
        change = store.begin("documents", batch)
        change.write("chunks", some)
        change.commit()
    return store.read("chunks").groupBy("kg_id").agg(F.count("*").alias("chunks"))


@query("chunk_delete", "SELECT doc_id, count(*) AS chunks FROM stored WHERE doc_id % 3 <> 0 GROUP BY doc_id", **CHUNKS)
def chunk_delete(t):
    c = X.chunks(t.docs, "doc_id", "content")
    return M.without(c, t.docs.where("doc_id % 3 = 0"), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("kg_update", "SELECT kg_id, CASE WHEN kg_id = 1 THEN 'renamed' ELSE name END AS name, is_public FROM kgs WHERE kg_id <> 4")
def kg_update(t):
    patch = t.spark.createDataFrame([(1, "renamed", None)], "kg_id long, name string, is_public boolean")
    return M.without(M.upsert(t.kgs.select("kg_id", "name", "is_public"), patch, ["kg_id"]), t.kgs.where("kg_id = 4"), ["kg_id"])


@query("document_delete", "SELECT d.doc_id, coalesce(l.kg_id, -1) AS kg_id FROM docs d LEFT JOIN kg_documents l ON d.doc_id = l.doc_id WHERE d.doc_id % 11 <> 0")
def document_delete(t):
    gone = t.docs.where("doc_id % 11 = 0")
    docs, links = M.without(t.docs, gone, ["doc_id"]), M.without(t.kg_documents, gone, ["doc_id"])
    return docs.select("doc_id").join(links, "doc_id", "left").select("doc_id", F.coalesce("kg_id", F.lit(-1)).alias("kg_id"))


@query("valid_times", "SELECT event_id, event_id % 3 <> 0 AS ok FROM events")
def valid_times(t):
    raw = F.when(F.col("event_id") % 3 == 0, "not a time").otherwise("2024-05-01T10:00:00+08:00")
    return t.read("events").select("event_id", H.valid_time(raw).alias("ok"))


@query("fact_sentences", "SELECT subject || CASE rel_type WHEN 'USES' THEN ' 使用 ' WHEN 'REQUIRES' THEN ' 需要 ' ELSE ' 產出 ' END || object || '。' AS sentence, count(*) AS n FROM edges GROUP BY ALL")
def fact_sentences(t):
    s = t.edges.select(R.sentence_of(G.fact_text()).alias("sentence"))
    return s.groupBy("sentence").agg(F.count("*").alias("n"))


@query("fact_entities", "SELECT DISTINCT unnest([subject, object]) AS name FROM edges")
def fact_entities(t):
    return t.edges.select(F.explode(R.entity_names(G.fact_text())).alias("name")).distinct()


@query("fact_render_count", f"SELECT count(DISTINCT {FACT_SQL}) AS n FROM edges")
def fact_render_count(t):
    return t.edges.agg(F.countDistinct(G.fact_text()).alias("n"))


@query("truncations", "SELECT doc_id, length(substr(content, 1, 2000)) AS a, length(substr(content, 1, 512)) AS b FROM docs")
def truncations(t):
    cut = lambda n: F.length(F.substring("content", 1, n)).cast("long")
    return t.docs.select("doc_id", cut(2000).alias("a"), cut(512).alias("b"))


@query("list_cleanup", r"SELECT item_id, 'term ' || item_id AS term FROM benchmark")
def list_cleanup(t):
    raw = F.concat(F.when(F.col("item_id") % 3 == 0, F.lit("1. ")).when(F.col("item_id") % 3 == 1, F.lit('- "')).otherwise(F.lit("• ")), F.lit("term "), "item_id", F.when(F.col("item_id") % 3 == 1, F.lit('"')).otherwise(F.lit("")))
    return t.read("benchmark").select("item_id", X.list_item(raw).alias("term"))


@query("fingerprints", "SELECT owner_id, i - 1 AS pos, round(avg(q_vector[i]), 4) AS x FROM firsts, range(1, 65) r(i) GROUP BY owner_id, i", firsts="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY round((interest + professional) / 2, 4) DESC, name) AS rn FROM links) WHERE rn <= 20")
def fingerprints(t):
    score = F.round((F.col("interest") + F.col("professional")) / 2, 4)
    first = t.links.withColumn("rn", F.row_number().over(W.partitionBy("owner_id").orderBy(F.desc(score), "name"))).where("rn <= 20")
    v = S.mean_vectors(first, "owner_id", digits=4)
    return v.select("owner_id", F.posexplode("centroid").alias("pos", "x")).select("owner_id", F.col("pos").cast("long").alias("pos"), "x")


@query("kg_route", "SELECT k.name AS kg, score, row_number() OVER (ORDER BY score DESC, s.owner_id) AS rank FROM scores s JOIN kgs k ON s.owner_id = kg_id WHERE score >= 0.05 AND is_public", **SCORES)
def kg_route(t):
    s = S.match_scores(t.queries, t.links).where("score >= 0.05").join(t.kgs.where("is_public").select(F.col("kg_id").alias("owner_id"), F.col("name").alias("kg")), "owner_id")
    return s.select("kg", "score", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), "owner_id")).cast("long").alias("rank"))


@query("health", "SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM concepts) AS concepts, (SELECT count(*) FROM kgs) AS kgs")
def health(t):
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(t.docs, "documents").join(n(t.concepts, "concepts"), F.lit(True)).join(n(t.kgs, "kgs"), F.lit(True))


@query("valid_types", "SELECT name, count(*) AS n FROM (SELECT rel_type AS name FROM edges UNION ALL SELECT 'NEW_TYPE' FROM kgs) WHERE name NOT IN ('USES', 'PRODUCES') GROUP BY name")
def valid_types(t):
    names = t.edges.select(F.col("rel_type").alias("name")).unionByName(t.kgs.select(F.lit("NEW_TYPE").alias("name")))
    return names.where(F.size(F.array_except(F.array("name"), F.array(F.lit("USES"), F.lit("PRODUCES")))) > 0).groupBy("name").agg(F.count("*").alias("n"))


@query("seed_union", "SELECT DISTINCT name FROM (SELECT q_name AS name FROM queries UNION ALL SELECT name FROM (SELECT name, round(max(cos), 6) AS c FROM cos_pairs GROUP BY name) WHERE c > 0.3)")
def seed_union(t):
    hit = S.pairs(t.queries, t.links).groupBy("name").agg(F.round(F.max("cos"), 6).alias("c")).where("c > 0.3").select("name")
    return t.queries.select(F.col("q_name").alias("name")).unionByName(hit).distinct()


@query("staging_union", "SELECT doc_id, 'staging' AS origin FROM docs WHERE doc_id % 40 = 0 UNION ALL SELECT doc_id, 'orphan' FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM kg_documents)")
def staging_union(t):
    staged = t.docs.where("doc_id % 40 = 0").select("doc_id", F.lit("staging").alias("origin"))
    return staged.unionByName(t.docs.join(t.kg_documents.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("orphan").alias("origin")))


@query("judge_metrics", "SELECT mode, round(avg(score), 2) AS mean FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'vector' WHEN doc_id % 3 = 1 THEN 'graph' ELSE 'hybrid' END AS mode, CASE WHEN quality = 1 THEN (doc_id % 10) / 10.0::DOUBLE ELSE 0.7::DOUBLE END AS score FROM labels) GROUP BY mode")
def judge_metrics(t):
    mode = F.when(F.col("doc_id") % 3 == 0, "vector").when(F.col("doc_id") % 3 == 1, "graph").otherwise("hybrid")
    score = F.coalesce(F.when(F.col("quality") == 1, (F.col("doc_id") % 10) / 10), F.lit(0.7))
    return t.read("labels").select(mode.alias("mode"), score.alias("score")).groupBy("mode").agg(F.round(F.avg("score"), 2).alias("mean"))


@query("history_ranks", "SELECT conv_id, turn, rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rank FROM conversations)")
def history_ranks(t):
    return t.read("conversations").select("conv_id", "turn", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role")).cast("long").alias("rank"))


@query("relation_counts", "SELECT rel_type, count(*) AS n, sum(confidence)::BIGINT AS confidence FROM edges GROUP BY rel_type")
def relation_counts(t):
    return t.edges.groupBy("rel_type").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"))


@query("pick_chunks")
def pick_chunks(t):
    ship_package(t.spark)
    q = [(r["q_name"], r["q_vec"]) for r in t.queries.limit(2).collect()]  # one question's concepts
    return R.pick_chunks(t.docs, "doc_id", "content", [("the", q[0][1]), ("and", q[1][1])], ["token"], 1200, lambda c: P.embed(c, dim=64))


@query("embedded_docs")
def embedded_docs(t):
    ship_package(t.spark)
    return t.docs.select("doc_id", P.embed(F.substring("content", 1, 512), dim=32).alias("vector"))
