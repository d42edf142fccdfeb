"""Queries of routing, classification, federation, evaluation and housekeeping operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import admin as A
from weftgraph.operators import evaluation as V
from weftgraph.operators import federation as D
from weftgraph.operators import graph as G
from weftgraph.operators import routing as R
from weftgraph.operators import scoring as S
from weftgraph.operators.services import federated_query
from weftgraph.plans.graph_queries import FACT_SQL
from weftgraph.plans.registry import query
from weftgraph.plans.retrieval_queries import SCORES


@query("route_fallback", "SELECT owner_id, score FROM scores WHERE score >= 0.05 ORDER BY score DESC, owner_id LIMIT 5", **SCORES)
def route_fallback(t):
    """No concept of the question leads to a link, so all links are scanned."""
    return R.route(t.queries, t.concepts.withColumn("name", F.concat(F.lit("other "), "name")), t.links)


CLASSIFY = {
    "name_pairs": "SELECT a.name AS d_name, b.name AS g_name, list_cosine_similarity(a.q_vector, b.q_vector) AS cos FROM concepts a CROSS JOIN concepts b",
    "doc_scores": """SELECT d.owner_id AS doc_id, l.owner_id AS kg_id, round(sum(cos * greatest(0.0::DOUBLE, 1 - (abs(d.interest - l.interest) + abs(d.professional - l.professional)) / 2) * (d.interest + d.professional + l.interest + l.professional) / 4)
      / sum((d.interest + d.professional + l.interest + l.professional) / 4), 4) AS score FROM name_pairs JOIN doc_links d ON d.name = d_name JOIN links l ON l.name = g_name WHERE cos >= 0.01 GROUP BY ALL""",
    "best_graphs": "SELECT doc_id, arg_max(kg_id, (score, -kg_id)) AS kg_id, max(score) AS score FROM doc_scores WHERE score >= 0.05 GROUP BY doc_id",
}


@query("classify_documents", "SELECT d.doc_id, b.kg_id, coalesce(score, 0.0::DOUBLE) AS score, CASE WHEN score >= 0.3 THEN 'assigned' WHEN score IS NOT NULL THEN 'pending' ELSE 'unmatched' END AS status FROM docs d LEFT JOIN best_graphs b ON d.doc_id = b.doc_id", **CLASSIFY)
def classify_documents(t):
    return R.classify_documents(t.docs, t.doc_links, t.links)


@query("assign_documents", "SELECT kg_id, doc_id FROM kg_documents UNION SELECT b.kg_id, b.doc_id FROM best_graphs b JOIN docs d ON b.doc_id = d.doc_id WHERE score >= 0.3 OR b.doc_id % 2 = 0", **CLASSIFY)
def assign_documents(t):
    return R.assign(t.kg_documents, R.classify_documents(t.docs, t.doc_links, t.links), t.docs.where("doc_id % 2 = 0"))


@query("refresh_concepts", """SELECT DISTINCT k.kg_id, c.name FROM kg_documents k JOIN doc_links c ON k.doc_id = c.owner_id UNION ALL
  SELECT kg_id, name FROM (SELECT e.kg_id, e.name, row_number() OVER (PARTITION BY e.kg_id ORDER BY count(x.subject) DESC, e.name) AS rn FROM entities e LEFT JOIN edges x ON e.kg_id = x.kg_id AND e.name = x.subject
  WHERE e.type IN ('概念', '技術', '算法', '方法', '框架', '模型', '工具') AND e.kg_id NOT IN (SELECT k.kg_id FROM kg_documents k JOIN doc_links c ON k.doc_id = c.owner_id) GROUP BY e.kg_id, e.name) WHERE rn <= 50""")
def refresh_concepts(t):
    """Graph 4 has no documents, so it takes its entities."""
    return R.refresh_concepts(t.kgs, t.kg_documents, t.doc_links, t.entities, t.edges)


@query("visible_kgs", """SELECT 'public' AS who, kg_id FROM kgs WHERE is_public UNION ALL SELECT 'all', kg_id FROM kgs UNION ALL
  SELECT 'owner', kg_id FROM kgs WHERE owner_id = 'owner-1' OR is_public UNION ALL SELECT 'own', kg_id FROM kgs WHERE owner_id = 'owner-1'""")
def visible_kgs(t):
    cases = {"public": {}, "all": {"include_private": True}, "owner": {"owner": "owner-1"}, "own": {"owner": "owner-1", "include_private": True}}
    parts = [R.visible(t.kgs, **v).select(F.lit(k).alias("who"), "kg_id") for k, v in cases.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("restricted_docs", "SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM kg_documents WHERE kg_id = 1)")
def restricted_docs(t):
    """No allowed graph is named, so only the exclusion restricts."""
    return R.restricted(t.docs, "doc_id", t.kg_documents.where("kg_id = 99"), t.kg_documents.where("kg_id = 1")).select("doc_id")


@query("contrastive_pairs", "SELECT a, b FROM (SELECT DISTINCT x.name AS a, y.name AS b FROM doc_links x JOIN doc_links y ON x.owner_id = y.owner_id AND x.name < y.name) ORDER BY a, b LIMIT 500")
def contrastive_pairs(t):
    return R.contrastive_pairs(t.doc_links, t.links)


@query("federated_facts", f"""SELECT kg_id, CASE WHEN kg_id = 2 THEN 'error' ELSE 'ok' END AS status, CASE WHEN kg_id <> 2 THEN fact END AS fact FROM (
  SELECT kg_id, {FACT_SQL} AS fact, row_number() OVER (PARTITION BY kg_id ORDER BY confidence DESC, subject, rel_type, object, source_doc_id) AS rn FROM edges
  WHERE contains(subject, 'supplier-1') OR contains(object, 'part-77')) WHERE rn <= 30 AND kg_id <> 2 GROUP BY ALL UNION ALL SELECT 2, 'error', NULL""")
def federated_facts(t):
    """Every graph is a shard that is asked for its best facts around the expanded terms; graph 2 fails."""
    synonyms = D.synonym_table(t.spark)
    stored = t.stored_edges  # written here: the shards ask at once, and each would write them

    def expand(terms):
        rows = D.expand_terms(t.spark.createDataFrame(list(enumerate(terms)), "pos int, term string"), synonyms).orderBy("pos", "k").collect()
        return [r["term"] for r in rows]

    def shard(kg):
        def ask(terms):
            if kg == 2:
                raise ValueError("no such store")
            edges, entities = stored.where(F.col("kg_id") == kg), t.entities.where(F.col("kg_id") == kg)
            hits = G.beside(edges, G.names_containing(entities, terms).select("kg_id", F.col("name").alias("node")))
            return [r["fact"] for r in hits.orderBy(F.desc("confidence"), *G.KEY).limit(30).select(G.fact_text().alias("fact")).collect()]  # 30 at most

        return ask

    ids = [r["kg_id"] for r in t.kgs.select("kg_id").orderBy("kg_id").collect()]  # the registry of shards
    _, results = federated_query({str(k): shard(k) for k in ids}, ["Supplier-1", "part-77"], expand, {str(k) for k in ids}, seconds=300.0)
    rows = [(int(r["shard"]), r["status"], f) for r in results for f in (r["facts"] or ([None] if r["status"] != "ok" else []))]
    return t.spark.createDataFrame(rows, "kg_id long, status string, fact string")


ABLATION = {
    "vector_docs": "SELECT q_name AS question, owner_id AS doc_id, max(round(list_cosine_similarity(q_vector, q_vec), 6)) AS score FROM doc_links CROSS JOIN queries GROUP BY ALL HAVING max(list_cosine_similarity(q_vector, q_vec)) >= 0.01",
    "graph_docs": "SELECT q_name AS question, source_doc_id AS doc_id, sum(confidence)::DOUBLE AS score FROM edges JOIN queries ON subject = 'supplier-' || (replace(q_name, 'concept-', '')::INT + 1) GROUP BY ALL",
    "v_ranked": "SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) AS rank FROM vector_docs",
    "g_ranked": "SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) AS rank FROM graph_docs",
    "firsts_g": "SELECT question, doc_id, rank FROM g_ranked WHERE rank <= 10",
    "others_v": "SELECT question, doc_id, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) AS place FROM vector_docs v WHERE NOT EXISTS (SELECT 1 FROM firsts_g f WHERE f.question = v.question AND f.doc_id = v.doc_id)",
    "n_first": "SELECT q_name AS question, (SELECT count(*) FROM firsts_g f WHERE f.question = q_name) AS n FROM queries",
    "found_docs": """SELECT question, 'vector' AS mode, doc_id, rank FROM v_ranked WHERE rank <= 5 UNION ALL SELECT question, 'graph', doc_id, rank FROM g_ranked WHERE rank <= 5 UNION ALL SELECT question, 'hybrid', doc_id, rank FROM firsts_g
      UNION ALL SELECT o.question, 'hybrid', doc_id, n + place FROM others_v o JOIN n_first USING (question) WHERE place <= greatest(1, 5 - n)""",
    "wanted": "SELECT q_name AS question, doc_id FROM docs JOIN queries ON doc_id % 7 = replace(q_name, 'concept-', '')::INT WHERE doc_id < 200",
    "per_question": """SELECT w.question, m.mode, w.size, count(f.doc_id) AS n, count(x.doc_id) AS hits, min(f.rank) FILTER (x.doc_id IS NOT NULL) AS best_rank FROM (SELECT question, count(*) AS size FROM wanted GROUP BY question) w CROSS JOIN (VALUES ('vector'), ('graph'), ('hybrid')) m(mode)
      LEFT JOIN found_docs f ON f.question = w.question AND f.mode = m.mode LEFT JOIN wanted x ON x.question = f.question AND x.doc_id = f.doc_id GROUP BY ALL""",
}


@query("ablation", """SELECT mode, count(*) AS questions, round(avg(hits::DOUBLE / size), 4) AS recall, round(avg(CASE WHEN n = 0 THEN 0 ELSE hits::DOUBLE / n END), 4) AS precision, round(avg(coalesce(1.0::DOUBLE / best_rank, 0)), 4) AS mrr FROM per_question GROUP BY mode""", **ABLATION)
def ablation(t):
    """Vector, graph and hybrid contexts of each question against the documents that count as relevant here."""
    v = S.pairs(t.queries, t.doc_links).groupBy(F.col("q_name").alias("question"), F.col("owner_id").alias("doc_id")).agg(F.max(F.round("cos", 6)).alias("score"))
    number = F.regexp_extract("q_name", r"(\d+)$", 1).cast("long")
    subject = t.queries.select(F.col("q_name").alias("question"), F.concat(F.lit("supplier-"), number + 1).alias("subject"))
    g = t.edges.join(F.broadcast(subject), "subject").groupBy("question", F.col("source_doc_id").alias("doc_id")).agg(F.sum("confidence").cast("double").alias("score"))
    asked = t.queries.select(F.col("q_name").alias("question"), number.alias("n"))
    relevant = t.docs.where("doc_id < 200").join(F.broadcast(asked), F.col("doc_id") % 7 == F.col("n")).select("question", "doc_id")  # the graph's documents have these ids
    return V.retrieval_metrics(V.contexts(v, g), relevant)


@query("mode_averages", """SELECT *, row_number() OVER (ORDER BY faithfulness + relevance DESC, mode) = 1 AS best FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'vector' WHEN doc_id % 3 = 1 THEN 'graph' ELSE 'hybrid' END AS mode, count(*) AS questions,
  round(avg(quality), 4) AS faithfulness, round(avg(1.0::DOUBLE - toxic), 4) AS relevance FROM labels GROUP BY ALL)""")
def mode_averages(t):
    mode = F.when(F.col("doc_id") % 3 == 0, "vector").when(F.col("doc_id") % 3 == 1, "graph").otherwise("hybrid")
    rows = t.read("labels").select(mode.alias("mode"), F.col("quality").cast("double").alias("faithfulness"), (1.0 - F.col("toxic")).alias("relevance"))
    return V.averages(rows, ("faithfulness", "relevance"))


@query("ingest_summary", """SELECT *, fail_percent >= 20 AS warning FROM (SELECT count(*) AS total, count(*) FILTER (length(content) >= 100) AS ok, count(*) FILTER (length(content) < 100) AS fail,
  round(100.0::DOUBLE * count(*) FILTER (length(content) < 100) / count(*), 2) AS fail_percent FROM docs)""")
def ingest_summary(t):
    return A.ingest_summary(t.docs.select((F.length("content") >= 100).alias("ok")))


@query("effective_sync", "SELECT owner_id, name, max(interest) AS interest, max(professional) AS professional FROM links GROUP BY ALL")
def effective_sync(t):
    return A.effective(t.links.select("owner_id", "name", "interest", "professional"))


@query("clear_relations", "SELECT kg_id, subject, rel_type, object, source_doc_id FROM edges WHERE kg_id <> 4")
def clear_relations(t):
    return A.clear_relations(t.edges, 4).select("kg_id", *G.KEY)


@query("clear_entities", "SELECT kg_id, count(*) AS entities, (SELECT count(*) FROM edges x WHERE x.kg_id = e.kg_id) AS relations FROM entities e WHERE kg_id <> 1 GROUP BY kg_id")
def clear_entities(t):
    entities, edges = A.clear_entities(t.entities, t.edges, 1)
    n = edges.groupBy("kg_id").agg(F.count("*").alias("relations"))
    return entities.groupBy("kg_id").agg(F.count("*").alias("entities")).join(n, "kg_id", "left").na.fill(0, ["relations"])


@query("kg_delete", "SELECT k.kg_id, (SELECT count(*) FROM kg_documents d WHERE d.kg_id = k.kg_id) AS document_count, (SELECT count(*) FROM entities d WHERE d.kg_id = k.kg_id) AS entity_count, (SELECT count(*) FROM edges d WHERE d.kg_id = k.kg_id) AS relation_count FROM kgs k WHERE kg_id <> 3")
def kg_delete(t):
    kgs, links, edges = A.delete_graph(t.kgs.select("kg_id"), t.kg_documents, t.edges, 3)
    return A.with_counters(kgs, links, A.clear_relations(t.entities, 3), edges)


@query("orphans_deleted", "SELECT kg_id, name FROM entities e WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.kg_id = e.kg_id AND (x.subject = e.name OR x.object = e.name)) ORDER BY kg_id, name LIMIT 5000")
def orphans_deleted(t):
    return A.without_orphans(t.entities, t.edges)[1].select("kg_id", "name")


@query("graph_vector_write", "SELECT name, CASE WHEN vec_id % 2 = 0 THEN len(q_vector) ELSE 0 END AS width, CASE WHEN vec_id % 2 = 0 THEN round(q_vector[1], 6) ELSE 0 END AS first FROM concepts")
def graph_vector_write(t):
    done = A.write_graph_vectors(t.concepts, t.concepts.where("vec_id % 2 = 0").select("name", F.col("q_vector").alias("vector")))
    width = F.when(F.col("g_vector").isNotNull(), F.size("g_vector")).otherwise(0)
    return done.select("name", width.cast("long").alias("width"), F.coalesce(F.round(F.get("g_vector", F.lit(0)), 6), F.lit(0.0)).alias("first"))


@query("subscription_merge", "SELECT 'inst-2::' || kg_id AS kg_id, subject, rel_type, object, source_doc_id, max(confidence) AS confidence FROM edges GROUP BY ALL")
def subscription_merge(t):
    return A.namespaced(t.edges, "inst-2", F.col("kg_id"))


@query("row_ids", "SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM (SELECT doc_id, sha256(kg_id || chr(31) || title) AS h FROM docs)")
def row_ids(t):
    return t.docs.select("doc_id", A.row_id(F.col("kg_id"), F.col("title")).alias("id"))


@query("thresholds", "SELECT owner_id, score >= 0.05 AS route, score >= 0.28 AS similar, score >= 0.35 AS search, score > 0 AS world, score >= 0.3 AS auto FROM scores", **SCORES)
def thresholds(t):
    s = S.match_scores(t.queries, t.links)
    return s.select("owner_id", *[R.passing(F.col("score"), k).alias(k) for k in ("route", "similar", "search", "world", "auto")])
