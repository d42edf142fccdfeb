"""Queries over the graph: scans, traversal, facts, history, mutations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.functions import constants as C
from weftgraph.operators import graph as G
from weftgraph.operators import history as H
from weftgraph.operators import retrieval as R
from weftgraph.operators import store as S
from weftgraph.operators.federation import best_degree, quota
from weftgraph.operators.indexes import NameIndex
from weftgraph.operators.routing import visible
from weftgraph.plans.registry import query

NOW = "timestamp'2002-01-01 00:00:00'"
KEY = ["kg_id", *G.KEY]
COLS = "kg_id, subject, rel_type, object, source_doc_id"
LABELS = "map([" + ", ".join(f"'{k}'" for k in C.REL_LABELS) + "], [" + ", ".join(f"'{v}'" for v in C.REL_LABELS.values()) + "])"
FACT_SQL = f"subject || '(' || coalesce(subject_type, '概念') || ') -[' || {LABELS}[rel_type] || ':' || verb || ']→ ' || object || '(' || coalesce(object_type, '概念') || ')'"
DECAY_SQL = "exp(-0.005::DOUBLE * greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(created_at)) / 86400000000.0::DOUBLE))"


def now():
    return F.expr(NOW)


def seeds(t, *terms):
    return G.names_containing(t.entities, list(terms)).select("kg_id", F.col("name").alias("seed"))


SEEDS = {"seeds": "SELECT kg_id, name AS seed FROM entities WHERE lower(name) LIKE '%supplier-1%'"}
HOP = {
    "reach0": "SELECT kg_id, seed, seed AS node FROM seeds",
    "reach1": "SELECT * FROM reach0 UNION SELECT r.kg_id, r.seed, u.other FROM reach0 r JOIN undirected u ON r.kg_id = u.kg_id AND r.node = u.node",
    "reach2": "SELECT * FROM reach1 UNION SELECT r.kg_id, r.seed, u.other FROM reach1 r JOIN undirected u ON r.kg_id = u.kg_id AND r.node = u.node",
    "hit1": "SELECT DISTINCT r.seed, e.* FROM edges e JOIN reach0 r ON e.kg_id = r.kg_id AND (e.subject = r.node OR e.object = r.node)",
    "hit2": "SELECT DISTINCT s.seed, e.* FROM edges e JOIN (SELECT kg_id, seed, node FROM reach1) s ON e.kg_id = s.kg_id AND e.subject = s.node UNION SELECT DISTINCT s.seed, e.* FROM edges e JOIN reach1 s ON e.kg_id = s.kg_id AND e.object = s.node",
    "hit3": "SELECT DISTINCT s.seed, e.* FROM edges e JOIN reach2 s ON e.kg_id = s.kg_id AND e.subject = s.node UNION SELECT DISTINCT s.seed, e.* FROM edges e JOIN reach2 s ON e.kg_id = s.kg_id AND e.object = s.node",
    "top2": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kg_id, seed ORDER BY confidence DESC, subject, rel_type, object, source_doc_id) AS seed_rank FROM hit2) WHERE seed_rank <= 20",
    "grouped": "SELECT kg_id, subject, subject_type, rel_type, verb, object, object_type, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT source_doc_id))[1:3], ',') AS docs, max(created_at) AS created_at FROM top2 GROUP BY ALL",
    "best": "SELECT * FROM grouped ORDER BY confidence DESC, kg_id, subject, subject_type, rel_type, verb, object, object_type LIMIT 50",
} | SEEDS


@query("kg_edges_scan", f"SELECT {COLS}, confidence FROM edges WHERE kg_id = 2")
def kg_edges_scan(t):
    return t.edges.where("kg_id = 2").select(*KEY, "confidence")


@query("entity_pairs", "SELECT DISTINCT kg_id, least(subject, object) AS a, greatest(subject, object) AS b FROM edges WHERE subject <> object")
def entity_pairs(t):
    return G.entity_pairs(t.edges)


@query("bipartite_edges", "SELECT 'kg:' || owner_id AS owner, 'concept:' || name AS concept FROM links UNION SELECT 'doc:' || owner_id, 'concept:' || name FROM doc_links")
def bipartite_edges(t):
    side = lambda df, kind: df.select(F.concat(F.lit(kind), "owner_id").alias("owner"), F.concat(F.lit("concept:"), "name").alias("concept"))
    return side(t.links, "kg:").unionByName(side(t.doc_links, "doc:")).distinct()


@query("point_lookup", "SELECT kg_id, name, type FROM entities WHERE name = 'supplier-7'")
def point_lookup(t):
    return t.entities.where("name = 'supplier-7'")


@query("public_kgs", "SELECT kg_id, name FROM kgs WHERE is_public OR owner_id = 'owner-1'")
def public_kgs(t):
    return visible(t.kgs, "owner-1").select("kg_id", "name")


@query("name_contains", "SELECT kg_id, name FROM entities WHERE contains(lower(name), 'lier-1') OR contains(lower(name), 'part-77')")
def name_contains(t):
    return G.names_containing(t.entities, ["LIER-1", "Part-77"]).select("kg_id", "name")


@query("prefix_seed", r"SELECT kg_id, name FROM entities WHERE regexp_matches(lower(name), '(^|[^\p{L}\p{N}])(12|supp)')")
def prefix_seed(t):
    return G.names_with_prefix(t.entities, ["12", "supp"]).select("kg_id", "name")


@query("name_index", r"""SELECT kg_id, name, (regexp_matches(lower(name), '(^|[^\p{L}\p{N}])12'))::BIGINT + (regexp_matches(lower(name), '(^|[^\p{L}\p{N}])supp'))::BIGINT AS terms
  FROM (SELECT DISTINCT kg_id, name FROM entities) WHERE regexp_matches(lower(name), '(^|[^\p{L}\p{N}])(12|supp)')""")
def name_index(t):
    """Prefixes of words, found in the sorted postings, with the number of terms that each entity has."""
    return NameIndex.build(t.entities).search(["12", "Supp"])


@query("min_confidence", f"SELECT {COLS}, confidence FROM edges WHERE confidence >= 2")
def min_confidence(t):
    return t.edges.where("confidence >= 2").select(*KEY, "confidence")


@query("rel_type_filter", "SELECT rel_type, count(*) AS n FROM edges WHERE rel_type IN ('USES', 'PRODUCES', 'IS_A') GROUP BY rel_type")
def rel_type_filter(t):
    types = t.spark.createDataFrame([("USES",), ("PRODUCES",), ("IS_A",)], "rel_type string")
    return t.edges.join(F.broadcast(types), "rel_type", "left_semi").groupBy("rel_type").agg(F.count("*").alias("n"))


@query("fact_strings", f"SELECT {FACT_SQL} AS fact, confidence FROM edges")
def fact_strings(t):
    return t.edges.select(G.fact_text().alias("fact"), "confidence")


@query("citations_text", f"""SELECT CASE WHEN coalesce(title, '') <> '' THEN fact || '[來源：《' || title || '》' || CASE WHEN confidence > 1 THEN '，信心 ' || confidence ELSE '' END || ']'
  WHEN confidence > 1 THEN fact || '[信心 ' || confidence || ']' ELSE fact END AS citation
  FROM (SELECT {FACT_SQL} AS fact, confidence, CASE WHEN source_doc_id % 3 = 0 THEN NULL ELSE title END AS title FROM edges e LEFT JOIN docs ON source_doc_id = doc_id)""")
def citations_text(t):
    e = t.edges.join(t.docs.select(F.col("doc_id").alias("source_doc_id"), "title"), "source_doc_id", "left")
    title = F.when(F.col("source_doc_id") % 3 != 0, F.col("title"))
    return e.select(R.cite(G.fact_text(), title, F.col("confidence")).alias("citation"))


@query("change_type", "SELECT CASE WHEN updated_at IS NULL THEN 'created' ELSE 'updated' END AS change_type, count(*) AS n FROM edges GROUP BY ALL")
def change_type(t):
    return t.edges.groupBy(H.change_type().alias("change_type")).agg(F.count("*").alias("n"))


@query("kg_documents", "SELECT k.name AS kg, d.doc_id, d.title FROM kg_documents l JOIN kgs k ON l.kg_id = k.kg_id JOIN docs d ON l.doc_id = d.doc_id")
def kg_documents(t):
    return t.kg_documents.join(t.kgs.select("kg_id", F.col("name").alias("kg")), "kg_id").join(t.docs.select("doc_id", "title"), "doc_id").select("kg", "doc_id", "title")


@query("fact_titles", "SELECT subject, object, source_doc_id, coalesce(title, '') AS title FROM edges LEFT JOIN (SELECT doc_id, title FROM docs WHERE doc_id % 4 <> 0) ON source_doc_id = doc_id")
def fact_titles(t):
    titles = t.docs.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("source_doc_id"), "title")
    return t.edges.join(titles, "source_doc_id", "left").select("subject", "object", "source_doc_id", F.coalesce("title", F.lit("")).alias("title"))


@query("entity_degree", "SELECT e.kg_id, e.name, count(x.subject) AS degree FROM entities e LEFT JOIN edges x ON e.kg_id = x.kg_id AND e.name = x.subject GROUP BY ALL")
def entity_degree(t):
    return G.out_degree(t.entities, t.edges)


@query("bfs_1hop", f"SELECT seed, {COLS} FROM hit1", **HOP)
def bfs_1hop(t):
    return G.expand(t.stored_edges, seeds(t, "supplier-1"), 1).select("seed", *KEY)


@query("bfs_2hop", "SELECT kg_id, seed, count(*) AS edges, sum(confidence)::BIGINT AS confidence FROM hit2 GROUP BY ALL", **HOP)
def bfs_2hop(t):
    return G.expand(t.stored_edges, seeds(t, "supplier-1"), 2).groupBy("kg_id", "seed").agg(F.count("*").alias("edges"), F.sum("confidence").alias("confidence"))


@query("bfs_3hop", "SELECT kg_id, seed, count(*) AS edges FROM hit3 GROUP BY ALL", **(HOP | {"seeds": "SELECT kg_id, name AS seed FROM entities WHERE name = 'supplier-12'"}))
def bfs_3hop(t):
    one = t.entities.where("name = 'supplier-12'").select("kg_id", F.col("name").alias("seed"))
    return G.expand(t.stored_edges, one, 3).groupBy("kg_id", "seed").agg(F.count("*").alias("edges"))


@query("seed_expand", """SELECT kg_id, seed FROM seeds UNION ALL SELECT kg_id, other FROM (SELECT *, row_number() OVER (PARTITION BY kg_id ORDER BY other) AS rn FROM
  (SELECT DISTINCT u.kg_id, u.other FROM undirected u JOIN seeds s ON u.kg_id = s.kg_id AND u.node = s.seed WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.kg_id = u.kg_id AND x.seed = u.other))) WHERE rn <= 20""", **HOP)
def seed_expand(t):
    return G.seed_neighbours(t.stored_edges, seeds(t, "supplier-1"))


@query("seed_topk", f"SELECT seed, {COLS}, confidence, seed_rank FROM top2", **HOP)
def seed_topk(t):
    return G.expand_top(t.stored_edges, seeds(t, "supplier-1"), 2).select("seed", *KEY, "confidence", F.col("seed_rank").cast("long").alias("seed_rank"))


CHAIN = HOP | {"meeting": "SELECT kg_id, subject AS node, object AS other FROM best UNION SELECT kg_id, object, subject FROM best"}


@query("chains", """SELECT DISTINCT a.kg_id, a.node AS first, a.other AS second, b.other AS third FROM meeting a JOIN meeting b ON a.kg_id = b.kg_id AND a.other = b.node
  WHERE a.node <> b.other AND a.node <> a.other ORDER BY a.kg_id, first, second, third LIMIT 10""", **CHAIN)
def chains(t):
    f = G.top_facts(G.grouped_facts(G.expand_top(t.stored_edges, seeds(t, "supplier-1"), 2)))
    return G.chains(G.undirected(f).select("kg_id", F.col("node").alias("subject"), F.col("other").alias("object")))


@query("orphan_entities", "SELECT kg_id, name FROM entities e WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.kg_id = e.kg_id AND (x.subject = e.name OR x.object = e.name))")
def orphan_entities(t):
    return G.orphans(t.entities, t.edges).select("kg_id", "name")


@query("orphan_documents", "SELECT doc_id, title, replace(replace(substr(content, 1, 80), chr(10), ' '), chr(13), ' ') AS preview FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM kg_documents)")
def orphan_documents(t):
    return t.docs.join(t.kg_documents.select("doc_id"), "doc_id", "left_anti").select("doc_id", "title", F.translate(F.substring("content", 1, 80), "\n\r", "  ").alias("preview"))


MEMBERS = {"members": "SELECT kg_id, name FROM entities WHERE name LIKE 'supplier-2%' OR name LIKE 'part-1%'"}


@query("member_facts", f"SELECT {COLS} FROM edges e WHERE EXISTS (SELECT 1 FROM members m WHERE m.kg_id = e.kg_id AND m.name = e.subject) AND EXISTS (SELECT 1 FROM members m WHERE m.kg_id = e.kg_id AND m.name = e.object) ORDER BY confidence DESC, kg_id, subject, rel_type, object, source_doc_id LIMIT 30", **MEMBERS)
def member_facts(t):
    m = t.entities.where("name like 'supplier-2%' or name like 'part-1%'")
    s, o = m.select("kg_id", F.col("name").alias("subject")), m.select("kg_id", F.col("name").alias("object"))
    return t.edges.join(s, ["kg_id", "subject"], "left_semi").join(o, ["kg_id", "object"], "left_semi").orderBy(F.desc("confidence"), *KEY).limit(30).select(*KEY)


@query("allowed_docs", "SELECT doc_id, title FROM docs WHERE doc_id IN (SELECT doc_id FROM kg_documents WHERE kg_id IN (1, 2))")
def allowed_docs(t):
    return t.docs.join(t.kg_documents.where("kg_id in (1, 2)"), "doc_id", "left_semi").select("doc_id", "title")


@query("entity_chunks", "SELECT name, chunk_id, n FROM (SELECT subject AS name, chunk_id, count(*) AS n, row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, chunk_id) AS rn FROM facts_raw GROUP BY subject, chunk_id) WHERE rn <= 5")
def entity_chunks(t):
    n = t.facts_raw.groupBy(F.col("subject").alias("name"), "chunk_id").agg(F.count("*").alias("n"))
    return n.withColumn("rn", F.row_number().over(W.partitionBy("name").orderBy(F.desc("n"), "chunk_id"))).where("rn <= 5").drop("rn")


@query("neighbors", """SELECT kg_id, neighbour, count(*) AS edges FROM (SELECT kg_id, object AS neighbour FROM edges WHERE subject = 'supplier-3' UNION ALL SELECT kg_id, subject FROM edges WHERE object = 'supplier-3')
  GROUP BY ALL ORDER BY edges DESC, kg_id, neighbour LIMIT 50""")
def neighbors(t):
    return G.neighbours(t.stored_edges, "supplier-3")


@query("grouped_facts", "SELECT * FROM grouped", **HOP)
def grouped_facts(t):
    f = G.grouped_facts(G.expand_top(t.stored_edges, seeds(t, "supplier-1"), 2))
    return f.withColumn("docs", F.array_join(F.col("docs").cast("array<string>"), ","))


@query("kg_counts", """SELECT k.kg_id, coalesce(d.n, 0) AS documents, coalesce(e.n, 0) AS entities, coalesce(r.n, 0) AS relations FROM kgs k
  LEFT JOIN (SELECT kg_id, count(*) AS n FROM kg_documents GROUP BY kg_id) d ON k.kg_id = d.kg_id LEFT JOIN (SELECT kg_id, count(*) AS n FROM entities GROUP BY kg_id) e ON k.kg_id = e.kg_id
  LEFT JOIN (SELECT kg_id, count(*) AS n FROM edges GROUP BY kg_id) r ON k.kg_id = r.kg_id""")
def kg_counts(t):
    n = lambda df, c: df.groupBy("kg_id").agg(F.count("*").alias(c))
    out = t.kgs.select("kg_id")
    for df, c in ((t.kg_documents, "documents"), (t.entities, "entities"), (t.edges, "relations")):
        out = out.join(n(df, c), "kg_id", "left")
    return out.na.fill(0)


@query("entity_frequency", "SELECT kg_id, name, count(*) AS n FROM (SELECT kg_id, subject AS name FROM edges UNION ALL SELECT kg_id, object FROM edges) GROUP BY ALL")
def entity_frequency(t):
    return t.edges.select("kg_id", F.explode(F.array("subject", "object")).alias("name")).groupBy("kg_id", "name").agg(F.count("*").alias("n"))


@query("doc_citations", "SELECT source_doc_id, count(*) AS citations FROM edges GROUP BY source_doc_id ORDER BY citations DESC, source_doc_id LIMIT 10")
def doc_citations(t):
    return t.edges.groupBy("source_doc_id").agg(F.count("*").alias("citations")).orderBy(F.desc("citations"), "source_doc_id").limit(10)


@query("world_stats", "SELECT (SELECT count(*) FROM kgs WHERE is_public) AS kgs, (SELECT count(*) FROM entities WHERE kg_id IN (SELECT kg_id FROM kgs WHERE is_public)) AS entities, (SELECT count(*) FROM edges WHERE kg_id IN (SELECT kg_id FROM kgs WHERE is_public)) AS relations, (SELECT count(*) FROM kg_documents WHERE kg_id IN (SELECT kg_id FROM kgs WHERE is_public)) AS documents")
def world_stats(t):
    public = t.kgs.where("is_public").select("kg_id")
    n = lambda df, c: df.join(F.broadcast(public), "kg_id", "left_semi").agg(F.count("*").alias(c))
    return n(t.kgs, "kgs").join(n(t.entities, "entities"), F.lit(True)).join(n(t.edges, "relations"), F.lit(True)).join(n(t.kg_documents, "documents"), F.lit(True))


@query("diff_counts", """SELECT count(*) FILTER (updated_at IS NULL) AS created_count, count(*) FILTER (updated_at IS NOT NULL) AS updated_count FROM
  (SELECT * FROM edges WHERE created_at >= TIMESTAMP '1998-06-01' OR updated_at >= TIMESTAMP '1998-06-01' ORDER BY coalesce(updated_at, created_at) DESC, kg_id, subject, rel_type, object, source_doc_id LIMIT 200)""")
def diff_counts(t):
    return H.diff_counts(H.diff(t.edges, F.expr("timestamp'1998-06-01'"), KEY))


@query("label_stats", "SELECT CASE type WHEN '組織' THEN 'Organization' WHEN '工具' THEN 'Tool' ELSE 'Person' END AS label, count(*) AS n FROM entities GROUP BY ALL")
def label_stats(t):
    return S.type_labels(t.entities, F.broadcast(t.spark.createDataFrame(list(C.TYPE_LABELS.items()), "type string, label string")))


PROGRESS = {
    "todo": "SELECT DISTINCT source_doc_id AS doc_id, chunk_id FROM facts_raw",
    "progress": "SELECT chunk_id FROM todo WHERE doc_id % 3 <> 0",
}


@query("extraction_gaps", "SELECT doc_id, count(*) FILTER (p.chunk_id IS NOT NULL) AS done, count(*) FILTER (p.chunk_id IS NULL) AS missing FROM todo c LEFT JOIN progress p ON c.chunk_id = p.chunk_id GROUP BY doc_id", **PROGRESS)
def extraction_gaps(t):
    todo = t.facts_raw.select(F.col("source_doc_id").alias("doc_id"), "chunk_id").distinct()
    done = todo.where("doc_id % 3 <> 0").select("chunk_id", F.lit(True).alias("done"))
    return todo.join(done, "chunk_id", "left").groupBy("doc_id").agg(F.count_if(F.col("done")).alias("done"), F.count_if(F.col("done").isNull()).alias("missing"))


@query("pending_chunks", "SELECT doc_id, chunk_id FROM todo WHERE chunk_id NOT IN (SELECT chunk_id FROM progress)", **PROGRESS)
def pending_chunks(t):
    todo = t.facts_raw.select(F.col("source_doc_id").alias("doc_id"), "chunk_id").distinct()
    return S.pending_chunks(todo, todo.where("doc_id % 3 <> 0").withColumn("processed", F.lit(True)))


@query("upsert_counter", f"SELECT {COLS}, count(*) AS confidence FROM facts_raw GROUP BY {COLS} HAVING count(*) > 1")
def upsert_counter(t):
    return t.facts_raw.groupBy(*KEY).agg(F.count("*").alias("confidence")).where("confidence > 1")


@query("per_kg_quota", "SELECT kg_id, name FROM (SELECT kg_id, name, row_number() OVER (PARTITION BY kg_id ORDER BY name) AS rn FROM entities) WHERE rn <= greatest(1, 30 // (SELECT count(DISTINCT kg_id) FROM entities)) * 2")
def per_kg_quota(t):
    return quota(t.entities, 30, [F.col("name")], times=2).select("kg_id", "name")


@query("decay_rank", f"SELECT *, row_number() OVER (ORDER BY score DESC, confidence DESC, subject, subject_type, rel_type, verb, object, object_type) AS rank FROM (SELECT kg_id, subject, subject_type, rel_type, verb, object, object_type, confidence, round(confidence * {DECAY_SQL}, 6) AS score FROM best)", **HOP)
def decay_rank(t):
    f = G.top_facts(G.grouped_facts(G.expand_top(t.stored_edges, seeds(t, "supplier-1"), 2)))
    return G.decayed(f, now()).select("kg_id", *G.FACT, "confidence", "score", F.col("rank").cast("long").alias("rank"))


@query("paged_changelog", f"SELECT {COLS}, coalesce(updated_at, created_at) AS changed_at FROM edges ORDER BY changed_at DESC, {COLS} LIMIT 50 OFFSET 100")
def paged_changelog(t):
    return H.changelog(t.edges, KEY, 100, 50).select(*KEY, "changed_at")


@query("changelog", f"SELECT {COLS}, CASE WHEN updated_at IS NULL THEN 'created' ELSE 'updated' END AS change_type FROM edges ORDER BY coalesce(updated_at, created_at) DESC, {COLS} LIMIT 50")
def changelog(t):
    return H.changelog(t.edges, KEY).select(*KEY, "change_type")


@query("diff", f"SELECT {COLS}, created_at, updated_at FROM edges WHERE created_at >= TIMESTAMP '2000-01-01' OR updated_at >= TIMESTAMP '2000-01-01' ORDER BY coalesce(updated_at, created_at) DESC, {COLS} LIMIT 200")
def diff(t):
    return H.diff(t.edges, F.expr("timestamp'2000-01-01'"), KEY).select(*KEY, "created_at", "updated_at")


@query("snapshot", f"SELECT {COLS}, created_at, confidence FROM edges WHERE created_at <= TIMESTAMP '1996-01-01' ORDER BY created_at, {COLS} LIMIT 500")
def snapshot(t):
    return H.snapshot(t.edges, F.expr("timestamp'1996-01-01'"), KEY).select(*KEY, "created_at", "confidence")


@query("doc_upsert", """SELECT d.doc_id, coalesce(n.title, d.title) AS title FROM docs d LEFT JOIN (SELECT doc_id, 'new ' || title AS title FROM docs WHERE doc_id % 7 = 0) n ON d.doc_id = n.doc_id
  UNION ALL SELECT doc_id + 1000000, 'added' FROM docs WHERE doc_id % 50 = 0""")
def doc_upsert(t):
    base = t.docs.select("doc_id", "title")
    change = base.where("doc_id % 7 = 0").select("doc_id", F.concat(F.lit("new "), "title").alias("title")).unionByName(base.where("doc_id % 50 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("added").alias("title")))
    return S.upsert(base, change, ["doc_id"])


@query("edge_upsert", f"""SELECT {COLS}, max_by(verb, seq) AS verb, count(*) AS confidence, min(ts) AS created_at, CASE WHEN count(*) > 1 THEN max(ts) END AS updated_at FROM facts_raw GROUP BY {COLS}""")
def edge_upsert(t):
    return S.merge_triples(t.facts_raw).select(*KEY, "verb", "confidence", "created_at", "updated_at")


@query("edge_merge", f"SELECT {COLS}, count(*) AS confidence, min(ts) AS created_at FROM facts_raw GROUP BY {COLS}")
def edge_merge(t):
    base, delta = S.merge_triples(t.facts_raw.where("seq % 3 > 0")), S.merge_triples(t.facts_raw.where("seq % 3 = 0"))
    cols = [*KEY, "verb", "confidence", "created_at", "updated_at"]
    return S.merge_edges(base.select(*cols), delta.select(*cols)).select(*KEY, "confidence", "created_at")


@query("chunk_ids", f"SELECT {COLS}, string_agg(chunk_id, ',' ORDER BY last, chunk_id) AS chunk_ids FROM (SELECT {COLS}, chunk_id, max(seq) AS last FROM facts_raw GROUP BY ALL) GROUP BY {COLS}")
def chunk_ids(t):
    return S.merge_triples(t.facts_raw).select(*KEY, F.array_join("source_chunk_ids", ",").alias("chunk_ids"))


@query("link_remove", "SELECT kg_id, doc_id FROM kg_documents WHERE doc_id % 5 <> 0")
def link_remove(t):
    return S.without(S.link(t.kg_documents, t.kg_documents), t.kg_documents.where("doc_id % 5 = 0"), ["kg_id", "doc_id"])


@query("retype_edges", "SELECT kg_id, subject, CASE WHEN rel_type = 'USES' THEN 'REQUIRES' ELSE rel_type END AS rel_type, object, source_doc_id, sum(confidence)::BIGINT AS confidence, min(created_at) AS created_at FROM edges GROUP BY ALL")
def retype_edges(t):
    return S.retype(t.edges, t.spark.createDataFrame([("uses", "USES", "REQUIRES")], "verb string, rel_type string, new_type string"))


@query("mark_processed", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2002-01-01' END AS svo_processed_at FROM docs")
def mark_processed(t):
    d = t.docs.select("doc_id", F.lit(None).cast("timestamp_ntz").alias("svo_processed_at"))
    return S.mark_processed(d, d.where("doc_id % 2 = 0"), F.expr("timestamp_ntz'2002-01-01'"))


@query("unprocessed_docs", "SELECT doc_id FROM kg_documents WHERE kg_id = 1 AND doc_id % 2 = 1")
def unprocessed_docs(t):
    d = t.docs.withColumn("svo_processed_at", F.when(F.col("doc_id") % 2 == 0, F.expr(NOW)))
    return d.where("svo_processed_at is null").join(t.kg_documents.where("kg_id = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query("get_or_create", "SELECT name, 'd' AS domain FROM concepts WHERE vec_id < 100 UNION SELECT name, 'd' FROM concepts WHERE vec_id % 3 = 0")
def get_or_create(t):
    c = t.concepts.select("name", F.lit("d").alias("domain"), "vec_id")
    return S.get_or_create(c.where("vec_id < 100").drop("vec_id"), c.where("vec_id % 3 = 0").drop("vec_id"))


@query("query_facts", f"""SELECT *, {FACT_SQL} AS fact FROM (SELECT *, row_number() OVER (ORDER BY score DESC, confidence DESC, subject, subject_type, rel_type, verb, object, object_type) AS rank
  FROM (SELECT kg_id, subject, subject_type, rel_type, verb, object, object_type, confidence, docs, round(confidence * {DECAY_SQL}, 6) AS score FROM best))""", **HOP)
def query_facts(t):
    f = G.query_facts(t.stored_edges, t.entities, ["Supplier-1"], now())
    return f.select("kg_id", *G.FACT, "confidence", F.array_join(F.col("docs").cast("array<string>"), ",").alias("docs"), "score", F.col("rank").cast("long").alias("rank"), "fact")


@query("provenance_facts", f"""SELECT kg_id, subject, rel_type, object, source_doc_id, confidence, score, coalesce(title, '') AS title FROM (
  SELECT *, row_number() OVER (PARTITION BY subject, rel_type, object ORDER BY score DESC, confidence DESC, kg_id, source_doc_id) AS rn FROM (
  SELECT kg_id, subject, rel_type, object, source_doc_id, confidence, round(confidence * {DECAY_SQL}, 6) AS score FROM (SELECT DISTINCT ON (kg_id, subject, rel_type, object, source_doc_id) * FROM hit1) ORDER BY confidence DESC, {COLS} LIMIT 50)) f
  LEFT JOIN (SELECT doc_id, title FROM docs) d ON f.source_doc_id = d.doc_id WHERE rn = 1""", **HOP)
def provenance_facts(t):
    titles = t.docs.select(F.col("doc_id").alias("source_doc_id"), "title")
    return G.provenance_facts(t.stored_edges, t.entities, titles, ["supplier-1"], now()).select(*KEY, "confidence", "score", "title")


REMOTE = "map([" + ", ".join(f"'{k}'" for k in C.REMOTE_LABELS) + "], [" + ", ".join(f"'{v}'" for v in C.REMOTE_LABELS.values()) + "])"


@query("remote_facts", f"SELECT kg_id, '[inst-2] ' || {FACT_SQL.replace(LABELS, REMOTE)} AS fact FROM hit1 ORDER BY subject, rel_type, object, source_doc_id LIMIT 30", **(HOP | {"seeds": "SELECT kg_id, name AS seed FROM entities WHERE name = 'supplier-5'"}))
def remote_facts(t):
    one = t.entities.where("name = 'supplier-5'").select("kg_id", F.col("name").alias("seed"))
    hit = G.expand(t.stored_edges, one, 1).orderBy("subject", "rel_type", "object", "source_doc_id").limit(30)
    return hit.select("kg_id", F.concat(F.lit("[inst-2] "), G.fact_text(C.REMOTE_LABELS)).alias("fact"))


@query("kg_graph", f"SELECT {COLS}, confidence FROM edges WHERE kg_id = 1 AND confidence >= 1 ORDER BY confidence DESC, {COLS} LIMIT 200")
def kg_graph(t):
    return t.edges.where("kg_id = 1 and confidence >= 1").orderBy(F.desc("confidence"), *KEY).limit(200).select(*KEY, "confidence")


@query("degree_top", "SELECT kg_id, name, count(*) AS degree FROM (SELECT kg_id, subject AS name FROM edges UNION ALL SELECT kg_id, object FROM edges) GROUP BY ALL ORDER BY degree DESC, kg_id, name LIMIT 50")
def degree_top(t):
    return G.degree(t.edges).orderBy(F.desc("degree"), "kg_id", "name").limit(50)


@query("best_degree", """SELECT lower(name) AS name, arg_max(kg_id, (degree, -kg_id)) AS kg_id, max(degree) AS degree FROM
  (SELECT kg_id, name, count(*) AS degree FROM (SELECT kg_id, subject AS name FROM edges UNION ALL SELECT kg_id, object FROM edges) GROUP BY ALL) GROUP BY lower(name)""")
def best_degree_query(t):
    return best_degree(G.degree(t.edges))


@query("explore_entities", """SELECT kg_id, name, degree FROM (SELECT *, row_number() OVER (PARTITION BY kg_id ORDER BY degree DESC, name) AS rn FROM
  (SELECT e.kg_id, e.name, count(x.subject) AS degree FROM entities e LEFT JOIN edges x ON e.kg_id = x.kg_id AND e.name = x.subject WHERE contains(lower(e.name), 'er-2') GROUP BY ALL)) WHERE rn <= 20""")
def explore_entities(t):
    hit = G.out_degree(G.names_containing(t.entities, ["er-2"]), t.edges)
    return hit.withColumn("rn", F.row_number().over(W.partitionBy("kg_id").orderBy(F.desc("degree"), "name"))).where("rn <= 20").select("kg_id", "name", "degree")
