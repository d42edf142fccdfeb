"""Queries over concepts, texts, terms and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.functions import constants as C
from weftgraph.functions import text as X
from weftgraph.functions import vectors as V
from weftgraph.operators import cluster as K
from weftgraph.operators import federation as D
from weftgraph.operators import indexes as I
from weftgraph.operators import retrieval as R
from weftgraph.operators import scoring as S
from weftgraph.operators import selfjoin as J
from weftgraph.plans.registry import query

SCORES = {
    "scores": "SELECT owner_id, CASE WHEN sum(mag) < 1e-9 THEN 0 ELSE round(sum(cos * al * mag) / sum(mag), 4) END AS score FROM pair_weights GROUP BY owner_id",
    "knn": "SELECT q_name, name, cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_name ORDER BY cos DESC, name) AS rank FROM (SELECT q_name, c.name, round(list_cosine_similarity(c.q_vector, q_vec), 6) AS cos FROM concepts c CROSS JOIN queries)) WHERE rank <= 100",
    "routed": "SELECT owner_id, round(sum(cos * al * mag) / sum(mag), 4) AS score FROM pair_weights WHERE name IN (SELECT name FROM knn) GROUP BY owner_id HAVING round(sum(cos * al * mag) / sum(mag), 4) >= 0.05",
}


@query("concept_links", "SELECT k.name AS kg, l.name, l.interest, l.professional FROM links l JOIN kgs k ON l.owner_id = k.kg_id")
def concept_links(t):
    return t.links.join(t.kgs.select(F.col("kg_id").alias("owner_id"), F.col("name").alias("kg")), "owner_id").select("kg", "name", "interest", "professional")


@query("concept_doc_count", "SELECT c.name, count(l.owner_id) AS docs FROM concepts c LEFT JOIN (SELECT DISTINCT owner_id, name FROM doc_links) l ON c.name = l.name GROUP BY c.name")
def concept_doc_count(t):
    n = t.doc_links.select("owner_id", "name").distinct().groupBy("name").agg(F.count("*").alias("docs"))
    return t.concepts.select("name").join(n, "name", "left").na.fill(0)


@query("cosine_pairs", "SELECT q_name, name, owner_id, round(cos, 6) AS cos FROM pair_weights")
def cosine_pairs(t):
    return S.pairs(t.queries, t.links).select("q_name", "name", "owner_id", F.round("cos", 6).alias("cos"))


@query("knn_concepts", "SELECT * FROM knn", **SCORES)
def knn_concepts(t):
    return S.nearest(t.queries, t.concepts).withColumn("rank", F.col("rank").cast("long"))


@query("vector_search", "SELECT q.name AS q_name, c.name, round(list_cosine_similarity(c.q_vector, q.q_vector), 6) AS cos, row_number() OVER (PARTITION BY q.name ORDER BY round(list_cosine_similarity(c.q_vector, q.q_vector), 6) DESC, c.name) AS rank FROM concepts q CROSS JOIN concepts c WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10")
def vector_search(t):
    """The 10 nearest concepts of every fiftieth, exactly, through the index."""
    asked = t.concepts.where("vec_id % 50 = 0").select(F.col("name").alias("q_name"), F.col("q_vector").alias("q_vec"))
    return I.VectorIndex.build(t.concepts).search(asked, 10, exact=True).withColumn("rank", F.col("rank").cast("long"))


@query("vector_route", "SELECT owner_id, score FROM routed ORDER BY score DESC, owner_id LIMIT 5", **SCORES)
def vector_route(t):
    """The two-stage route whose first stage is the index."""
    index = I.VectorIndex.build(t.concepts)
    return S.two_stage(t.queries, t.concepts, t.links, search=lambda q, k: index.search(q, k, exact=True))


@query("cooccur_pairs", "SELECT a.name AS a, b.name AS b, count(*) AS n FROM (SELECT DISTINCT owner_id, name FROM doc_links) a JOIN (SELECT DISTINCT owner_id, name FROM doc_links) b ON a.owner_id = b.owner_id AND a.name < b.name GROUP BY ALL")
def cooccur_pairs(t):
    return S.co_occurring(t.doc_links)


CENTROIDS = {
    "cells": "SELECT owner_id, i, round(avg(q_vector[i]), 6) AS x FROM doc_links, range(1, 65) r(i) GROUP BY owner_id, i",
    "centroids": "SELECT owner_id, list(x ORDER BY i) AS v FROM cells GROUP BY owner_id",
    "sims": "SELECT a.owner_id AS a, b.owner_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM centroids a JOIN centroids b ON a.owner_id < b.owner_id",
    "reach": "/*RECURSIVE_STEP*/ SELECT owner_id AS node, owner_id AS label FROM centroids UNION SELECT CASE WHEN s.a = r.node THEN s.b ELSE s.a END, r.label FROM reach r JOIN sims s ON s.sim >= 0.35 AND (s.a = r.node OR s.b = r.node) WHERE r.label < CASE WHEN s.a = r.node THEN s.b ELSE s.a END",
    "comps": "SELECT node, min(label) AS component FROM reach GROUP BY node",
}


@query("centroids", "SELECT owner_id, i - 1 AS pos, x FROM cells", **CENTROIDS)
def centroids(t):
    return S.mean_vectors(t.doc_links, "owner_id").select("owner_id", F.posexplode("centroid").alias("pos", "x")).select("owner_id", F.col("pos").cast("long").alias("pos"), "x")


@query("doc_pair_similarity", "SELECT a, b, sim FROM sims WHERE sim >= 0.1", **CENTROIDS)
def doc_pair_similarity(t):
    return S.pair_similarity(S.mean_vectors(t.doc_links, "owner_id"), "owner_id", 0.1)


@query("similar_concepts", "SELECT a.name AS a, b.name AS b, round(list_cosine_similarity(a.q_vector, b.q_vector), 6) AS sim FROM concepts a JOIN concepts b ON a.name < b.name WHERE round(list_cosine_similarity(a.q_vector, b.q_vector), 6) >= 0.4")
def similar_concepts(t):
    """All pairs of concepts from a cosine on, over all concepts."""
    return J.similar_pairs(t.concepts, "name", "q_vector", 0.4)


@query("components", "SELECT node, component FROM comps", **CENTROIDS)
def components(t):
    c = S.mean_vectors(t.doc_links, "owner_id")
    return K.threshold_components(c, "owner_id")


CLUSTERS = """SELECT component, count(DISTINCT node) AS size, (SELECT round(avg(sim), 3) FROM sims s JOIN comps x ON s.a = x.node JOIN comps y ON s.b = y.node WHERE x.component = c.component AND y.component = c.component) AS similarity
       , (SELECT string_agg(name, '|' ORDER BY rn) FROM tops p WHERE p.component = c.component AND rn <= 15) AS top_concepts
  FROM comps c GROUP BY component HAVING count(DISTINCT node) >= 2 AND similarity >= 0.35"""
TOPS = {"tops": "SELECT component, name, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, name) AS rn FROM doc_links JOIN comps ON owner_id = node GROUP BY component, name"}


@query("cluster_docs", CLUSTERS, **TOPS, **CENTROIDS)
def cluster_docs(t):
    c = S.mean_vectors(t.doc_links, "owner_id")
    return K.cluster_documents(c, "owner_id", t.doc_links.select("owner_id", "name")).select("component", "size", "similarity", "top_concepts")


#: The same over the links of documents that no graph's question reaches.
STAGED = {k: v.replace("doc_links", "staged") for k, v in (TOPS | CENTROIDS).items()} | {
    "doc_scores": "SELECT owner_id, round(sum(cos * al * mag) / sum(mag), 4) AS score FROM (SELECT *, (1.6 + interest + professional) / 4 AS mag, greatest(0, 1 - (abs(0.8::DOUBLE - interest) + abs(0.8::DOUBLE - professional)) / 2) AS al, list_cosine_similarity(q_vector, q_vec) AS cos FROM doc_links CROSS JOIN queries) WHERE cos >= 0.01 GROUP BY owner_id",
    "staged": "SELECT * FROM doc_links WHERE owner_id NOT IN (SELECT owner_id FROM doc_scores WHERE score >= 0.05)",
}


@query("cluster_staging", CLUSTERS, **STAGED)
def cluster_staging(t):
    """Clusters of the documents that match no graph: without a score, or with one under the least."""
    links = K.unmatched(t.doc_links, S.match_scores(t.queries, t.doc_links))
    c = S.mean_vectors(links, "owner_id")
    return K.cluster_documents(c, "owner_id", links.select("owner_id", "name")).select("component", "size", "similarity", "top_concepts")


@query("intra_similarity", "SELECT label, round(avg(list_cosine_similarity(a.q_vector, b.q_vector)), 5) AS similarity FROM concepts a JOIN (SELECT vec_id AS v2, label AS l2, q_vector FROM concepts) b ON label = l2 AND vec_id < v2 GROUP BY label")
def intra_similarity(t):
    return S.mean_pair_cosine(t.concepts, "label").select("label", F.round("similarity", 5).alias("similarity"))


@query("match_score", "SELECT * FROM scores", **SCORES)
def match_score(t):
    return S.match_scores(t.queries, t.links)


@query("matched_concepts", "SELECT owner_id, name, cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY cos DESC, name) AS rank FROM (SELECT owner_id, name, round(max(cos), 6) AS cos FROM cos_pairs WHERE cos > 0.2 GROUP BY ALL)) WHERE rank <= 5")
def matched_concepts(t):
    return S.matched_concepts(t.queries, t.links, least=0.2).withColumn("rank", F.col("rank").cast("long"))


@query("two_stage_route", "SELECT owner_id, score FROM routed ORDER BY score DESC, owner_id LIMIT 5", **SCORES)
def two_stage_route(t):
    return S.two_stage(t.queries, t.concepts, t.links)


@query("classify_docs", "SELECT owner_id, score, CASE WHEN score >= 0.3 THEN 'assigned' WHEN score >= 0.05 THEN 'pending' ELSE 'unmatched' END AS status FROM scores ORDER BY score DESC, owner_id LIMIT 1", **SCORES)
def classify_docs(t):
    return S.classified(t.queries, t.links)


@query("search", "SELECT owner_id AS doc_id, score FROM (SELECT owner_id, round(sum(cos * al * mag) / sum(mag), 4) AS score FROM (SELECT *, (1.6 + interest + professional) / 4 AS mag, greatest(0, 1 - (abs(0.8::DOUBLE - interest) + abs(0.8::DOUBLE - professional)) / 2) AS al, list_cosine_similarity(q_vector, q_vec) AS cos FROM doc_links CROSS JOIN queries) WHERE cos >= 0.01 GROUP BY owner_id) WHERE score >= 0.05 ORDER BY score DESC, owner_id LIMIT 10")
def search(t):
    return S.match_scores(t.queries, t.doc_links).where("score >= 0.05").orderBy(F.desc("score"), "owner_id").limit(10).withColumnRenamed("owner_id", "doc_id")


@query("skill_concepts", "SELECT owner_id, name, score FROM (SELECT owner_id, name, round((interest + professional) / 2, 4) AS score, row_number() OVER (PARTITION BY owner_id ORDER BY round((interest + professional) / 2, 4) DESC, name) AS rn FROM links) WHERE rn <= 20")
def skill_concepts(t):
    s = t.links.select("owner_id", "name", F.round((F.col("interest") + F.col("professional")) / 2, 4).alias("score"))
    return s.withColumn("rn", F.row_number().over(W.partitionBy("owner_id").orderBy(F.desc("score"), "name"))).where("rn <= 20").drop("rn")


@query("top_concepts", "SELECT name, interest + professional AS weight FROM links WHERE owner_id = 1 ORDER BY weight DESC, name LIMIT 10")
def top_concepts(t):
    return t.links.where("owner_id = 1").select("name", (F.col("interest") + F.col("professional")).alias("weight")).orderBy(F.desc("weight"), "name").limit(10)


@query("cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.q_vector, b.q_vector), 6) AS cos FROM concepts a JOIN (SELECT vec_id AS v2, q_vector FROM concepts) b ON v2 = a.vec_id + 1")
def cosine(t):
    b = t.concepts.select((F.col("vec_id") - 1).alias("vec_id"), F.col("q_vector").alias("y"))
    return t.concepts.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("q_vector"), F.col("y")), 6).alias("cos"))


@query("align_mag", "SELECT name, greatest(0.0::DOUBLE, 1 - (abs(0.8::DOUBLE - interest) + abs(0.8::DOUBLE - professional)) / 2) AS al, (1.6::DOUBLE + interest + professional) / 4 AS mag FROM links")
def align_mag(t):
    args = (F.lit(0.8), F.lit(0.8), F.col("interest"), F.col("professional"))
    return t.links.select("name", V.alignment(*args).alias("al"), V.magnitude(*args).alias("mag"))


@query("fuse_vectors", """SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: i * (0.85::DOUBLE * a.q_vector[i] / sqrt(list_dot_product(a.q_vector, a.q_vector)) + (1 - 0.85::DOUBLE) * b.q_vector[i] / sqrt(list_dot_product(b.q_vector, b.q_vector))))), 5) AS mark
  FROM concepts a JOIN (SELECT vec_id AS v2, q_vector FROM concepts) b ON v2 = a.vec_id + 1""")
def fuse_vectors(t):
    b = t.concepts.select((F.col("vec_id") - 1).alias("vec_id"), F.col("q_vector").alias("y"))
    fused = t.concepts.join(b, "vec_id").select("vec_id", V.fuse(F.col("q_vector"), F.col("y")).alias("f"))
    mark = F.aggregate(F.transform("f", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return fused.select("vec_id", F.round(mark, 5).alias("mark"))


@query("decay", "SELECT subject, object, source_doc_id, rel_type, round(exp(-0.005::DOUBLE * greatest(0, (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(created_at)) / 86400000000.0::DOUBLE)), 6) AS decay FROM edges")
def decay(t):
    return t.edges.select("subject", "object", "source_doc_id", "rel_type", F.round(V.decay(F.col("created_at"), F.expr("timestamp'2002-01-01 00:00:00'")), 6).alias("decay"))


READ = r"[\x00-\x7F\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\x{2E80}-\x{2EFF}]"


@query("readable_docs", f"SELECT doc_id, length(content) > 0 AND length(regexp_replace(substr(content, 1, 500), '{READ}', '', 'g')) / length(substr(content, 1, 500)) < 0.05 AS readable FROM docs")
def readable_docs(t):
    return t.docs.select("doc_id", X.readable(F.col("content"), 0.05).alias("readable"))


PARTS = {
    "raw_parts": "SELECT doc_id, unnest(regexp_extract_all(content, '[^。！？!?\\n]*[。！？!?\\n]|[^。！？!?\\n]+$')) AS part, unnest(range(len(regexp_extract_all(content, '[^。！？!?\\n]*[。！？!?\\n]|[^。！？!?\\n]+$')))) AS pos FROM docs",
    "kept_parts": "SELECT doc_id, pos, trim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM raw_parts WHERE length(trim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 5",
    "sents": """SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM kept_parts UNION ALL
      SELECT doc_id, trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1 FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM kept_parts) AND length(trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0""",
}


@query("sentence_split", "SELECT doc_id, rn - 1 AS pos, s FROM sents", **PARTS)
def sentence_split(t):
    return t.docs.select("doc_id", F.posexplode(X.sentences(F.col("content"))).alias("pos", "s")).withColumn("pos", F.col("pos").cast("long"))


@query("sentence_chunks", "SELECT doc_id, doc_id || '_' || lpad(((rn - 1) // 5 + 1)::VARCHAR, 4, '0') AS chunk_id, string_agg(s, '' ORDER BY rn) AS text, count(*) AS sentences FROM sents GROUP BY doc_id, (rn - 1) // 5", **PARTS)
def sentence_chunks(t):
    return X.chunks(t.docs, "doc_id", "content").select("doc_id", "chunk_id", "text", F.size("sentences").cast("long").alias("sentences"))


@query("char_offsets", "SELECT doc_id, pos, (sum(length(part)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - length(part))::BIGINT AS start, length(part)::BIGINT AS length FROM raw_parts WHERE length(part) > 0", **PARTS)
def char_offsets(t):
    o = X.sentence_offsets(t.docs, "doc_id", "content")
    return o.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"))


@query("md5_key", "SELECT doc_id, md5('kg:' || substr(content, 1, 3000)) AS key FROM docs")
def md5_key(t):
    return t.docs.select("doc_id", F.md5(F.concat(F.lit("kg:"), F.substring("content", 1, 3000))).alias("key"))


@query("normalize_ascii", r"SELECT name, trim(regexp_replace(regexp_replace(trim(raw), '\s+', ' ', 'g'), '\s*\(.*?\)\s*$', '')) AS clean FROM (SELECT name, '  ' || name || '   x (note ' || vec_id || ') ' AS raw FROM concepts)")
def normalize_ascii(t):
    raw = F.concat(F.lit("  "), "name", F.lit("   x (note "), "vec_id", F.lit(") "))
    return t.concepts.select("name", X.normalise_name(raw).alias("clean"))


@query("sanitize", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content || chr(13) || 'a' || chr(8203) || chr(133) || 'b   ' || chr(10) || chr(10) || chr(10) || chr(10) || 'end' || chr(7), '[\x00-\x08\x0B\x0C\x0E-\x1F]|\p{Cf}|[\x{7F}-\x{9F}]|\p{Co}', '', 'g'), '\r\n|\r', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x{A0}\x{2000}-\x{200A}\x{3000}]+', ''), '[\s\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '')) AS key FROM docs")
def sanitize(t):
    return t.docs.select("doc_id", F.md5(X.sanitise(F.concat("content", F.lit("\ra\u200b\x85b   \n\n\n\nend\x07")))).alias("key"))


@query("paragraph_counts", r"""SELECT doc_id, CASE WHEN len(w) < 5 OR total / greatest(1, len(w)) > 400 THEN len(n) ELSE len(w) END AS paragraphs FROM (SELECT doc_id, w, n, coalesce(list_sum(list_transform(w, lambda p: length(p))), 0) AS total FROM (SELECT doc_id,
  list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: length(p) > 0) AS w, list_filter(list_transform(string_split(content, chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: length(p) > 0) AS n FROM docs))""")
def paragraph_counts(t):
    return t.docs.select("doc_id", F.size(X.paragraphs(F.col("content"))).cast("long").alias("paragraphs"))


@query("parse_pipe", "SELECT kg_id, 'supplier' AS subject, '組織' AS subject_type, CASE WHEN kg_id % 2 = 0 THEN 'USES' ELSE 'RELATED_TO' END AS rel_type, 'uses' AS verb, name AS object, '其他' AS object_type FROM kgs UNION ALL SELECT kg_id, 'a', '概念', 'RELATED_TO', 'b', 'c', '概念' FROM kgs")
def parse_pipe(t):
    rel = F.when(F.col("kg_id") % 2 == 0, "uses").otherwise("odd")
    text = F.concat(F.lit("# head\n\nsupplier|組織|"), rel, F.lit("|uses|"), "name", F.lit("|nothing\na｜b｜c\na|b|c\nnone|b|c\n"))
    return X.parse_lines(t.kgs.withColumn("raw", text), "raw", ("kg_id",))


@query("parse_json", "SELECT kg_id, 's' AS subject, '工具' AS subject_type, 'USES' AS rel_type, 'v' AS verb, name AS object, '概念' AS object_type FROM kgs UNION ALL SELECT kg_id, 'none', '概念', 'RELATED_TO', 'v', 'o', '其他' FROM kgs")
def parse_json(t):
    text = F.concat(F.lit('[{"s":"s","st":"工具","r":"uses","v":"v","o":"'), "name", F.lit('"},{"s":"none","r":"zz","v":"v","o":"o","ot":"?"},{"s":"x","v":"","o":"y"}]'))
    return X.parse_json(t.kgs.withColumn("raw", text), "raw", ("kg_id",))


@query("triple_valid", "SELECT o_orderkey, length(o_orderpriority) <= 20 AND lower(o_orderstatus) NOT IN ('f') AS ok FROM orders")
def triple_valid(t):
    verb = F.when(F.lower("o_orderstatus") == "f", "none").otherwise(F.col("o_orderpriority"))
    return t.read("orders").select("o_orderkey", X.valid_triple(F.col("o_orderkey").cast("string"), verb, F.lit("o")).alias("ok"))


@query("grounded_triples", "SELECT doc_id, contains(lower(content), 'the') OR contains(lower(content), 'und') AS ok FROM docs")
def grounded_triples(t):
    return t.docs.select("doc_id", X.grounded(F.lit("The"), F.lit("UND"), F.col("content")).alias("ok"))


@query("global_question", "SELECT item_id, regexp_matches(text, '(?i)(overview|summar(y|ize)|entire knowledge\\s*base)') OR item_id % 2 = 0 AS global FROM benchmark")
def global_question(t):
    text = F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit(" 請總結整體"))).otherwise(F.col("text"))
    return t.read("benchmark").select("item_id", text.rlike("(?i)" + C.GLOBAL_QUESTION).alias("global"))


@query("calibrate", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '找不到相關資訊 ' ELSE 'answer ' END || turn AS clean, least(1.0::DOUBLE, greatest(0.0::DOUBLE, least(CASE WHEN turn % 2 = 0 THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END, CASE WHEN turn % 3 = 2 THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END) * 0.9::DOUBLE)) AS confidence FROM conversations")
def calibrate(t):
    text = F.concat(F.when(F.col("turn") % 3 == 2, F.lit("找不到相關資訊 ")).otherwise(F.lit("answer ")), "turn", F.when(F.col("turn") % 2 == 0, F.lit(' \n{"confidence": 0.85}')).otherwise(F.lit("")))
    return t.read("conversations").select("conv_id", "turn", X.calibrated(text).alias("c")).select("conv_id", "turn", "c.*")


@query("chunk_score", r"""SELECT chunk_id, round(0.5::DOUBLE + 0.4::DOUBLE * q + 0.10::DOUBLE * e + CASE WHEN q + e > 0 AND regexp_matches(text, '(?m)^\s*(#{1,6}\s+)?([①-⑩]|[1-9][0-9]?([.)）]\s|、)|[•·▪▸]\s|第[一二三四五六七八九十百]+[章節項])') THEN 0.25::DOUBLE ELSE 0 END, 6) AS score FROM (SELECT chunk_id, text, contains(text, 'the')::INT + contains(text, 'and')::INT AS q, contains(text, 'token')::INT AS e FROM chunk_rows)""",
       chunk_rows="SELECT doc_id, doc_id || '_' || lpad(((rn - 1) // 5 + 1)::VARCHAR, 4, '0') AS chunk_id, CASE WHEN doc_id % 9 = 0 THEN '1. ' ELSE '' END || string_agg(s, '' ORDER BY rn) AS text FROM sents GROUP BY doc_id, (rn - 1) // 5", **PARTS)
def chunk_score(t):
    """Chunks of all documents; those of every ninth are made enumerations, which earn the bonus."""
    text = F.concat(F.when(F.col("doc_id") % 9 == 0, "1. ").otherwise(""), "text")
    c = X.chunks(t.docs, "doc_id", "content").withColumn("text", text)
    return c.select("chunk_id", F.round(R.chunk_score(F.lit(0.5), R.hits(F.col("text"), ["the", "and"]), R.hits(F.col("text"), ["token"]), F.col("text")), 6).alias("score"))


SIZED = PARTS | {"sized": "SELECT doc_id, (rn - 1) // 5 + 1 AS idx, sum(length(s))::BIGINT AS n FROM sents GROUP BY doc_id, (rn - 1) // 5"}


@query("budget_select", "SELECT doc_id, idx, total FROM (SELECT doc_id, idx, (sum(n) OVER (PARTITION BY doc_id ORDER BY n DESC, idx ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM sized) WHERE total <= 1500", **SIZED)
def budget_select(t):
    c = X.chunks(t.docs, "doc_id", "content").select("doc_id", F.col("idx").cast("long").alias("idx"), F.length("text").alias("n"))
    return R.budget(c, ["doc_id"], [F.desc("n"), F.col("idx")], "n", 1500).select("doc_id", "idx", "total")


@query("neighbor_hits", "SELECT doc_id, idx FROM (SELECT doc_id, idx, hit OR coalesce(lag(hit) OVER w, false) OR coalesce(lead(hit) OVER w, false) AS near FROM (SELECT *, n % 7 = 0 AS hit FROM sized) WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) WHERE near", **SIZED)
def neighbor_hits(t):
    c = X.chunks(t.docs, "doc_id", "content").select("doc_id", F.col("idx").cast("long").alias("idx"), (F.length("text") % 7 == 0).alias("hit"))
    return R.with_neighbours(c, "doc_id", "idx", "hit").select("doc_id", "idx")


@query("uniform_sample", "SELECT doc_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rn FROM (SELECT doc_id, idx - 1 AS idx, count(*) OVER (PARTITION BY doc_id) AS c FROM sized) WHERE idx % greatest(1, c // 2) = 0) WHERE rn <= 2", **SIZED)
def uniform_sample(t):
    c = X.chunks(t.docs, "doc_id", "content").select("doc_id", (F.col("idx") - 1).cast("long").alias("idx"))
    return R.sampled(c, "doc_id", "idx", cap=2).select("doc_id", "idx")


@query("recent_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS back FROM conversations) WHERE back <= 8")
def recent_turns(t):
    return R.recent_turns(t.read("conversations")).select("conv_id", "turn", "role")


@query("prompt_budget", "SELECT conv_id, turn, greatest(500, 7500 // count(*) OVER (PARTITION BY conv_id)) AS budget FROM conversations")
def prompt_budget(t):
    return R.prompt_budget(t.read("conversations"), "conv_id").select("conv_id", "turn", F.col("budget").cast("long").alias("budget"))


@query("chunk_rank", "SELECT name, coalesce(cos, -1.0::DOUBLE) AS cos, row_number() OVER (ORDER BY coalesce(cos, -1.0::DOUBLE) DESC, name) AS rank FROM (SELECT c.name, CASE WHEN c.vec_id % 5 = 0 THEN NULL ELSE round(list_cosine_similarity(c.q_vector, q_vec), 6) END AS cos FROM concepts c CROSS JOIN (SELECT q_vec FROM queries WHERE q_name = 'concept-1')) ORDER BY rank LIMIT 20")
def chunk_rank(t):
    p = S.pairs(t.queries.where("q_name = 'concept-1'"), t.concepts, floor=None)
    cos = F.coalesce(F.when(F.col("vec_id") % 5 != 0, F.round("cos", 6)), F.lit(-1.0))
    top = p.select("name", cos.alias("cos")).orderBy(F.desc("cos"), "name").limit(20)
    return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("cos"), "name")).cast("long"))


@query("first_seen", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def first_seen(t):
    return D.first_seen(t.read("events").select("event_type", "event_id"), ["event_type"], "event_id")


TERMS = {
    "terms": "SELECT doc_id AS pos, CASE doc_id % 8 WHEN 0 THEN 'AI' WHEN 1 THEN 'zebra' WHEN 2 THEN 'Docker' WHEN 3 THEN 'ai' WHEN 4 THEN 'fine tuning' WHEN 5 THEN 'Zebra' ELSE title END AS term FROM docs",
    "syn": "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i})" for m, i in {m: i for i, g in enumerate(C.SYNONYMS) for m in g}.items()) + ") v(member, gid)",
    "expanded": """SELECT pos, 0 AS k, term FROM terms UNION ALL SELECT pos, k, member FROM (SELECT t.pos, s.member, row_number() OVER (PARTITION BY t.pos ORDER BY encode(s.member)) AS k FROM terms t JOIN syn g ON g.member = lower(t.term) JOIN syn s ON s.gid = g.gid AND s.member <> lower(t.term)) WHERE k <= 3""",
}


def _terms(t):
    """A term of each document: some known to the synonyms, some in two spellings, else its title."""
    some = F.element_at(F.array(*map(F.lit, ["AI", "zebra", "Docker", "ai", "fine tuning", "Zebra"])), (F.col("doc_id") % 8 + 1).cast("int"))
    return t.docs.select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 8 < 6, some).otherwise(F.col("title")).alias("term"))


@query("expand_terms", "SELECT pos, k, term FROM (SELECT *, row_number() OVER (PARTITION BY lower(term) ORDER BY pos, k) AS rn FROM expanded) WHERE rn = 1", **TERMS)
def expand_terms(t):
    return D.expand_terms(_terms(t), D.synonym_table(t.spark)).select("pos", F.col("k").cast("long").alias("k"), "term")


@query("synonym_lookup", "SELECT t.term, coalesce((SELECT string_agg(s.member, '|' ORDER BY encode(s.member)) FROM syn s WHERE s.gid = g.gid), '') AS members FROM terms t LEFT JOIN syn g ON g.member = lower(t.term)", **TERMS)
def synonym_lookup(t):
    return D.synonyms_of(_terms(t), D.synonym_table(t.spark))


@query("skill_terms", "SELECT owner_id, round(count(DISTINCT term) / 2.0::DOUBLE, 4) AS score FROM links JOIN (VALUES ('concept-12'), ('pt-7')) v(term) ON contains(name, term) OR contains(term, name) GROUP BY owner_id")
def skill_terms(t):
    return D.skill_score(t.spark.createDataFrame([("Concept-12",), ("pt-7",)], "term string"), t.links)


@query("registry_merge", "SELECT kb_id, is_local FROM (SELECT 'kb-' || kg_id AS kb_id, true AS is_local FROM kgs WHERE kg_id < 3 UNION ALL SELECT 'kb-' || kg_id, false FROM kgs WHERE kg_id >= 3)")
def registry_merge(t):
    kb = lambda cond, local: t.kgs.where(cond).select(F.concat(F.lit("kb-"), "kg_id").alias("kb_id"), F.lit(local).alias("is_local"))
    return D.merge_registry(kb("kg_id < 3", True), kb("kg_id > 1", False))


@query("registry_sync", "SELECT 'kb-' || kg_id AS kb_id, is_public AS is_local FROM kgs WHERE is_public OR kg_id = 3")
def registry_sync(t):
    kb = lambda cond, local: t.kgs.where(cond).select(F.concat(F.lit("kb-"), "kg_id").alias("kb_id"), F.lit(local).alias("is_local"))
    return D.sync_registry(kb("kg_id = 1", True).unionByName(kb("kg_id = 3", False)), kb("is_public", True))


ENT = {"raw_entities": "SELECT row_number() OVER (ORDER BY c_custkey) AS seq, CASE WHEN c_custkey % 3 = 0 THEN 'AI' WHEN c_custkey % 3 = 1 THEN 'Artificial Intelligence' ELSE c_name END AS name, 'inst' || (c_custkey % 2) AS instance_id, c_nationkey AS degree FROM customer"}


def _entities(t):
    c = t.read("customer")
    name = F.when(F.col("c_custkey") % 3 == 0, "AI").when(F.col("c_custkey") % 3 == 1, "Artificial Intelligence").otherwise(F.col("c_name"))
    return c.select(F.col("c_custkey").alias("seq"), name.alias("name"), F.concat(F.lit("inst"), F.col("c_custkey") % 2).alias("instance_id"), F.col("c_nationkey").alias("degree"))


@query("align_entities", "SELECT CASE WHEN name IN ('AI', 'Artificial Intelligence') THEN 'ai' ELSE lower(name) END AS key, arg_min(name, seq) AS canonical_name, max(degree) AS max_degree, count(DISTINCT instance_id) AS instance_count, string_agg(DISTINCT instance_id, '|' ORDER BY instance_id) AS instances, count(*) AS members FROM raw_entities GROUP BY ALL", **ENT)
def align_entities(t):
    return D.align(_entities(t), D.synonym_table(t.spark)).withColumn("instances", F.array_join("instances", "|"))


@query("aligned_stats", "SELECT count(*) AS entities, count(*) FILTER (n > 1) AS cross_instance, (SELECT string_agg(DISTINCT instance_id, '|' ORDER BY instance_id) FROM raw_entities) AS instances FROM (SELECT CASE WHEN name IN ('AI', 'Artificial Intelligence') THEN 'ai' ELSE lower(name) END AS key, count(DISTINCT instance_id) AS n FROM raw_entities GROUP BY ALL)", **ENT)
def aligned_stats(t):
    return D.align(_entities(t), D.synonym_table(t.spark)).agg(F.count("*").alias("entities"), F.count_if(F.col("instance_count") > 1).alias("cross_instance"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("instances")))), "|").alias("instances"))


@query("union_shards", "SELECT fact, arg_min(shard, shard * 1000000000 + seq) AS shard FROM (SELECT kg_id AS shard, row_number() OVER (PARTITION BY kg_id ORDER BY object, rel_type, subject, source_doc_id) AS seq, object AS fact FROM edges WHERE kg_id <> 2) GROUP BY fact")
def union_shards(t):
    # a shard's order begins with the fact, so a fact's rows are ordered among themselves and no task numbers a shard
    seq = F.struct("object", "rel_type", "subject", "source_doc_id")
    f = t.edges.select(F.col("kg_id").alias("shard"), seq.alias("seq"), F.when(F.col("kg_id") == 2, "timeout").otherwise("ok").alias("status"), F.col("object").alias("fact"))
    return D.shard_union(f).select("fact", "shard")


@query("leftover_items", "SELECT doc_id FROM docs EXCEPT SELECT doc_id FROM kg_documents")
def leftover_items(t):
    return t.docs.select("doc_id").exceptAll(t.kg_documents.select("doc_id")).distinct()


@query("hybrid_context", """SELECT doc_id, 'graph' AS origin, doc_id + 1 AS rank FROM docs WHERE doc_id < 3 UNION ALL
  SELECT doc_id, 'similar', rank FROM (SELECT owner_id AS doc_id, row_number() OVER (ORDER BY w DESC, owner_id) AS rank FROM (SELECT owner_id, sum(interest) AS w FROM doc_links WHERE owner_id >= 3 GROUP BY owner_id)) WHERE rank <= 2""")
def hybrid_context(t):
    g = t.docs.where("doc_id < 3").select("doc_id", (F.col("doc_id") + 1).alias("rank"))
    s = t.doc_links.groupBy(F.col("owner_id").alias("doc_id")).agg(F.sum("interest").alias("score"))
    return R.hybrid(g, s).withColumn("rank", F.col("rank").cast("long"))


@query("eval_averages", "SELECT quality AS mode, round(avg(toxic), 2) AS toxic, count(*) AS n FROM labels GROUP BY quality")
def eval_averages(t):
    return t.read("labels").groupBy(F.col("quality").alias("mode")).agg(F.round(F.avg("toxic"), 2).alias("toxic"), F.count("*").alias("n"))
