"""The graph tables of the queries, derived from the star-schema tables; with the same tables in SQL."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import materialise


def _subject() -> Column:
    return F.concat(F.lit("supplier-"), F.col("l_suppkey"))


def _object() -> Column:
    return F.concat(F.lit("part-"), F.col("l_partkey"))


def _rel_type() -> Column:
    return F.when(F.col("kind") == 0, "USES").when(F.col("kind") == 1, "PRODUCES").otherwise("REQUIRES")


class Tables:
    """Lazy tables of one folder. Nothing is collected or kept here but plans."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def kgs(self) -> DataFrame:
        return self.read("region").select(F.col("r_regionkey").cast("long").alias("kg_id"), F.col("r_name").alias("name"), (F.col("r_regionkey") % 2 == 0).alias("is_public"), F.concat(F.lit("owner-"), F.col("r_regionkey") % 3).alias("owner_id"))

    @cached_property
    def suppliers(self) -> DataFrame:
        nation = self.read("nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("kg_id"))
        return self.read("supplier").select("s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "kg_id")

    @cached_property
    def items(self) -> DataFrame:
        """The line items' columns that facts are made of, with the graph of the supplier; numbers instead of names, which every shuffle would carry."""
        li = self.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
        kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
        return li.join(self.suppliers, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("kind", kind).withColumn("source_doc_id", F.col("l_orderkey") % 200)

    @cached_property
    def facts_raw(self) -> DataFrame:
        """One row per line item: a triple row with its document and time."""
        return self.items.select(
            "kg_id", _subject().alias("subject"), F.lit("組織").alias("subject_type"), _rel_type().alias("rel_type"), F.concat(F.lit("verb-"), F.lower("l_linestatus")).alias("verb"), _object().alias("object"), F.lit("工具").alias("object_type"),
            "source_doc_id", F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.format_string("%s_%04d", F.col("source_doc_id"), F.col("l_linenumber")).alias("chunk_id"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        """One row per fact and document; a plan, so a filter on the graph reaches the line items' join and columns that aren't read aren't made."""
        g = self.items.groupBy("kg_id", "l_suppkey", "kind", "l_partkey", "source_doc_id").agg(F.count("*").alias("confidence"), F.min("l_shipdate").alias("created_at"), F.max("l_shipdate").alias("hi"))
        return g.select("kg_id", _subject().alias("subject"), F.lit("組織").alias("subject_type"), _rel_type().alias("rel_type"), F.lower(_rel_type()).alias("verb"), _object().alias("object"), F.lit("工具").alias("object_type"), "source_doc_id", "confidence", "created_at", F.when(F.col("confidence") > 1, F.col("hi")).alias("updated_at"))

    @cached_property
    def stored_edges(self) -> DataFrame:
        """The edges as a written table, for queries that read them more than once."""
        return materialise(self.edges, "edges")

    @cached_property
    def entities(self) -> DataFrame:
        """All suppliers and parts of line items, and parts without any as orphans of graph 0."""
        ends = self.items.select("kg_id", F.explode(F.array(F.struct(F.lit(True).alias("supplier"), F.col("l_suppkey").cast("long").alias("key")), F.struct(F.lit(False).alias("supplier"), F.col("l_partkey").cast("long").alias("key")))).alias("e")).select("kg_id", "e.*").distinct()
        ends = ends.select("kg_id", F.concat(F.when(F.col("supplier"), "supplier-").otherwise("part-"), F.col("key")).alias("name"), F.when(F.col("supplier"), "組織").otherwise("工具").alias("type"))
        lone = self.read("customer").where("c_custkey % 50 = 0").select(F.lit(0).cast("long").alias("kg_id"), F.concat(F.lit("customer-"), "c_custkey").alias("name"), F.lit("人物").alias("type"))
        return ends.unionByName(lone)

    @cached_property
    def docs(self) -> DataFrame:
        kg = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3).cast("long")
        return self.read("documents").select("doc_id", F.concat("source", F.lit("-"), "doc_id").alias("title"), F.col("text").alias("content"), kg.alias("kg_id"))

    @cached_property
    def kg_documents(self) -> DataFrame:
        return self.docs.where("doc_id % 10 <> 9").select("kg_id", "doc_id")

    @cached_property
    def concepts(self) -> DataFrame:
        return self.read("embeddings").select(F.concat(F.lit("concept-"), "vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("q_vector"), "vec_id", F.col("label").cast("long").alias("label"))

    @cached_property
    def links(self) -> DataFrame:
        """Graph to concept."""
        return self.concepts.select((F.col("label") % 5).alias("owner_id"), "name", "q_vector", ((F.col("vec_id") % 10 + 1) / 10).alias("interest"), ((F.col("vec_id") % 7 + 1) / 10).alias("professional"))

    @cached_property
    def doc_links(self) -> DataFrame:
        """Document to concept."""
        return self.concepts.select((F.col("vec_id") % 200).alias("owner_id"), "name", "q_vector", ((F.col("vec_id") % 10 + 1) / 10).alias("interest"), ((F.col("vec_id") % 7 + 1) / 10).alias("professional"))

    @cached_property
    def queries(self) -> DataFrame:
        """The concepts of one question."""
        w = F.lit(0.8)
        return self.concepts.where("vec_id < 3").select(F.col("name").alias("q_name"), F.col("q_vector").alias("q_vec"), w.alias("q_interest"), w.alias("q_professional"))


#: The same tables for DuckDB.
SQL = {
    "kgs": "SELECT r_regionkey::BIGINT AS kg_id, r_name AS name, r_regionkey % 2 = 0 AS is_public, 'owner-' || (r_regionkey % 3) AS owner_id FROM region",
    "suppliers": "SELECT s_suppkey, n_regionkey::BIGINT AS kg_id FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "facts_raw": """SELECT kg_id, 'supplier-' || l_suppkey AS subject, '組織' AS subject_type, CASE l_returnflag WHEN 'A' THEN 'USES' WHEN 'N' THEN 'PRODUCES' ELSE 'REQUIRES' END AS rel_type,
      'verb-' || lower(l_linestatus) AS verb, 'part-' || l_partkey AS object, '工具' AS object_type, l_orderkey % 200 AS source_doc_id, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq,
      (l_orderkey % 200) || '_' || lpad(l_linenumber::VARCHAR, 4, '0') AS chunk_id FROM lineitem JOIN suppliers ON l_suppkey = s_suppkey""",
    "edges": """SELECT kg_id, subject, '組織' AS subject_type, rel_type, lower(rel_type) AS verb, object, '工具' AS object_type, source_doc_id, count(*) AS confidence, min(ts) AS created_at,
      CASE WHEN count(*) > 1 THEN max(ts) END AS updated_at FROM facts_raw GROUP BY kg_id, subject, rel_type, object, source_doc_id""",
    "entities": """SELECT DISTINCT kg_id, subject AS name, subject_type AS type FROM edges UNION SELECT DISTINCT kg_id, object, object_type FROM edges
      UNION ALL SELECT 0::BIGINT, 'customer-' || c_custkey, '人物' FROM customer WHERE c_custkey % 50 = 0""",
    "docs": "SELECT doc_id, source || '-' || doc_id AS title, text AS content, (CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END)::BIGINT AS kg_id FROM documents",
    "kg_documents": "SELECT kg_id, doc_id FROM docs WHERE doc_id % 10 <> 9",
    "concepts": "SELECT 'concept-' || vec_id AS name, embedding::DOUBLE[] AS q_vector, vec_id, label::BIGINT AS label FROM embeddings",
    "links": "SELECT label % 5 AS owner_id, name, q_vector, (vec_id % 10 + 1) / 10.0::DOUBLE AS interest, (vec_id % 7 + 1) / 10.0::DOUBLE AS professional FROM concepts",
    "doc_links": "SELECT vec_id % 200 AS owner_id, name, q_vector, (vec_id % 10 + 1) / 10.0::DOUBLE AS interest, (vec_id % 7 + 1) / 10.0::DOUBLE AS professional FROM concepts",
    "queries": "SELECT name AS q_name, q_vector AS q_vec, 0.8::DOUBLE AS q_interest, 0.8::DOUBLE AS q_professional FROM concepts WHERE vec_id < 3",
    # shared steps
    "undirected": "SELECT kg_id, subject AS node, object AS other FROM edges UNION SELECT kg_id, object, subject FROM edges",
    "cos_pairs": "SELECT l.*, q.*, list_cosine_similarity(q_vector, q_vec) AS cos FROM links l CROSS JOIN queries q",
    "pair_weights": """SELECT *, (q_interest + q_professional + interest + professional) / 4 AS mag,
      greatest(0.0::DOUBLE, 1 - (abs(q_interest - interest) + abs(q_professional - professional)) / 2) AS al FROM cos_pairs WHERE cos >= 0.01""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """body with the tables it names (and theirs) as common table expressions."""
    known = SQL | (extra or {})
    need: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name, sql in known.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(sql)
                need.append(name)

    visit(body)
    recursive = "RECURSIVE " if any("RECURSIVE_STEP" in known[n] for n in need) or "RECURSIVE_STEP" in body else ""
    ctes = ",\n".join(f"{n} AS ({known[n]})" for n in need)
    return (f"WITH {recursive}{ctes}\n{body}" if ctes else body).replace("/*RECURSIVE_STEP*/", "")
