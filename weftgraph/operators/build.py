"""The build of a graph from documents: chunk, extract with checks and retries, merge, with progress that a later run goes on from."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import constants as C
from weftgraph.functions import text as X
from weftgraph.functions.providers import Language, language
from weftgraph.operators import store as M
from weftgraph.operators.tablelog import TableLog, empty
from weftgraph.session import materialise, ship_package, temporary

#: Rounds in which failed chunks are tried again, tries of one extraction, and relation types one run may add.
ROUNDS, TRIES, NEW_TYPES = 3, 2, 3


def verified_lines(provider: Language, text: str, known: tuple[str, ...], tries: int = TRIES) -> tuple[list[str], list[str]]:
    """(triple lines that the provider confirms, relation types among them that are not known).

    An extraction of which nothing is confirmed is made again, up to `tries`
    times; each line is confirmed by the provider and must name something of
    the text.
    """
    kept: list[str] = []
    for _ in range(tries):
        lines = provider.triples(text)
        kept = provider.verify(text, lines)
        if kept or not lines:
            break
    types = [p[2].strip().upper() for p in (line.replace("｜", "|").split("|") for line in kept) if len(p) >= 6]
    return kept, sorted({t for t in types if t and t not in known})


def extract_verified(chunks: DataFrame, keys: tuple[str, ...], known: tuple[str, ...], provider: Callable[[], Language] = language, tries: int = TRIES) -> DataFrame:
    """(keys, raw, new_types, error): `verified_lines` of each chunk's text; a provider that fails gives an error and no lines."""
    ship_package(chunks.sparkSession)
    given = chunks.select(*keys, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    n = len(keys)
    schema = T.StructType([*given.schema.fields[:n], T.StructField("raw", T.StringType()), T.StructField("new_types", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = provider()
        for b in batches:
            raw, types, errors = [], [], []
            for t in b.column(n).to_pylist():
                try:
                    lines, new = verified_lines(model, t, known, tries)
                    raw.append("\n".join(lines))
                    types.append(new)
                    errors.append(None)
                except Exception as e:  # one chunk's failure is a row of its own, tried again in the next round
                    raw.append(None)
                    types.append([])
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(raw, pa.string()), pa.array(types, pa.list_(pa.string())), pa.array(errors, pa.string())], names=schema.names)

    return given.mapInArrow(run, schema)


def triples_of(extracted: DataFrame, keys: tuple[str, ...], rels: tuple[str, ...]) -> DataFrame:
    """Valid, grounded, normalised triples (keys, subject, rel_type, verb, object) of extracted rows (keys, raw, text)."""
    rows = X.parse_lines(extracted.where("raw <> ''"), "raw", (*keys, "text"), rels).where(X.grounded(F.col("subject"), F.col("object"), F.col("text")))
    return rows.withColumns({"subject": X.normalise_name(F.col("subject")), "object": X.normalise_name(F.col("object"))}).where("subject <> '' and object <> ''").drop("text")


EDGES = "kg_id long, subject string, rel_type string, object string, source_doc_id long, verb string, confidence long, created_at timestamp, updated_at timestamp, source_chunk_ids array<string>"
CHUNKS = "kg_id long, doc_id long, chunk_id string, idx int, sentences array<string>, text string"
PROGRESS = "kg_id long, doc_id long, chunk_id string, idx int, processed boolean, attempt int, error string, triples long"
DOCUMENTS = "kg_id long, doc_id long, processed boolean, processed_at timestamp"
TYPES = "kg_id long, name string, type string"


def first_types(rows: DataFrame) -> DataFrame:
    """The first type that an entity was given."""
    return rows.groupBy("kg_id", "name").agg(F.min_by("type", F.when(F.col("type").isNotNull(), F.col("gen"))).alias("type"))


class GraphStore(TableLog):
    """The tables of a graph build under one commit log: edges, entity types, chunks, progress of chunks, marks of documents."""

    def __init__(self, spark: SparkSession, path: str):
        tables = {
            "edges": (EDGES, M.merge_generations), "types": (TYPES, first_types), "chunks": (CHUNKS, M.latest_rows((), ("kg_id", "doc_id"))),
            "progress": (PROGRESS, M.latest_rows(("kg_id", "chunk_id"))), "documents": (DOCUMENTS, M.latest_rows(("kg_id", "doc_id"))),
        }
        super().__init__(spark, path, tables)

    def entities(self) -> DataFrame:
        """(kg_id, name, type) of all ends of edges: an entity without edges has gone."""
        ends = self.read("edges").select("kg_id", F.explode(F.array("subject", "object")).alias("name")).distinct()
        return ends.join(self.read("types"), ["kg_id", "name"], "left")

    def events(self) -> DataFrame:
        """Progress events of all builds from the log: (version, event, kg_id, doc_id, chunk_idx, triples, message), a `done` after each batch."""
        chunks = self.rows("progress").select(F.col("gen").alias("version"), F.when(F.col("processed"), "chunk_done").otherwise("error").alias("event"), "kg_id", "doc_id", F.col("idx").alias("chunk_idx"), "triples", F.col("error").alias("message"))
        done = self.history().where("writer like 'build%'").select("version", F.lit("done").alias("event"), F.lit(None).cast("long").alias("kg_id"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("chunk_idx"), F.get_json_object("note", "$.triples").cast("long").alias("triples"), F.col("note").alias("message"))
        return chunks.unionByName(done)


def without_known(rows: DataFrame, known: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """rows whose key is not in known; null ids are ids."""
    k = known.select(*[F.col(c).alias(f"__{c}") for c in key])
    return rows.join(k, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], "left_anti")


def build_graph(store: GraphStore, docs: DataFrame, provider: Callable[[], Language] = language, rounds: int = ROUNDS, now: str = "2002-01-01 00:00:00", rels: tuple[str, ...] = C.REL_TYPES, batches: int = 1, force: bool = False) -> DataFrame:
    """Build or go on building the graphs of docs (doc_id, kg_id, text); returns the summary of the run as one row.

    Documents go in `batches` by a hash of their id. A batch writes its edges,
    entity types, chunks, progress and marks, and one commit makes them
    visible together: a run that is cut off anywhere leaves what it had
    committed, and the next run does the rest, so nothing is counted twice.
    Documents that are marked as done in their graph and chunks that have been
    processed are skipped. With `force` the edges, types, progress and marks of
    the graphs in docs are cleared first, in a commit with the first batch.

    Each round extracts the chunks that are left; those that fail are tried
    again in the next, and are recorded with their error after the last.
    Relation types that the provider proposes and that hold their own join the
    ontology of the batch, at most NEW_TYPES of them, and lines of these types
    keep them. Texts without a chunk (null or blank) are done at once.
    """
    spark, total = store.spark, [0] * 5
    added: list[str] = []
    most = 0
    run = f"build-{uuid.uuid4().hex}"
    for batch in range(batches):
        change = store.begin(run, batch)
        state = store.state()
        some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == batch) if batches > 1 else docs
        with temporary(spark):
            if force:
                if batch == 0:
                    cleared = [r["kg_id"] for r in docs.select("kg_id").distinct().collect()]
                    for table in ("edges", "types", "progress", "documents", "chunks"):
                        for kg in cleared:
                            change.clear(table, "kg_id", kg)
                left, known = some, empty(spark, store.schemas["progress"])
            else:
                left, known = without_known(some, store.read("documents", state).where("processed"), ("kg_id", "doc_id")), store.read("progress", state).where("processed")
            left = left.select("doc_id", "kg_id", "text")
            if left.isEmpty():
                if change.cleared:
                    change.commit({"batch": batch})
                continue
            # dealt anew: a file may hold all texts in one piece, and so would be cut in one task
            cut = X.chunks(left.repartition("kg_id", "doc_id").select(F.struct("kg_id", "doc_id").alias("key"), "doc_id", "text"), "key", "text").select("key.kg_id", "key.doc_id", F.format_string("%s_%04d", F.col("key.doc_id"), F.col("idx")).alias("chunk_id"), "idx", "sentences", "text")
            chunks = change.write("chunks", cut)
            keys = ("kg_id", "doc_id", "chunk_id", "idx", "text")
            todo = without_known(chunks, known, ("kg_id", "chunk_id")).select(*keys)
            done, attempts = None, []
            for attempt in range(1, rounds + 1):
                # a text is read again where it has lines, or is tried again
                got = extract_verified(todo, keys, rels, provider).withColumn("text", F.when(F.col("error").isNotNull() | (F.col("raw") != ""), F.col("text")))
                got = materialise(got, "build-extracted")
                attempts.append(got.select(*keys[:4], F.col("error").isNull().alias("processed"), F.lit(attempt).alias("attempt"), "error"))
                good = got.where("error is null")
                done = good if done is None else done.unionByName(good)
                todo = got.where("error is not null").select(*keys)
                if todo.isEmpty():
                    break
            proposed = done.select(F.explode("new_types").alias("t")).groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(NEW_TYPES)
            new = [r["t"] for r in proposed.collect()]
            triples = materialise(triples_of(done, keys[:4], (*rels, *new)), "build-triples")
            rows = triples.select("kg_id", "subject", "rel_type", "object", F.col("doc_id").alias("source_doc_id"), "verb", "chunk_id", F.col("idx").cast("long").alias("seq"), F.lit(now).cast("timestamp").alias("ts"))
            edges = change.write("edges", M.merge_triples(rows))
            ends = triples.select("kg_id", "doc_id", "idx", F.explode(F.array(F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("type")), F.struct(F.col("object").alias("name"), F.col("object_type").alias("type")))).alias("e"))
            change.write("types", ends.groupBy("kg_id", "e.name").agg(F.min_by("e.type", F.struct("doc_id", "idx", "e.type")).alias("type")))
            per_chunk = triples.groupBy("kg_id", "chunk_id").agg(F.count("*").alias("triples"))
            # a chunk is in the list of each round that tried it
            tried = reduce(DataFrame.unionByName, attempts).groupBy(*keys[:4]).agg(F.max_by("processed", "attempt").alias("processed"), F.max("attempt").alias("attempt"), F.max_by(F.struct("error"), "attempt")["error"].alias("error"))
            progress = change.write("progress", tried.join(per_chunk, [tried[c].eqNullSafe(per_chunk[c]) for c in ("kg_id", "chunk_id")], "left").select(*[tried[c] for c in tried.columns], F.coalesce("triples", F.lit(0)).alias("triples")))
            failed = progress.where("not processed").select("kg_id", "doc_id").distinct()
            change.write("documents", without_known(left.select("kg_id", "doc_id").distinct(), failed, ("kg_id", "doc_id")).select("kg_id", "doc_id", F.lit(True).alias("processed"), F.lit(now).alias("processed_at")))
            n = progress.agg(F.count_if("processed").alias("done"), F.count_if(~F.col("processed")).alias("failed"), F.coalesce(F.sum("triples"), F.lit(0)).alias("triples")).first()
            counts = [chunks.count(), n["done"], n["failed"], edges.count(), n["triples"]]
            change.commit({"batch": batch, "chunks": counts[0], "done": counts[1], "failed": counts[2], "new_edges": counts[3], "triples": counts[4], "rounds": len(attempts), "new_types": new})
        total, most, added = [a + b for a, b in zip(total, counts, strict=True)], max(most, len(attempts)), [*added, *(t for t in new if t not in added)]
        for table in store.schemas:
            store.compact(table)
    row = (*total, store.read("edges").count(), most, added)
    return spark.createDataFrame([row], "chunks long, done long, failed long, new_edges long, triples long, edges long, rounds int, new_types array<string>")
