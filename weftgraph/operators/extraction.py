"""Extraction in two passes: what a judge refuses is tried again, then extracted once more with types that the refused chunks asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from weftgraph.functions import constants as C
from weftgraph.functions.providers import Language, language
from weftgraph.operators.joins import spread_join
from weftgraph.session import materialise, ship_package

#: Further tries of a refused extraction; types of one kind that a chunk may propose, and that a round may add to a graph.
RETRIES, PROPOSED = 1, 3
RELS, ENTITIES = "rel_types", "entity_types"
#: Marks the types that all graphs get.
GLOBAL = "global"


def proposal_of(answer: dict, rels: tuple[str, ...], entities: tuple[str, ...], most: int = PROPOSED) -> tuple[list[str], list[str], str]:
    """(relation types, entity types, scope) of a provider's proposal: without blanks, repeats and what is known, `most` of a kind; a scope that is no scope is the graph's own."""

    def new(kind: str, known: tuple[str, ...], form: Callable[[str], str]) -> list[str]:
        names = [form(str(n).strip()) for n in answer.get(kind) or []]
        return [n for n in dict.fromkeys(names) if n and n not in known][:most]

    return new(RELS, rels, str.upper), new(ENTITIES, entities, str), GLOBAL if answer.get("scope") == GLOBAL else "kg"


def judged_lines(provider: Language, text: str, rels: tuple[str, ...], entities: tuple[str, ...], retries: int = RETRIES) -> tuple[list[str], bool, int, tuple[list[str], list[str], str]]:
    """(lines, accepted, tries, proposal) of one text.

    An extraction is accepted if the provider confirms every line; nothing to
    confirm is accepted as it is. A refused one is made again up to `retries`
    times. If the last is refused too, the provider proposes types; one that
    fails at that, or gives no object, proposes none.
    """
    tries = 0
    while True:
        tries += 1
        lines = provider.triples(text)
        confirmed = set(provider.verify(text, lines)) if lines else set()
        refused = [line for line in lines if line not in confirmed]
        if not refused or tries > retries:
            break
    if not refused:
        return lines, True, tries, ([], [], "kg")
    try:
        answer = provider.propose(text, lines, refused)
        proposal = proposal_of(answer, rels, entities)
    except Exception:  # proposing is a bonus: the last extraction stands
        proposal = ([], [], "kg")
    return lines, False, tries, proposal


def _python(chunks: DataFrame, extra: list[str], fields: list[T.StructField], work: Callable[[], Callable]) -> DataFrame:
    """The columns of chunks but those in `extra`, and the fields that work()'s function gives for the values of `extra` (None after an error)."""
    ship_package(chunks.sparkSession)
    keep = [c for c in chunks.columns if c not in extra]
    given = chunks.select(*keep, *extra)
    n = len(keep)
    schema = T.StructType([*given.schema.fields[:n], *fields, T.StructField("error", T.StringType())])
    names = schema.names
    count = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = work()
        kinds = None
        for b in batches:
            kinds = kinds or [{"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[f.dataType.simpleString()] for f in fields]
            rows = []
            for values in zip(*[b.column(n + i).to_pylist() for i in range(len(extra))], strict=True):
                try:
                    rows.append((*compute(*values), None))
                except Exception as e:  # one chunk's failure is a row of its own
                    rows.append((*[None] * count, f"{type(e).__name__}: {e}"[:200]))
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate([*kinds, pa.string()])]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], names=names)

    return given.mapInArrow(run, schema)


def first_pass(chunks: DataFrame, provider: Callable[[], Language] = language, rels: tuple[str, ...] = C.REL_TYPES, entities: tuple[str, ...] = tuple(C.TYPE_LABELS), retries: int = RETRIES) -> DataFrame:
    """The columns of chunks (kg_id, text, ...) with raw, accepted, tries, rel_types, entity_types, scope, error; null texts are empty."""

    def work():
        model = provider()

        def one(text):
            lines, accepted, tries, (new_rels, new_entities, scope) = judged_lines(model, text or "", rels, entities, retries)
            return "\n".join(lines), accepted, tries, new_rels, new_entities, scope

        return one

    strings = T.ArrayType(T.StringType())
    fields = [T.StructField("raw", T.StringType()), T.StructField("accepted", T.BooleanType()), T.StructField("tries", T.IntegerType()), T.StructField(RELS, strings), T.StructField(ENTITIES, strings), T.StructField("scope", T.StringType())]
    return _python(chunks.withColumn("__text", F.col("text")), ["__text"], fields, work)


def extension(passed: DataFrame, most: int = PROPOSED) -> DataFrame:
    """(kg_id, kind, name, chunks): the types that join the ontology, `most` of a kind for each graph and for all graphs (kg_id null).

    Those that the most refused chunks ask for, ties by name. Counts combine
    on the map side, so what is ranked are the distinct names of a graph.
    """
    asked = passed.where("not accepted")
    kinds = [asked.select(F.when(F.col("scope") != GLOBAL, F.col("kg_id")).alias("kg_id"), (F.col("scope") == GLOBAL).alias("all"), F.lit(k).alias("kind"), F.explode(k).alias("name")) for k in (RELS, ENTITIES)]
    count = kinds[0].unionByName(kinds[1]).groupBy("all", "kg_id", "kind", "name").agg(F.count("*").alias("chunks"))
    rank = F.row_number().over(W.partitionBy("all", "kg_id", "kind").orderBy(F.desc("chunks"), "name"))
    return count.withColumn("rn", rank).where(F.col("rn") <= most).select("kg_id", "all", "kind", "name", "chunks")


def extract_extended(chunks: DataFrame, provider: Callable[[], Language] = language, rels: tuple[str, ...] = C.REL_TYPES, entities: tuple[str, ...] = tuple(C.TYPE_LABELS), retries: int = RETRIES, most: int = PROPOSED) -> tuple[DataFrame, DataFrame]:
    """(chunks with raw, accepted, tries, extended, known, error; the extension): the whole course over chunks (kg_id, text, ...).

    Refused chunks of graphs that got new types are extracted once more with
    them; that result stands without a further judgement, so the course is
    bounded. If it fails or there are no new types, the last extraction
    stands. `known` are the relation types beyond the fixed ones that the
    chunk's graph has. An extraction that fails in the first pass has its
    error and no lines. The types of all graphs are `most` rows of a kind; a
    graph's own are joined by a spread join, so one graph may hold all chunks.
    """
    first = materialise(first_pass(chunks, provider, rels, entities, retries), "extract-first")
    added = materialise(extension(first, most), "extract-types")
    common = {kind: [r["name"] for r in added.where(F.col("all") & (F.col("kind") == kind)).orderBy("name").collect()] for kind in (RELS, ENTITIES)}  # `most` names
    wait = first.where("not accepted")
    sizes = wait.groupBy("kg_id").agg(F.count("*").alias("n"))
    own = added.where(~F.col("all")).groupBy("kg_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("name")))).alias(f"__{k}") for k in (RELS, ENTITIES)])
    # null graphs are a graph
    key = F.coalesce(F.col("kg_id").cast("string"), F.lit("null"))
    table = sizes.join(own, sizes["kg_id"].eqNullSafe(own["kg_id"]), "left").select(F.coalesce(sizes["kg_id"].cast("string"), F.lit("null")).alias("__kg"), "n", *[F.array_distinct(F.concat(F.coalesce(F.col(f"__{k}"), F.array().cast("array<string>")), F.array(*map(F.lit, common[k])).cast("array<string>"))).alias(f"__{k}") for k in (RELS, ENTITIES)])
    joined = spread_join(wait.withColumn("__kg", key), materialise(table, "extract-ontology"), ["__kg"], "n").drop("__kg")

    def work():
        model = provider()

        def one(text, raw, own_rels, own_entities):
            if not own_rels and not own_entities:
                return raw, False
            try:
                return "\n".join(model.triples(text or "", tuple(own_rels), tuple(own_entities))), True
            except Exception:  # the first pass's lines stand
                return raw, False

        return one

    keep = [*chunks.columns, "tries"]
    again = joined.select(*keep, F.col(f"__{RELS}").alias("known"), F.col("text").alias("__text"), F.col("raw").alias("__raw"), F.col(f"__{RELS}").alias("__r"), F.col(f"__{ENTITIES}").alias("__e"))
    second = _python(again, ["__text", "__raw", "__r", "__e"], [T.StructField("raw", T.StringType()), T.StructField("extended", T.BooleanType())], work)
    out = [*chunks.columns, "raw", "accepted", "tries", "extended", "known", "error"]
    done = first.where("accepted is null or accepted").withColumns({"extended": F.lit(False), "known": F.array().cast("array<string>")}).select(*out)
    return done.unionByName(second.withColumn("accepted", F.lit(False)).select(*out)), added
