"""Routes from questions and documents to graphs, with their fallbacks, and what may be seen."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.functions import constants as C
from weftgraph.functions.vectors import norm
from weftgraph.operators.joins import spread_join
from weftgraph.operators.scoring import first_pairs, match_scores, two_stage
from weftgraph.session import materialise, ship_package

#: Vectors of names are broadcast to the links of up to this many links; beyond it they are joined by a shuffle.
BROADCAST_CONCEPTS = 20_000
#: Links of a block, blocks of a side of some thousand links (so that there are tasks for them), rows of one matrix product's strip, and sums that a task holds as one array.
BLOCK, LEAST_BLOCKS, STRIP, DENSE = 32_768, 4, 128, 4_000_000


def route(queries: DataFrame, concepts: DataFrame, links: DataFrame, least: float = C.ROUTE_MIN, top: int | None = C.ROUTE_TOP) -> DataFrame:
    """`two_stage`, or the scan over all links where the nearest concepts lead to no owner. Returns owner_id, score."""
    near = two_stage(queries, concepts, links, least=least, top=None)
    found = F.broadcast(near.agg((F.count("*") == 0).alias("none")))
    full = match_scores(queries, links).where(F.col("score") >= least).join(found, F.lit(True)).where("none").drop("none")
    out = near.unionByName(full).orderBy(F.desc("score"), "owner_id")
    return out if top is None else out.limit(top)


def _packed(links: DataFrame, side: str) -> DataFrame:
    """(width, side, n, owners, weights, at, v): links in blocks of at most about BLOCK, with the unit vectors of a block's names once.

    Links that can be in no pair (a null owner, name, weight or component, a
    vector without length or with a non-finite number) are left out. A
    name's links stand in one block unless they are very many.
    """
    vec = F.col("q_vector").cast("array<double>")
    use = links.select("owner_id", "name", vec.alias("v"), F.col("interest").cast("double").alias("i"), F.col("professional").cast("double").alias("p")).dropna()
    use = use.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm(F.col("v")) >= 1e-9))
    use = materialise(use, "route-links")
    total = use.count()
    blocks = max(-(-total // BLOCK), min(LEAST_BLOCKS, -(-total // 4096)), 1)
    # a name has one vector, whichever of its rows are read first
    names = materialise(use.groupBy("name").agg(F.min("v").alias("v"), F.count("*").alias("n")), "route-names")
    table = names.withColumn("links", F.col("n"))
    placed = use.drop("v").join(F.broadcast(table.drop("n")), "name") if total <= BROADCAST_CONCEPTS else spread_join(use.drop("v"), table, ["name"], "n", total)
    part = F.pmod(F.xxhash64("owner_id", "i", "p"), F.ceil(F.col("links") / 1000))
    placed = placed.withColumn("width", F.size("v")).withColumn("side", F.pmod(F.xxhash64("name", part), F.lit(blocks)).cast("int"))
    kind = links.schema["owner_id"].dataType.simpleString()

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("owner_id", "ascending"), ("i", "ascending"), ("p", "ascending"), ("name", "ascending")])
        names = t.column("name").combine_chunks().dictionary_encode()
        at = names.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        _, first = np.unique(at, return_index=True)
        v = np.asarray(t.column("v").take(pa.array(first)).combine_chunks().flatten()).reshape(len(first), -1)
        weights = np.stack([t.column(c).to_numpy() for c in ("i", "p")])
        owners = pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column("owner_id").combine_chunks())
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (weights, at, v / np.sqrt((v * v).sum(1))[:, None])]
        return pa.Table.from_arrays([t.column("width")[:1], t.column("side")[:1], owners, *blobs], names=["width", "side", "owners", "weights", "at", "v"])

    rows = placed.select("width", "side", "owner_id", "name", "i", "p", "v").groupBy("width", "side")
    return materialise(rows.applyInArrow(pack, f"width int, side int, owners array<{kind}>, weights binary, at binary, v binary"), f"route-{side}")


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Places at which a run of equal rows begins."""
    return np.nonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))[0]


def _block_scores(d: tuple, g: tuple, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, graph, part, mag) sums of two blocks of links (owner, weights, at, v), owners as sorted numbers.

    Links of one graph and weight are a class: cosines from `floor` on are
    summed and counted by class first, so weights are applied once per class.
    """
    (d_own, d_w, d_at, d_v), (g_own, g_w, g_at, g_v) = d, g
    start = _runs(g_own, *g_w)
    kg_start, gi, gp = _runs(g_own[start]), g_w[0][start], g_w[1][start]
    once = len(g_at) == len(g_v)
    turn = np.ascontiguousarray(g_v[g_at].T if once else g_v.T)
    order = np.argsort(d_at, kind="stable")
    ends = np.searchsorted(d_at[order], np.arange(0, len(d_v) + STRIP, STRIP))
    for k, at in enumerate(range(0, len(d_v), STRIP)):
        cos = d_v[at : at + STRIP] @ turn
        if not once:
            cos = cos[:, g_at]
        near = cos >= floor
        cos *= near
        total = np.add.reduceat(cos, start, axis=1)
        count = np.add.reduceat(near, start, axis=1, dtype=np.int32)
        mine = order[ends[k] : ends[k + 1]]
        for i in range(0, len(mine), STRIP):
            rows = mine[i : i + STRIP]
            di, dp, local = d_w[0][rows, None], d_w[1][rows, None], d_at[rows] - at
            mag = (di + dp + gi + gp) / 4
            fit = np.maximum(0.0, 1 - (np.abs(di - gi) + np.abs(dp - gp)) / 2)
            part = np.add.reduceat(total[local] * fit * mag, kg_start, axis=1)
            mags = np.add.reduceat(count[local] * mag, kg_start, axis=1)
            pairs = np.add.reduceat(count[local], kg_start, axis=1)
            x, y = np.nonzero(pairs)
            yield d_own[rows][x], g_own[start][kg_start][y], part[x, y], mags[x, y]


def concept_scores(docs: DataFrame, graphs: DataFrame) -> DataFrame:
    """(doc_id, kg_id, score) of every document and graph with a pair of concepts of enough cosine.

    docs, graphs: (owner_id, name, q_vector, interest, professional). All
    pairs of concepts are looked at, as the floor of the cosine asks, but none
    is listed: both sides are packed into blocks, a task multiplies two blocks
    strip by strip and hands on one row per document and graph of them. A
    task's memory is two blocks; work grows with the product of both sides.
    """
    ship_package(docs.sparkSession)
    left, right = _packed(docs, "documents"), _packed(graphs, "graphs")
    kinds = [x.schema["owner_id"].dataType.simpleString() for x in (docs, graphs)]
    plan = materialise(left.select("width", F.col("side").alias("a")).join(right.select("width", F.col("side").alias("b")), "width"), "route-plan")
    columns = ["owners", "weights", "at", "v"]
    fill = lambda kind: F.lit(None).cast(f"array<{kind}>")
    one = plan.join(left.withColumnRenamed("side", "a"), ["width", "a"]).select("width", "a", "b", F.lit(0).alias("role"), F.col("owners").alias("docs"), fill(kinds[1]).alias("kgs"), *columns[1:])
    two = plan.join(right.withColumnRenamed("side", "b"), ["width", "b"]).select("width", "a", "b", F.lit(1).alias("role"), fill(kinds[0]).alias("docs"), F.col("owners").alias("kgs"), *columns[1:])
    floor = C.COS_FLOOR

    def compare(t: pa.Table) -> pa.Table:
        roles = t.column("role").to_pylist()

        def side(role: int, column: str):
            i = roles.index(role)
            named = t.column(column)[i].values.dictionary_encode()
            at = np.frombuffer(t.column("at")[i].as_py(), np.int32)
            v = np.frombuffer(t.column("v")[i].as_py()).reshape(-1, t.column("width")[i].as_py())
            return named.dictionary, (named.indices.to_numpy(zero_copy_only=False), np.frombuffer(t.column("weights")[i].as_py()).reshape(2, -1), at, v)

        (d_names, d), (g_names, g) = side(0, "docs"), side(1, "kgs")
        part, mag, seen = (np.zeros(len(d_names) * len(g_names)) for _ in range(3)) if len(d_names) * len(g_names) <= DENSE else (None, None, None)
        found = []
        for own, kg, p, m in _block_scores(d, g, floor):
            key = own.astype(np.int64) * len(g_names) + kg
            if part is None:
                found.append((key, p, m))
                continue
            np.add.at(part, key, p)
            np.add.at(mag, key, m)
            seen[key] = 1
        if part is not None:
            key = np.nonzero(seen)[0]
            p, m = part[key], mag[key]
        else:
            key, p, m = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"doc_id": d_names.take(pa.array(key // len(g_names))), "kg_id": g_names.take(pa.array(key % len(g_names))), "part": pa.array(p), "mag": pa.array(m)})

    tasks = min(4 * max(plan.count(), 1), 4096)
    met = one.unionByName(two).repartition(tasks, "width", "a", "b").groupBy("width", "a", "b")
    rows = met.applyInArrow(compare, f"doc_id {kinds[0]}, kg_id {kinds[1]}, part double, mag double")
    total = rows.groupBy("doc_id", "kg_id").agg(F.sum("part").alias("part"), F.sum("mag").alias("mag"))
    return total.select("doc_id", "kg_id", F.when(F.col("mag") < 1e-9, F.lit(0.0)).otherwise(F.round(F.col("part") / F.col("mag"), 4)).alias("score"))


def classify_documents(documents: DataFrame, docs: DataFrame, graphs: DataFrame, auto: float = C.CLASSIFY_AUTO, least: float = C.CLASSIFY_MIN) -> DataFrame:
    """(doc_id, kg_id, score, status) of every row of documents (doc_id): its best graph, ties to the smaller id.

    assigned from `auto`, pending from `least`; else unmatched, without graph.
    Documents without concepts are unmatched with score 0.
    """
    scored = concept_scores(docs, graphs).where(F.col("score") >= least)
    best = scored.groupBy("doc_id").agg(F.max(F.struct("score", F.negative("kg_id").alias("k"))).alias("b"))
    best = best.select("doc_id", F.negative("b.k").alias("kg_id"), F.col("b.score").alias("score"))
    out = documents.select("doc_id").join(best, "doc_id", "left")
    status = F.when(F.col("score") >= auto, "assigned").when(F.col("score").isNotNull(), "pending").otherwise("unmatched")
    return out.withColumn("status", status).withColumn("score", F.coalesce("score", F.lit(0.0)))


def assign(kg_documents: DataFrame, classified: DataFrame, accept: DataFrame | None = None) -> DataFrame:
    """kg_documents (kg_id, doc_id) with the links of assigned documents, and of the pending ones whose id is in accept."""
    take = classified.where("status = 'assigned'")
    if accept is not None:
        take = take.unionByName(classified.where("status = 'pending'").join(accept.select("doc_id"), "doc_id", "left_semi"))
    return kg_documents.select("kg_id", "doc_id").unionByName(take.select("kg_id", "doc_id")).distinct()


def refresh_concepts(kgs: DataFrame, kg_documents: DataFrame, doc_concepts: DataFrame, entities: DataFrame, edges: DataFrame, extra: DataFrame | None = None, top: int = 50, types: tuple[str, ...] = C.ROUTING_TYPES) -> DataFrame:
    """(kg_id, name) of the concepts a graph is routed by.

    Those of its documents; a graph whose documents have none takes the `top`
    entities of the routing types by outgoing edges; `extra` (kg_id, name),
    from a text, joins either.
    """
    own = kg_documents.select("kg_id", "doc_id").join(doc_concepts.select(F.col("owner_id").alias("doc_id"), "name"), "doc_id").select("kg_id", "name").distinct()
    bare = kgs.select("kg_id").join(own, "kg_id", "left_anti")
    degree = edges.groupBy("kg_id", F.col("subject").alias("name")).agg(F.count("*").alias("degree"))
    rows = entities.where(F.col("type").isin(*types)).select("kg_id", "name").join(bare, "kg_id", "left_semi").join(degree, ["kg_id", "name"], "left")
    rank = F.row_number().over(W.partitionBy("kg_id").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "name"))
    out = own.unionByName(rows.withColumn("rn", rank).where(F.col("rn") <= top).select("kg_id", "name"))
    return (out if extra is None else out.unionByName(extra.select("kg_id", "name"))).distinct()


def contrastive_pairs(doc_concepts: DataFrame, kg_concepts: DataFrame, enough: int = 20, most: int = 500) -> DataFrame:
    """(a, b): concept pairs of one document in order, at most `most`; pairs of one graph fill up where there are under `enough`."""
    own = materialise(first_pairs(doc_concepts, most), "contrastive-own")
    n = F.broadcast(own.agg(F.count("*").alias("n")))
    more = first_pairs(kg_concepts, 2 * most).join(own, ["a", "b"], "left_anti").orderBy("a", "b").limit(most).join(n, F.lit(True)).where(F.col("n") < enough)
    rank = F.row_number().over(W.partitionBy("n").orderBy("a", "b"))
    return own.unionByName(more.withColumn("rn", rank).where(F.col("rn") <= F.lit(most) - F.col("n")).select("a", "b"))


def visible(kgs: DataFrame, owner: str | None = None, include_private: bool = False) -> DataFrame:
    """Graphs that may be listed: an owner's own and, unless private ones are asked for, the public ones; without owner the public ones or all."""
    if owner:
        return kgs.where((F.col("owner_id") == owner) | (F.col("is_public") & F.lit(not include_private)))
    return kgs.where(F.col("is_public") | F.lit(include_private))


def restricted(rows: DataFrame, key: str, allowed: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """rows whose key is in `allowed` and not in `excluded`, tables with the same column; an absent or empty table restricts nothing."""
    if allowed is not None and not allowed.isEmpty():
        rows = rows.join(allowed.select(key).distinct(), key, "left_semi")
    return rows if excluded is None else rows.join(excluded.select(key).distinct(), key, "left_anti")


def passing(score: Column, kind: str) -> Column:
    """Whether a score reaches the threshold of its use: route, similar, search, world (above 0), classify, auto."""
    return score > 0 if kind == "world" else score >= C.THRESHOLDS[kind]
