"""Near copies by the exact Jaccard of their shingle sets: a prefix-filtered self-join that loses no pair, and components."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import few, hash_sample, materialise, per_text, row_hash, python_ready
from weftgraph.operators.components import connected_components
from weftgraph.operators.joins import HOT_ROWS, spread_join

#: Words of a shingle, and the Jaccard from which two texts are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which the fingerprints of pairs that are checked first differ at most.
FINGERPRINT_BITS = 3
#: Texts sampled for the order of shingles, and the frequent shingles it lists. They decide the cost, never the result.
ORDER_ROWS, ORDER_SHINGLES = 10_000, 100_000
#: A shingle of more texts is first linked sparsely, then only across the components found.
GROUP_LIMIT = 64
#: Partners of a node that a round across components checks at first.
FIRST_PARTNERS = 8
#: Prefix rows a join task holds at once, beyond whole groups.
CHUNK = 400_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: ASCII lower case, words between ASCII blanks.

    A text of fewer words is one shingle, a text without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x) for x in words], np.uint64)
    k = min(shingle, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def prefix(have: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The set's first elements in the order of (frequency in the sample, hash): similar sets share one of them."""
    size = len(have) - math.ceil(similarity * len(have) - 1e-9) + 1 if len(have) else 0
    if len(common) and size:
        at = np.minimum(np.searchsorted(common, have), len(common) - 1)
        have = have[np.argsort(np.where(common[at] == have, counts[at], 0), kind="stable")]
    return have[:size]


def parity(have: np.ndarray) -> bytes:
    """One bit for each part of the hashes, four to eight parts an element and a power of two: whether the part's number is odd.

    Each element that only one of two sets has changes one bit, so the bits in
    which two sets differ are at most the elements that they don't share, and
    with so many parts hardly fewer.
    """
    if not len(have):
        return b""
    bits = 4 << int(len(have) - 1).bit_length() if len(have) > 16 else 64
    odd = np.bincount((have >> np.uint64(17)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two parities differ, the longer one folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat.view(np.int64)))


def _sets(df: DataFrame, keep: list[str], shingle: int) -> DataFrame:
    """Columns `keep` of df, node (hash of the set), n (its size), x (the whole set)."""

    def work():
        def hashed(texts):
            sets = [shingle_set(t, shingle) for t in texts]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            return [pa.array(node.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), _lists(sets)]

        return hashed

    return per_text(df, F.col("text"), keep, [("node", "long"), ("n", "int"), ("x", "array<long>")], work)


def _prints(df: DataFrame, keep: list[str], shingle: int, common, similarity: float, fingerprint: Callable[[str | None, int], int]) -> DataFrame:
    """Columns `keep` of df, node, n, odd (parity of the set), fp (the text's fingerprint), x (the set's prefix)."""

    def work():
        def hashed(texts):
            sets = [shingle_set(t, shingle) for t in texts]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            return [pa.array(node.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), pa.array([parity(s) for s in sets], pa.binary()), pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)), _lists([prefix(s, *common.value, similarity) for s in sets])]

        return hashed

    return per_text(df, F.col("text"), keep, [("node", "long"), ("n", "int"), ("odd", "binary"), ("fp", "long"), ("x", "array<long>")], work)


def shingle_order(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the frequent shingles in a bounded sample of texts."""
    sample = hash_sample(docs, F.xxhash64("text"), docs.count(), ORDER_ROWS, 17)
    counted = _sets(sample, [], shingle).select(F.explode("x").alias("x")).groupBy("x").agg(F.count("*").alias("k")).where("k > 1")
    top = counted.orderBy(F.desc("k"), "x").limit(ORDER_SHINGLES).toPandas()
    x, k = top["x"].to_numpy(np.int64).view(np.uint64), top["k"].to_numpy(np.int64)
    order = np.argsort(x)
    return x[order], k[order]


def may_be_similar(n, pos, m, at, similarity: float):
    """False only if sets of n and m elements whose first common element is at `pos` and `at` can't be similar."""
    need = np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (np.minimum(n - pos, m - at) >= need)


def _in_groups(rows: DataFrame, pairs, schema: str) -> DataFrame:
    """`pairs` on whole groups of equal x, as int64 columns sorted by x, n, node; each node once in a group."""
    python_ready(rows.sparkSession)

    def join(batches):
        held: list[np.ndarray] = []

        def done(r: np.ndarray):
            r = r[np.lexsort((r[:, 1], r[:, 2], r[:, 0]))]
            return pairs(r[np.concatenate(([True], np.any(r[1:, :2] != r[:-1, :2], axis=1)))])

        count = 0
        for b in batches:
            got = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], 1)
            if len(got) and count + len(got) >= CHUNK:
                others = np.nonzero(got[:, 0] != got[-1, 0])[0]
                cut = int(others[-1]) + 1 if len(others) else 0  # the last group may go on
                if cut or (held and held[-1][-1, 0] != got[0, 0]):
                    yield from done(np.concatenate([*held, got[:cut]]))
                    held, count, got = [], 0, got[cut:]
            held.append(got)
            count += len(got)
        if count:
            yield from done(np.concatenate(held))

    return rows.repartition("x").sortWithinPartitions("x").mapInArrow(join, schema)


def _batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"u": np.minimum(u, v), "v": np.maximum(u, v)})


def candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """(u, v): all pairs of nodes (x, node, n, pos) that may be similar, by shared x.

    Groups beyond GROUP_LIMIT give pairs at distances 1, 8, 64, ... only and
    their x, with v null.
    """

    def pairs(r: np.ndarray):
        x, node, n, pos = r.T
        starts = np.nonzero(np.concatenate(([True], x[1:] != x[:-1])))[0]
        sizes = np.diff(np.append(starts, len(x)))
        big = np.repeat(sizes > GROUP_LIMIT, sizes)
        for i, step in ((np.nonzero(~big)[0], lambda d: d + 1), (np.nonzero(big)[0], lambda d: d * 8)):
            d = 1
            while len(i):
                i = i[i + d < len(x)]
                i = i[x[i] == x[i + d]]
                ok = i[may_be_similar(n[i], pos[i], n[i + d], pos[i + d], similarity)]
                if len(ok):
                    yield _batch(node[ok], node[ok + d])
                d = step(d)
        much = x[starts[sizes > GROUP_LIMIT]]
        if len(much):
            yield pa.RecordBatch.from_pydict({"u": much, "v": pa.nulls(len(much), pa.int64())})

    return _in_groups(rows.select("x", "node", "n", "pos"), pairs, "u long, v long")


def crossings(rows: DataFrame, similarity: float, most: int) -> DataFrame:
    """(u, v): pairs of nodes (x, node, n, pos, odd, part) of different parts that size, position and parity allow, by shared x.

    Of each node's partners the `most` whose parities are closest are given;
    where there are more, its x follows with v null. The largest part has no
    pair within itself.
    """

    def pairs(group: pa.Table) -> pa.Table:
        node, n, pos, part = (group.column(c).to_numpy() for c in ("node", "n", "pos", "part"))
        _, first = np.unique(node, return_index=True)
        node, n, pos, part = node[first], n[first], pos[first], part[first]
        odd = [group.column("odd")[int(i)].as_py() for i in first]
        size = np.array([len(o) for o in odd])
        packed = {k: (np.nonzero(size == k)[0], np.frombuffer(b"".join(o for o in odd if len(o) == k), np.uint8).reshape(-1, k)) for k in set(size.tolist()) if k}
        names, counts = np.unique(part, return_counts=True)
        major, u, v, more = names[counts.argmax()], [], [], False
        for i in np.nonzero(part != major)[0].tolist():
            ok = may_be_similar(n[i], pos[i], n, pos, similarity) & (part != part[i]) & ((part == major) | (node > node[i]))
            at, apart = [], []
            for k, (where, bits) in packed.items():  # similar sizes have parities of one length, or of double or half the length
                use = ok[where]
                if not use.any():
                    continue
                mine, other = np.frombuffer(odd[i], np.uint8), bits[use]
                if len(mine) > k:
                    mine = np.bitwise_xor.reduce(mine.reshape(-1, k), axis=0)
                elif len(mine) < k:
                    other = np.bitwise_xor.reduce(other.reshape(len(other), -1, len(mine)), axis=1)
                at.append(where[use])
                apart.append(np.bitwise_count(other ^ mine).sum(1))
            if not at:
                continue
            at, apart = np.concatenate(at), np.concatenate(apart)
            near = apart <= (n[i] + n[at]) * (1 - similarity) / (1 + similarity) + 1e-9
            at = at[near][np.argsort(apart[near], kind="stable")]
            more |= len(at) > most
            u.append(np.full(min(len(at), most), node[i]))
            v.append(node[at[:most]])
        a, b = np.concatenate([*u, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64)
        out = pa.table({"u": np.minimum(a, b), "v": np.maximum(a, b)})
        return pa.concat_tables([out, pa.table({"u": group.column("x").to_numpy()[:1], "v": pa.nulls(1, pa.int64())})]) if more else out

    python_ready(rows.sparkSession)
    return rows.select("x", "node", "n", "pos", "odd", "part").groupBy("x").applyInArrow(pairs, "u long, v long")


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that the parities of their sets don't rule out: no similar pair is."""
    pairs = materialise(pairs.distinct(), "similar-pairs")
    small = nodes.select("node", "n", "odd")
    a, b = (small.toDF(c, f"n_{c}", f"odd_{c}") for c in "uv")
    both = pairs.join(a, "u").join(b, "v")

    def check(batches):
        for r in batches:
            n = r.column("n_u").to_numpy() + r.column("n_v").to_numpy()
            apart = np.array([differing(x, y) for x, y in zip(r.column("odd_u").to_pylist(), r.column("odd_v").to_pylist(), strict=True)], np.int64)
            # sets of Jaccard s share s / (1 + s) of all elements at least
            ok = pa.array(apart <= n * (1 - similarity) / (1 + similarity) + 1e-9)
            yield r.select(["u", "v"]).filter(ok)

    return materialise(both.mapInArrow(check, "u long, v long"), "similar-plausible")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose sets have the Jaccard, computed from the texts of the pairs' nodes only."""
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    rows = materialise(nodes.join(wanted, "node").select("row").distinct(), "similar-rows")
    sets = materialise(_sets(docs.join(few(rows), "row", "left_semi"), ["row"], shingle).select("node", "n", "x").dropDuplicates(["node"]), "similar-sets")
    a, b = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("x").alias(f"x_{c}")) for c in "uv")
    both = pairs.join(a, "u").join(b, "v").withColumn("both", F.size(F.array_intersect("x_u", "x_v")))
    return materialise(both.where(F.col("both") >= similarity * (F.col("n_u") + F.col("n_v") - F.col("both")) - 1e-9).select("u", "v"), "similar-links")


def merged(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Components (node, component) of the links and of what the components `labels` join already."""
    if labels is not None:
        links = links.unionByName(labels.where("node <> component").select(F.col("component").alias("u"), F.col("node").alias("v")))
    return materialise(connected_components(links), "similar-parts")


def fingerprint_pairs(nodes: DataFrame, links: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(u, v), u < v: nodes (node, n, fp) of fingerprints within FINGERPRINT_BITS, each fingerprint by its least node, and with that node its others."""
    worded = nodes.where("n > 0").select("node", "fp")
    least = materialise(worded.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("rows")), "similar-fingerprints")
    same = spread_join(worded, least, ["fp"], "rows").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    ends = [least.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}")) for c in "uv"]
    near = links(least.select("fp"), FINGERPRINT_BITS).join(ends[0], "u").join(ends[1], "v")
    return same.unionByName(near.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v"))).distinct()


def link(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float, near: DataFrame) -> DataFrame:
    """Components (node, component) of the pairs that are similar.

    The pairs `near` of like fingerprints and each node's pair with its least
    partner are checked first; what that joins needs no other pair. All pairs that then still cross components are
    checked, so no link between components is lost.
    """
    likely, near = plausible(pairs, nodes, similarity), plausible(near, nodes, similarity)
    first = near.unionByName(likely.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")).distinct()
    found = merged(verified(first, docs, nodes, shingle, similarity), None)
    rest = likely.join(found.toDF("u", "part_u"), "u", "left").join(found.toDF("v", "part_v"), "v", "left")
    rest = materialise(rest.where("coalesce(part_u, u) <> coalesce(part_v, v)").select("u", "v"), "similar-rest")
    return found if rest.isEmpty() else merged(verified(rest, docs, nodes, shingle, similarity), found)


def link_across(rows: DataFrame, labels: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Components after all links between different ones in the groups (x, node, n, pos, odd) of frequent elements.

    Each round checks a bounded number of the closest pairs of each node and
    merges what is similar; the bound grows until a round leaves no pair
    unchecked. So a dense group costs rows in proportion to its size, and
    only pairs that parity can't tell from similar ones cost more rounds.
    """
    most, refused = FIRST_PARTNERS, None
    while True:
        parts = rows.join(labels.toDF("node", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
        found = materialise(crossings(parts, similarity, most), "similar-crossings")
        fresh = found.where("v is not null").distinct()
        fresh = materialise(fresh if refused is None else fresh.join(refused, ["u", "v"], "left_anti"), "similar-fresh")
        if fresh.isEmpty() and found.where("v is null").isEmpty():
            return labels
        links = verified(fresh, docs, nodes, shingle, similarity)
        bad = fresh.join(links, ["u", "v"], "left_anti")
        refused = materialise(bad if refused is None else refused.unionByName(bad), "similar-refused")
        labels, most = merged(links, labels), most * 8


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, fingerprint: Callable[[str | None, int], int] | None = None, links: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Component of every row: components link texts whose shingle sets have the Jaccard `similarity` or more.

    Fingerprints (`fingerprint` of text and shingle, `links` within a number
    of bits) find the near copies first. They miss pairs further apart, so a
    join that loses none follows for what they have not joined, and all links
    are checked exactly.

    In any fixed order of all shingles two similar sets share one of the
    first n - ceil(similarity * n) + 1 elements of each, so texts meet by the
    elements of these prefixes; sizes and positions rule pairs out, then
    parities of the sets (`parity`; none of these loses a pair), and the rest
    are checked exactly. Rare shingles come first in the order, so a passage
    that many texts share rarely is in a prefix. A shingle of many texts is
    linked sparsely first; what that joins needs no more pairs, and those
    across the components are then checked in rounds (`link_across`). No pair
    is lost, and every link is exact.

    Equal sets are one node, which only one of its rows brings to the joins,
    so copies cost nothing there. Texts without words (null, empty, blank) are
    one node; null ids keep their rows but come last in their component; equal
    rows share it. Very long texts are hashed whole; one text's set is in one
    task. Other columns only tell rows apart. An empty table gives no rows.
    Returns id, row (its hash), place (its number), component_id (the least
    id, null if all are null), keep_row and keep_place (the row that comes
    first by id, then row hash, then place).
    """
    if fingerprint is None or links is None:
        from weftgraph.llm.neardup import fingerprint_links, simhash  # it imports this module

        fingerprint, links = fingerprint or simhash, links or fingerprint_links
    docs = df.select(F.col(f"`{id_col}`").alias("id"), row_hash(df).alias("row"), F.col(f"`{text_col}`").alias("text"))
    common = df.sparkSession.sparkContext.broadcast(shingle_order(docs, shingle))
    prints = _prints(docs, ["id", "row"], shingle, common, similarity, fingerprint).withColumn("place", F.monotonically_increasing_id())
    prints = materialise(prints, "similar-prints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "place")).alias("first")
    heads = materialise(prints.groupBy("node").agg(first, F.count("*").alias("rows")), "similar-heads")
    # of nodes with several rows only the first one's prefix takes part
    copied = heads.where("rows > 1").select("node", "rows", F.col("first.place").alias("place"))
    lone = prints.join(F.broadcast(copied.where(F.col("rows") > HOT_ROWS).select("node")), "node", "left_anti")
    lone = lone.join(few(materialise(copied.where(F.col("rows") <= HOT_ROWS).select("node"), "similar-copied")), "node", "left_anti")
    one = lone.unionByName(prints.join(few(materialise(copied.select("node", "place"), "similar-firsts")), ["node", "place"], "left_semi").select(*lone.columns))
    nodes = materialise(one.select("node", "n", "row", "odd", "fp"), "similar-nodes")
    rows = one.select("node", "n", F.posexplode("x").alias("pos", "x"))
    found = materialise(candidates(rows, similarity), "similar-candidates")
    labels = link(found.where("v is not null"), docs, nodes, shingle, similarity, fingerprint_pairs(nodes, links))
    big = materialise(found.where("v is null").select(F.col("u").alias("x")).distinct(), "similar-big")
    if not big.isEmpty():
        inside = one.select("node", "n", "odd", F.posexplode("x").alias("pos", "x")).join(few(big), "x", "left_semi")
        labels = link_across(materialise(inside, "similar-frequent"), labels, docs, nodes, shingle, similarity)
    linked = heads.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = linked.groupBy("component").agg(F.min("first").alias("head"), F.count("*").alias("n"))
    named = spread_join(linked.select("node", "component", "rows"), materialise(named, "similar-names"), ["component"], "n")
    named = materialise(named.select("node", "rows", F.col("head.id").alias("component_id"), F.col("head.row").alias("keep_row"), F.col("head.place").alias("keep_place")), "similar-components")
    return spread_join(prints.select("id", "row", "place", "node"), named, ["node"], "rows").select(F.col("id").alias(id_col), "row", "place", "component_id", "keep_row", "keep_place")
