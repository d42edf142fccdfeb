"""SimHash near-duplicates: a binary trie self-join under a Hamming budget, and their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import materialise, per_text, python_ready, temporary, without_rows
from weftgraph.llm.similar import similar_components
from weftgraph.operators.components import connected_components
from weftgraph.operators.joins import spread_join

#: Shingles hashed at once, so that memory doesn't follow the longest text.
PIECE = 1 << 17
#: Fingerprints a join task holds at once, beyond whole groups.
CHUNK = 200_000
#: A group of more fingerprints is dealt out again by the next bits of the trie, as often as needed.
GROUP_LIMIT, SPLIT_BITS = 100_000, 8
#: Pairs of trie nodes that are traversed together; more are taken in parts.
NODE_PAIRS = 1_000_000


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text: ASCII lower case, words between ASCII blanks, repeats included.

    A bit is 1 if it is set in over half of the shingles' XXH64. A text of
    fewer words is one shingle; a text without words has fingerprint 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[-n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : min(n, at + PIECE)].tolist(), ends[at : at + PIECE], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""

    def work():
        return lambda texts: [pa.array(np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64))]

    return per_text(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), F.col("text"), ["id"], [("fp", "long")], work)


def trie_pairs(group: np.ndarray, fp: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield positions of all pairs in one group whose fingerprints differ in 1 to `budget` bits.

    group, fp: sorted by group, then by unsigned fingerprint, distinct in each
    group. The sorted run of a group is the leaves of its binary trie and a
    node is a range of it. Pairs of nodes are traversed together from the
    roots, one bit a step, for all groups at once: equal branches keep a
    pair's error, different ones add 1, and pairs beyond the budget go. A
    front of over NODE_PAIRS pairs is halved and its halves are traversed one
    after the other, so memory follows the front, not the number of pairs.
    """
    first = np.concatenate(([0], np.nonzero(group[1:] != group[:-1])[0] + 1, [len(group)])) if len(group) else np.zeros(1, np.int64)
    lo, hi = first[:-1], first[1:]
    big = hi - lo > 1
    zeros: dict[int, np.ndarray] = {}
    todo = [(63, lo[big], hi[big], lo[big], hi[big], np.zeros(int(big.sum()), np.int8))]
    while todo:
        bit, a0, a1, b0, b1, err = todo.pop()
        if not len(a0):
            continue
        if bit < 0:
            yield a0, b0
            continue
        if len(a0) > NODE_PAIRS:
            half = len(a0) // 2
            todo += [(bit, *(x[half:] for x in (a0, a1, b0, b1, err))), (bit, *(x[:half] for x in (a0, a1, b0, b1, err)))]
            continue
        if bit not in zeros:
            zeros[bit] = np.concatenate(([0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1) == 0)))
        z = zeros[bit]
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        same = a0 == b0
        parts = []
        for x0, x1, y0, y1, more, take in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
            ok = (x1 > x0) & (y1 > y0) & (err + more <= budget)
            ok &= (x0 != y0) | (x1 - x0 > 1)
            if take is not None:
                ok &= take
            parts.append((x0[ok], x1[ok], y0[ok], y1[ok], err[ok] + np.int8(more)))
        todo.append((bit - 1, *(np.concatenate(c) for c in zip(*parts, strict=True))))


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(shift, bits) of budget + 1 blocks: fingerprints within the budget agree on one of them."""
    n = budget + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def split_groups(rows: DataFrame, level: int, blocks: list[tuple[int, int]], budget: int) -> DataFrame:
    """Rows (fp, block, path, key, side, left) of heavy groups, dealt out by the next SPLIT_BITS bits after the agreed block.

    Two fingerprints within what is left of the budget have prefixes that
    differ in as many bits at most, so each row goes to the pairs of its own
    prefix with every such prefix; the pair is the new group. side says which
    prefix of an unequal pair the row has (0 or 1, 2 for equal ones so far):
    a group whose pairs differ is joined across its sides only, so each pair
    of fingerprints meets in one group.
    """
    starts = F.array(*[F.lit((shift + bits + level * SPLIT_BITS) % 64) for shift, bits in blocks])
    size = 1 << SPLIT_BITS
    flips = F.array(*[F.lit(m) for m in range(size) if m.bit_count() <= budget])
    # the bits are read around the end of the fingerprint, so a prefix may join its two ends
    turned = F.expr("case when s = 0 then fp else shiftrightunsigned(fp, s) | shiftleft(fp, 64 - s) end")
    out = rows.withColumn("s", F.element_at(starts, F.col("block") + 1)).withColumn("own", turned.bitwiseAND(F.lit(size - 1)).cast("int"))
    out = out.withColumn("flip", F.explode(flips)).where(F.bit_count("flip") <= F.col("left")).withColumn("other", F.col("own").bitwiseXOR(F.col("flip")))
    new = F.when(F.col("side") < 2, F.col("side")).when(F.col("flip") == 0, F.lit(2)).otherwise((F.col("own") > F.col("other")).cast("int"))
    out = out.withColumn("new", new)
    first = F.when(F.col("new") == 1, F.col("other")).otherwise(F.col("own"))
    second = F.when(F.col("new") == 1, F.col("own")).otherwise(F.col("other"))
    key = F.xxhash64("key", first, second)
    return out.select("fp", "block", "path", key.alias("key"), F.col("new").alias("side"), (F.col("left") - F.bit_count("flip")).cast("int").alias("left"))


def fingerprint_links(distinct: DataFrame, budget: int = 2) -> DataFrame:
    """All pairs (u, v), u < v, of the distinct `fp` that differ in 1 to `budget` bits.

    Fingerprints within the budget agree on one of budget + 1 bit blocks, so
    each goes to that many groups; a group is one subtree in which the agreed
    bits are the path from the root. Tasks hold whole groups in chunks and
    join their tries. A group beyond GROUP_LIMIT is dealt out by more bits
    (`split_groups`), and its parts again, until all are small; no pair is
    lost, however dense the fingerprints.
    """
    python_ready(distinct.sparkSession)
    blocks = _blocks(budget)
    mask = [((1 << bits) - 1) << shift for shift, bits in blocks]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in mask]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed]))).withColumnsRenamed({"pos": "block", "col": "path"})
    todo = keyed.withColumns({"key": F.lit(0).cast("long"), "side": F.lit(2), "left": F.lit(budget)})
    group, small = ["block", "path", "key"], None
    for level in range((64 - max(bits for _, bits in blocks)) // SPLIT_BITS):
        sizes = todo.groupBy(*group).agg(F.count("*").alias("n"))
        heavy = materialise(sizes.where(F.col("n") > GROUP_LIMIT).select(*group), "simhash-heavy")  # at most rows / GROUP_LIMIT
        if heavy.isEmpty():
            break
        light = todo.join(F.broadcast(heavy), group, "left_anti")
        small = light if small is None else small.unionByName(light)
        todo = materialise(split_groups(todo.join(F.broadcast(heavy), group, "left_semi"), level, blocks, budget), "simhash-split")
    plain = todo if small is None else small.unionByName(todo)
    spread = plain.select(*group, "side", "fp").repartition(*group).sortWithinPartitions(*group)

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = rows[:, 4].view(np.uint64)
        order = np.lexsort((fp, rows[:, 2], rows[:, 1], rows[:, 0]))
        rows, fp = rows[order], fp[order]
        # one fingerprint may come to a group from both sides; the trie joins distinct ones
        number = np.concatenate(([0], np.cumsum(np.any(rows[1:, :3] != rows[:-1, :3], axis=1))))
        for i, j in trie_pairs(number, fp, budget):
            block, a, b = rows[i, 0], rows[i, 3], rows[j, 3]
            keep = ((a == 2) & (b == 2)) | (a + b == 1)
            for k, m in enumerate(mask):  # a pair counts in the first block on which it agrees
                keep &= (k >= block) | ((fp[i] ^ fp[j]) & np.uint64(m) != 0)
            u, v = fp[i][keep].view(np.int64), fp[j][keep].view(np.int64)
            yield pa.RecordBatch.from_pydict({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    def join(batches):
        held: list[np.ndarray] = []
        count = 0
        for b in batches:
            got = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], 1)
            if count + len(got) >= CHUNK and len(got):
                cuts = np.nonzero(np.any(got[1:, :3] != got[:-1, :3], axis=1))[0]
                at = int(cuts[-1]) + 1 if len(cuts) else 0  # the last group may go on
                if not at and held and np.any(held[-1][-1, :3] != got[0, :3]):
                    yield from pairs(np.concatenate(held))
                    held, count = [], 0
                elif at:
                    yield from pairs(np.concatenate([*held, got[:at]]))
                    held, count, got = [], 0, got[at:]
            held.append(got)
            count += len(got)
        if count:
            yield from pairs(np.concatenate(held))

    return spread.mapInArrow(join, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """Fingerprint and component of every row: components link fingerprints within `budget` bits.

    Rows with one fingerprint collapse into one node before any join, so
    copies cost a map-side aggregation; links and components are computed on
    distinct fingerprints as tables and never reach the driver. A fingerprint
    of very many rows stays spread when its component is looked up.

    Null and blank texts have fingerprint 0, linked like any other; null ids
    keep their rows but never name a component (it is null if all are null);
    repeated rows share their component; very long texts are hashed whole, in
    pieces; other columns are not read. An empty table gives no rows.
    Returns id, fingerprint (16 hex digits), component_id.
    """
    prints = materialise(fingerprints(df, id_col, text_col, shingle), "simhash-prints")
    with temporary(df.sparkSession) as kept:
        nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
        labels = connected_components(materialise(fingerprint_links(nodes.select("fp"), budget), "simhash-links"))
        linked = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        named = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
        named = spread_join(linked.select("fp", "component", F.col("n").alias("rows")), materialise(named, "simhash-names"), ["component"], "n")
        kept.append(materialise(named.select("fp", "component_id", "rows"), "simhash-components"))
    out = spread_join(prints, kept[0], ["fp"], "rows")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each component of near copies by exact Jaccard: the one with the smallest id, then row hash; columns unchanged.

    SimHash fingerprints of five-word shingles find near copies first, as in
    operator 10; each link is checked by its Jaccard, and a join that loses no
    pair adds what lies further apart.

    Rows are told apart by all their columns: two texts under one id are two
    rows, and rows that are equal in every column leave one. A component of
    null ids alone leaves one row too. Odd rows as in `similar_components`.
    """
    with temporary(df.sparkSession) as kept:
        others = materialise(similar_components(df, id_col, text_col, fingerprint=simhash, links=fingerprint_links).where("place <> keep_place").select("row", "keep_row"), "near-others")
        gone = materialise(others.where("row <> keep_row").select("row").distinct(), "near-gone")
        once = materialise(others.where("row = keep_row").select("row").distinct(), "near-once")
        kept.extend((gone, once))
    return without_rows(df, gone, once)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs)
