"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle check.

DataFrame functions only.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import BLANK, few, materialise, row_hash, temporary, without_rows

#: Words of a shingle, and the similarity from which a window counts as the item.
SHINGLE, SIMILARITY = 5, 0.8
#: The fingerprint's blocks and the bits that may differ in one: all fingerprints
#: within RADIUS differ in at most FLIPS bits of some block.
BLOCKS, FLIPS = 8, 3
BLOCK_BITS = 64 // BLOCKS
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Fingerprints speak for a text of at least so many distinct shingles, few of them repeated.
LEAST_DISTINCT = 24
#: A table of the items is broadcast up to this many values; beyond it its join shuffles. Each table is counted.
BROADCAST_VALUES = 4_000_000


def words(text: Column) -> Column:
    """Lower-cased words without punctuation at their ends; null and blank texts have none."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.filter(F.split(clean, BLANK), lambda w: w != "")


def with_shingles(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column `out` in place of `text`: 64-bit hashes of all shingles in order.

    Fewer words make one shingle, none makes none. The word hashes are a
    column of their own, so that the lambda over positions reads them instead
    of computing them again at each position.
    """
    rest = [c for c in df.columns if c != text]
    hashed = df.select(*rest, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("__w"))
    at = lambda i: F.xxhash64(*[F.get(F.col("__w"), i + k) for k in range(SHINGLE)])
    last = F.greatest(F.size("__w") - SHINGLE, F.lit(0))
    return hashed.select(*rest, F.when(F.size("__w") > 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<bigint>")).alias(out))


def fingerprint(hashes: Column) -> Column:
    """64-bit SimHash: a bit is 1 if it is set in over half of the hashes."""

    def bit(b):
        ones = F.aggregate(hashes, F.lit(0), lambda n, x: n + F.shiftright(x, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(ones * 2 > F.size(hashes), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    out = bit(0)
    for b in range(1, 64):
        out = out.bitwiseOR(bit(b))
    return out


def _blocks(fp: Column) -> Column:
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fp, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("value")) for b in range(BLOCKS)])


def telling(hashes: Column) -> Column:
    """Whether the text has enough distinct shingles, and few enough repeats, for its fingerprint to be near those of similar texts.

    With at least LEAST_DISTINCT distinct shingles and at most a quarter of
    their root as repeats, the sums behind the bits of two texts of similarity
    0.8 are correlated by 0.82 or more (0.89 without repeats), so a bit differs
    with probability 0.19 at most (0.15), and over RADIUS of 64 bits in one of
    10^7 pairs at the worst (10^10).
    """
    distinct = F.size(F.array_distinct(hashes))
    return (distinct >= LEAST_DISTINCT) & (F.pow(F.size(hashes) - distinct, F.lit(2)) * 16 <= distinct)


def _small(table: DataFrame, values: int) -> DataFrame:
    return F.broadcast(table) if values <= BROADCAST_VALUES else table


def matches(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The (document, item) pairs in which some window of the document is similar enough to the item.

    A window has as many words as the item (a shorter document is one
    window); its similarity to the item is the Jaccard of their shingles
    weighted by how often they occur: sum of minima over sum of maxima.

    Windows are cut where they can reach the similarity, which loses none: a
    window with similarity s and m shingles shares at least 2sm/(1+s) of them
    with the item, and can be moved to the right until it starts on a shared
    one. So the whole documents' shingles are matched with the items', and a
    window starts at each match from which enough matches follow within its
    length. Its SimHash then has to meet that item's fingerprint within RADIUS
    bits by multi-index hashing (each item lists every value of each block
    with up to FLIPS bits changed; windows only look their blocks up), which
    rules pairs out, and the others are checked exactly. Fingerprints say little about texts of few
    distinct or many repeated shingles (`telling`): where the window or the
    item is such a text, the pair is checked without them, so that no pair depends on a fingerprint that can't vouch.

    Null or blank documents and items match nothing; null ids are reported as
    null; repeated rows of one id are one document with several texts. Texts
    are read whole however long; one row's shingles are an array in one task.
    Other columns only tell rows apart. An empty table on either side gives
    no rows.
    Returns id, row (its hash), item, similarity, start (word position) of every such window.
    """
    item = with_shingles(items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("t")), "t", "h").where(F.size("h") > 0).distinct()
    item = materialise(item.withColumn("m", F.size("h")).withColumn("k", F.monotonically_increasing_id()), "decontam-shingles")
    item = materialise(item.withColumn("fp", fingerprint(F.col("h"))).withColumn("telling", telling(F.col("h"))), "decontam-items")
    n_items, n_shingles = item.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    marks = item.select("k", "m", F.explode(F.array_distinct("h")).alias("x"))

    docs = df.select(F.col(f"`{id_col}`").alias("id"), row_hash(df).alias("row"), F.col(f"`{text_col}`").alias("text"))
    flat = with_shingles(docs, "text", "all")
    flat = flat.select("id", "row", F.size("all").alias("of"), "all")  # the size first: exploded rows must not carry the array
    # outer: else the optimiser computes the arrays once more, and inside a lambda, for a filter on their size
    flat = flat.select("id", "row", "of", F.posexplode_outer("all").alias("pos", "x")).where("x is not null")
    met = flat.join(_small(marks.select("x").distinct(), n_shingles), "x", "left_semi") if n_shingles else flat.limit(0)
    met = materialise(met, "decontam-met")
    # a shingle that many items share meets each of them: the sums below are per document and item
    spots = met.join(_small(marks, n_shingles), "x").groupBy("id", "row", "of", "k", "m").agg(F.array_sort(F.collect_set("pos")).alias("spots"))
    size = F.least(F.col("m"), F.col("of"))
    share = similarity / (1 + similarity)
    need = F.greatest(F.lit(1), F.ceil(F.lit(share) * (F.col("m") + size) - 1e-9).cast("int"))
    spots = spots.withColumn("size", size).withColumn("need", need).where(F.size("spots") >= F.col("need"))
    starts = F.expr("transform(filter(sequence(0, size(spots) - need), i -> spots[i + need - 1] - spots[i] < size), i -> least(spots[i], of - size))")
    windows = spots.select("id", "row", "size", "m", "k", F.explode_outer(F.array_distinct(starts)).alias("start")).where("start is not null")
    windows = materialise(windows, "decontam-windows")

    # the windows' shingles come from their own documents only: few texts pass the semi join, which
    # shuffles none of the others while the hit texts' hashes are a bounded broadcast
    cuts = windows.select("row", "size", "m", "start").distinct().groupBy("row").agg(F.collect_set(F.struct("size", "m", "start")).alias("cuts"))
    rows = materialise(windows.select("row").distinct(), "decontam-rows")
    hit = docs.join(few(rows), "row", "left_semi").dropDuplicates(["row"]).join(cuts, "row")
    cut = with_shingles(hit.select("id", "row", "cuts", "text"), "text", "all").select("id", "row", "all", F.explode_outer("cuts").alias("c"))
    cut = cut.select("id", "row", F.col("c.m").alias("m"), F.col("c.start").alias("start"), F.slice("all", F.col("c.start") + 1, F.col("c.size")).alias("h"))
    cut = materialise(cut, "decontam-shingled")
    cut = materialise(cut.withColumn("fp", fingerprint(F.col("h"))).withColumn("telling", telling(F.col("h"))), "decontam-cuts")

    flips = [0, *(sum(1 << b for b in c) for f in range(1, FLIPS + 1) for c in itertools.combinations(range(BLOCK_BITS), f))]
    # the windows' own items only: a window of another item is that item's to find
    own = windows.select("row", "m", "start", "k").join(cut.select("row", "m", "start", "fp", "telling"), ["row", "m", "start"])
    own = own.join(_small(item.select("k", F.col("fp").alias("item_fp"), F.col("telling").alias("item_telling")), n_items), "k")
    own = materialise(own, "decontam-own")
    probes = item.where("telling").select("k", F.explode(_blocks(F.col("fp"))).alias("b"))
    probes = probes.select("k", F.col("b.block").alias("block"), F.explode(F.array(*[F.col("b.value").bitwiseXOR(F.lit(f)) for f in flips])).alias("value"))
    looked = own.where("telling and item_telling").select("row", "m", "start", "k", "fp", "item_fp", F.explode(_blocks(F.col("fp"))).alias("b"))
    looked = looked.select("row", "m", "start", "k", "fp", "item_fp", F.col("b.block").alias("block"), F.col("b.value").alias("value"))
    near = looked.join(_small(probes, n_items * BLOCKS * len(flips)), ["k", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = near.select("row", "m", "start", "k").distinct().unionByName(own.where("not telling or not item_telling").select("row", "m", "start", "k"))

    full = near.join(cut.select("id", "row", "m", "start", "h"), ["row", "m", "start"]).join(_small(item.select("k", "item", F.col("h").alias("g")), n_items + n_shingles), "k")
    both = F.expr("aggregate(array_distinct(array_intersect(h, g)), 0, (a, x) -> a + least(size(filter(h, y -> y = x)), size(filter(g, y -> y = x))))")
    full = full.withColumn("both", both).withColumn("similarity", F.col("both") / (F.size("h") + F.size("g") - F.col("both")))
    return full.where(F.col("similarity") >= similarity - 1e-12).select("id", "row", "item", "similarity", "start")


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The (document, item) pairs with a similar window: `matches` with the best window of each. Returns id, item, similarity, start."""
    found = matches(df, items, id_col, text_col, item_col, item_text, similarity)
    best = found.groupBy("id", "item").agg(F.max(F.struct("similarity", F.negative("start").alias("s"))).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.similarity").alias("similarity"), F.negative("b.s").alias("start"))


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df without the rows that hold a benchmark item; columns unchanged. Rows are told apart by all their columns."""
    with temporary(df.sparkSession) as kept:
        gone = materialise(matches(df, items, id_col, text_col, **options).select("row").distinct(), "decontam-gone")
        kept.append(gone)
    return without_rows(df, gone)


def op7_decontam(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contaminated(docs, items)
