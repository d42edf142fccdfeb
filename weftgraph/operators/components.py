"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.joins import HOT_ROWS, spread_join
from weftgraph.session import discard, materialise, temporary


def _large_star(edges: DataFrame, join) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join(both.where("v > u"), least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, join) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hung = join(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _round(edges: DataFrame, count: int) -> DataFrame:
    """One large-star and one small-star step as a written table."""
    if 2 * count <= HOT_ROWS:  # no node can have many edges
        plain = lambda big, least: big.join(least.drop("n"), "u")
        return materialise(_small_star(_large_star(edges, plain), plain), "cc-round")
    with temporary(edges.sparkSession) as kept:
        spread = lambda big, least: spread_join(big, materialise(least, "cc-least"), ["u"], "n", 2 * count)
        large = materialise(_large_star(edges, spread), "cc-large")
        kept.append(materialise(_small_star(large, spread), "cc-round"))
    return kept[0]


def connected_components(edges: DataFrame, a: str = "u", b: str = "v", max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the least node of its component.

    Each round is two aggregations with map-side partial minima and two joins
    (large-star, small-star; O(log^2 n) rounds for any shape, long chains
    included), written to the shared folder, so lineage stays short; a round's
    tables go when the next is written. The edges of a node with very many of
    them stay where they are, their minimum is broadcast. Nothing but a row
    count and a checksum per round reaches the driver.

    Returns (node, component). Self loops and nulls are ignored; an empty edge
    table gives an empty result.
    """
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct()
    cur = materialise(cur, "cc-edges")
    seen, count = None, cur.count()
    for _ in range(max_rounds):
        nxt = _round(cur, count)
        mark = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(cur)
        cur = nxt
        count = mark[0]
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
