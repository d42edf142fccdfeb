"""URL filter: host and path rules, then gradient-boosted trees on lexical features.

DataFrame functions and MLlib on the JVM only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import few, hash_sample, materialise

#: (verdict, rule): host up to the first slash, then the path's start.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Labelled urls the trees are fitted on, and the trees.
FIT_ROWS, TREES, DEPTH = 20_000, 12, 4
#: Labelled urls that a host suffix or first path segment needs for a statistic of its own, and the folds that keep a url out of its own statistic.
PART_LEAST, FOLDS = 20, 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "depth", "host_parts", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "query_length", "fragment", "longest_part", "suffix_length", "suffix_blocked", "suffix_seen", "segment_blocked", "segment_seen")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits the host or a parent domain and starts the path; ties by the rule's text; else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def entropy(chars: Column) -> Column:
    """Shannon entropy in bits of a sorted array of characters; 0 for an empty one."""
    n = F.size(chars).cast("double")
    # in sorted order a run ends where the next character differs; its length is the difference of two ends
    ends = F.filter(F.sequence(F.lit(1), F.size(chars)), lambda i: ~F.get(chars, i).eqNullSafe(F.get(chars, i - 1)))
    total = F.aggregate(ends, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("h")), lambda a, e: F.struct(e.alias("last"), (a["h"] - (e - a["last"]) / n * F.log2((e - a["last"]) / n)).alias("h")))
    return F.when(n > 0, total["h"]).otherwise(F.lit(0.0))


def lexical(df: DataFrame) -> DataFrame:
    """df (with url, host, path) and the lexical features that need no training."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    digits = F.regexp_count(url, F.lit("[0-9]"))
    columns = {
        "length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "depth": F.regexp_count(path, F.lit("/[^/]")), "host_parts": F.size(F.split(host, r"\.")),
        "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)), "host_digits": F.regexp_count(host, F.lit("[0-9]")), "hyphens": F.regexp_count(host, F.lit("-")), "entropy": entropy(F.col("__chars")),
        "parameters": F.regexp_count(query, F.lit("[^&]+")), "query_length": F.length(query), "fragment": F.col("url").contains("#").cast("int"), "longest_part": F.array_max(F.transform(F.split(host, r"\."), lambda p: F.length(p))),
    }
    df = df.withColumn("__chars", F.filter(F.array_sort(F.split(url, "")), lambda c: c != ""))
    out = df.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()}).drop("__chars")
    return out.withColumns(_parts(host, path)).withColumn("suffix_length", F.length("suffix").cast("double"))


def part_statistics(labelled: DataFrame, part: str, prior: float) -> DataFrame:
    """(part, fold, <part>_blocked, <part>_seen) over all labelled urls (part, fold, blocked); fold -1 is for unlabelled ones.

    The share of blocked urls is smoothed towards the prior. The row of a fold
    leaves that fold's urls out, so no url's feature holds its own label.
    Counts are combined on the map side.
    """
    cells = labelled.groupBy(part, "fold").agg(F.count("*").alias("k"), F.sum("blocked").alias("s"))
    total = cells.groupBy(part).agg(F.sum("k").alias("all_k"), F.sum("s").alias("all_s")).where(F.col("all_k") >= PART_LEAST)
    folds = total.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(-1, FOLDS)])))
    left = folds.join(cells, [part, "fold"], "left").na.fill(0, ["k"]).na.fill(0.0, ["s"])
    n, b = F.col("all_k") - F.col("k"), F.col("all_s") - F.col("s")
    return materialise(left.select(part, "fold", ((b + 5 * prior) / (n + 5)).alias(f"{part}_blocked"), F.log1p(n).alias(f"{part}_seen")), f"url-{part}")


def _with_parts(df: DataFrame, stats: dict[str, DataFrame], fold: Column, prior: float) -> DataFrame:
    """df with its parts' statistics for a fold; each counted table is broadcast while it is small."""
    out = df.withColumn("fold", fold)
    for part, table in stats.items():
        out = out.join(few(table), [part, "fold"], "left")
        out = out.withColumns({f"{part}_blocked": F.coalesce(f"{part}_blocked", F.lit(prior)), f"{part}_seen": F.coalesce(f"{part}_seen", F.lit(0.0))})
    return out.drop("fold")


def _parts(host: Column, path: Column) -> dict[str, Column]:
    """The last label of the host and the first segment of the path."""
    return {"suffix": F.element_at(F.split(host, r"\."), -1), "segment": F.regexp_extract(path, r"(?s)^/([^/]*)", 1)}


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(31)), F.lit(FOLDS)).cast("int")


def url_sample(labelled: DataFrame, bound: int, seed: int) -> DataFrame:
    """(url, host, path, blocked, copies): about `bound` of the distinct labelled urls, each one row that counts its copies, so a repeated url brings no more rows than another."""
    urls = labelled.groupBy("url", "host", "path", "blocked").agg(F.count("*").cast("double").alias("copies"))
    urls = materialise(urls, "url-labels")
    return hash_sample(urls, F.col("url"), urls.count(), bound, seed)


def judge(df: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, seed: int = 23) -> DataFrame:
    """Verdict on every url: the longest fitting rule's, else the trees'.

    labelled: (url, blocked 0 or 1). By default the urls that the rules decide
    are the labelled ones. The trees are fitted on a seeded hash sample of
    about FIT_ROWS of the distinct ones, weighed by their copies, and scored
    on the JVM in the same pass that judges the rules. Besides lengths, ratios and counts the features are the
    smoothed share of blocked urls and the logarithm of the number of urls by
    last host label and by first path segment, over all labelled urls and out
    of fold (`part_statistics`); these tables are broadcast while their counted
    number is small, so no url is shuffled for its verdict.

    Null urls and urls without :// have empty host and path, no rule, and a
    verdict by the trees. Without labelled urls of both classes the verdict
    is that of the only class, or allow if there is none. A score of exactly
    one half allows. Repeated rows are judged alike, very long urls whole;
    other columns are not read; an empty table gives no rows.
    Returns id, host, path, rule, verdict, score (of blocking).
    """
    verdicts = {rule: verdict for verdict, rule in rules}
    base = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    base = base.withColumn("by_rule", by_rule)
    if labelled is None:
        labelled = base.where("by_rule is not null").select("url", "host", "path", (F.col("by_rule") == "block").cast("double").alias("blocked"))
    else:
        labelled = labelled.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "blocked": F.col("blocked").cast("double")})
    counts = labelled.agg(F.count("*").alias("n"), F.sum("blocked").alias("b")).first()
    n, b = counts["n"], counts["b"] or 0.0
    if not n or b in (0.0, float(n)):
        share = b / n if n else 0.0
        scored = base.withColumn("score", F.lit(float(share)))
    else:
        prior = float(b) / n
        parts = labelled.withColumns(_parts(F.col("host"), F.col("path"))).withColumn("fold", _fold(F.col("url")))
        stats = {part: part_statistics(parts.select(part, "fold", "blocked"), part, prior) for part in ("suffix", "segment")}
        sample = lexical(url_sample(labelled, FIT_ROWS, seed))
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
        trees = GBTClassifier(featuresCol="vector", labelCol="blocked", weightCol="copies", maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=seed, cacheNodeIds=False)
        data = vectors.transform(_with_parts(sample, stats, _fold(F.col("url")), prior)).select("vector", "blocked", "copies")
        model = trees.fit(materialise(data.repartition(4, F.xxhash64("blocked", vector_to_array("vector"))), "url-sample"))
        scored = model.transform(vectors.transform(_with_parts(lexical(base), stats, F.lit(-1), prior))).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("by_rule"), F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")


def op4_urls(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
