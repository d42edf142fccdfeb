"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import few, fold, hash_sample, materialise, per_text

#: Labelled rows the trees are fitted on.
FIT_ROWS = 8000
BINS = 64
STATISTICS = ("log_chars", "log_words", "word_mean", "word_dev", "letters", "upper", "digits", "spaces", "points", "symbols", "marks_end", "lines", "line_mean", "repeated_lines", "distinct_words", "short_words", "upper_words", "top_char", "non_ascii", "stops", "commas", "entropy")


#: Code points measured at once; a longer text is taken in pieces, cut after a line or a word if it has any.
PIECE = 1 << 20
_POINTS, _SYMBOLS = np.array([33, 44, 46, 58, 59, 63]), np.array([35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126])


def pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        cut = max(text.rfind("\n", at, end), 0) or max(text.rfind(" ", at, end), 0)
        cut = cut + 1 if cut > at else end
        yield text[at:cut]
        at = cut
    yield text[at:]


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of one whole text; an empty or null text has zeros.

    Characters are told apart by code point in every script. Sums are added up
    piece by piece, so only distinct words and lines are held (as hashes).
    """
    if not text:
        return [0.0] * len(STATISTICS)
    low, high = np.zeros(256, np.int64), {}
    n = words = ends = upper = upper_words = short = lines = letters = 0
    length = square = 0.0
    seen_words: set[int] = set()
    seen_lines: set[int] = set()
    for piece in pieces(text):
        a = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        n += len(a)
        narrow = piece.isascii()
        if narrow:
            low += np.bincount(a, minlength=256)
            upper += int(((a >= 65) & (a <= 90)).sum())
        else:
            low += np.bincount(a[a < 256], minlength=256)
            points, counts = np.unique(a[a >= 256], return_counts=True)
            for c, k in zip(points.tolist(), counts.tolist(), strict=True):
                high[c] = high.get(c, 0) + k
            upper += sum(map(str.isupper, piece))
        parts = piece.split()
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        words, length, square, short = words + len(parts), length + float(lens.sum()), square + float((lens * lens).sum()), short + int((lens <= 2).sum())
        ends += sum(not x[-1].isalnum() for x in parts)
        upper_words += sum(map(str.isupper, parts))
        seen_words.update(map(hash, parts))
        rows = piece.removesuffix("\n").split("\n") if piece is not text else piece.split("\n")
        lines += len(rows)
        seen_lines.update(map(hash, rows))
    letters = int(low[65:91].sum() + low[97:123].sum() + low[192:].sum()) + sum(k for c, k in high.items() if chr(c).isalpha())
    share = np.concatenate((low[low > 0], np.fromiter(high.values(), np.int64, len(high)))) / n
    w = words or 1
    mean = length / w
    return [
        np.log1p(n), np.log1p(words), mean, max(0.0, square / w - mean * mean) ** 0.5, letters / n, upper / n, low[48:58].sum() / n, (low[9:14].sum() + low[32]) / n,
        low[_POINTS].sum() / n, low[_SYMBOLS].sum() / n, ends / w, lines / w, n / lines, 1 - len(seen_lines) / lines, len(seen_words) / w, short / w,
        upper_words / w, share.max(), 1 - low[:128].sum() / n, low[46] / w, low[44] / w, float(-(share * np.log2(share)).sum()),
    ]


class Forest:
    """Boosted trees in flat arrays; every tree has the full shape of its depth, so traversal is index arithmetic."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float, depth: int):
        self.feature, self.threshold, self.value, self.base, self.depth = feature, threshold, value, base, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x, all rows of a tree level at once."""
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            raw += v[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-raw))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, reg: float = 1.0, least: float = 1.0) -> Forest:
    """Gradient boosting with logistic loss on quantile histograms."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    flat = binned + np.arange(k) * BINS
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    raw = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    out_f, out_t, out_v = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, q * (1 - q)
        f, t, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            for at in range(first, 2 * first + 1):
                rows = np.nonzero(node == at)[0]
                if len(rows) < 2:
                    continue
                cells = flat[rows].ravel()
                hg = np.bincount(cells, np.repeat(g[rows], k), k * BINS).reshape(k, BINS)
                hh = np.bincount(cells, np.repeat(h[rows], k), k * BINS).reshape(k, BINS)
                lg, lh = hg.cumsum(1)[:, :-1], hh.cumsum(1)[:, :-1]
                tg, th = g[rows].sum(), h[rows].sum()
                gain = lg**2 / (lh + reg) + (tg - lg) ** 2 / (th - lh + reg) - tg**2 / (th + reg)
                gain[(lh < least) | (th - lh < least)] = 0
                j, b = divmod(int(gain.argmax()), BINS - 1)
                if gain[j, b] > 1e-6 and b < len(edges[j]):
                    f[at], t[at] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        leaf = node - inner
        v = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + reg)
        raw += v[leaf]
        out_f.append(f)
        out_t.append(t)
        out_v.append(v)
    return Forest(np.array(out_f), np.array(out_t), np.array(out_v), base, depth)


def _measure():
    return lambda texts: [pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))]


def score_quality(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Quality of every whole text: id, carried columns, score (probability of label 1), predicted.

    labelled: (id, text, y) with y 0 or 1, a bounded sample (`sampled_labels`;
    beyond FIT_ROWS rows it is sampled again). The trees are fitted on the
    driver on the rows' statistics, then broadcast as flat arrays. Without
    labelled rows every score is 0.5; with one class all scores are near that
    class. Null and empty texts have zero statistics and a score; very long
    texts are measured whole, in pieces; repeated rows score alike. Ids and
    carried columns are passed on unchanged, and a carried column named like a
    result is an error. An empty table gives no rows.
    """
    rows = materialise(per_text(labelled, F.col("text"), ["y"], [("stats", "array<double>")], _measure), "quality-sample")
    sample = sorted(((r["stats"], r["y"]) for r in hash_sample(rows, F.xxhash64("stats"), rows.count(), 2 * FIT_ROWS, 13).collect()), key=lambda r: (r[1], r[0]))
    if sample:
        forest = fit_forest(np.array([r[0] for r in sample]), np.array([float(r[1]) for r in sample]))
    else:
        forest = Forest(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 0.0, 1)
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def predict():
        forest = shared.value

        def work(texts):
            s = forest.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS)))
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

        return work

    return per_text(df, F.col(f"`{text_col}`"), [id_col, *carry], [("score", "double"), ("predicted", "int")], predict)


def sampled_labels(docs: DataFrame, labels: DataFrame, column: str, bounds: int | dict[int, int], seed: int) -> DataFrame:
    """(id, text, y) of at most about `bounds` labels (or bounds[y] of each class y), the same ones in every run, in one scan of docs.

    The sample is taken from the labels by id, so texts of other documents are
    never shuffled: the few sampled ids, counted, are broadcast to the
    documents. Null labels and ids are no labels. A document that is labelled
    more than once takes its greatest label.
    """
    marks = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    marks = materialise(marks.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col(column).cast("int")).alias("y")), "labels")
    sizes = dict(marks.groupBy("y").agg(F.count("*")).collect())
    if isinstance(bounds, int):
        chosen = hash_sample(marks, F.col("__id"), sum(sizes.values()), bounds, seed)
    else:
        parts = [hash_sample(marks.where(F.col("y") == y), F.col("__id"), sizes.get(y, 0), bound, seed) for y, bound in bounds.items()]
        chosen = parts[0]
        for p in parts[1:]:
            chosen = chosen.unionByName(p)
    return docs.join(few(materialise(chosen, "label-sample")), F.col("doc_id") == F.col("__id")).select(F.col("doc_id").alias("id"), "text", "y")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    labels = labels.where(fold(F.col("doc_id"), 3) != 1)
    docs = docs.withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    return score_quality(docs, sampled_labels(docs, labels, "quality", FIT_ROWS, 13), carry=("held_out",))
