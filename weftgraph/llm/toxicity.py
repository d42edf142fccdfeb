"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import discard, fold, materialise, per_text
from weftgraph.llm.quality import sampled_labels

#: Hashed character n-grams inside words, their orders and the width of their vectors.
BITS, ORDERS, WIDTH = 18, (3, 4), 8
DIM = 1 << BITS
#: Labelled rows the model is fitted on: of label 1 and of label 0.
FIT_TOXIC, FIT_CLEAN = 2000, 4000
#: Steps of the training, whatever the number of rows; and of each training on all folds but one.
STEPS, FOLD_STEPS, FOLDS = 20_000, 8_000, 3
#: Shares of the strongest subword's evidence below which evidence is noise; the folds choose one.
SHRINKS = (0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4)
#: Neutral subwords added to every average, so that a text of few words is not judged by one odd n-gram.
PADDING = 50
PIECE = 1 << 20

_word: np.ndarray | None = None


def _word_table() -> np.ndarray:
    global _word
    if _word is None:
        _word = np.array([chr(c).isalnum() for c in range(0x10000)])
    return _word


def subwords(text: str):
    """Yield arrays of hashed n-grams that lie in one lower-cased word with its two borders."""
    low = text.lower()
    for start in range(0, len(low), PIECE):
        a = np.frombuffer(low[start : start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = _word_table()[np.minimum(a, 0xFFFF)] | (a > 0xFFFF)
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        a = np.concatenate(([np.uint32(32)], np.where(inside, a, 32).astype(np.uint32)[keep]))
        border = np.concatenate(([0], np.cumsum(a == 32)))
        h = a * np.uint32(0x9E3779B1)
        for n in range(2, ORDERS[-1] + 1):
            if len(a) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + a[n - 1 :] * np.uint32(0xC2B2AE35)
            if n in ORDERS:
                # no border but at the two ends
                whole = border[n - 1 : len(border) - 1] - border[1 : len(border) - n + 1] == 0
                yield ((h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS))[whole]


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct subwords of a text and how often each occurs."""
    parts = list(subwords(text)) if text else []
    at, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    return at.astype(np.uint32), n.astype(np.uint32)


def shares(n: np.ndarray) -> np.ndarray:
    return (n / (n.sum(dtype=np.int64) + PADDING)).astype(np.float32)


def embed(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weigh: tuple[float, float], steps: int, rate: float = 0.5, seed: int = 5) -> np.ndarray:
    """Fit embeddings and softmax together by AdaGrad; returns the evidence of each subword for label 1.

    The softmax is linear in the averaged embeddings, so a text's log odds are
    the average of its subwords' evidence plus a bias. AdaGrad's sums start
    well above one gradient, so a subword seen once moves little.
    """
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.01, (DIM, WIDTH)).astype(np.float32)
    e2 = np.full((DIM, WIDTH), 1e-5, np.float32)
    w, b = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    w[:, 1] = rng.normal(0, 1, WIDTH)
    w2, b2 = np.full((WIDTH, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    epochs = -(-steps // len(bags))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(bags)):
            at, share = bags[i][0], shares(bags[i][1])
            ei = e[at]
            mean = share @ ei
            s = mean @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            p *= weigh[int(y[i])]
            gm = w @ p
            gw = np.outer(mean, p)
            w2 += gw * gw
            b2 += p * p
            w -= step * gw / np.sqrt(w2)
            b -= 0.1 * step * p / np.sqrt(b2)
            if len(at):
                ge = share[:, None] * gm
                acc = e2[at] + ge * ge
                e2[at] = acc
                e[at] = ei - step * ge / np.sqrt(acc)
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float64)


def shrunk(evidence: np.ndarray, share: float) -> np.ndarray:
    """Evidence soft-thresholded at a share of the strongest, which silences the noise of clean subwords."""
    return np.sign(evidence) * np.maximum(np.abs(evidence) - share * np.abs(evidence).max(initial=0.0), 0)


def averages(bags: list[tuple[np.ndarray, np.ndarray]], evidence: np.ndarray) -> np.ndarray:
    return np.array([shares(n) @ evidence[at] for at, n in bags])


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, float]:
    """The evidence of each subword for label 1, and the bias.

    The rarer class weighs more, by the root of the ratio. The share of
    evidence that counts as noise is the one with the least loss over FOLDS
    folds (part modulo FOLDS), each judged by a model of the others; with too
    few labels of either class the middle one is taken. Slope and bias are
    fitted on the shrunk evidence.
    """
    toxic = max(1, int(y.sum()))
    weigh = (1.0, float(np.clip((len(y) - toxic) / toxic, 1, 25)) ** 0.5)
    pick = lambda rows: [bags[i] for i in np.nonzero(rows)[0]]
    loss = np.zeros(len(SHRINKS))
    for f in range(FOLDS):
        out = part % FOLDS == f
        if min(y[out].sum(), (1 - y[out]).sum(), y[~out].sum(), (1 - y[~out]).sum()) < 3:
            loss[:] = np.abs(np.arange(len(SHRINKS)) - len(SHRINKS) // 2)
            break
        evidence = embed(pick(~out), y[~out], weigh, FOLD_STEPS)
        for k, share in enumerate(SHRINKS):
            e = shrunk(evidence, share)
            slope, bias = rescale(averages(pick(~out), e), y[~out], weigh)
            odds = slope * averages(pick(out), e) + bias
            loss[k] += float((np.where(y[out] == 1, weigh[1], weigh[0]) * np.logaddexp(0, np.where(y[out] == 1, -odds, odds))).sum())
    evidence = shrunk(embed(bags, y, weigh, STEPS), SHRINKS[int(loss.argmin())])
    slope, bias = rescale(averages(bags, evidence), y, weigh)
    return (slope * evidence).astype(np.float32), bias


def rescale(s: np.ndarray, y: np.ndarray, weigh: tuple[float, float]) -> tuple[float, float]:
    """Slope and bias of a logistic fit of y on s, by Newton steps with a small ridge."""
    width = float(s.std()) or 1.0
    x = np.stack([s / width, np.ones(len(s))], 1)
    k, ridge, w = np.zeros(2), np.array([1e-2, 1e-6]), np.where(y == 1, weigh[1], weigh[0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ k, -50, 50)))
        hessian = (x * (w * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, x.T @ (w * (p - y)) + ridge * k)
        k -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(k[0] / width), float(k[1])


def _bags():
    def work(texts):
        got = [bag(t) for t in texts]
        return [pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([n.tobytes() for _, n in got], pa.binary())]

    return work


def fitted(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """The model of (id, text, y), a bounded sample: bags of subwords are built and written in the tasks, the driver trains on them."""
    bags = materialise(per_text(labelled.withColumn("part", F.xxhash64("id", F.lit(29))), F.col("text"), ["part", "y"], [("at", "binary"), ("n", "binary")], _bags), "toxicity-bags")
    # a written table of bounded size: read part by part, so that the driver holds the sample once
    rows = [(r["part"], r["y"], np.frombuffer(r["at"], np.uint32).copy(), np.frombuffer(r["n"], np.uint32).copy()) for r in bags.toLocalIterator()]
    discard(bags)
    if not rows:
        return np.zeros(DIM, np.float32), -np.inf
    rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))  # the same order in every run
    return train([r[2:] for r in rows], np.array([r[1] for r in rows]), np.array([r[0] for r in rows]))


def _judging(model):
    def judge():
        evidence, bias = model.value

        def work(texts):
            score = []
            for t in texts:
                total, n = 0.0, 0
                for g in subwords(t) if t else ():
                    total += float(evidence[g].sum(dtype=np.float64))
                    n += len(g)
                odds = total / (n + PADDING) + bias
                score.append(float(1 / (1 + np.exp(-np.clip(odds, -700, 700)))) if np.isfinite(odds) else 0.0)
            s = np.array(score, np.float64)
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(s < 0.5)]

        return work

    return judge


_RESULTS = [("score", "double"), ("predicted", "int"), ("clean", "boolean")]


def score_toxicity(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Toxicity of every whole text: id, carried columns, score (probability of label 1), predicted.

    labelled: (id, text, y), a bounded sample (`toxicity_labels`). Bags of
    subwords are built in the tasks; the driver trains on them and broadcasts
    one number per subword. Null and empty texts get the score of the bias
    alone; without labelled rows every score is 0. Very long texts are read
    whole, in pieces; repeated rows score alike. Ids and carried columns are
    passed on unchanged, and a carried column named like a result (score,
    predicted, clean) is an error. An empty table gives no rows.
    """
    model = df.sparkSession.sparkContext.broadcast(fitted(labelled))
    return per_text(df, F.col(f"`{text_col}`"), [id_col, *carry], _RESULTS, _judging(model)).drop("clean")


def drop_toxic(df: DataFrame, labelled: DataFrame, text_col: str = "text") -> DataFrame:
    """df without the rows whose text the classifier rejects; all columns unchanged, whatever their names. Odd rows as in `score_toxicity`."""
    model = df.sparkSession.sparkContext.broadcast(fitted(labelled))
    return per_text(df, F.col(f"`{text_col}`"), df.columns, _RESULTS, _judging(model), where="clean")


def toxicity_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A bounded sample of labelled texts with both classes: (id, text, y)."""
    return sampled_labels(docs, labels.where("toxic in (0, 1)"), "toxic", {1: FIT_TOXIC, 0: FIT_CLEAN}, 13)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    labels = labels.where(fold(F.col("doc_id"), 5) != 0)
    docs = docs.withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    return score_toxicity(docs, toxicity_labels(docs, labels), carry=("held_out",))
