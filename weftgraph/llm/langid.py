"""Language identification: FTRL-trained sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import fold, materialise, per_text

#: Hashed n-gram features and the n-gram orders.
BITS, ORDERS = 15, (1, 2, 3)
DIM = 1 << BITS
#: Labelled rows the classifier is fitted on, at least so many of each language, and the languages it can learn.
FIT_ROWS, LANGUAGE_ROWS, MOST_LANGUAGES = 3000, 50, 1000
#: The share of rows kept for calibration, of languages with enough of them.
CALIBRATION_SHARE, CALIBRATION_LEAST = 0.2, 10
#: Scale of the features: term shares are small numbers.
SCALE = 16.0
#: Code points handled at once, so that memory doesn't follow the longest text.
PIECE = 1 << 20

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x10000)])
    return _letters


def grams(text: str):
    """Yield arrays of hashed n-grams of a text: lower-cased letters, every other run as one border."""
    low = text.lower()
    for start in range(0, len(low), PIECE):
        a = np.frombuffer(low[start : start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        table = _letter_table()
        letter = table[np.minimum(a, 0xFFFF)] | (a > 0xFFFF)
        a = np.where(letter, a, 32).astype(np.uint32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one border after each run of letters
        a = np.concatenate(([np.uint32(32)], a[keep]))
        h = a * np.uint32(0x9E3779B1)
        for n in ORDERS:
            if n > 1:
                if len(a) < n:
                    break
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + a[n - 1 :] * np.uint32(0xC2B2AE35)
            yield (h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 3) -> np.ndarray:
    """Weights (DIM, classes) of softmax regression by follow-the-regularised-leader with elastic net."""
    z, n = np.zeros((DIM, classes)), np.zeros((DIM, classes))
    order = np.random.default_rng(seed)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(x)):
            idx, val = x[i]
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            s = val @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = val[:, None] * p
            g2 = g * g
            z[idx] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            n[idx] = ni + g2
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """How many training texts hold each feature: counted in the tasks, summed by feature."""

    def tally(batches):
        df, docs = np.zeros(DIM, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                docs += 1
                seen = np.zeros(DIM, bool)
                for g in grams(t):
                    seen[g] = True
                df += seen
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], docs))], names=["feature", "df"])

    out = np.zeros(DIM + 1, np.int64)
    for feature, n in train.select("text").mapInArrow(tally, "feature int, df long").groupBy("feature").agg(F.sum("df")).collect():
        out[feature] = n  # -1, the number of texts, is the last place
    return out[:-1], int(out[-1])


def sampled(train: DataFrame, rows: int) -> DataFrame:
    """About FIT_ROWS of the training rows by seeded hash, but at least LANGUAGE_ROWS of each language (all of a rarer one)."""
    langs = train.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages among the labels")
    share = min(1.0, FIT_ROWS / max(1, rows))
    limits = [(r["lang"], int(min(1.0, max(share, 1.5 * LANGUAGE_ROWS / r["n"])) * (1 << 30))) for r in langs]
    table = train.sparkSession.createDataFrame(limits, "lang string, most long")
    drawn = F.pmod(F.xxhash64("id", F.xxhash64("text"), F.lit(7)), F.lit(1 << 30))
    return train.join(F.broadcast(table), "lang").where(drawn < F.col("most")).select("id", "text", "lang")


def fit(train: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """From (id, text, lang): the languages, the weights with TF-IDF folded in, the temperature.

    Document frequencies cover all training texts; the regression sees the
    bounded sample of `sampled`, in which every language occurs. The
    temperature is fitted on rows kept apart from languages that can spare
    them; without such rows it is 1.
    """
    df, docs = _document_frequencies(train)
    idf = (np.log((1 + docs) / (1 + df)) + 1) * SCALE

    def features():
        def work(texts):
            at_all, tf_all = [], []
            for t in texts:
                got = [np.bincount(g, minlength=DIM) for g in grams(t)]
                n = np.sum(got, axis=0) if got else np.zeros(DIM, np.int64)
                at = np.nonzero(n)[0]
                at_all.append(at.astype(np.uint16).tobytes())
                tf_all.append((n[at] / max(1, n.sum())).astype(np.float32).tobytes())
            return [pa.array(at_all, pa.binary()), pa.array(tf_all, pa.binary())]

        return work

    part = F.pmod(F.xxhash64("id", F.xxhash64("text"), F.lit(11)), F.lit(1000)).cast("int")
    sample = sampled(train, docs).withColumn("part", part)
    rows = materialise(per_text(sample, F.col("text"), ["part", "lang"], [("at", "binary"), ("tf", "binary")], features), "lang-sample").collect()
    if not rows:
        return [], np.zeros((DIM, 0)), 1.0
    langs = sorted({r["lang"] for r in rows})
    rows.sort(key=lambda r: (r["part"], r["lang"], bytes(r["at"]), bytes(r["tf"])))  # the same order in every run
    y = np.array([langs.index(r["lang"]) for r in rows])
    at = [np.frombuffer(r["at"], np.uint16).astype(np.int64) for r in rows]
    x = [(i, idf[i] * np.frombuffer(r["tf"], np.float32)) for i, r in zip(at, rows, strict=True)]
    held = np.array([r["part"] < CALIBRATION_SHARE * 1000 for r in rows]) & (np.bincount(y)[y] >= CALIBRATION_LEAST)
    for c in range(len(langs)):  # no language goes to calibration as a whole
        if held[y == c].all():
            held[y == c] = False
    fitted, kept = np.nonzero(~held)[0], np.nonzero(held)[0]
    w = ftrl([x[i] for i in fitted], y[fitted], len(langs))
    t = temperature(np.array([v @ w[i] for i, v in (x[k] for k in kept)]).reshape(len(kept), len(langs)), y[kept])
    return langs, w * idf[:, None], t


def predict_languages(df: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Language of every whole text: id, carried columns, lang_pred, score (calibrated probability).

    train: (id, text, lang); rows with null text or lang are left out. A text
    that is null or has no letter gets `und` with score 0, and so does every
    text if there is no training row. Any number of training rows will do,
    and every language among them can be predicted. Equal scores go to the
    first language by code point. Texts are read whole, in pieces, however
    long. Repeated rows and null ids are judged row by row; ids and carried
    columns are passed on unchanged, and a carried column named like a result
    is an error. An empty table gives no rows.
    """
    langs, w, t = fit(train.where("text is not null and lang is not null"))
    shared = df.sparkSession.sparkContext.broadcast((w / t).astype(np.float32))

    def predict():
        w = shared.value

        def work(texts):
            pred, score = [], []
            for text in texts:
                s, n = np.zeros(len(langs)), 0
                for g in grams(text) if text and langs else ():
                    s += w[g].sum(0)
                    n += len(g)
                if not n:
                    pred.append("und")
                    score.append(0.0)
                    continue
                s /= n
                p = np.exp(s - s.max())
                pred.append(langs[int(p.argmax())])
                score.append(float(p.max() / p.sum()))
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64())]

        return work

    # a text without letters is handed over as null
    text = F.when(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.col(f"`{text_col}`"))
    return per_text(df, text, [id_col, *carry], [("lang_pred", "string"), ("score", "double")], predict)


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    train = docs.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang")
    return predict_languages(docs, train, carry=("held_out",))
