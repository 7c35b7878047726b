"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character 3- to 6-grams it holds (present or not), each times its log-count ratio between the
classes, as a vector of length 1. Counts are smoothed in proportion to the classes, so that a gram seen a few times has a
ratio near 0; none is left out. A logistic regression on them is trained on the driver by dual coordinate ascent from at most about
`per_class` labelled documents of each class (picked by a hash of doc_id, none longer than `longest` characters), and its intercept
is corrected for the classes' true shares. Whole texts are scored, piece by piece.

Defined cases: null or empty text scores the intercept alone; no labels: every score is 0; repeated rows score alike; of
repeated labels of one doc_id the highest counts, and of several texts with one labelled doc_id the least in order is learned from; a
null doc_id is not held out and has no label; an empty table gives no rows; other columns pass through, clashing names are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fold

BITS = 20
DIM = 1 << BITS
ORDERS = (3, 4, 5, 6)
PIECE = 1 << 20
#: Pseudo-counts of the smaller class, and the weight of the penalty.
SMOOTH, PENALTY = 30.0, 1e-5


def _hashes(text: str):
    """Hashed grams, one array a piece; pieces overlap so that no gram is lost."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for k in range(0, max(1, len(c) - 2), PIECE):
        part = c[k : k + PIECE + ORDERS[-1] - 1]
        h, found = np.zeros(len(part), np.uint32), []
        for n in range(1, ORDERS[-1] + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] * np.uint32(0x85EBCA6B)
            if n in ORDERS:
                x = (h ^ (h >> np.uint32(13)) ^ np.uint32(n)) * np.uint32(0x9E3779B1)
                found.append(x >> np.uint32(32 - BITS))
        yield _once(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def _once(h: np.ndarray) -> np.ndarray:
    """Distinct values, ascending."""
    h = np.sort(h)
    first = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=first[1:])
    return h[first]


def features(text: str | None) -> np.ndarray:
    """Distinct hashed grams."""
    parts = list(_hashes(text)) if text else []
    return parts[0] if len(parts) == 1 else _once(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


def _dual(z: float, old: float, slope: float) -> float:
    """Where one row's share of the dual is highest: log((1 - a) / a) = z + (a - old) * slope, by halving."""
    near = 1 / (1 + math.exp(min(max(z, -30.0), 30.0)))
    low, high = max(min(old, near), 1e-12), min(max(old, near), 1 - 1e-12)
    for _ in range(30):
        mid = (low + high) / 2
        if math.log((1 - mid) / mid) > z + (mid - old) * slope:
            low = mid
        else:
            high = mid
    return (low + high) / 2


class NbLinear:
    """Of each hashed gram the ratio times its coefficient, and the log-count ratio's square."""

    def __init__(self, ratio, weight, intercept):
        self.weight, self.square, self.intercept = weight, ratio * ratio, intercept

    @classmethod
    def train(cls, texts, labels, positive_share: float, epochs: int = 10) -> NbLinear:
        y = np.asarray(labels, float)
        if not len(y) or y.min() == y.max():
            return cls(np.zeros(DIM, np.float32), np.zeros(DIM, np.float32), -np.inf if not len(y) or y.max() == 0 else 30.0)
        rows = [features(t).astype(np.int32) for t in texts]
        n, n1, n0 = len(y), y.sum(), len(y) - y.sum()
        df1, df0 = (np.bincount(np.concatenate([r for r, v in zip(rows, y) if v == k]), minlength=DIM) for k in (1, 0))
        more1, more0 = SMOOTH * n1 / min(n1, n0), SMOOTH * n0 / min(n1, n0)
        ratio = (np.log((df1 + more1) / (n1 + 2 * more1)) - np.log((df0 + more0) / (n0 + 2 * more0))).astype(np.float32)
        w, b, dual = np.zeros(DIM, np.float32), 0.0, np.zeros(n)
        sign, inverse = np.where(y > 0, 1.0, -1.0), [1 / max(1e-6, math.sqrt(np.square(ratio[r], dtype=np.float64).sum())) for r in rows]
        rng = np.random.default_rng(0)
        for _ in range(epochs):
            for i in rng.permutation(n):
                x = ratio[rows[i]] * np.float32(inverse[i])
                z = sign[i] * (float(w[rows[i]] @ x) + b)
                new = _dual(z, dual[i], (float(x @ x) + 1) / (PENALTY * n))
                step = (new - dual[i]) * sign[i] / (PENALTY * n)
                dual[i] = new
                w[rows[i]] += np.float32(step) * x
                b += step
        prior = np.log(positive_share / (1 - positive_share)) - np.log(n1 / n0)
        return cls(ratio, w * ratio, float(b + prior))

    def score(self, text: str | None) -> float:
        held = features(text)
        z = self.intercept + float(self.weight.take(held).sum(dtype=np.float64)) / max(1e-6, math.sqrt(self.square.take(held).sum(dtype=np.float64)))
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700)))) if np.isfinite(z) else 0.0


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label: str = "toxic", per_class: int = 2500, longest: int = 1 << 18) -> NbLinear:
    """Learn from docs (doc_id, text) and labels (doc_id, label 0/1); `allowed` is a condition on doc_id."""
    pool = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if allowed is None else allowed))
    pool = pool.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("_y"))
    counts = {r["_y"]: r["count"] for r in pool.groupBy("_y").count().collect()}
    if not counts:
        return NbLinear.train([], [], 0.5)
    unit = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    share = {k: min(1.0, per_class / n) for k, n in counts.items()}
    picked = pool.filter(unit < F.when(F.col("_y") == 1, F.lit(share.get(1, 0.0))).otherwise(F.lit(share.get(0, 0.0))))
    # about 2 * per_class rows of two numbers: bounded by the parameter, so safe to broadcast; one text a document comes back
    rows = docs.select("doc_id", "text").filter(F.char_length("text") <= longest).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "_y").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    return NbLinear.train(list(rows["text"]), list(rows["_y"]), np.clip(counts.get(1, 0) / sum(counts.values()), 1e-4, 1 - 1e-4))


def score_toxicity(df: DataFrame, model: NbLinear, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """df with score and predicted."""
    held = df.sparkSession.sparkContext.broadcast(model)  # 8 MB of numbers

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([held.value.score(x.as_py()) for x in column], pa.float64())

    return df.withColumn("score", run(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = fold(F.col("doc_id"), 4) == 2
    model = train(docs, labels, ~out)
    return score_toxicity(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")
