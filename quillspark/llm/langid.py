"""Language identification by error-correcting output codes.

Every language gets a codeword; for every bit a binary classifier over hashed character 1- to 3-grams (a naive Bayes
log-ratio, scaled and shifted by a logistic fit) predicts that bit. Decoding is loss-weighted: a codeword's loss is the
sum over bits of reliability times log(1 + exp(-bit * margin)), and the nearest codeword wins. The score is the softmax of the
negative losses; `ambiguous` marks a winner whose lead over the second is under `lead`.

Training reads at most about `per_language` labelled texts a language, picked by a hash of doc_id and text; equal rows count once.
Their gram profiles (DIM entries at most) are made on the executors from whole texts, and only these go to the driver. Whole texts
are scored.

Defined cases: null text, or text without a letter: `und`, score 0, ambiguous; no labelled rows: all `und`; one language: always
that; ties go to the language first in code point order; repeated rows score alike; an empty table gives no rows; other columns pass
through, clashing names are replaced (`identify` takes other names); a null doc_id is not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fold, unused

DIM = 1 << 14
#: Characters handled at once: longer texts are summed piece by piece.
PIECE = 1 << 20
_letters: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points, 0 for what is no letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_letters[0][c], c, 0).astype(np.uint32)


def _grams(c: np.ndarray) -> np.ndarray:
    """Hashed 1-, 2- and 3-grams that hold a letter."""
    pad = np.zeros(len(c) + 2, np.uint32)
    pad[1:-1] = c
    a, b, d = pad[:-2], pad[1:-1], pad[2:]
    two = a * np.uint32(0x85EBCA6B) + b * np.uint32(0xC2B2AE35) + np.uint32(77)
    three = two * np.uint32(0x27D4EB2F) + d * np.uint32(0x9E3779B1)
    one = b * np.uint32(0x165667B1)
    h = np.concatenate([one[b > 0], two[(a | b) > 0], three[(a | b | d) > 0]])
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 14)


def gram_counts(text: str) -> tuple[np.ndarray, int]:
    """Counts by hashed gram, and their number."""
    c = _codes(text)
    if not c.any():
        return np.zeros(DIM, np.int64), 0
    total = np.zeros(DIM, np.int64)
    for k in range(0, len(c), PIECE):
        total += np.bincount(_grams(c[k : k + PIECE]), minlength=DIM)
    return total, int(total.sum())


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The grams that a text holds, and their shares."""
    counts, n = gram_counts(text)
    hit = np.flatnonzero(counts).astype(np.int32)
    return hit, (counts[hit] / max(n, 1)).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 / -1: the exhaustive code up to 6 languages, else the best of seeded random ones."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 6:
        bits = [[1] + [1 if k >> (n - 2 - i) & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(bits, np.int8).T
    rng, best, gap = np.random.default_rng(seed), None, -1
    width = max(15, 5 * int(np.ceil(np.log2(n))))
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], np.int8), (n, width))
        near = int(((width - m.astype(int) @ m.T.astype(int)) // 2 + width * np.eye(n, dtype=int)).min())
        if near > gap and (np.abs(m.sum(0)) < n).all():
            best, gap = m, near
    return best


class EccModel:
    """Languages, their codewords, gram weights by bit, and each bit's scale, shift and reliability."""

    def __init__(self, langs, code, weights, scale, shift, trust):
        self.langs, self.code, self.weights, self.scale, self.shift, self.trust = langs, code, weights, scale, shift, trust

    @classmethod
    def train(cls, texts, labels) -> EccModel:
        return cls.fit([profile(t) for t in texts], labels)

    @classmethod
    def fit(cls, rows, labels) -> EccModel:
        """rows: profiles of labelled texts."""
        langs = sorted(set(labels))
        code = codewords(len(langs))
        width = code.shape[1]
        kinds = np.array([langs.index(x) for x in labels], int)
        by = np.zeros((len(langs), DIM))
        for (hit, share), kind in zip(rows, kinds):
            by[kind][hit] += share
        use = [i for i, (hit, _) in enumerate(rows) if len(hit)]
        weights, scale, shift, trust = np.zeros((DIM, width), np.float32), np.ones(width), np.zeros(width), np.ones(width)
        for b in range(width):
            plus, minus = by[code[:, b] > 0].mean(0) + 1e-5, by[code[:, b] < 0].mean(0) + 1e-5
            weights[:, b] = np.log(plus / plus.sum()) - np.log(minus / minus.sum())
        if use and width:
            margin = np.array([rows[i][1] @ weights[rows[i][0]] for i in use])
            truth = code[kinds[use]]
            for b in range(width):
                scale[b], shift[b], trust[b] = _fit_scale(margin[:, b], truth[:, b])
        return cls(langs, code, weights, scale, shift, trust)

    def decode(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, lead over the second."""
        counts, n = gram_counts(text) if text else (None, 0)
        if not n or not self.langs:
            return "und", 0.0, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0, 1.0
        hit = np.flatnonzero(counts)
        margin = (counts[hit].astype(np.float32) @ self.weights[hit]) / n * self.scale + self.shift
        loss = (self.trust * np.logaddexp(0, -self.code * margin)).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return self.langs[order[0]], float(min(1.0, p[order[0]])), float(p[order[0]] - p[order[1]])


def _fit_scale(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float, float]:
    """Logistic scale and shift of one margin by damped Newton steps; reliability is 2 * accuracy - 1."""
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(-(a * x + c), -30, 30)))
        g, w = p - (y > 0), p * (1 - p) + 1e-9
        n = len(x)
        ga, gc = (g * x).mean() + 1e-3 * a, g.mean() + 1e-4 * c
        haa, hac, hcc = (w * x * x).mean() + 1e-3, (w * x).mean(), w.mean() + 1e-4
        det = max(haa * hcc - hac * hac, 1e-12)
        a, c = a - np.clip((hcc * ga - hac * gc) / det, -5, 5), c - np.clip((haa * gc - hac * ga) / det, -5, 5)
    right = ((a * x + c > 0) == (y > 0)).mean()
    return float(a), float(c), float(max(0.05, 2 * right - 1))


def labelled_sample(docs: DataFrame, allowed: Column, per_language: int):
    """Profiles and languages of at most about per_language texts a language, by a hash of doc_id and text."""
    pool = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & allowed).select("lang", "text", F.xxhash64(F.lit("langid"), "doc_id", "text").alias("_key"))
    counts = {r["lang"]: r["count"] for r in pool.groupBy("lang").count().collect()}  # one row a language
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    picked = pool.filter(F.pmod("_key", F.lit(1_000_000)) / F.lit(1_000_000.0) < share).groupBy("lang", "_key").agg(F.min("text").alias("text"))

    @F.arrow_udf("struct<hit array<int>, share array<float>>")
    def profiles(column: pa.Array) -> pa.Array:
        found = [profile(x.as_py()) for x in column]
        kinds = (pa.list_(pa.int32()), pa.list_(pa.float32()))
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], kinds[k]) for k in (0, 1)], ["hit", "share"])

    rows = picked.select("lang", "_key", profiles("text").alias("p")).select("lang", "_key", "p.*").toArrow()
    keys, langs = rows["_key"].to_pylist(), rows["lang"].to_pylist()
    order = sorted(range(len(keys)), key=lambda i: (keys[i], langs[i]))
    hits, shares = _lists(rows["hit"]), _lists(rows["share"])
    return [(hits[i], shares[i]) for i in order], [langs[i] for i in order]


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Lists of numbers as views of the column's own buffers: no object a number on the driver."""
    return [v for c in column.chunks if len(c) for v in np.split(c.flatten().to_numpy(), (c.offsets.to_numpy() - c.offsets[0].as_py())[1:-1])]


def train(docs: DataFrame, allowed: Column | None = None, per_language: int = 600) -> EccModel:
    """Learn from text and non-null lang of the allowed rows; the bound keeps the driver's share the same at every size."""
    return EccModel.fit(*labelled_sample(docs, F.lit(True) if allowed is None else allowed, per_language))


def identify(df: DataFrame, model: EccModel, lead: float = 0.1, text: str = "text", names=("lang_pred", "score", "ambiguous")) -> DataFrame:
    """df with the language, the score, and whether its lead is under `lead`, under `names`."""
    held = df.sparkSession.sparkContext.broadcast(model)  # DIM x bits floats: bounded by the number of languages

    @F.arrow_udf("struct<lang_pred string, score double, ambiguous boolean>")
    def run(column: pa.Array) -> pa.Array:
        found = [held.value.decode(x.as_py()) for x in column]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] < lead for f in found], pa.bool_())],
            ["lang_pred", "score", "ambiguous"],
        )

    found = unused(df, "_found")
    out = df.withColumn(found, run(F.col(text)))
    return out.withColumns({n: F.col(found)[k] for n, k in zip(names, ("lang_pred", "score", "ambiguous"))}).drop(found)


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = fold(F.col("doc_id"), 3) == 1
    model = train(docs.select("doc_id", "text", "lang"), ~out)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")
