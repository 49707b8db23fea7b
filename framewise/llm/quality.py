"""Quality classifier: a factorisation machine over hashed words and structure statistics of the text.

score(x) = sigmoid(w0 + w.x + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise interactions at a cost
linear in the number of features. Scoring is one Arrow pass over the texts without a shuffle.

The machine is fitted on at most `train_rows` labelled rows (a documented bound; those with the smallest hash of their
id, repeated rows among them), which are the only rows that reach the driver. Labels, lang, source and doc_id are never inputs.

Defined results: a null text scores as an empty one; repeated rows score alike; an empty table gives no rows; rows whose
label is null, other than 0 or 1, or contradictory are not learnt from; without any usable label every score is 0.5.
A column named like a result column is replaced by it; other columns stay."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_texts, ngrams, read_table, split_texts

N_STATS = 16


@dataclass(frozen=True)
class Params:
    buckets: int = 2048  # of hashed words
    factors: int = 8
    train_rows: int = 8000  # bound on the labelled rows that are fitted on
    steps: int = 500
    batch: int = 128
    rate: float = 0.02
    decay: float = 1e-4
    threshold: float = 0.3
    seed: int = 7


@dataclass(frozen=True)
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        x = standard(x, self.mean, self.scale)
        return 1 / (1 + np.exp(-np.clip(raw_score(x, self.w0, self.w, self.v), -30, 30)))


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = x.copy()
    x[:, :N_STATS] = np.clip((x[:, :N_STATS] - mean) / scale, -4, 4)
    return x


def raw_score(x: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return w0 + x @ w + 0.5 * (((x @ v) ** 2) - (x * x) @ (v * v)).sum(axis=1)


_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_PUNCT = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_ODD = np.array([ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"])
_ENDS = np.array([ord(c) for c in ".!?"])


def features(texts: list[bytes | None], buckets: int) -> np.ndarray:
    """Rows of N_STATS statistics and `buckets` hashed words (log counts, unit length)."""
    out = np.zeros((len(texts), N_STATS + buckets), np.float32)
    for i, (text, h) in enumerate(zip(texts, split_texts(pa.array(texts, pa.binary())))):
        text = text or b""
        count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        n, size = max(1, len(h)), max(1, len(text))
        letters = max(1, int(count[_UPPER].sum() + count[_LOWER].sum()))
        pairs = ngrams(h, 2) if len(h) > 1 else h
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[i, :N_STATS] = (
            np.log1p(size), np.log1p(len(h)), np.log1p(len(lines)), size / n, np.log1p(n / max(1, len(lines))),
            count[_UPPER].sum() / letters, count[_DIGIT].sum() / size, count[_PUNCT].sum() / n, count[_ODD].sum() / n, count[_ENDS].sum() / n,
            count[128:].sum() / size, len(np.unique(h)) / n, len(np.unique(pairs)) / n, float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0,
            len(set(lines)) / max(1, len(lines)), np.sqrt(np.bincount((h % np.uint64(1024)).astype(np.int64)).max() / n) if len(h) else 0.0,
        )
        if len(h):
            x = np.log1p(np.bincount((h % np.uint64(buckets)).astype(np.int64), minlength=buckets)).astype(np.float32)
            out[i, N_STATS:] = x / np.sqrt((x * x).sum())
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, p: Params) -> Machine:
    """Log loss by Adam over random batches; the same rows give the same machine."""
    rng = np.random.default_rng(p.seed)
    d = x.shape[1]
    if not len(y):
        return Machine(0.0, np.zeros(d, np.float32), np.zeros((d, p.factors), np.float32), np.zeros(N_STATS, np.float32), np.ones(N_STATS, np.float32))
    mean, scale = x[:, :N_STATS].mean(axis=0), x[:, :N_STATS].std(axis=0) + 1e-3
    x = standard(x, mean, scale)
    rate = np.clip(y.mean(), 0.01, 0.99)
    theta = [np.array([np.log(rate / (1 - rate))], np.float32), np.zeros(d, np.float32), rng.normal(0, 0.01, (d, p.factors)).astype(np.float32)]
    m, s = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, p.steps + 1):
        k = rng.integers(0, len(y), p.batch)
        xb, yb = x[k], y[k]
        xv = xb @ theta[2]
        out = theta[0][0] + xb @ theta[1] + 0.5 * ((xv**2) - (xb * xb) @ (theta[2] ** 2)).sum(axis=1)
        e = ((1 / (1 + np.exp(-np.clip(out, -30, 30)))) - yb).astype(np.float32) / p.batch
        grads = [np.array([e.sum()], np.float32), xb.T @ e + p.decay * theta[1], xb.T @ (e[:, None] * xv) - theta[2] * ((xb * xb).T @ e)[:, None] + p.decay * theta[2]]
        now = p.rate * (1 - 0.9 * step / p.steps)
        for t, g, a, b in zip(theta, grads, m, s):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            t -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Machine(float(theta[0][0]), theta[1], theta[2], mean, scale)


def is_held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Machine:
    """Fit on at most p.train_rows rows of docs that have one clear label and are not held out."""
    clear = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~is_held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("__y"), F.max("quality").alias("__max")).where("__y = __max")
        .select(F.col("doc_id").alias("__id"), "__y").orderBy(F.xxhash64("__id"), "__id").limit(p.train_rows)
    )
    # At most p.train_rows rows of two numbers, so it may be broadcast.
    rows = docs.select(F.col("doc_id").alias("__doc"), F.col("text").alias("__t")).join(F.broadcast(clear), F.col("__doc") == F.col("__id"))
    rows = rows.select("__id", "__y", "__t")
    buckets = p.buckets

    def sparse(texts: list) -> list:
        x = features(texts, buckets)
        at = [np.flatnonzero(r) for r in x]
        return [[k.astype(np.int32).tobytes() for k in at], [r[k].tobytes() for r, k in zip(x, at)]]

    fields = [T.StructField("__k", T.BinaryType()), T.StructField("__v", T.BinaryType())]
    # An id that many rows of docs repeat doesn't widen the bound.
    got = map_texts(rows, sparse, fields, text="__t", keep=["__id", "__y"]).orderBy(F.xxhash64("__id"), "__id", "__k", "__v").limit(p.train_rows).collect()
    got = sorted(got, key=lambda r: (r["__id"], bytes(r["__k"]), bytes(r["__v"])))
    x = np.zeros((len(got), N_STATS + buckets), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["__k"], np.int32)] = np.frombuffer(r["__v"], np.float32)
    return fit_machine(x, np.array([r["__y"] for r in got], np.float32), p)


def score(docs: DataFrame, machine: Machine, p: Params = Params(), keep: list[str] | None = None) -> DataFrame:
    """docs with `score` (0 to 1, higher: better) and `predicted` (1 if score >= p.threshold)."""
    buckets, threshold = p.buckets, p.threshold

    def run(texts: list) -> list:
        s = machine.score(features(texts, buckets)).astype(np.float64)
        return [s.tolist(), (s >= threshold).astype(np.int32).tolist()]

    return map_texts(docs, run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], keep=keep)


def keep_good(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    scored = docs.withColumnsRenamed({c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in ("score", "predicted")})
    own = [F.col(f"`{a}`").alias(b) for a, b in zip(scored.columns, docs.columns)]
    return score(scored, fit(docs, labels, p), p).where("predicted = 1").select(*own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, read_table(spark, sf_dir, "labels"))
    scored = score(docs, machine, keep=["doc_id"])
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
