"""Exact top-k search by multi-resolution segment statistics.

Each component x becomes floor(256 * x); a score is the integer inner product. Split both vectors into equal segments; with a
segment's mean m and deviation d (times the root of its length), its share of the product is at most len * m_q * m_v +
d_q * d_v (Cauchy-Schwarz on what remains without the means). The sum over segments bounds the score from above, which bounds
the distance from below; halving segments tightens it. A task takes a block of vectors and a block of queries: a small part
is scored exactly to start each query's threshold, the others pass the coarse bounds, then finer ones, and only survivors
are scored. The k best are merged by query within a task, whose later blocks start from the threshold reached, then over all tasks.

Queries are a stated set and meet all vectors in blocks, each a packed row. Both sides are tables of blocks, and a task reads one
partition of each: nothing is copied into a shuffle or sent to the driver, whatever the number of queries. Components are kept as
32-bit integers if a block allows it, else as doubles, which hold floor(256 * x) exactly; scores are taken in doubles while they
stay below 2^53, else in integers of any size.

Defined results: vectors that are null or empty, or hold a null, NaN or infinite component, or whose id is null take no part;
vectors of each length meet those of the same length; an empty table gives no rows; equal scores are ranked by id; repeated ids
are vectors of their own (all but rows with the query's own id are candidates); a score that no long holds becomes the nearest
one that does, after the ranking. Other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize, read_table, spread

K, EVERY, VECTORS, QUERIES, LEVELS = 5, 50, 4096, 1024, (1, 4, 16)
PACKED = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("data", T.BinaryType())])


def to_integers(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(ok, matrices by length): floor(256 * x) of the usable vectors."""
    ok, out = np.zeros(len(column), bool), {}
    lengths = np.array([-1 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    for size in {int(x) for x in lengths if x > 0}:
        rows = np.flatnonzero(lengths == size)
        flat = column.take(pa.array(rows)).flatten()
        x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
        fine = np.isfinite(x).all(axis=1)
        ok[rows[fine]] = True
        out[size] = (rows[fine], np.floor(256 * x[fine]))
    return ok, out


def pack(data: np.ndarray) -> bytes:
    """Whole numbers held in doubles, as 32-bit integers if all fit."""
    return b"i" + data.astype("<i4").tobytes() if (abs(data) < 1 << 31).all() else b"f" + data.astype("<f8").tobytes()


def unpack(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(blob, "<i4" if blob[:1] == b"i" else "<f8", offset=1).reshape(-1, size).astype(np.float64)


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Vectors packed into rows of at most `rows` of them, all of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def put(size: int, parts: list) -> pa.RecordBatch:
            ids, data = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([pack(data)], pa.binary())], names=PACKED.names)

        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=object)
            for size, (at, data) in to_integers(batch.column(1))[1].items():
                known = np.array([ids[i] is not None for i in at], bool)
                at, data = ids[at[known]].astype(np.int64), data[known]
                while len(at):
                    parts = held.setdefault(size, [])
                    room = rows - sum(len(p[0]) for p in parts)
                    parts.append((at[:room], data[:room]))
                    at, data = at[room:], data[room:]
                    if sum(len(p[0]) for p in parts) == rows:
                        yield put(size, held.pop(size))
        for size, parts in held.items():
            yield put(size, parts)

    return vectors.mapInArrow(run, PACKED)


class Bounds:
    """Segment statistics at each level, scaled so that two sides' dot product is the upper bound of the score."""

    def __init__(self, x: np.ndarray):
        self.levels = []
        for n in LEVELS:
            if x.shape[1] % n == 0:
                seg = x.reshape(len(x), n, -1).astype(np.float64)
                size = seg.shape[2]
                mean = seg.mean(axis=2)
                rest = np.sqrt(np.maximum((seg * seg).sum(axis=2) - size * mean * mean, 0))
                self.levels.append(np.hstack([mean * np.sqrt(size), rest]))


def search(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the k best vectors of the block for each query, of whole numbers held in doubles; ties go to smaller ids.
    least: scores that each query has k of already, so that lower ones needn't be returned."""
    order = np.argsort(v_ids, kind="stable")
    v_ids, v = v_ids[order], v[order]
    most = float(abs(q).max(initial=0)) * float(abs(v).max(initial=0)) * q.shape[1]
    exact, slack = most < 2.0**53, 0.5 + (0 if most < 2.0**53 else 1e-9 * most)
    whole = None if exact else [[int(x) for x in row] for row in v]
    bq, bv = Bounds(q).levels, Bounds(v).levels
    probe = min(len(v), 16 * k + 1)
    start = np.argsort(-(v * v).sum(axis=1), kind="stable")[:probe]  # long vectors are likely to score high
    known = q @ v[start].T
    known[q_ids[:, None] == v_ids[start][None, :]] = -np.inf
    floor = np.partition(known, len(start) - k, axis=1)[:, len(start) - k] - (slack - 0.5) if len(start) >= k else np.full(len(q), -np.inf)
    if least is not None and exact:
        floor = np.maximum(floor, least)
    out_q, out_v, out_s = [], [], []
    alive = q_ids[:, None] != v_ids[None, :]
    for a, b in zip(bq, bv):
        on = np.flatnonzero(alive.sum(axis=1) > 4 * k)
        if len(on):
            alive[on] &= a[on] @ b.T + slack >= floor[on, None]
    scores = q @ v.T if exact and alive.mean() > 0.1 else None
    for i in np.flatnonzero(alive.any(axis=1)):
        at = np.flatnonzero(alive[i])
        if exact:
            score = v[at] @ q[i] if scores is None else scores[i, at]
            if len(at) > k:
                best = np.partition(score, len(at) - k)[len(at) - k]
                keep = score >= best
                at, score = at[keep], score[keep]
            first = np.lexsort((v_ids[at], -score))[:k]
            score = score[first].astype(np.int64)
        else:
            own = [int(x) for x in q[i]]
            score = [sum(x * y for x, y in zip(own, whole[j])) for j in at]
            first = np.array(sorted(range(len(at)), key=lambda j: (-score[j], v_ids[at[j]]))[:k], np.int64)
            score = np.array([min(max(score[j], -(1 << 63)), (1 << 63) - 1) for j in first], np.int64)
        out_q.append(np.full(len(first), q_ids[i])), out_v.append(v_ids[at[first]]), out_s.append(score)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (out_q, out_v, out_s))


def merged(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query over several results of `search`, by query."""
    q, v, s = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((v, ~s, q))  # ~s falls as s grows, for any long
    q, v, s = q[order], v[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], v[place < k], s[place < k]


def kth(found: tuple, q_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score so far of each query, or minus infinity."""
    q, _, s = merged([found], k)
    end = np.searchsorted(q, q_ids, "right")
    full = end - np.searchsorted(q, q_ids) == k
    return np.where(full, s[end - 1], -np.inf) if len(q) else np.full(len(q_ids), -np.inf)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, vector_rows: int = VECTORS, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) from two tables (vec_id, embedding)."""
    cast = lambda t: t.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    parts = max(1, -(-queries.count() // query_rows))
    q = materialize(blocks(cast(queries).repartition(parts, "vec_id"), query_rows).select(F.struct("*").alias("q")), "query-blocks")
    if q.isEmpty():
        return q.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    v = materialize(blocks(cast(vectors), vector_rows).select(F.struct("*").alias("v")), "vector-blocks")
    v = v.coalesce(-(-spread(vectors) // q.rdd.getNumPartitions()))  # a task for each pair of partitions; each of v sends k rows a query on
    met = v.hint("shuffle_replicate_nl").join(q, v["v.size"] == q["q.size"])
    met = met.select(F.col("q.size").alias("size"), F.col("q.ids").alias("qi"), F.col("q.data").alias("qd"), F.col("v.ids").alias("vi"), F.col("v.data").alias("vd"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], tuple] = {}
        for batch in batches:
            for size, qi, qd, vi, vd in zip(*(batch.column(i) for i in range(5))):
                size, key = size.as_py(), (size.as_py(), qi.as_py())
                ids = lambda x: np.frombuffer(x.as_py(), "<i8")
                data = lambda x: unpack(x.as_py(), size)
                found = search(ids(qi), data(qd), ids(vi), data(vd), k, kth(held[key], ids(qi), k) if key in held else None)
                held[key] = merged([held[key], found], k) if key in held else found
        for found in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    best = met.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_aggregate(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), 'bool_and')),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
