"""LM scoring: stupid-backoff scores from n-gram counts of the corpus itself.

Word i scores c(w[i-2..i]) / c(w[i-2..i-1]) if that trigram's count reaches `min_count`, else 0.4 * c(w[i-1..i]) / c(w[i-1])
if the bigram's does, else 0.4^2 * c(w[i]) / N; the first words start at the order they have. The counts are those of
all documents, whole texts, and grow with them. A document's score is the sum of the natural logarithms, each rounded to a
millionth, so that sums don't depend on their order.

Relationally: n-grams (order, hash) are exploded from chunks of documents and summed within a chunk; the count table is
partitioned by hash, and each chunk's n-grams join it there; the counts return to the chunk, where its words are scored and
summed by document. Rows are packed: one holds the n-grams of a chunk that fall in one hash range, as sorted 64-bit values less the range's first, so
a common n-gram is one value for each chunk, however hot it is. Unigrams and bigrams are counted first, and with them the empty
n-gram, once for each word, whose count is N; a trigram is sent only
if the bigrams that it begins and ends with reach `min_count`, as it can't be more frequent than they are. A chunk is a hash class of documents, sent as compressed tables; `chunk_chars` and
`range_grams` set how many classes and hash ranges there are from the corpus's size, so that either fits a task at any size.

Defined results: null and empty texts have 0 words and score 0; repeated rows are counted and scored each; an empty table gives
no rows; null doc_ids are documents like others. Columns besides doc_id and text are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import P1, U64, hash_texts, mix, pack_ascending, read_table, unpack_ascending

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
CHUNK_CHARS, RANGE_GRAMS = 12_000_000, 4_000_000
PACKED_BYTES = 48 << 20  # of rows that a task holds before it packs them by chunk
EMPTY = mix(np.array([0xE3779B97F4A7C15], np.uint64))[0]  # stands for the n-gram of no words, which occurs once for each word
GRAMS = T.StructType([T.StructField("level", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("grams", T.BinaryType()), T.StructField("counts", T.BinaryType())])


class Words:
    """The words of a chunk's documents: their hashes, place in the document, and n-grams that end at each."""

    def __init__(self, texts: list[pa.Array]):
        parts = [hash_texts(c) for c in texts]
        self.words, self.n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        self.first = np.cumsum(self.n) - self.n
        self.place = np.arange(len(self.words)) - np.repeat(self.first, self.n)

    def of(self, k: int, among: np.ndarray | None = None) -> np.ndarray:
        """The n-grams of order k, or those that end at the words among."""
        h = self.words
        for _ in range(k - 1):  # where place < k - 1 it holds words of two documents, and is not read
            h = np.concatenate((h[:1], h[:-1] * P1 + self.words[1:]))
        return mix(h[self.place >= k - 1 if among is None else among] + U64(k))


def _count(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs."""
    grams = np.sort(grams)
    start = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
    return grams[start], np.diff(np.concatenate((start, [len(grams)])))


def _back(grams: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each value, what is known of it; known follows the distinct values in ascending order."""
    by = np.argsort(grams)
    grams = grams[by]
    out = np.empty(len(grams), known.dtype)
    if len(grams):
        out[by] = known[np.concatenate(([0], np.cumsum(grams[1:] != grams[:-1])))]
    return out


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts in one byte each; those of 255 and more follow in eight."""
    return len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def _unpack_counts(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    counts = np.frombuffer(blob, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, "<u8", offset=8 + n).astype(np.int64)
    return counts


def _of_chunks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of a key column, from batches sorted by it."""
    held, value = [], None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and keys[a] != value:
                yield pa.Table.from_batches(held)
                held = []
            value = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, doc_id, text) as compressed tables (doc_id, text), one for each chunk that a stretch of the input has rows of."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")

    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        chunk = table.column("chunk").to_numpy()
        by = np.argsort(chunk, kind="stable")
        table, chunk = table.select(["doc_id", "text"]).take(pa.array(by)), chunk[by]
        edges = np.concatenate(([0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, [len(chunk)]))
        for some in np.array_split(np.arange(len(edges) - 1), range(200, len(edges) - 1, 200)):
            blobs = []
            for i in some:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                    out.write_table(table.slice(edges[i], edges[i + 1] - edges[i]))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(chunk[edges[some]]), pa.array(blobs, pa.binary())], names=["chunk", "docs"])

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            held.append(batch.slice(at, 2048))
            size += held[-1].nbytes
            if size >= PACKED_BYTES:
                yield from rows(held)
                held, size = [], 0
    if size:
        yield from rows(held)


def _docs(packed: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for c in packed.column("docs").chunks for x in c])


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, chunk_chars: int = CHUNK_CHARS, range_grams: int = RANGE_GRAMS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, log_score (sum), mean_log_score, n_unseen (words that backed off)."""
    size = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    chars = (size[0] or 0) + 16 * size[1]
    n_chunks, n_ranges = max(1, -(-chars // chunk_chars)), max(1, -(-chars * order // 6 // range_grams))
    tables = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    source = source.mapInArrow(_packed, "chunk long, docs binary").repartition(max(tables, min(n_chunks, 20_000)), "chunk").sortWithinPartitions("chunk")
    step = (1 << 64) // n_ranges + 1

    def sent(level: int, chunk: int, grams: np.ndarray, counts: np.ndarray) -> pa.Table:
        """A chunk's n-grams of a level, in rows by hash range."""
        edges = np.searchsorted(grams, np.array([i * step for i in range(n_ranges)], np.uint64))
        rows = [(level, i, chunk, pack_ascending(grams[a:b] - U64(i * step)), _pack_counts(counts[a:b])) for i, (a, b) in enumerate(zip(edges, [*edges[1:], len(grams)])) if b > a]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _ARROW)], names=GRAMS.names)

    both = min(2, order)

    def first_levels(words: Words) -> tuple[np.ndarray, int]:
        """The n-grams of the first levels, and where the empty n-gram stands among their distinct values."""
        flat = np.concatenate([words.of(k) for k in range(1, both + 1)])
        return flat, int(np.searchsorted(_count(flat)[0], EMPTY))

    def counts_by_word(words: Words, replies: pa.Table, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """(c, wanted): c[k] is the count of the n-gram of order k that ends at each word, 0 where there is none or it can't reach
        min_count; wanted: words whose n-gram of order levels + 1 may reach min_count."""
        known: dict[int, list] = {}
        for level, bucket, counts in zip(*(replies.column(c).to_pylist() for c in ("level", "bucket", "counts"))):
            known.setdefault(level, []).append((bucket, counts))
        known = {k: np.concatenate([_unpack_counts(x) for _, x in sorted(v)]) for k, v in known.items()}
        c = np.zeros((order + 1, len(words.place)), np.int64)
        flat, at = first_levels(words)
        c[0] = known[both][at]
        found, at = _back(flat, np.delete(known[both], at)), 0
        for k in range(1, both + 1):
            there = words.place >= k - 1
            c[k][there] = found[at : (at := at + int(there.sum()))]
        wanted = np.zeros(len(words.place), bool)
        for k in range(both + 1, levels + 2):  # an n-gram is at most as frequent as what it begins and ends with
            often = c[k - 1] >= min_count
            wanted = (words.place >= k - 1) & often & np.concatenate(([False], often[:-1]))[: len(often)]
            if k <= levels:
                c[k][wanted] = _back(words.of(k, wanted), known.get(k, c[0][:0]))
        return c, wanted

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _of_chunks(batches, "chunk"):
            words = Words(_docs(table).column("text").chunks)
            flat, at = first_levels(words)
            grams, counts = _count(flat)
            yield from sent(both, table.column("chunk")[0].as_py(), np.insert(grams, at, EMPTY), np.insert(counts, at, int(words.n.sum()))).to_batches()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _of_chunks(batches, "bucket"):
            chunks = table.column("chunk").to_pylist()
            grams = [unpack_ascending(x.as_py()) for x in table.column("grams")]
            counts = [_unpack_counts(x.as_py()) for x in table.column("counts")]
            all_grams, all_counts = np.concatenate(grams), np.concatenate(counts)
            by = np.argsort(all_grams, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], all_grams[by][1:] != all_grams[by][:-1])))
            back = np.empty(len(by), np.int64)
            back[by] = np.repeat(np.add.reduceat(all_counts[by], start), np.diff(np.concatenate((start, [len(by)]))))
            at = 0
            for row, (chunk, g) in enumerate(zip(chunks, grams)):
                one = [table.column(c)[row : row + 1].combine_chunks() for c in ("level", "bucket")]
                yield pa.RecordBatch.from_arrays(one + [pa.array([chunk]), pa.nulls(1, pa.binary()), pa.array([_pack_counts(back[at : at + len(g)])], pa.binary())], names=GRAMS.names)
                at += len(g)

    def totals(grams: DataFrame) -> DataFrame:
        ranged = grams.repartition(max(tables, min(n_ranges, 20_000)), "bucket").sortWithinPartitions("bucket", "chunk")
        return ranged.mapInArrow(total, GRAMS).select("level", "chunk", "bucket", "counts")

    def next_level(level: int):
        def pick(docs_of: pa.Table, replies: pa.Table) -> pa.Table:
            words = Words(_docs(docs_of).column("text").chunks)
            _, wanted = counts_by_word(words, replies, level - 1)
            return sent(level, docs_of.column("chunk")[0].as_py(), *_count(words.of(level, wanted)))

        return pick

    chunks = source.groupBy("chunk")
    answers = totals(source.mapInArrow(count, GRAMS))
    for level in range(3, order + 1):
        answers = answers.unionByName(totals(chunks.cogroup(answers.groupBy("chunk")).applyInArrow(next_level(level), GRAMS)))
    names = ["doc_id", "n_words", "log_score", "mean_log_score", "n_unseen"]
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("mean_log_score", T.DoubleType()), T.StructField("n_unseen", T.LongType())])

    def score(docs_of: pa.Table, replies: pa.Table) -> pa.Table:
        docs = _docs(docs_of)
        words = Words(docs.column("text").chunks)
        c, _ = counts_by_word(words, replies, order)
        place, first, n = words.place, words.first, words.n
        value, unseen = np.zeros(len(place)), np.zeros(len(place), np.int64)
        left = np.ones(len(place), bool)
        for k in range(order, 0, -1):  # the context of an n-gram ends one word earlier
            before = c[0] if k == 1 else np.concatenate(([0], c[k - 1][:-1]))[: len(place)]
            ok = left & (place >= k - 1) & (c[k] >= (min_count if k > 1 else 1))
            cost = np.minimum(order, place + 1) - k
            value[ok] = alpha ** cost[ok] * (c[k][ok] / before[ok])
            unseen[ok] = cost[ok] > 0
            left &= ~ok
        micro = np.floor(np.log(value, where=value > 0, out=np.zeros(len(place))) * 1e6 + 0.5).astype(np.int64)
        total, backed = (np.concatenate(([0], np.cumsum(x)))[[first, first + n]] for x in (micro, unseen))
        total, backed = total[1] - total[0], backed[1] - backed[0]
        mean = np.floor(total / np.maximum(n, 1) + 0.5) / 1e6
        return pa.table([docs.column("doc_id"), pa.array(n), pa.array(total / 1e6), pa.array(mean), pa.array(backed)], names=names)

    return chunks.cogroup(answers.groupBy("chunk")).applyInArrow(score, out)


_ARROW = [pa.field("level", pa.int64()), pa.field("bucket", pa.int64()), pa.field("chunk", pa.int64()), pa.field("grams", pa.binary()), pa.field("counts", pa.binary())]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read_table(spark, sf_dir, "documents"))


SQL = rf"""
WITH word AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, i, w[i] AS w3, CASE WHEN i > 1 THEN w[i - 1] END AS w2, CASE WHEN i > 2 THEN w[i - 2] END AS w1
        FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM word WHERE len(w) > 0)),
c1 AS (SELECT w3, count(*) AS n FROM pos GROUP BY ALL),
c2 AS (SELECT w2, w3, count(*) AS n FROM pos WHERE i > 1 GROUP BY ALL),
c3 AS (SELECT w1, w2, w3, count(*) AS n FROM pos WHERE i > 2 GROUP BY ALL),
total AS (SELECT count(*) AS n FROM pos),
seen AS (
  SELECT p.doc_id, p.i, t.n AS t, b12.n AS b12, b23.n AS b23, u2.n AS u2, u3.n AS u3, (SELECT n FROM total) AS n
  FROM pos p LEFT JOIN c3 t ON p.w1 = t.w1 AND p.w2 = t.w2 AND p.w3 = t.w3 LEFT JOIN c2 b12 ON p.w1 = b12.w2 AND p.w2 = b12.w3
  LEFT JOIN c2 b23 ON p.w2 = b23.w2 AND p.w3 = b23.w3 LEFT JOIN c1 u2 ON p.w2 = u2.w3 JOIN c1 u3 ON p.w3 = u3.w3),
score AS (
  SELECT doc_id, i, CASE WHEN t >= {MIN_COUNT} THEN 3 WHEN b23 >= {MIN_COUNT} THEN 2 ELSE 1 END AS used,
         CASE WHEN t >= {MIN_COUNT} THEN t::DOUBLE / b12 WHEN b23 >= {MIN_COUNT} THEN b23::DOUBLE / u2 ELSE u3::DOUBLE / n END AS s FROM seen),
doc AS (
  SELECT doc_id, count(*) AS n, sum(floor(ln(s * power({ALPHA}, least(3, i) - used)) * 1e6 + 0.5)::BIGINT) AS total, count(*) FILTER (WHERE used < least(3, i)) AS unseen
  FROM score GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(total, 0)::BIGINT / 1e6 AS log_score,
       coalesce(floor(total::DOUBLE / n + 0.5), 0) / 1e6 AS mean_log_score, coalesce(unseen, 0)::BIGINT AS n_unseen
FROM documents d LEFT JOIN doc USING (doc_id)
"""
