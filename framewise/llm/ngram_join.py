"""N-gram Jaccard join by PartEnum signatures.

A document's set: its distinct 5-word shingles (A-Z lower-cased, words between ASCII white space), as 64-bit hashes. Two sets
link when 100 * intersection >= 80 * union. Sizes are cut into bands, each 5/4 of the one before. Band j answers for the
pairs whose smaller set is in it; then the sets differ in at most k elements, k following from the band's largest sizes. The
domain is split by hash into n1 >= k + 1 parts; at most k parts hold a difference, so a set with k + 1 parts or more that
aren't empty agrees with any partner in one of them that isn't empty: that part's elements, hashed, are a shared signature.
Sets with fewer such parts also sign their empty parts, and so meet each other. No link is lost, whatever the data.

Signatures meet in one shuffle, packed by hash range. In each run of equal signatures every member is compared with the first and those just
before it; what that links is summed up to components, and members of different components are then compared in blocks.
Sizes and sketches (lower bounds of the difference) discard pairs before exact sets are fetched, and pairs that are
connected already need no exact check. Texts met twice in
a task are signed once.

Defined results: null, empty and blank texts have n_shingles 0 and are linked with nothing; a text of fewer than 5 words is
one shingle; repeated rows each give a row; rows with a null doc_id give a row without a component; an empty table gives
none. Where a doc_id stands on different texts, each text is a node of its own (numbered in order of doc_id, which shuffles the
texts once more) and those of one doc_id are in one component. Columns besides doc_id and text are ignored."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import U64, as_bytes, materialize, mix, ngrams, pieces, read_table, release, split_texts
from ._links import SENT, Sender, among, facts_of, find_runs, numbers, pack_set, ranges, resolve, sketches

WORDS, PERCENT = 5, 80
CHARS = 8  # bytes of text to a signature, about


class PartEnum:
    def __init__(self, percent: int = PERCENT, longest: int = 1 << 40):
        self.percent, self.lows = percent, [1]
        while self.lows[-1] < longest:
            self.lows.append(max(self.lows[-1] + 1, self.lows[-1] * 5 // 4))

    def bands(self, n: int) -> list[tuple[int, int]]:
        """(band, k) of the bands that a set of n elements signs for: its own, and those of smaller sets that it may link with."""
        j, out = bisect_right(self.lows, n) - 1, []
        while j >= 0:
            most = self.lows[j + 1] - 1
            if most * 100 // self.percent < n:
                break
            out.append((j, (most + most * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)))
            j -= 1
        return out

    def sign(self, elements: np.ndarray) -> np.ndarray:
        out, h = [], mix(elements ^ U64(0x5851F42D4C957F2D))
        low, high = (h & U64(0xFFFFFFFF)).astype(np.float64), (h >> U64(32)).astype(np.float64)
        for j, k in self.bands(len(elements)):
            if k == 0:
                parts, n1 = np.zeros(len(elements), np.int64), 1
            else:
                n1 = k + 2 + (k + 12) // 12
                parts = ((mix(elements + U64(2 * j + 1)) >> U64(32)) * U64(n1) >> U64(32)).astype(np.int64)
            filled = np.bincount(parts, minlength=n1) > 0
            signs = mix(np.bincount(parts, low, n1).astype(np.uint64) + mix(np.bincount(parts, high, n1).astype(np.uint64) + U64(j << 32) + np.arange(n1, dtype=np.uint64)))
            out.append(signs[filled] if filled.sum() > k else signs)
        return np.concatenate(out)


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The set of a sequence of word hashes."""
    return np.unique(ngrams(words, n))


def signatures(docs: DataFrame, percent: int, words: int, n_ranges: int) -> DataFrame:
    """Rows for find_runs of rows (node, text): signatures, and for each row its size, its sketch and the node that it is a copy of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, scheme, seen = Sender(n_ranges), PartEnum(percent), {}
        for whole in batches:
            for batch in pieces(whole, 1):
                sets = [shingles(w, words) for w in split_texts(batch.column(1))]
                nodes, copies = batch.column(0).to_pylist(), []
                sigs, of = [], []
                for node, e, text in zip(nodes, sets, as_bytes(batch.column(1))):
                    copy_of = None
                    if node is not None and len(e):
                        key = xxhash.xxh3_128_digest(text.as_buffer())
                        copy_of = seen.get(key)
                        if copy_of is None:
                            if len(seen) >= 200_000:
                                seen.clear()
                            seen[key] = node
                            sigs.append(scheme.sign(e)), of.append((node, len(sigs[-1]), len(e)))
                    copies.append(copy_of)
                sizes = np.array([len(e) for e in sets], np.int64)
                yield Sender.facts(nodes, sizes.tolist(), copies, sketches(np.concatenate(sets), sizes))
                if sigs:
                    node, times, n = np.array(of, np.int64).T
                    yield from sender.add(np.concatenate(sigs), np.repeat(node, times), np.repeat(n, times))
        yield from sender.flush()
        seen.clear()
        release()

    return docs.select("node", "text").mapInArrow(run, SENT)


def join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, n_shingles, component_id for each row of docs, and links (a, b, common, either) between nodes, enough to
    connect what is connected."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size, conflict, *_ = facts_of(docs)
    placed, ids = docs.withColumnRenamed("doc_id", "node"), None
    if conflict:
        docs = docs.withColumn("digest", F.xxhash64("text"))
        ids = materialize(numbers(docs, F.lit(1)), "ids")
        placed = docs.join(ids, ["doc_id", "digest"], "left").select(F.col("start").alias("node"), "text")
    found = materialize(find_runs(signatures(placed, percent, words, ranges(size // CHARS)), ranges(size // CHARS)), "runs")
    own = found.where("sig IS NULL")
    facts = own.where("node IS NOT NULL").groupBy("node").agg(F.max(F.struct("n", "sketch")).alias("x")).select("node", "x.n", "x.sketch")
    certain = own.where("copy_of IS NOT NULL").select(F.col("copy_of").alias("a"), F.col("node").alias("b"))
    if ids is not None:
        rest = ids.join(ids.groupBy("doc_id").agg(F.min("start").alias("low")), "doc_id").where("low < start")
        certain = certain.unionByName(rest.select(F.col("low").alias("a"), F.col("start").alias("b")))

    def sets_of(nodes: DataFrame) -> DataFrame:
        fetched = among(placed, F.col("node"), nodes, F.col("node"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, 1):
                    sets = [pack_set(shingles(w, words)) for w in split_texts(batch.column(1))]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "elements"])
            release()

        return fetched.where("node IS NOT NULL").mapInArrow(run, "node long, elements binary").dropDuplicates(["node"])

    comps, links = resolve(found, facts, sets_of, certain, percent)
    out = own.select("node", "n").join(comps.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("node", F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("comp"))
    if ids is None:
        return out.select(F.col("node").alias("doc_id"), "n_shingles", F.col("comp").alias("component_id")), links
    of = lambda node, doc: ids.select(F.col("start").alias(node), F.col("doc_id").alias(doc))
    return out.join(of("node", "doc_id"), "node", "left").join(of("comp", "component_id"), "comp", "left").select("doc_id", "n_shingles", "component_id"), links


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """docs without those that reach a document with a smaller doc_id; rows that repeat a doc_id stay or go together."""
    components, _ = join(docs, percent, words)
    gone = components.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(materialize(gone, "gone"), F.col("doc_id") == F.col("__gone"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents"))[0]


SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM word WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN size p ON p.doc_id = a.doc_id JOIN size q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN size s USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id
"""
