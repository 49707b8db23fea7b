"""Substring dedup: repeated paragraphs by MinHash banding, and repeated passages inside paragraphs.

Paragraphs (between line ends) of `least_words` words or more: 36 minima of their 5-word shingles in 12 bands of 3 put two
paragraphs of similarity 0.8 in one band with probability 0.9998. In each run of equal bands every member is compared with
the first and those just before it, then members of different components with each other; exact Jaccard similarity of the
shingle sets (0.8 or more) decides. Components of these links are clusters: the paragraph with the smallest (doc_id, place)
stays, the others are removals.

A passage that was put inside other text shares no paragraph. So each document's words are also cut where the hash of three
words is the least within `reach` words either way; the same passage is cut alike wherever it stands. A unit between two cuts
that stood before, in an earlier place, is repeated; repeated units that follow one another with `least_passage` words or
more are removals too. Both kinds meet in one shuffle of signatures, packed by hash range, to which a collection of a task sends
a few members of a very frequent paragraph or passage only.

Defined results: null, empty and short texts have no removals; of repeated rows (equal doc_id and text) one stands for all;
rows with a null doc_id take no part; an empty table gives no rows. Where a doc_id stands on different texts, removals of each are
given under that id (clean() expects one text for an id). Other columns are ignored.

A node is a place in a document as one long. Where doc_ids are below 2^41 in size, none stands on different texts and texts are
below 8 MB it is doc_id * 2^22 + the place; else (doc_id, text) get numbers in order of doc_id, long ones several in a row, so every
doc_id, every text and every word has a node, in the same order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import U64, as_bytes, bytes_of, hash_texts, materialize, mix, ngrams, pieces, read_table, words_in
from ._links import SENT, Sender, among, facts_of, find_runs, numbers, pack_set, ranges, resolve, sketches

WORDS, PERCENT, BANDS, ROWS = 5, 80, 12, 3
LEAST_WORDS, LEAST_PASSAGE, REACH = 20, 24, 4
PLACES = 1 << 22  # places under one number of a document
CHARS = 12  # bytes of text to a signature, about
_A = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | U64(1)


def cuts(words: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Places before which a sequence of word hashes is cut, by what stands around them."""
    g = ngrams(words, 3)
    if len(words) < 2 * reach:
        return np.zeros(0, np.int64)
    top = np.full(reach, ~U64(0))
    low = np.lib.stride_tricks.sliding_window_view(np.concatenate((top, g, top)), reach)
    before, after = low[: len(g)].min(axis=1), low[reach + 1 : reach + 1 + len(g)].min(axis=1)
    return np.flatnonzero((g < before) & (g <= after))


def paragraphs(column: pa.Array) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
    """Of each text: the word hashes, and (first word, words) of each of its lines that has words."""
    words, n = hash_texts(column)
    data, offsets = bytes_of(column) if len(words) else (np.zeros(0, np.uint8), np.zeros(len(n) + 1, np.int64))
    line = np.searchsorted(np.flatnonzero(data == 10), words_in(data, offsets)[0]) if len(words) else np.zeros(0, np.int64)
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist()):
        own = line[a:b]
        start = np.flatnonzero(np.concatenate(([b > a], own[1:] != own[:-1])))
        yield words[a:b], list(zip(start.tolist(), np.diff(np.append(start, b - a)).tolist()))


def min_bands(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures (one row for each set) of BANDS bands of ROWS minima."""
    flat = np.concatenate(sets)
    start = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((BANDS, len(sets)), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sets), U64(b))
        for r in range(ROWS):
            h = mix(h + np.minimum.reduceat(flat * _A[b * ROWS + r] ^ (flat * _A[b * ROWS + r] >> U64(29)), start))
        out[b] = h
    return out.T


def nodes_of(docs: DataFrame, low: int, high: int, longest: int, conflict: bool) -> tuple[DataFrame, DataFrame | None]:
    """((base, text), ids): base is the node of a text's first word; ids (number, __doc, base): a node belongs to the document with its
    number (node >> 22), at place node - base. ids is None if doc_ids can be the numbers."""
    if not conflict and low >= -(1 << 41) and high < 1 << 41 and longest < 2 * PLACES:
        return docs.select(F.shiftleft("doc_id", 22).alias("base"), "text"), None
    docs = docs.withColumn("digest", F.xxhash64("text"))
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")  # of two bytes a word at least, but for the last
    placed = materialize(numbers(docs, F.floor((length + 1) / (2 * PLACES)) + 1), "ids")
    ids = placed.select(F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("number"), F.col("doc_id").alias("__doc"), F.shiftleft("start", 22).alias("base"))
    texts = docs.join(placed, ["doc_id", "digest"]).select(F.shiftleft("start", 22).alias("base"), "text")
    return texts, materialize(ids, "ids")


def located(df: DataFrame, ids: DataFrame | None, node: str, doc: str, place: str) -> DataFrame:
    """df with the document and place of a node in its stead."""
    number = F.shiftright(node, 22)
    if ids is None:
        return df.withColumn(doc, number).withColumn(place, F.col(node).bitwiseAND(PLACES - 1)).drop(node)
    return df.withColumn("number", number).join(ids, "number").withColumn(doc, F.col("__doc")).withColumn(place, F.col(node) - F.col("base")).drop("number", "__doc", "base", node)


def signatures(texts: DataFrame, least_words: int, n_ranges: int) -> DataFrame:
    """Of rows (base, text). Units have their size as a negative number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, seen = Sender(n_ranges), {}
        for whole in batches:
            for batch in pieces(whole, 1):
                sets, nodes, copies, units = [], [], [], []
                for base, (words, places) in zip(batch.column(0).to_pylist(), paragraphs(batch.column(1))):
                    for first, n in places:
                        if n >= least_words:
                            w = words[first : first + n]
                            key = xxhash.xxh3_128_digest(w.tobytes())
                            if key in seen:
                                copies.append((base + first, seen[key]))
                                continue
                            if len(seen) >= 300_000:
                                seen.clear()
                            seen[key] = base + first
                            sets.append(np.unique(ngrams(w, WORDS)))
                            nodes.append(base + first)
                    edge = [0, *cuts(words).tolist(), len(words)]
                    raw = words.tobytes()
                    for a, b in zip(edge[:-1], edge[1:]):
                        if b - a > REACH:
                            units.append((xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]), base + a, a - b))
                if units:
                    u = list(zip(*units))
                    yield from sender.add(np.array(u[0], np.uint64), np.array(u[1], np.int64), np.array(u[2], np.int64))
                sizes = np.array([len(x) for x in sets], np.int64)
                if sets:
                    yield from sender.add(min_bands(sets).ravel(), np.repeat(np.array(nodes, np.int64), BANDS), np.repeat(sizes, BANDS))
                if sets or copies:
                    own, of = [list(x) for x in zip(*copies)] if copies else ([], [])
                    drawn = sketches(np.concatenate(sets), sizes) if sets else []
                    yield Sender.facts(nodes + own, sizes.tolist() + [0] * len(own), [None] * len(nodes) + of, drawn + [None] * len(own))
        yield from sender.flush()

    return texts.mapInArrow(run, SENT)


def paragraph_sets(texts: DataFrame, nodes: DataFrame, ids: DataFrame | None) -> DataFrame:
    """(node, elements) of paragraphs; a document's are fetched together."""
    wanted = located(nodes.distinct().select("node", F.col("node").alias("own")), ids, "own", "__of", "at")
    wanted = materialize(wanted.groupBy((F.col("node") - F.col("at")).alias("__base")).agg(F.collect_list("node").alias("nodes")), "wanted")  # at most a document's lines
    fetched = among(texts, F.col("base"), wanted, F.col("__base")).join(wanted, F.col("base") == F.col("__base")).select("text", "nodes", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 0):
                out = []
                for (words, places), want, base in zip(paragraphs(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    size = dict(places)
                    out += [(node, pack_set(np.unique(ngrams(words[at : at + size[at]], WORDS)))) for node in want if (at := node - base) in size]
                if out:
                    own, sets = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(sets, pa.binary())], names=["node", "elements"])

    return fetched.mapInArrow(run, "node long, elements binary").dropDuplicates(["node"])


def removals(docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, least_passage: int = LEAST_PASSAGE) -> DataFrame:
    """One row for each removal: doc_id, kind (paragraph or passage), first_word, n_words (null: to the end of the line), keep_doc_id, keep_first_word."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    size, conflict, low, high, longest = facts_of(docs)
    texts, ids = nodes_of(docs, low, high, longest, conflict)
    n_ranges = ranges(size // CHARS)
    found = materialize(find_runs(signatures(texts, least_words, n_ranges), n_ranges), "runs")
    own = found.where("sig IS NULL")
    facts = own.where("sketch IS NOT NULL").groupBy("node").agg(F.max(F.struct("n", "sketch")).alias("x")).select("node", "x.n", "x.sketch")
    copies = own.where("copy_of IS NOT NULL").select(F.col("copy_of").alias("a"), F.col("node").alias("b"))
    comps, _ = resolve(found.where("sig IS NOT NULL AND n >= 0"), facts, lambda nodes: paragraph_sets(texts, nodes, ids), copies, percent)
    kept = lambda df, node: located(df, ids, node, "keep_doc_id", "keep_first_word")
    lines = kept(located(comps.where("comp < node"), ids, "node", "doc_id", "first_word"), "comp")
    lines = lines.select("doc_id", F.lit("paragraph").alias("kind"), "first_word", F.lit(None).cast("long").alias("n_words"), "keep_doc_id", "keep_first_word")

    units = found.where("sig IS NOT NULL AND n < 0").select("sig", "node", (-F.col("n")).alias("size"), F.col("first").alias("keep"))
    # The first of a run within a collection may itself stand behind the first of all.
    firsts = units.groupBy("sig", F.col("node").alias("keep")).agg(F.min("keep").alias("before"))
    units = units.groupBy("sig", "node", "size").agg(F.min("keep").alias("keep")).join(firsts, ["sig", "keep"], "left")
    units = units.select("node", "size", F.coalesce("before", "keep").alias("keep"))
    units = located(units.withColumn("own", F.col("node")), ids, "own", "__unit_doc", "at").select(F.col("__unit_doc").alias("doc_id"), (F.col("node") - F.col("at")).alias("text_of"), "at", "size", "keep").distinct()
    by_doc = Window.partitionBy("text_of").orderBy("at")
    units = units.withColumn("new", (F.coalesce(F.lag(F.col("at") + F.col("size")).over(by_doc), F.lit(-1)) != F.col("at")).cast("int"))
    units = units.withColumn("passage", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    passages = units.groupBy("doc_id", "text_of", "passage").agg(F.min("at").alias("first_word"), F.sum("size").alias("n_words"), F.min("keep").alias("keep")).where(F.col("n_words") >= least_passage)
    passages = kept(passages, "keep").select("doc_id", F.lit("passage").alias("kind"), "first_word", "n_words", "keep_doc_id", "keep_first_word")
    return lines.unionByName(passages)


def clean(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with their removals taken out of text; a line that loses all its words goes, white space inside others becomes single spaces."""
    spans = gone.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct("first_word", F.coalesce("n_words", F.lit(-1)).cast("long").alias("n_words"))).alias("__spans"))
    joined = docs.join(spans, F.col("doc_id") == F.col("__doc"), "left")
    schema = T.StructType([docs.schema[c] for c in docs.columns])
    at = docs.columns.index("text")

    def cut(text: bytes, spans: list[dict]) -> str:
        ends = {s["first_word"] for s in spans if s["n_words"] < 0}
        dead = {i for s in spans if s["n_words"] >= 0 for i in range(s["first_word"], s["first_word"] + s["n_words"])}
        out, place = [], 0
        for line in text.split(b"\n"):
            words = line.split()
            kept = [] if place in ends and words else [w for i, w in enumerate(words, place) if i not in dead]
            if len(kept) == len(words):
                out.append(line)
            elif kept:
                out.append(b" ".join(kept))
            place += len(words)
        return b"\n".join(out).decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not s or t is None else cut(t, s) for t, s in zip(as_bytes(batch.column(at)).to_pylist(), batch.column(len(schema)).to_pylist())]
            columns = [batch.column(i) for i in range(len(schema))]
            columns[at] = pa.array([t.decode("utf-8", "replace") if isinstance(t, bytes) else t for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "__spans").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(read_table(spark, sf_dir, "documents"))
