"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Every n-gram of a test item is a seed, however rare or common, so no choice of seeds can leave out those that survive an edit.
A document with a seed gives a window around the item's place there, as wide as an alignment through the seed that reaches
`least` can be, and overlapping windows of an item are joined. A window is aligned (match 2, mismatch and gap -1) unless an
upper bound of its score (words that the item has count 2, others -1, best stretch) is below `least` of a full copy; all
windows of a slice of documents at once. A document is contaminated by an item if the best score reaches `least` of that of
a full copy, and the alignment has `seed` equal words in a row. One pass over the documents without a shuffle.

Items are taken in blocks of at most `block` items and about BLOCK_BYTES of text, and one more item at most. A benchmark of one block is one lazy pass over the
documents; beyond that each block is a pass of its own, and what the passes before it found is written to the shared folder, so that neither the
driver nor a task ever holds more than one block, however many there are.

Defined results: null and empty texts hold nothing; items that are null, have a null id or fewer words than a seed are not
searched; equal items are reported each; repeated documents are reported each; empty tables give no rows. Other columns stay;
`leaks` replaces a column of that name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import P1, P2, hash_words, map_texts, ngrams, read_table, remove, split_texts, written

SEED, LEAST, BLOCK, BLOCK_BYTES = 3, 0.5, 20_000, 8 << 20
MOST = 1_000_000  # rows or window words that are worked on at once
LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]))


class Lookup:
    """Positions of wanted 64-bit values in an array: a bit table discards most, binary search settles the rest."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.shift = np.uint64(64 - max(16, 6 + int(len(self.values)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[self.values >> self.shift] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in x, indexes of values) of what is wanted."""
        at = np.flatnonzero(self.table[x >> self.shift])
        k = np.searchsorted(self.values, x[at])
        ok = self.values[np.minimum(k, len(self.values) - 1)] == x[at]
        return at[ok], k[ok]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score (match 2, mismatch -1, gap -1) of each item in its window, the window place where that alignment begins and the
    one after its end; of equal scores the alignment that begins first.

    Row by row over all pairs at once; a running maximum along the row covers gaps in the item exactly, as their cost is linear.
    A cell holds its score times 2^32 plus a number that falls with the place where its alignment begins."""
    n, rows, cols = len(items), max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((n, rows), np.uint64), np.zeros((n, cols), np.uint64)
    in_a, in_b = np.zeros((n, rows), bool), np.zeros((n, cols), bool)
    for i, (x, y) in enumerate(zip(items, windows)):
        a[i, : len(x)], b[i, : len(y)], in_a[i, : len(x)], in_b[i, : len(y)] = x, y, True, True
    one = np.int64(1 << 32)
    fresh = (1 << 31) - np.arange(cols + 1, dtype=np.int64)  # score 0: an alignment may begin at the next word
    slope = np.arange(1, cols + 1, dtype=np.int64) * one
    h, best, end = np.tile(fresh, (n, 1)), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in range(rows):
        same = (b == a[:, r : r + 1]) & in_b
        t = np.maximum(h[:, :-1] + np.where(same, 2 * one, -one), h[:, 1:] - one)
        t = np.maximum.accumulate(t + slope, axis=1) - slope
        t = np.where((t < one) | ~in_a[:, r : r + 1], fresh[1:], t)
        h[:, 1:] = t
        at = t.argmax(axis=1)
        top = t[np.arange(n), at]
        better = (top >= one) & (top > best)
        end, best = np.where(better, at + 1, end), np.where(better, top, best)
    score = best >> np.int64(32)
    return score, np.where(score > 0, (1 << 31) - (best & np.int64((1 << 32) - 1)), 0), end


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of about MOST in total size, or of one element."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST, side="right")))
        yield slice(at, to)
        at = to


class Matcher:
    """Aligns texts with a block of items by their seeds."""

    def __init__(self, items: list[tuple[int, bytes]], counts: dict[int, int] | None = None, seed: int = SEED, least: float = LEAST):
        """counts: how often n-grams occur in the texts, if known; those that don't occur need no place in the lookup."""
        self.seed, self.least = seed, least
        self.items = [(i, w) for i, w in ((i, hash_words(t)) for i, t in items) if len(w) >= seed]
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        self.slack = (2 * self.sizes * (1 - least)).astype(np.int64) + 1  # words that an alignment reaching `least` can skip
        grams = [ngrams(w, seed) for _, w in self.items] or [np.zeros(0, np.uint64)]
        item, at = np.repeat(np.arange(len(grams)), list(map(len, grams))), np.concatenate([np.arange(len(g)) for g in grams])
        grams = np.concatenate(grams)
        if counts is not None:
            occurs = np.array([counts.get(g, 0) > 0 for g in grams.tolist()], bool)
            grams, item, at = grams[occurs], item[occurs], at[occurs]
        order = np.lexsort((at, item, grams))
        grams, item, at = grams[order], item[order], at[order]
        start = np.flatnonzero(np.append(len(grams) > 0, (grams[1:] != grams[:-1]) | (item[1:] != item[:-1])))
        self.lookup = Lookup(grams)
        self.item, self.low, self.high = item[start], at[start], at[np.append(start, len(at))[1:] - 1]  # of each n-gram in each item: first and last place
        self.ends = np.append(np.searchsorted(grams[start], self.lookup.values), len(start))
        keys = [self._key(np.full(len(w), k), w) for k, (_, w) in enumerate(self.items)]
        self.shift = np.uint64(64 - max(16, 4 + int(self.sizes.sum()).bit_length()))
        self.has = np.zeros(1 << (64 - int(self.shift)), bool)
        self.has[np.concatenate(keys or [np.zeros(0, np.uint64)]) >> self.shift] = True

    @staticmethod
    def _key(item: np.ndarray, words: np.ndarray) -> np.ndarray:
        return (words ^ ((item + 1).astype(np.uint64) * P1)) * P2

    def bounds(self, words: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Upper bounds of the items' scores in windows: the best stretch where words of the item count 2 and others -1."""
        n = last - first + 1
        start = np.cumsum(n) - n
        which = np.repeat(np.arange(len(n)), n)
        at = first[which] + np.arange(len(which)) - start[which] - 1
        value = np.where(self.has[self._key(item[which], words[at]) >> self.shift], 2, -1)
        value[start] = -3 * len(which)  # a window starts lower than any sum before it
        total = np.cumsum(value)
        return np.maximum.reduceat(total - np.minimum.accumulate(total), start)

    def windows(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, word after the last) of the windows to align."""
        if len(words) < self.seed or not len(self.item):
            return []
        at, k = self.lookup.find(ngrams(words, self.seed))
        n = self.ends[k + 1] - self.ends[k]
        out = []
        for some in _slices(n):
            m = n[some]
            hit = np.repeat(np.arange(len(m)), m)
            row = self.ends[k[some]][hit] + np.arange(len(hit)) - (np.cumsum(m) - m)[hit]
            item, seed = self.item[row], at[some][hit]
            first = np.maximum(0, seed - self.high[row] - self.slack[item])
            last = np.minimum(len(words), seed - self.low[row] + self.sizes[item] + self.slack[item])
            order = np.lexsort((first, item))
            item, first, last = item[order], first[order], last[order]
            reach = np.maximum.accumulate(item * (len(words) + 1) + last)
            new = np.flatnonzero(np.concatenate(([True], (item * (len(words) + 1) + first)[1:] >= reach[:-1])))
            item, first, last = item[new], first[new], np.maximum.reduceat(last, new)
            for part in _slices(last - first):
                i, a, b = item[part], first[part], last[part]
                ok = self.bounds(words, i, a, b) >= self.least * 2 * self.sizes[i]
                out += zip(i[ok].tolist(), a[ok].tolist(), b[ok].tolist())
        return out

    def leaks(self, texts: list[bytes | None]) -> list[list[dict]]:
        out: list[dict[int, dict]] = [{} for _ in texts]
        todo = []
        for i, words in enumerate(split_texts(pa.array(texts, pa.binary()))):
            todo += [(i, item, a, words[a:b]) for item, a, b in self.windows(words)]
        todo.sort(key=lambda x: len(x[3]))
        at = 0
        while at < len(todo):  # windows of like length together, about a million cells a row at most
            few = max(1, min(len(todo) - at, 256))
            while few > 1 and few * len(todo[at + few - 1][3]) > 1_000_000:
                few //= 2
            some = todo[at : at + few]
            at += few
            for (i, item, a, _), score, first, last in zip(some, *(x.tolist() for x in align([self.items[x[1]][1] for x in some], [x[3] for x in some]))):
                key, words = self.items[item]
                score /= 2 * len(words)
                if score >= self.least and (key not in out[i] or score > out[i][key]["score"]):
                    out[i][key] = {"item_id": key, "score": round(score, 6), "first_word": a + first, "n_words": last - first}
        return [[x[k] for k in sorted(x)] for x in out]


def _blocks(benchmark: DataFrame, block: int, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The items, a block at a time: at most `block` of them, and no more once their texts have `most` bytes."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text")
    held, size = [], 0
    for r in rows.toLocalIterator():
        held.append((r[0], r[1].encode()))
        size += len(held[-1][1])
        if len(held) == block or size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def mark(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """docs with `leaks`: the items that a document holds a copy of, exact or edited, with score and place."""
    spark, out, parts = docs.sparkSession, docs, []
    shared = path = None
    for i, items in enumerate(_blocks(benchmark, block)):
        if shared is not None:
            last = path
            out, path = written(out, "leaks")
            shared.destroy()
            if last is not None:
                remove(spark, last)
        shared = spark.sparkContext.broadcast(items)

        def run(texts: list, shared=shared) -> list:
            if not hasattr(run, "matcher"):
                run.matcher = Matcher(shared.value, None, seed, least)
            return [run.matcher.leaks(texts)]

        parts.append(f"__leaks_{i}")
        out = map_texts(out, run, [T.StructField(parts[-1], LEAKS)])
    found = F.flatten(F.array(*parts)) if parts else F.array().cast(LEAKS)
    own = [c for c in docs.columns if c.lower() != "leaks"]
    return out.select(*[F.col(f"`{c}`") for c in own], found.alias("leaks"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with their own columns."""
    own = docs.withColumnsRenamed({c: "__own_leaks" for c in docs.columns if c.lower() == "leaks"})
    return mark(own, benchmark).where(F.size("leaks") == 0).select(*[F.col(f"`{a}`").alias(b) for a, b in zip(own.columns, docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")
