"""Phrases of two to four words that stick together, by best-first branch and bound over their prefixes.

A phrase's score is its weakest cut's: floor(2,000,000 a / (l + r)) for a occurrences of the phrase, l of the part before the cut and r of
the part after it. r is a at least, and a falls as a phrase grows, so 2,000,000 a / (l + a) of a prefix bounds the score of everything that
begins with it. Words are counted first, then pairs of frequent words; pairs are the nodes of the search. Opening a node counts all phrases of up
to four words around it, so that its own survival, and that of all it grows into, is settled. Each round opens the nodes of greatest (bound, count) of
each language in one pass over the texts, and the search ends when no node's bound reaches the score of the language's last
kept survivor, ties included. A phrase that contains a pair of fewer than `least` occurrences has fewer itself, so it is never counted.

Words, pairs and longer phrases are keyed by 64-bit hashes of (language, word), one to each word; that no two frequent words share a hash is checked, so counts are
exact. What a task needs to know of the others' counts are two bitmaps of at most 64 MB. Counts are summed within a task before they are
shuffled by phrase, so a hot language or word is no hot key. Tables in the shared folder hold what frequent phrases there are; nothing whole reaches the driver.

Defined results: null text is empty; a null language is `und`; A-Z is lower-cased; a piece ends at `.,;:!?` and at any line end, words are what stands between
blanks and tabs in it; repeated rows count each; an empty table gives no rows; other columns aren't read."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import P1, U64, _hash_spans, bytes_of, mix, pieces, read_table, remove, words_in, written
from ._links import MOST_BITS

LEAST, KEEP, PERCENT = 30, 2000, 80
FIRST_NODES, GROWTH = 8192, 8  # nodes of a language that the first round opens; how many times as many each next one
HELD_WORDS = 200_000  # distinct words that a task collects before it sends their counts
UNKNOWN = "und"

_ENDS = b".,;:!?\n\x0b\x0c\r"
_BETWEEN = np.zeros(256, bool)
_BETWEEN[list(_ENDS + b" \t")] = True
_BREAK = np.zeros(256, np.int32)
_BREAK[list(_ENDS)] = 1
_BLANKED = bytes(32 if _BETWEEN[i] else i + 32 if 65 <= i <= 90 else i for i in range(256))


def _lang_keys(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def _lang_of(lang: str) -> Column:
    return F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang")


def _keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(key of each word of a batch of lang and text, whether the next word stands in the same piece)."""
    data, offsets = bytes_of(batch.column(1))
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    first, last = words_in(data, offsets, _BETWEEN)
    langs = batch.column(0).dictionary_encode()
    n = np.diff(np.searchsorted(first, offsets))
    of = _lang_keys(langs.dictionary.to_pylist())[langs.indices.to_numpy(zero_copy_only=False)]
    keys = mix(_hash_spans(data, first, last) ^ np.repeat(mix(of), n))
    ends = np.cumsum(_BREAK[data], dtype=np.int32)
    doc = np.repeat(np.arange(len(n)), n)
    joined = np.zeros(len(keys), bool)
    joined[:-1] = (ends[first[1:]] == ends[last[:-1] - 1]) & (doc[1:] == doc[:-1])
    return keys, joined


def _pair(keys: np.ndarray) -> np.ndarray:
    """A hash of each word's key and the next one's; the last word's is of no use."""
    out = np.zeros(len(keys), np.uint64)
    out[:-1] = mix(keys[:-1] * P1 + keys[1:])
    return out


def _counted(keys: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """n columns of the word keys of each distinct phrase of n words that begins at one of the places `at`, and its count."""
    h = keys[at]
    for i in range(1, n):
        h = mix(h * P1 + keys[at + i])
    by = np.argsort(h)
    columns = [keys[at + i][by] for i in range(n)]
    fresh = np.ones(len(at), bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if len(at) > 1 else fresh[1:]
    start = np.flatnonzero(fresh)
    return [c[start].view(np.int64) for c in columns] + [np.diff(np.append(start, len(at)))]


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, k, n) to be summed up; rows with a null word have a language's total."""

    def sent(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            column = pa.array(list(words), pa.binary())
            data, offsets = bytes_of(column)
            keys = mix(_hash_spans(data, offsets[:-1], offsets[1:]) ^ mix(_lang_keys([lang]))) if len(column) else np.zeros(0, np.uint64)
            words_and_all = pa.concat_arrays([column.cast(pa.string()), pa.nulls(1, pa.string())])
            n = np.fromiter(words.values(), np.int64, len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(n) + 1)), words_and_all, pa.array(np.append(keys.view(np.int64), 0)), pa.array(np.append(n, n.sum()))], names=["lang", "word", "k", "n"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.cast(pa.binary()).as_py() if text.is_valid else b""
                counts.setdefault(lang, Counter()).update(words.translate(_BLANKED).split(b" ") if words else ())
                counts[lang].pop(b"", None)
                if sum(map(len, counts.values())) >= HELD_WORDS:
                    yield from sent(counts)
                    counts = {}
        yield from sent(counts)

    return docs.mapInArrow(run, "lang string, word string, k long, n long")


def _bitmap(keys: DataFrame, columns: list[str]) -> Broadcast:
    """Bits of the keys of words (one column) or the pairs of them (two), at most MOST_BITS, 16 for each key if they fit."""
    spark, bits = keys.sparkSession, 1 << 18
    n = keys.count()
    while bits < min(16 * n, MOST_BITS):
        bits *= 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = [c.to_numpy().view(np.uint64) for c in batch.columns]
            h = k[0] if len(k) == 1 else mix(k[0] * P1 + k[1])
            yield pa.RecordBatch.from_arrays([pa.array((h & U64(bits - 1)).view(np.int64) + 1)], names=["p"])

    places = keys.select(*columns).mapInArrow(place, "p long")
    rows = places.groupBy(F.bitmap_bucket_number("p").alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:  # buckets count from 1, and so do the places in them
        low = (r["i"] - 1) * 4096
        out[low : low + 4096] |= np.frombuffer(r["bits"], np.uint8)[: len(out) - low]
    return spark.sparkContext.broadcast(out)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = h & U64(len(bits) * 8 - 1)
    return (bits[(p >> U64(3)).astype(np.int64)] >> (p & U64(7)).astype(np.uint8) & 1).astype(bool)


def count_pairs(docs: DataFrame, words: Broadcast) -> DataFrame:
    """(k1, k2, n) to be summed up: pairs of words that may both be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, 65_536, 8 << 20):
                keys, joined = _keyed(batch)
                good = _has(words.value, keys)
                at = np.flatnonzero(joined[:-1] & good[:-1] & good[1:])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _counted(keys, at, 2)], names=["k1", "k2", "n"])

    return docs.mapInArrow(run, "k1 long, k2 long, n long")


def count_around(docs: DataFrame, pairs: Broadcast, opened: Broadcast) -> DataFrame:
    """(k1, k2, k3, k4, n) to be summed up: phrases of three words (k4 is null) and four that contain an opened pair and whose pairs may all be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, 65_536, 8 << 20):
                keys, joined = _keyed(batch)
                pair = _pair(keys)
                good = joined & _has(pairs.value, pair)
                hit = good & _has(opened.value, pair)
                for n in (3, 4):
                    last = max(len(keys) - n + 1, 0)
                    every = np.logical_and.reduce([good[i : i + last] for i in range(n - 1)])
                    some = np.logical_or.reduce([hit[i : i + last] for i in range(n - 1)])
                    columns = [pa.array(x) for x in _counted(keys, np.flatnonzero(every & some), n)]
                    if n == 3:
                        columns.insert(3, pa.nulls(len(columns[0]), pa.int64()))
                    yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "k3", "k4", "n"])

    return docs.mapInArrow(run, "k1 long, k2 long, k3 long, k4 long, n long")


def score(a: Column, total: Column) -> Column:
    """floor(2,000,000 a / total) by exact decimals, as the product takes more than 64 bits where a has more than 42."""
    total, product = total.cast("decimal(20,0)"), a.cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    return ((product - product % total) / total).cast("long")


def _cut(k: int, a: Column, left: Column, right: Column) -> Column:
    return F.struct(score(a, left + right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))


def _weakest(cuts: list[Column]) -> Column:
    return F.array_min(F.array(*cuts)).alias("cut")


class _Search:
    """The tables of a search: words and pairs are complete, phrases of three and four words those around opened pairs."""

    def __init__(self, docs: DataFrame, least: int, keep: int, percent: int):
        self.docs, self.least, self.keep, self.percent, self.paths = docs, least, keep, percent, []
        counts = self.table(count_words(docs).groupBy("lang", "word").agg(F.first("k").alias("k"), F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= least)), "words")
        self.totals = counts.where("word IS NULL").select("lang", "n")
        self.words = counts.where("word IS NOT NULL")
        if not self.words.groupBy("k").count().where("count > 1").isEmpty():
            raise RuntimeError("two frequent words have one hash")
        known = _bitmap(self.words, ["k"])
        pairs = count_pairs(docs, known).groupBy("k1", "k2").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        of = lambda i, n, *more: self.words.select(F.col("k").alias(i), F.col("n").alias(n), *more)
        pairs = self.table(pairs, "pairs").join(of("k1", "l", "lang"), "k1").join(of("k2", "r"), "k2")
        self.pairs = self.table(pairs.withColumn("bound", score(F.col("a"), F.col("l") + F.col("a"))), "pairs")
        known.unpersist()
        self.frequent = _bitmap(self.pairs, ["k1", "k2"])
        self.opened = self.phrases = None

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        out, path = written(df, tag)
        self.paths.append(path)
        return out

    def open(self, nodes: DataFrame) -> None:
        """Count what is around nodes (k1, k2)."""
        bits = _bitmap(nodes, ["k1", "k2"])
        key = ["k1", "k2", "k3", "k4"]
        found = self.table(count_around(self.docs, self.frequent, bits).groupBy(*key).agg(F.sum("n").alias("a")).where(F.col("a") >= self.least), "phrases")
        bits.unpersist()
        self.opened = nodes if self.opened is None else self.opened.unionByName(nodes)
        self.phrases = found if self.phrases is None else self.table(self.phrases.unionByName(found).dropDuplicates(key), "phrases")

    def scored(self) -> tuple[DataFrame, DataFrame]:
        """(candidates that survive, phrases of four words whose last three aren't counted yet)."""
        pair = lambda i, j, **names: self.pairs.select(F.col("k1").alias(i), F.col("k2").alias(j), *[F.col(c).alias(n) for c, n in names.items()])
        c = F.col
        three = self.phrases.where("k4 IS NULL").drop("k4")
        three = three.join(pair("k1", "k2", a="a12", l="a1", lang="lang"), ["k1", "k2"]).join(pair("k2", "k3", a="a23", r="a3"), ["k2", "k3"])
        three = three.withColumn("cut", _weakest([_cut(1, c("a"), c("a1"), c("a23")), _cut(2, c("a"), c("a12"), c("a3"))]))
        four = self.phrases.where("k4 IS NOT NULL").join(pair("k1", "k2", a="a12", l="a1", lang="lang"), ["k1", "k2"]).join(pair("k3", "k4", a="a34", r="a4"), ["k3", "k4"])
        of = lambda i, j, k, n: three.select(c("k1").alias(i), c("k2").alias(j), c("k3").alias(k), c("a").alias(n))
        four = four.join(of("k1", "k2", "k3", "a123"), ["k1", "k2", "k3"], "left").join(of("k2", "k3", "k4", "a234"), ["k2", "k3", "k4"], "left")
        known = c("a123").isNotNull() & c("a234").isNotNull()
        cuts = [_cut(1, c("a"), c("a1"), F.coalesce("a234", "a")), _cut(2, c("a"), c("a12"), c("a34")), _cut(3, c("a"), F.coalesce("a123", "a"), c("a4"))]
        four = self.table(four.withColumn("cut", _weakest(cuts)).withColumn("known", known), "four")
        two = self.opened.join(self.pairs, ["k1", "k2"]).withColumn("cut", _cut(1, c("a"), c("l"), c("r")))
        none = F.lit(None).cast("long")
        two = self.surviving(two.withColumns({"k3": none, "k4": none}), three, ["k1", "k2"], [("k1", "k2"), ("k2", "k3")])
        kept = self.surviving(three.withColumn("k4", none), four, ["k1", "k2", "k3"], [("k1", "k2", "k3"), ("k2", "k3", "k4")])
        columns = ["lang", "k1", "k2", "k3", "k4", "a", "cut"]
        return self.table(two.select(columns).unionByName(kept.select(columns)).unionByName(four.where("known").select(columns)), "survivors"), four.where("NOT known")

    def surviving(self, short: DataFrame, long: DataFrame, key: list[str], inside: list[tuple[str, ...]]) -> DataFrame:
        """Of `short`, what no phrase one word longer contains nearly as often as it occurs: a phrase yet longer that does so contains such a one."""
        parts = [long.select(*[F.col(x).alias(k) for x, k in zip(part, key)], F.col("a").alias("__more")) for part in inside]
        most = parts[0].unionByName(parts[1]).groupBy(*key).agg(F.max("__more").alias("__more"))
        decimal = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("decimal(20,0)")
        return short.join(most, key, "left").where(decimal("__more") * 100 < decimal("a") * self.percent).drop("__more")

    def last_kept(self, survivors: DataFrame) -> DataFrame:
        """(lang, least_score, least_a) of the languages that have `keep` survivors: what the last of them has."""
        order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"))
        best = survivors.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= self.keep)
        last = best.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("cut.score", "a")).alias("last")).where(F.col("n") == self.keep)
        return self.table(last.select("lang", F.col("last.score").alias("least_score"), F.col("last.a").alias("least_a")), "last")

    def reaching(self, df: DataFrame, bound: str, last: DataFrame) -> DataFrame:
        ok = F.col("least_score").isNull() | (F.col(bound) > F.col("least_score")) | (F.col(bound) == F.col("least_score")) & (F.col("a") >= F.col("least_a"))
        return df.join(last, "lang", "left").where(ok).drop("least_score", "least_a")

    def frontier(self, last: DataFrame, waiting: DataFrame, most: int) -> DataFrame:
        """The next pairs to open: the best `most` of each language's whose bound reaches the last kept score, and those that phrases which may reach it wait for."""
        fresh = self.reaching(self.pairs, "bound", last).join(self.opened, ["k1", "k2"], "left_anti")
        order = Window.partitionBy("lang").orderBy(F.desc("bound"), F.desc("a"), "k1", "k2")
        best = fresh.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most).select("k1", "k2")
        asked = self.reaching(waiting.withColumn("bound", F.col("cut.score")), "bound", last).select(F.col("k2").alias("k1"), F.col("k3").alias("k2")).join(self.opened, ["k1", "k2"], "left_anti")
        return self.table(best.unionByName(asked).distinct(), "nodes")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, keep: int = KEEP, percent: int = PERCENT, first: int = FIRST_NODES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `keep` phrases by score, count and phrase, of those with `least` occurrences; without those that a
    longer one contains with `percent` % of their occurrences. A table in the shared folder."""
    search = _Search(docs.select(_lang_of(lang), F.col(f"`{text}`").cast("string").alias("text")), least, keep, percent)
    order = Window.partitionBy("lang").orderBy(F.desc("bound"), F.desc("a"), "k1", "k2")
    nodes = search.pairs.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= first).select("k1", "k2")
    nodes = search.table(nodes, "nodes")
    while True:
        search.open(nodes)
        survivors, waiting = search.scored()
        last = search.last_kept(survivors)
        first *= GROWTH
        nodes = search.frontier(last, waiting, first)
        if nodes.isEmpty():
            break
    found = search.reaching(survivors.withColumn("bound", F.col("cut.score")), "bound", last).drop("bound")
    for i in range(1, 5):
        found = found.join(search.words.select(F.col("k").alias(f"k{i}"), F.col("word").alias(f"w{i}")), f"k{i}", "left")
    found = found.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3", "w4")).join(search.totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    found = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= keep)
    out = written(found.select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")), "collocations")[0]
    search.frequent.unpersist()
    for path in search.paths:
        remove(docs.sparkSession, path)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, p FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
word AS (SELECT lang, piece, unnest(regexp_extract_all(p, '[^\x20\x09]+')) AS w, generate_subscripts(regexp_extract_all(p, '[^\x20\x09]+'), 1) AS i FROM piece),
ahead AS (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM word WINDOW o AS (PARTITION BY piece ORDER BY i)),
total AS (SELECT lang, count(*) AS n FROM word GROUP BY lang),
f1 AS (SELECT lang, w1 AS p, count(*) AS f FROM ahead GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
f4 AS (SELECT lang, w1, w2, w3, w4, count(*) AS f FROM ahead WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
f AS (
  SELECT lang, p, f FROM f1 UNION ALL SELECT lang, concat_ws(' ', w1, w2), f FROM f2 UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3), f FROM f3),
cut AS (
  SELECT lang, concat_ws(' ', w1, w2) AS phrase, f AS a, 1 AS k, w1 AS x, w2 AS y FROM f2 UNION ALL
  SELECT lang, concat_ws(' ', w1, w2, w3), f, 1, w1, concat_ws(' ', w2, w3) FROM f3 UNION ALL
  SELECT lang, concat_ws(' ', w1, w2, w3), f, 2, concat_ws(' ', w1, w2), w3 FROM f3 UNION ALL
  SELECT lang, concat_ws(' ', w1, w2, w3, w4), f, 1, w1, concat_ws(' ', w2, w3, w4) FROM f4 UNION ALL
  SELECT lang, concat_ws(' ', w1, w2, w3, w4), f, 2, concat_ws(' ', w1, w2), concat_ws(' ', w3, w4) FROM f4 UNION ALL
  SELECT lang, concat_ws(' ', w1, w2, w3, w4), f, 3, concat_ws(' ', w1, w2, w3), w4 FROM f4),
scored AS (
  SELECT c.lang, phrase, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f + r.f))::BIGINT AS score
  FROM cut c JOIN f l ON l.lang = c.lang AND l.p = c.x JOIN f r ON r.lang = c.lang AND r.p = c.y),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, concat_ws(' ', w1, w2) AS p, f FROM f3 UNION ALL SELECT lang, concat_ws(' ', w2, w3), f FROM f3 UNION ALL
  SELECT lang, concat_ws(' ', w1, w2), f FROM f4 UNION ALL SELECT lang, concat_ws(' ', w2, w3), f FROM f4 UNION ALL SELECT lang, concat_ws(' ', w3, w4), f FROM f4 UNION ALL
  SELECT lang, concat_ws(' ', w1, w2, w3), f FROM f4 UNION ALL SELECT lang, concat_ws(' ', w2, w3, w4), f FROM f4),
most AS (SELECT lang, p, max(f) AS f FROM longer GROUP BY ALL)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest w JOIN total USING (lang) LEFT JOIN most m ON m.lang = w.lang AND m.p = w.phrase
WHERE m.f IS NULL OR 100::HUGEINT * m.f < 80 * a QUALIFY rank <= 2000
"""
