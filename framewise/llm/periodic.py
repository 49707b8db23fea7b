"""Stretches of text that repeat with a period, found as maximal runs by Baier grouping.

The words of a text are a string over word numbers. Phase one of Baier's suffix sorter groups its suffixes by their longest Lyndon prefix:
groups are taken from the greatest down; each member moves the nearest suffix before it that isn't taken yet into a higher group, whose
prefix grows by the member's. When all are taken, a suffix's group tells its longest Lyndon word and two suffixes of one group have the
same one. This is done under the order of the word numbers and under its reverse; the Lyndon root of every run is such a word under one of
the two (the runs theorem). A run with an exponent of e holds e - 1 whole roots in a row, so chains of suffixes of one group, each a root
apart, are its candidates; the longest common extension to both sides gives its ends.

Before that, words that can't be in a run are set aside, which loses none: each word of a run stands floor(exponent) times in it, so a word with
fewer occurrences between two words set aside is set aside itself, until nothing changes. A document's cost is linear in its length but for
sorting, and no shuffle is needed: one pass over the rows, each document in one task.

Defined results: words are what stands between ASCII white space, and case counts; null and empty text have no words, no runs and an empty
collapsed text; repeated rows are rows of their own; an empty table gives no rows. Other columns stay; `n_words`, `runs` and `collapsed` replace
columns of those names. In the query a null doc_id has no checksum, so its text is taken as it is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_texts, read_table

LEAST_EXPONENT, LEAST_LENGTH = 4, 6

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def lyndon_groups(codes: list[int], n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    """(length of the longest Lyndon word at each place, a number alike for equal such words), codes being 0 to n_codes - 1."""
    n = len(codes)
    members: list[list[int]] = [[] for _ in range(n_codes)]
    for i, c in enumerate(codes):
        members[c].append(i)
    of, length = list(codes), [1] * n_codes
    lower, higher = list(range(-1, n_codes - 1)), list(range(1, n_codes + 1))
    free = list(range(n + 1))  # place i is at i + 1; leads to the nearest place at or before it that isn't taken
    g = n_codes - 1
    while g >= 0:
        taken = [i for i in members[g] if of[i] == g]
        for i in taken:
            free[i + 1] = i
        count: dict[int, int] = {}
        for x in taken:
            while free[x] != x:
                free[x] = free[free[x]]
                x = free[x]
            if x:
                count[x - 1] = count.get(x - 1, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, k in count.items():
            moved.setdefault((of[p], k), []).append(p)
        below = -1
        for old, k in sorted(moved):  # more copies of the taken prefix make a greater group
            below = old if below < 0 or old != last else below
            last, new = old, len(members)
            members.append(moved[old, k])
            length.append(length[old] + k * length[g])
            for p in members[new]:
                of[p] = new
            lower.append(below)
            higher.append(higher[below])
            lower[higher[below]] = new
            higher[below] = new
            below = new
        g = lower[g]
    group = np.array(of, np.int64)
    return np.array(length, np.int64)[group] if n else group, group


def _alike(w: np.ndarray, v: np.ndarray) -> int:
    """How many leading elements two sequences share; looks at about twice as many."""
    at, step, n = 0, 32, min(len(w), len(v))
    while at < n:
        same = w[at : min(at + step, n)] == v[at : min(at + step, n)]
        if not same.all():
            return at + int(same.argmin())
        at, step = at + step, step * 2
    return n


def runs_of(codes: np.ndarray, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of the runs of at least `least` elements and `exponent` periods."""
    n, found = len(codes), set()
    if n < max(2, least):
        return []
    kinds, codes = np.unique(codes, return_inverse=True)
    for order in (codes, len(kinds) - 1 - codes):
        root, group = lyndon_groups(order.tolist(), len(kinds))
        after = np.arange(n) + root
        inside = after < n
        after[~inside] = 0
        again = inside & (group[after] == group)
        chain = inside
        for _ in range(exponent - 2):
            chain = again & chain[after]
        at = np.flatnonzero(chain)
        end: dict[int, int] = {}
        for i in at[np.argsort(root[at], kind="stable")].tolist():
            q = int(root[i])
            if i + q <= end.get(q, 0):
                continue
            to = i + q + _alike(codes[i:], codes[i + q :])
            start = i - _alike(codes[:i][::-1], codes[: i + q][::-1])
            end[q] = to
            if to - start >= max(least, exponent * q):
                found.add((start, to - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(codes: np.ndarray, n_codes: int, exponent: int, least: int) -> list[tuple[int, int]]:
    """[first, last) of the stretches in which every word stands `exponent` times: whatever is in a run lies in one."""
    keep = np.bincount(codes, minlength=n_codes)[codes] >= exponent
    while True:
        flag = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8)))
        first, last = flag[::2], flag[1::2]
        long = last - first >= least
        first, last = first[long], last[long]
        size = last - first
        total = int(size.sum())
        if not total:
            return []
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(total)
        key = np.repeat(np.arange(len(first)), size) * n_codes + codes[at]
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        ok = n[inverse] >= exponent
        if ok.all():
            return list(zip(first.tolist(), last.tolist()))
        keep = np.zeros(len(codes), bool)
        keep[at[ok]] = True


def runs_of_words(words: list[bytes], exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    if len(words) < least:
        return []
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    found = []
    for a, b in _stretches(codes, len(numbers), exponent, least):
        found += [(a + s, n, q) for s, n, q in runs_of(codes[a:b], exponent, least)]
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def mark(df: DataFrame, text: str = "text", exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> DataFrame:
    """df with n_words, runs (start and length in words, smallest period; by start, then period) and the collapsed text."""
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")

    def run(texts: list) -> list[list]:
        n, found, out = [], [], []
        for t in texts:
            words = t.split() if t else []
            runs = runs_of_words(words, exponent, least)
            n.append(len(words))
            found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
            out.append(b" ".join(collapse(words, runs)).decode())
        return [n, found, out]

    return map_texts(df, run, [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())], text)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The contract's rewriting of a tenth of the documents, by the checksum h of doc_id: words from place a on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    some = docs.withColumn("__words", F.when(h % 10 == 0, words)).withColumn("__n", F.size("__words").cast("long")).withColumn("__a", F.when(F.col("__n") > 0, F.pmod(g, F.col("__n"))))
    some = some.withColumn("__p", F.lit(1) + F.floor((F.col("__n") - F.col("__a")) / (F.lit(3) + F.pmod(g, F.lit(8)))))

    def source(i: Column) -> Column:
        return F.when(i < F.col("__a"), i).otherwise(F.col("__a") + F.pmod(i - F.col("__a"), F.col("__p")))

    written = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1), lambda i: F.get("__words", source(i).cast("int"))), " ")
    return some.withColumn("text", F.when(F.col("__n") > 0, written).otherwise(F.col("text"))).drop("__words", "__n", "__a", "__p")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark(with_planted_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.shorter")).alias("period"),
        F.expr("1000 * best.length div -best.shorter").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Word pairs of one text a period apart, in rows: stretches of them are runs, the least period of those with the same ends counts.
SQL = r"""
WITH RECURSIVE byte AS (
  SELECT doc_id, text, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS b FROM documents),
hash AS (
  SELECT doc_id, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda x, y: CASE WHEN (xor(x, y) & 1) = 1 THEN xor(xor(x, y) >> 1, 3988292384) ELSE xor(x, y) >> 1 END)) AS h FROM byte),
split AS (SELECT doc_id, h, h // 10 AS g, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM hash),
place AS (SELECT doc_id, h, g, w, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a FROM split),
period AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM place),
word AS (
  SELECT doc_id, i, n, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM period)),
often AS (SELECT doc_id, word FROM word GROUP BY ALL HAVING count(*) >= 4),
frequent AS (SELECT word.* FROM word JOIN often USING (doc_id, word)),
equal AS (SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
  FROM frequent x JOIN frequent y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
run AS (SELECT doc_id, s, len, min(q) AS q FROM (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM equal GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)) GROUP BY doc_id, s, len),
digest AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed, first({'s': s, 'len': len, 'q': q} ORDER BY len DESC, s, q) AS best
  FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.q::BIGINT AS period,
       (1000 * best.len // best.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN digest USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
