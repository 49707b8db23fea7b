"""Collocations against counting everything, on made tables with few nodes a round and ties, and on the small table."""

import random
import re
from collections import Counter

import duckdb
import pytest

from framewise.llm import collocations

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_counting(rows, least, keep, percent):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            f.update(tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= percent * f[p[i:j]]}
        best = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:keep])]
    return sorted(out)


def mined(df, **how):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.mine(df, **how).collect())


@pytest.mark.parametrize("seed, first, keep", [(1, 1, 3), (2, 2, 10), (3, 5, 1), (4, 1000, 1000)])
def test_search_finds_what_counting_finds(spark, seed, first, keep):
    rng = random.Random(seed)
    chunks = [[f"w{rng.randrange(14)}" for _ in range(rng.randrange(2, 6))] for _ in range(12)]
    rows = []
    for _ in range(160):
        text = []
        for _ in range(rng.randrange(0, 9)):
            text += rng.choice(chunks) if rng.random() < 0.6 else [f"w{rng.randrange(14)}"]
            text += rng.choice([["."], [","], [], [], ["\n"]])
        rows.append((rng.choice(["en", "en", "fr", None]), " ".join(text)))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert mined(df, least=4, keep=keep, percent=80, first=first) == by_counting(rows, 4, keep, 80)


def test_small_table(spark):
    rows = duckdb.connect().execute(f"SELECT lang, text FROM '{SMALL}/documents.parquet'").fetchall()
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    for least, keep, first in ((5, 60, 16), (30, 2000, 8192)):
        assert mined(df, least=least, keep=keep, first=first) == by_counting(rows, least, keep, 80)


def test_awkward_rows(spark):
    rows = [("en", "A b. a B,a b\ta b"), ("en", None), (None, ""), (None, "x y x y"), ("und", "x\ty"), ("en", " ;. "), ("", "É é é é É é"), ("en", "a b"), ("en", "a b"), ("fr", "\x1fa\x1f b " * 3)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "lang string, text string, phrase string").repartition(2)
    for least in (1, 2, 3):
        assert mined(df, least=least, keep=5, first=2) == by_counting(rows, least, 5, 80)
    assert mined(df.limit(0)) == [] and mined(df, least=100) == []


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, total = 3 * 10**17 + 1, 7 * 10**17 + 3
    assert spark.range(1).select(collocations.score(F.lit(a), F.lit(total))).first()[0] == 2_000_000 * a // total
