"""Runs of words: Lyndon words and runs against definitions taken literally, awkward rows, the query against plain Python."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from framewise.llm import periodic

SMALL = "/root/testdata/sf0.001"


def lyndon(w):
    """The longest Lyndon word at each place ends before the next smaller suffix."""
    return [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) - i for i in range(len(w))]


def all_runs(w, exponent, least):
    found = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(least, exponent * q) and not any(all(w[k] == w[k + p] for k in range(s, s + n - p)) for p in range(1, q)):
                found.add((s, n, q))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


repeating = st.builds(lambda a, u, k, z: a + u * k + z, *[st.lists(st.integers(0, 2), max_size=6)] * 2, st.integers(1, 7), st.lists(st.integers(0, 2), max_size=6))


@settings(max_examples=400, deadline=None)
@given(repeating)
def test_groups_are_the_longest_lyndon_words(w):
    kinds = sorted(set(w))
    codes = [kinds.index(x) for x in w]
    length, group = periodic.lyndon_groups(codes, len(kinds))
    assert length.tolist() == lyndon(codes)
    words = [tuple(codes[i : i + n]) for i, n in enumerate(length.tolist())]
    assert len(set(zip(words, group.tolist()))) == len(set(words)) == len(set(group.tolist()))


@settings(max_examples=400, deadline=None)
@given(repeating, st.sampled_from([(2, 2), (3, 4), (4, 6), (5, 1)]))
def test_runs_are_those_of_the_definition(w, rule):
    assert periodic.runs_of(np.array(w, np.int64), *rule) == all_runs(w, *rule)
    assert periodic.runs_of_words([b"%d" % x for x in w], *rule) == all_runs(w, *rule)


def test_long_texts_take_linear_time():
    assert periodic.runs_of_words([b"a"] * 100_000) == [(0, 100_000, 1)]
    found = periodic.runs_of_words(([b"a"] * 50 + [b"b"]) * 2000)
    assert (0, 102_000, 51) in found and len(found) == 2001


def test_awkward_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t ", "x"), (None, "a b " * 5, "x"), (4, "É é  é é é é é", "x"), (4, "É é  é é é é é", "x"), (5, "z " + "a b " * 5 + "a y", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Runs string").repartition(2)
    got = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.mark(df).collect()))
    assert got == [
        (0, 10, [(0, 10, 2)], "a b"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 7, [(1, 6, 1)], "É é"), (4, 7, [(1, 6, 1)], "É é"), (5, 13, [(1, 11, 2)], "z a b y")
    ]
    assert periodic.mark(df.limit(0)).count() == 0


def test_query_equals_plain_python(spark):
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    want = {}
    for doc_id, text in docs:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = all_runs(words, 4, 6) if n < 400 or h % 10 == 0 else periodic.runs_of_words(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
        want[doc_id] = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) for r in periodic.query(spark, SMALL).collect()}
    assert got == want and any(x[0] for x in want.values())


def test_null_and_empty_documents_in_the_query(spark, tmp_path):
    spark.createDataFrame([(None, None), (None, "a"), (7, None), (26, ""), (26, " ")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic.query(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(r["n_runs"] == 0 and r["start"] is None for r in got)
