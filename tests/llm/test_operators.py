"""The ten operators against brute-force versions, on awkward rows and on the small tables."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewise.llm import _links, binary, decontaminate, lines, lm_score, ngram_join, packing, pii, quality, registry, substring_dedup, tokens, topk
from framewise.llm._common import hash_texts, hash_words, ngrams


def ascii_words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, leaks string, lines_kept string, sig string, node string, start string, `__text` string"


def rng_words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def awkward_texts():
    rng = random.Random(5)
    long = " ".join(rng_words(rng, 30_000))
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    base = rng_words(rng, 80)
    near = base[:40] + ["changed"] + base[41:]
    return [
        None, "", " \t\n ", "one", "two words", "a b c d e", "A B c D e", long, long + " tail", " ".join(base), " ".join(near), " ".join(base), passage,
        "before " * 3 + passage + " after it", "é ü ñ. 漢字 \U0001f600 x@y.co +49 (30) 1234567 4111 1111 1111 1111 10.0.0.1", "line\nline\n\nother\r\n  line \n", "the the the the the the the the", "x y ź  w",
    ]


def table(spark, texts, first=0):
    rows = [(first + i, t, "en", "s" if i % 3 else None, None, "own", "own", "own", "own", "own", "own", "own") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:5], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def awkward(spark):
    return table(spark, awkward_texts())


@pytest.fixture(scope="module")
def docs():
    return duckdb.connect().execute(f"SELECT doc_id, text, source FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


def as_rows(df):
    return [r.asDict() for r in df.collect()]


# --- every query with SQL ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    ours = registry.queries()[name](spark, SMALL).toPandas()
    theirs = con.execute(registry.oracle_sql()[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    order = lambda d: d[cols].astype(object).where(d[cols].notna(), None).astype(str).sort_values(cols).reset_index(drop=True)
    assert order(ours).equals(order(theirs))


# --- tokens, packing, binary ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.tokenizer_path())
    return lambda t: tk.encode(t or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(library, docs):
    ids = tokens.Ids(tokens.tokenizer_path())
    hard = ["<|endoftext|> a", "A <|ENDOFTEXT|> b", "don't. I'll, we've", "Σας ΟΔΟΣ.", "x\x1cy\x85z", "!., a.,b 3.14, 5.", "İ ß ẞ. a1.,", "é. É, é.", "a" * 3000 + ".", "½, ². 字,"]
    for t in hard + [x for x in awkward_texts() if x] + [t for _, t, _ in docs]:
        assert np.frombuffer(ids.of(t.encode()), "<u4").tolist() == library(t), t[:60]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    if not hasattr(test_ids_of_any_text, "both"):
        from tokenizers import Tokenizer

        test_ids_of_any_text.both = tokens.Ids(tokens.tokenizer_path()), Tokenizer.from_file(tokens.tokenizer_path())
    ids, tk = test_ids_of_any_text.both
    assert np.frombuffer(ids.of(text.encode("utf-8", "replace")), "<u4").tolist() == tk.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 4), max_size=8), st.integers(1, 120))
def test_fullest_is_the_best_subset_sum(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    taken = packing.fullest(counts, room)
    assert all(taken[k] <= counts[k] for k in taken)
    assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= room)


def check_packing(pieces, texts, library, size=4096):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    for doc, all_ids in texts.items():
        for ids in all_ids:
            assert all(p["doc_tokens"] == len(ids) for p in by_doc[doc]) or len({tuple(x) for x in all_ids}) > 1
        copies = len(all_ids)
        for i, ids in enumerate(all_ids[:1]):
            for p in by_doc[doc]:
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
            assert sum(p["length"] for p in by_doc[doc]) == copies * len(ids)
    for ps in by_seq.values():
        ps.sort(key=lambda p: p["offset"])
        at = 0
        for p in ps:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= size


def test_packing(spark, awkward, docs, library):
    for df, texts in ((awkward, None), (spark.read.parquet(f"{SMALL}/documents.parquet"), docs)):
        ids = defaultdict(list)
        for doc, text in [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]:
            ids[doc].append(library(text) + [2])
        pieces = as_rows(packing.pack(df))
        check_packing(pieces, ids, library)
    total = sum(p["length"] for p in pieces)
    assert total / (len({p["sequence_id"] for p in pieces}) * 4096) > 0.95
    assert packing.pack(awkward.limit(0)).count() == 0
    with_ids = packing.pack(awkward, with_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in with_ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano_round_trip(steps):
    values = np.cumsum(steps) if steps else np.zeros(0, np.int64)
    ef = binary.EliasFano(blob := binary.EliasFano.encode(values))
    assert ef.values().tolist() == values.tolist()
    assert [ef.select(k) for k in range(len(values))] == values.tolist()
    assert len(blob) <= 16 + len(values) * (2 + max(1, int(values[-1]) // len(values)).bit_length() + 1) / 8 + len(values) / 16 + 8 if len(values) else True


def test_binary_round_trip(spark, awkward, library, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    folder = str(tmp_path / "ids")
    binary.write(awkward, folder, segment_ids=500)
    got = as_rows(binary.read(spark, folder, with_ids=True))
    at, expected = 0, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = library(text) + [1]
        expected.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    binary.write(awkward.limit(0), str(tmp_path / "none"))
    assert binary.read(spark, str(tmp_path / "none")).count() == 0


def test_binary_holds_few_segments_at_once(spark, library, tmp_path):
    """Many segments in one file are many row groups, so that a writer or reader holds 16 MB of them, not all."""
    text, folder = "a b c d " * 25_000, str(tmp_path / "ids")
    binary.write(spark.range(60).select(F.lit(5).alias("doc_id"), F.lit(text).alias("text")), folder, segment_ids=100_000)
    groups = [m.row_group(i).num_rows for f in os.listdir(folder) if f.endswith(".parquet") for m in [pq.read_metadata(f"{folder}/{f}")] for i in range(m.num_row_groups)]
    assert sum(groups) == 60 and max(groups) <= (16 << 20) // 400_000
    one = np.array(library(text) + [1], "<u4")
    got = binary.read(spark, folder).orderBy("start").collect()
    assert [tuple(r) for r in got] == [(5, k * len(one), len(one), zlib.crc32(one.tobytes())) for k in range(60)]


def test_null_and_repeated_ids_have_one_order(spark, library, tmp_path):
    rows = [(None, "a b"), (4, "x"), (4, "y z w"), (None, "c"), (4, "x"), (1, None), (-7, "q r")]
    got = []
    for k, parts in enumerate((1, 3)):
        binary.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), str(tmp_path / str(k)), segment_ids=4)
        got.append([tuple(r) for r in binary.read(spark, str(tmp_path / str(k))).orderBy("start").collect()])
    assert got[0] == got[1] and [r[0] for r in got[0]] == [None, None, -7, 1, 4, 4, 4]
    assert [r[1] for r in got[0]] == [sum(r[2] for r in got[0][:i]) for i in range(len(rows))]


# --- top-k ------------------------------------------------------------------------------------------------------------


def test_top_k_of_large_and_repeated_vectors(spark):
    """Components beyond 32 bits, scores beyond 2^53 and 2^63, repeated ids, vectors of several lengths."""
    rng = random.Random(5)
    rows = [(i % 70, [rng.choice([1e8, -3e7, 2.5e15, 0.3, 7.0]) * rng.random() for _ in range(3 + (i % 9 == 0))]) for i in range(90)]
    rows.append((5, [float("inf"), 1.0, 2.0]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows[:-1]]
    expected = []
    for i, v in whole:
        if i % 10 == 0:
            for j, w in whole:
                if j != i and len(v) == len(w):
                    expected.append((i, sum(x * y for x, y in zip(v, w)), j))
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    best = {}
    for i, s, j in sorted(expected, key=lambda r: (r[0], -r[1], r[2])):
        best.setdefault(i, []).append((clip(s), j))
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 10 = 0"), k=4, vector_rows=7, query_rows=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    assert set(got) == set(best) and all(x == [s for s, _ in best[i][: len(x)]] and len(x) == min(4, len(best[i])) for i, x in got.items())


def test_top_k_on_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(120)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, [None] * 16), (204, [float("nan")] + [0.1] * 15), (205, [float("inf")] * 16), (None, rows[1][1]), (250, [0.0] * 16), (206, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    ok = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), vector_rows=17, query_rows=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    expected = {q: sorted(((v, int(ok[q] @ ok[v])) for v in ok if v != q), key=lambda x: (-x[1], x[0]))[:5] for q in ok if q % 50 == 0}
    assert dict(got) == expected
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_sends_no_copies_of_its_blocks(spark):
    """Neither side is broadcast or repeated for salts, however small its files look; later blocks start from what earlier ones reached."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    best = topk.top_k(df, df.where("vec_id % 10 = 0"), k=3, vector_rows=16, query_rows=8)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan
    whole = np.floor(256 * np.array([v for _, v in rows], np.float32).astype(float)).astype(int)
    expected = {(q, v) for q in range(0, 300, 10) for v in sorted((v for v in range(300) if v != q), key=lambda v: (-(whole[q] @ whole[v]), v))[:3]}
    assert {(r["query_id"], r["vec_id"]) for r in best.collect()} == expected


# --- personal data ----------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for k, kind in enumerate(PATTERNS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            odd = [int(c) for c in d[::-1]]
            luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(odd)) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((k, m.start(), m.end()))
    return sorted(out)


def test_personal_data(spark, awkward, docs):
    tricky = ["a@b@c.de f@g.h..i", "@x.y a@b-.c a.b@c.d.", "1.2.3.4.5 256.1.1.1 001.02.3.4 1.2.3", "4111111111111111 4111-1111-1111-1112 411111111111 1111", "+1 (736) 555-2678 +12 +1..2 +123456789012345678", "é +49 30 1234567é 10.0.0.1é"]
    more = table(spark, tricky, 100)
    for df in (awkward, more, spark.read.parquet(f"{SMALL}/documents.parquet")):
        texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
        got = as_rows(pii.spans(df))
        assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in df.select("doc_id").collect())
        for r in got:
            base = brute_spans(texts[r["doc_id"]])
            text = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in base) for i in range(4)], texts[r["doc_id"]]
            assert r["base_sha256"] == hashlib.sha256(",".join(text).encode()).hexdigest()
            assert set(text) <= set(r["spans"].split(",")) or not text
            assert len([s for s in r["spans"].split(",") if s]) == len(text) + r["n_added"]
    assert pii.spans(awkward.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1.@-+ ()é9%\n", max_size=40))
def test_base_spans_of_any_text(text):
    raw = text.encode()
    place = {len(text[:i].encode()): i for i in range(len(text) + 1)}
    assert sorted((k, place[a], place[b]) for k, a, b in pii.base_spans(raw)) == brute_spans(text)


def test_long_runs_take_linear_time():
    for text in (b"1" * 300_000, b"a" * 300_000 + b" dot ", b"1." * 100_000, b" " * 300_000 + b"[at]", b"x@" * 100_000, b"+" * 300_000 + b"1"):
        pii.candidates(text)


def test_written_out_addresses_are_candidates():
    text = b"write to jane.doe [at] example [dot] com or joe at mail dot example dot org now"
    assert [text[a:b] for a, b in pii.loose_emails(text)] == [b"jane.doe [at] example [dot] com", b"joe at mail dot example dot org"]


def test_candidates_do_not_depend_on_unrelated_text():
    alone = b"write to jane.doe at example.com today"
    span = (0, 9, 32, False)
    assert alone[9:32] == b"jane.doe at example.com" and span in pii.candidates(alone) and span in pii.candidates(alone + b" or polka dot shoes")


def test_expectation_maximisation_finds_the_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    right = np.array([0.95, 0.9, 0.85, 0.6])
    vote = np.where(rng.random((4000, 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    patterns, which, n = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    p = pii.em(patterns, n.astype(float))
    assert ((p[which.ravel()] > 0.5) == truth).mean() > 0.95


# --- quality ----------------------------------------------------------------------------------------------------------


def test_quality(spark, awkward):
    sf = "/root/testdata/sf0.01"
    got = quality.query(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert ((got.doc_id.astype(str).map(lambda x: zlib.crc32(x.encode()) % 5 == 0)) == got.held_out).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()
    held = labels.merge(got[got.held_out], on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.98
    machine = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    scored = quality.score(awkward, machine)
    assert scored.count() == awkward.count() and scored.where("score IS NULL").count() == 0
    kept = quality.keep_good(awkward, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept.columns == awkward.columns and kept.where("score <> 'own'").count() == 0
    assert quality.score(awkward.limit(0), machine).count() == 0


def test_unclear_labels_are_not_learnt_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_machine", lambda x, y, p: seen.append(y.tolist()))
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:6]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(ids[0], f"again {k}") for k in range(40)] + [(None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0), (ids[1], 0), (ids[2], 1), (ids[2], 0), (ids[3], None), (ids[4], 7), (None, 1)], "doc_id long, quality int")
    quality.fit(df, labels)
    assert sorted(seen[0]) == [0.0] + [1.0] * 41
    quality.fit(df, labels, quality.Params(train_rows=10))
    assert len(seen[1]) == 10  # rows, not ids, are bounded


def test_interactions_in_linear_time_equal_all_pairs():
    rng = np.random.default_rng(2)
    x, w, v = rng.normal(size=(5, 12)), rng.normal(size=12), rng.normal(size=(12, 3))
    slow = [0.5 + r @ w + sum(r[i] * r[j] * (v[i] @ v[j]) for i in range(12) for j in range(i)) for r in x]
    assert np.allclose(quality.raw_score(x, 0.5, w, v), slow)


def test_machine_without_labels_is_undecided():
    m = quality.fit_machine(np.zeros((0, quality.N_STATS + 8), np.float32), np.zeros(0, np.float32), quality.Params(buckets=8))
    assert m.score(np.zeros((1, quality.N_STATS + 8), np.float32)).tolist() == [0.5]


# --- lines ------------------------------------------------------------------------------------------------------------


def test_lines(spark, awkward):
    pages = [(i, "h" if i < 12 else None, f"only {i}\n  Menu \nmiddle {i % 6}\n\nMenu\r") for i in range(20)] + [(90, "h", None), (91, "h", ""), (92, "h", "Menu")]
    df = spark.createDataFrame(pages, "doc_id long, source string, text string").repartition(3)
    got = {r["doc_id"]: r for r in lines.drop_boilerplate(df, percent=50, min_pages=3).collect()}
    assert got[3]["text"] == "only 3\nmiddle 3\n" and (got[3]["lines_kept"], got[3]["lines_dropped"]) == (3, 2)
    assert got[15]["text"] == "only 15\nmiddle 3\n"
    assert got[90]["text"] is None and got[91]["text"] == "" and got[92]["text"] == ""
    out = lines.clean(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count() and out.where("lines_kept <> 'own'").count() == 0
    assert lines.drop_boilerplate(awkward.limit(0)).count() == 0


# --- n-gram join ------------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = ascii_words(text.encode() if text else None)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(sets, percent=80):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_similar_sets_share_a_signature():
    scheme, rng = ngram_join.PartEnum(), np.random.default_rng(4)
    for size in [*range(1, 40), 55, 80, 127, 300, 1500]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            most = int(len(a) / 9 * 2)
            drop, add = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64))))
            common = len(np.intersect1d(a, b))
            if common and 100 * common >= 80 * (len(a) + len(b) - common):
                assert np.intersect1d(scheme.sign(a), scheme.sign(b)).size, (len(a), len(b), common)


def near_family(rng, n, size=120):
    base = rng_words(rng, size, 10**6)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_ngram_join_finds_every_link(spark):
    rng = random.Random(8)
    texts = awkward_texts() + near_family(rng, 60) + near_family(rng, 25, 12) + [" ".join(rng_words(rng, 50)) for _ in range(20)]
    df = table(spark, texts)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(df)[0].collect()}
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    comps = brute_components(sets)
    assert got == {(i, len(s), comps[i]) for i, s in sets.items()}
    assert ngram_join.join(df)[0].count() == df.count()
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, c in comps.items() if i == c}
    nulls = df.withColumn("doc_id", F.when(F.col("doc_id") != 9, F.col("doc_id")))
    assert [r["component_id"] for r in ngram_join.join(nulls)[0].where("doc_id IS NULL").collect()] == [None]
    assert ngram_join.join(df.limit(0))[0].count() == 0


# --- decontamination --------------------------------------------------------------------------------------------------


def brute_align(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def test_alignment_equals_cell_by_cell():
    rng = np.random.default_rng(6)
    items = [rng.integers(0, 6, rng.integers(1, 20)).astype(np.uint64) for _ in range(40)]
    windows = [rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(40)]
    best, *_ = decontaminate.align(items, windows)
    assert best.tolist() == [brute_align(a.tolist(), b.tolist()) for a, b in zip(items, windows)]


def test_leaks(spark, awkward):
    rng = random.Random(9)
    items = [rng_words(rng, 30, 10**6) for _ in range(6)]
    edited = list(items[1])
    for i in range(4, 30, 7):
        edited[i] = "other"
    del edited[11]
    texts = [" ".join(rng_words(rng, 50) + items[0] + rng_words(rng, 50)), " ".join(rng_words(rng, 9) + edited), " ".join(items[2][:6]), " ".join(rng_words(rng, 300))] + [" ".join(items[3])] * 30
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(10, None), (None, "x y z"), (11, "too short"), (12, "")], "item_id long, text string")
    for block in (2, 100):
        marked = decontaminate.mark(table(spark, texts), bench, block=block)
        found = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in marked.collect()}
        assert found[0] == [0] and found[1] == [1] and found[2] == [] and found[3] == [] and all(found[i] == [3] for i in range(4, 34))
    out = decontaminate.keep_clean(awkward, bench)
    assert out.columns == awkward.columns and out.count() == awkward.count() and out.where("leaks <> 'own'").count() == 0
    assert decontaminate.mark(awkward.limit(0), bench).count() == 0 and decontaminate.mark(awkward, bench.limit(0)).where("size(leaks) > 0").count() == 0


@pytest.mark.parametrize("copies", [0, 1, 3000])
def test_edited_copies_keep_their_seeds(copies):
    """Every fifth word is changed; exact copies make the changed n-grams no rarer, thousands of edited ones the others common."""
    for size in (16, 20, 24, 30, 40, 60):
        item = [f"i{k}" for k in range(size)]
        edited = ["new" + w if k % 5 == 2 else w for k, w in enumerate(item)]
        texts = [" ".join(edited).encode()] * max(1, copies) + [" ".join(item).encode()] * min(copies, 2)
        counts = Counter()
        for t in texts:
            counts.update(ngrams(hash_words(t), 3).tolist())
        for known in (counts, None):
            found = decontaminate.Matcher([(7, " ".join(item).encode())], known).leaks(texts[:1] + texts[-1:])
            score = brute_align(item, edited) / (2 * size)
            assert score >= 0.5 and found[0][0]["score"] == round(score, 6) and found[1][0]["item_id"] == 7


def test_leaks_equal_aligning_every_item_with_every_text(spark):
    rng = random.Random(66)
    items = [rng_words(rng, rng.randrange(6, 40), 60 if i % 2 else 10**6) for i in range(25)]
    texts = []
    for _ in range(120):
        words = rng_words(rng, rng.randrange(0, 60), 60)
        for item in rng.sample(items, 2):
            for w in item:
                kind = rng.random()
                words += [] if kind < 0.06 else ["changed"] if kind < 0.2 else [w, *rng_words(rng, rng.randrange(1, 9))] if kind < 0.26 else [w]
        texts.append(words)
    hashes = lambda words: hash_words(" ".join(words).encode())
    expected = {}
    for i, item in enumerate(items):
        best, *_ = decontaminate.align([hashes(item)] * len(texts), [hashes(t) for t in texts])
        grams = {tuple(item[k : k + 3]) for k in range(len(item) - 2)}
        for d, score in enumerate(best.tolist()):
            if score >= len(item) and any(tuple(texts[d][k : k + 3]) in grams for k in range(len(texts[d]) - 2)):
                expected[d, i] = round(score / (2 * len(item)), 6)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    marked = decontaminate.mark(docs, bench, block=10).collect()
    assert {(r["doc_id"], x["item_id"]): x["score"] for r in marked for x in r["leaks"]} == expected and len(expected) > 150


def test_equal_items_are_reported_each(spark):
    bench = spark.createDataFrame([(1, "a b c d e"), (2, "A b  c d e"), (2, "a b c d e")], "item_id long, text string")
    df = spark.createDataFrame([(5, "x a b c d e y"), (None, "a b c d e")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, [x["item_id"] for x in r["leaks"]]) for r in decontaminate.mark(df, bench).collect()) == [(0, [1, 2]), (5, [1, 2])]


def test_alignments_are_reported_where_they_stand():
    item = [f"w{k}" for k in range(10)]
    place = lambda words: {(x["first_word"], x["n_words"]) for x in decontaminate.Matcher([(1, " ".join(item).encode())]).leaks([" ".join(words).encode()])[0]}
    assert place(["a", "b", *item[:5], "x", "y", *item[5:], "c"]) == {(2, 12)}
    assert place(["a", "b", *item[3:8], "c", "d"]) == {(2, 5)}
    assert place(item) == {(0, 10)}


def test_items_come_in_blocks_of_bounded_size(spark):
    bench = spark.createDataFrame([(i, "word " * 200) for i in range(20)], "item_id long, text string")
    sizes = [len(b) for b in decontaminate._blocks(bench, 8, 3000)]
    assert sum(sizes) == 20 and max(sizes) == 3


def test_benchmark_passages_in_documents_are_found(spark, docs):
    items = duckdb.connect().execute(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    exact = {(d, i) for d, t, _ in docs for i, b in items if t and b in t}
    assert exact <= {(r["doc_id"], r["item_id"]) for r in decontaminate.query(spark, SMALL).collect()}


# --- LM scoring -------------------------------------------------------------------------------------------------------


def test_lm_scores(spark, awkward):
    rows = [(r["doc_id"], ascii_words((r["text"] or "").encode())) for r in awkward.select("doc_id", "text").collect()]
    counts = Counter(tuple(w[i : i + n]) for _, w in rows for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in rows)

    def one(w, i):
        for n in range(min(3, i + 1), 0, -1):
            gram = tuple(w[i - n + 1 : i + 1])
            if counts[gram] >= (2 if n > 1 else 1):
                return 0.4 ** (min(3, i + 1) - n) * counts[gram] / (counts[gram[:-1]] if n > 1 else total)

    expected = sorted((d, len(w), sum(int(np.floor(np.log(one(w, i)) * 1e6 + 0.5)) for i in range(len(w))) / 1e6) for d, w in rows)
    for chunk in (2_000, 12_000_000):
        got = sorted((r["doc_id"], r["n_words"], r["log_score"]) for r in lm_score.scores(awkward, chunk_chars=chunk, range_grams=3_000).collect())
        assert got == expected
    assert lm_score.scores(awkward.limit(0)).count() == 0


def test_lm_scores_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c a b c"), (None, "a b c a b c"), (7, "a b c"), (7, "d"), (None, None)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_unseen"]) for r in lm_score.scores(spark.createDataFrame(rows, "doc_id long, text string"), chunk_chars=40).collect())
    assert got == [(0, 0, 0), (0, 6, 0), (0, 6, 0), (7, 1, 0), (7, 3, 0)]


# --- substring dedup --------------------------------------------------------------------------------------------------


def test_repeated_paragraphs_and_passages(spark, awkward):
    rng = random.Random(10)
    fresh = lambda n: rng_words(rng, n, 10**6)
    passage, para = fresh(55), fresh(64)
    near = para[:20] + ["edit"] + para[20:]
    texts = [" ".join(fresh(30) + passage + fresh(30)), " ".join(fresh(7) + passage + fresh(50)), " ".join(para) + "\n" + " ".join(fresh(40)), " ".join(fresh(40)) + "\n" + " ".join(near), " ".join(fresh(200)), " ".join(passage).upper()]
    df = table(spark, texts)
    gone = as_rows(substring_dedup.removals(df))
    assert {(r["doc_id"], r["keep_doc_id"]) for r in gone if r["kind"] == "paragraph"} == {(3, 2)}
    assert {(r["doc_id"], r["keep_doc_id"]) for r in gone if r["kind"] == "passage"} >= {(1, 0), (5, 0)}
    assert {r["doc_id"] for r in gone} == {1, 3, 5}
    cleaned = {r["doc_id"]: r["text"] for r in substring_dedup.clean(df, substring_dedup.removals(df)).collect()}
    assert cleaned[0] == texts[0] and cleaned[2] == texts[2] and cleaned[3] == texts[3].split("\n")[0] and len(cleaned[1].split()) < 90
    assert substring_dedup.removals(awkward).where("doc_id IS NULL").count() == 0
    assert substring_dedup.removals(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [[-(2**63), -(2**41) - 5, -3, 7, 2**41, 2**50 + 1, 2**63 - 1], list(range(7))])
def test_any_doc_id_and_every_word_take_part(spark, ids):
    """Removals don't depend on the size of doc_ids, and a text has no last place."""
    rng = random.Random(12)
    fresh = lambda n: rng_words(rng, n, 10**6)
    passage, para = fresh(70), fresh(64)
    long = "x\n" * (substring_dedup.PLACES + 10)
    texts = [" ".join(fresh(30) + passage + fresh(30)), " ".join(para), " ".join(fresh(9) + passage + fresh(50)), " ".join(fresh(40)) + "\n" + " ".join(para[:30] + ["edit"] + para[31:])]
    texts += [long + " ".join(para) + "\n" + " ".join(fresh(30) + passage + fresh(30)), " ".join(fresh(80)), " ".join(para)]
    df = spark.createDataFrame([(None, texts[1]), *zip(ids, texts)], "doc_id long, text string")
    gone = [r for r in as_rows(substring_dedup.removals(df)) if r["doc_id"] != ids[4] or r["first_word"] >= substring_dedup.PLACES]
    lines = {(ids.index(r["doc_id"]), r["first_word"], ids.index(r["keep_doc_id"]), r["keep_first_word"]) for r in gone if r["kind"] == "paragraph"}
    assert lines == {(3, 40, 1, 0), (4, substring_dedup.PLACES + 10, 1, 0), (6, 0, 1, 0)}
    passages = {(ids.index(r["doc_id"]), ids.index(r["keep_doc_id"])) for r in gone if r["kind"] == "passage" and r["n_words"] > 40}
    assert {(2, 0), (4, 0)} <= passages and {r["doc_id"] for r in gone} == {ids[i] for i in (2, 3, 4, 6)}


def test_numbered_documents_have_the_same_removals(spark, docs):
    df = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string").repartition(3)
    plain = sorted(map(str, as_rows(substring_dedup.removals(df))))
    shift = 2**62
    far = substring_dedup.removals(df.withColumn("doc_id", F.col("doc_id") + shift))
    assert plain and sorted(map(str, as_rows(far.withColumn("doc_id", F.col("doc_id") - shift).withColumn("keep_doc_id", F.col("keep_doc_id") - shift)))) == plain


def test_exact_copies_of_paragraphs_are_all_found(spark, docs):
    gone = {(r["doc_id"], r["first_word"]) for r in substring_dedup.query(spark, SMALL).where("kind = 'paragraph'").collect()}
    seen = set()
    for doc, text, _ in docs:
        at = 0
        for line in (text or "").split("\n"):
            w = tuple(ascii_words(line.encode()))
            if len(w) >= 20:
                assert (w not in seen) or (doc, at) in gone
                seen.add(w)
            at += len(w)


def test_bands_meet_at_the_threshold():
    rng, met = np.random.default_rng(3), 0
    for _ in range(200):
        a = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        b = np.concatenate((a[:80], rng.integers(0, 1 << 63, 10, dtype=np.uint64)))
        x, y = substring_dedup.min_bands([a, b])
        met += bool((x == y).any())
    assert met >= 198


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from([b" ", b"\n", b"\t", b"\x0b", b"\x0c", b"\r", b"a", b"B", b"\xc3\xa9", b"\xc2\xa0", b"\x1c"]), max_size=14).map(b"".join), max_size=6))
def test_words_of_texts_are_those_of_split(texts):
    hashes, n = hash_texts(pa.array(texts, pa.binary()))
    words = [ascii_words(t) for t in texts]
    assert n.tolist() == [len(w) for w in words]
    assert hashes.tolist() == [hash_words(x).tolist()[0] for w in words for x in w]


def test_word_hashes_differ_and_long_words_have_one():
    words = [f"{a}{b}".encode() for a in range(300) for b in ("x", "xx", "y", "\u00e9")]
    assert len(set(hash_words(b" ".join(words)).tolist())) == len(set(words))
    long = hash_words(b"z" * 1_500_000 + b" ab " * 200_000 + b"z" * 1_500_000)
    assert len(long) == 200_002 and long[0] == long[-1] and set(long[1:-1].tolist()) == set(hash_words(b"AB").tolist())
    assert len(ngrams(hash_words(b"a b"), 5)) == 1


def structured_pair(letters: int) -> tuple[bytes, bytes]:
    """A Thue-Morse word over a and b, and its complement: sums of letters times powers are alike modulo powers of two."""
    swap, word = bytes.maketrans(b"ab", b"ba"), b"a"
    while len(word) < letters:
        word += word.translate(swap)
    return word, word.translate(swap)


def test_structured_words_have_hashes_of_their_own():
    for k in range(1, 15):
        a, b = structured_pair(2**k)
        assert len(set(hash_words(b" ".join([a, b, a.upper()])).tolist())) == 2


@pytest.mark.parametrize("letters", [2**10, 2**14])
def test_structured_words_link_and_count_apart(spark, letters):
    a, b = (x.decode() for x in structured_pair(letters))
    df = spark.createDataFrame([(1, a), (2, b), (3, "other words"), (4, a)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(df)[0].collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    items = spark.createDataFrame([(0, f"{a} {a} {a} end")], "item_id long, text string")
    found = decontaminate.mark(spark.createDataFrame([(1, f"{a} {a} {a} end"), (2, f"{b} {b} {b} end")], "doc_id long, text string"), items)
    assert [r["doc_id"] for r in found.where("size(leaks) > 0").collect()] == [1]
    assert substring_dedup.removals(spark.createDataFrame([(1, f"{a} " * 30), (2, f"{b} " * 30)], "doc_id long, text string")).count() == 0
    scored = {r["doc_id"]: r["log_score"] for r in lm_score.scores(df).collect()}
    assert scored[1] == scored[4] == round(math.log(2 / 5), 6) and scored[2] == round(math.log(1 / 5), 6)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(17)
    for size in (1, 5, 200, 256, 257, 900, 3000):
        sets = [np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64)) for _ in range(3)]
        sets.append(np.unique(np.concatenate((sets[0][: size * 9 // 10], rng.integers(0, 1 << 63, size // 2 + 1, dtype=np.uint64)))))
        blobs = _links.sketches(np.concatenate(sets), np.array(list(map(len, sets))))
        rows = _links._unpack_all(blobs)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                far = len(np.setxor1d(a, b))
                assert _links._apart(rows[i : i + 1], rows[j : j + 1])[0] <= far and (blobs[i] == blobs[j]) == (far == 0)
    assert _links.sketches(np.zeros(0, np.uint64), np.array([0]))[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=40))
def test_packed_values_round_trip(values):
    assert _links.unpack_values(_links.pack_values(np.array(values, np.int64))).tolist() == values


def test_runs_of_any_length(spark, monkeypatch):
    """A run that many collections share has one first member in the end, whatever a collection holds of it."""
    rng = random.Random(3)
    sigs = [(rng.randrange(1 << 63) << 1, k) for k in (1, 2, 5, 40, 90)]
    rows = [(s, node, 7) for s, k in sigs for node in rng.sample(range(10**6), k)] * 2
    rng.shuffle(rows)
    batches = []
    for part in (rows[::2], rows[1::2]):
        sender = _links.Sender(3)
        batches += [b for x in sender.add(*(np.array(c, t) for c, t in zip(zip(*part), (np.uint64, np.int64, np.int64)))) for b in [x]] + list(sender.flush())
    sent = spark.createDataFrame([tuple(r.values()) for b in batches for r in b.to_pylist()], _links.SENT)
    got = _links.find_runs(sent, 3).select("sig", "node", "first").collect()
    for s, k in sigs:
        own = {n for x, n, _ in rows if x == s}
        edges = [(r["node"], r["first"]) for r in got if r["sig"] == s >> 16]
        root = {n: n for n in own}
        for _ in range(3):
            for a, b in edges:
                root[a] = min(root[a], root[b])
        assert set(root.values()) == {min(own)}


def test_components_of_any_graph_in_few_rounds(spark, monkeypatch):
    """Stars need no round, a path of 300 nodes takes as many as its length has bits, about, and any graph has its components."""
    rng, tables, written = random.Random(5), [], _links.written
    monkeypatch.setattr(_links, "written", lambda df, tag: tables.append(tag) or written(df, tag))

    def of(links):
        tables.clear()
        found = _links.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
        got = {r["node"]: r["comp"] for r in found}
        want = {i: i for x in links for i in x}
        while any(want[a] != want[b] for a, b in links):
            for a, b in links:
                want[a] = want[b] = min(want[a], want[b])
        assert len(found) == len(got) and got == want
        return len(tables)

    assert of([(7 * i, 7 * i + k) for i in range(5) for k in range(1, 7)]) == 1
    ids = list(range(300))
    assert of([(i + 1, i) for i in ids]) <= 11
    rng.shuffle(ids)
    assert of(list(zip(ids, ids[1:]))) <= 14
    of([(rng.randrange(400), rng.randrange(400, 800)) for _ in range(420)])


def test_later_links_join_components(spark):
    frame = lambda rows, columns: spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns))
    comps = frame([(1, 1), (5, 1), (2, 2), (6, 2), (3, 3), (7, 3)], ["node", "comp"])
    links = frame([(5, 6, 1, 2), (6, 8, 2, 8), (9, 10, 9, 10)], ["a", "b", "c_a", "c_b"])
    assert sorted(map(tuple, _links.joined(comps, links).collect())) == [(1, 1), (2, 1), (3, 3), (5, 1), (6, 1), (7, 3), (8, 1), (9, 9), (10, 9)]


def test_pairs_of_a_common_run_leave_in_small_batches(monkeypatch):
    """400 equal sketches in as many components are 79,800 pairs, which a task doesn't hold at once; each comes once, with its components."""
    monkeypatch.setattr(_links, "AT_ONCE", 5000)
    node = np.random.default_rng(2).permutation(400)
    batches = list(_links._close(np.zeros(400, int), node, node + 1000, np.full(400, 100), np.ones((400, 256), np.uint8), False, 80))
    assert max(b.num_rows for b in batches) < 5400
    found = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert len(found) == 400 * 399 // 2 and set(found) == {(a, b, a + 1000, b + 1000) for b in range(400) for a in range(b)}


def test_freed_memory_returns_to_the_system():
    """A worker that has held many small arrays is used again; what they took isn't kept beside the next stage's."""
    code = """if True:
        import re, numpy as np
        from framewise.llm._common import release
        own = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
        before = own()
        held = [np.ones(5000) for _ in range(5000)]
        last = [np.ones(50) for _ in range(100)]
        assert own() > before + 150
        del held
        release()
        assert own() < before + 40, (before, own())"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(_links.__file__)) + "/..")


def test_one_doc_id_on_two_texts_loses_no_link(spark):
    rng = random.Random(21)
    a, b = (" ".join(rng_words(rng, 70, 10**6)) for _ in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (4, " ".join(rng_words(rng, 70, 10**6))), (None, a), (5, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.join(df)[0].collect()), key=str)
    assert got == sorted([(1, 66, 1), (1, 66, 1), (2, 66, 1), (3, 66, 1), (4, 66, 4), (None, 66, None), (5, 0, 5)], key=str)
    gone = {(r["doc_id"], r["keep_doc_id"]) for r in as_rows(substring_dedup.removals(df)) if r["kind"] == "paragraph"}
    assert gone == {(2, 1), (3, 1)}
