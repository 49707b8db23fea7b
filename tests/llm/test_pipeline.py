"""The pipeline against a brute-force version of each stage."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F
from test_operators import SMALL, awkward_texts, brute_components, shingle_set, table

import corpus_pipeline
from framewise.llm import decontaminate, quality
from framewise.llm._common import hash_words


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    machine = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = {r["doc_id"]: (r["source"], r["text"]) for r in quality.score(docs, machine).where("predicted = 1").collect()}

    pages, seen = Counter(s for s, _ in rows.values()), defaultdict(int)
    for s, t in rows.values():
        for line in {x.strip(" \t\r") for x in t.split("\n")} - {""}:
            seen[s, line] += 1
    often = {k for k, n in seen.items() if n >= 2 and n * 100 > pages[k[0]] * 10}
    rows = {i: "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r")) not in often) for i, (s, t) in rows.items()}

    comps = brute_components({i: shingle_set(t) for i, t in rows.items()})
    rows = {i: t for i, t in rows.items() if comps[i] == i}

    items = [(r["item_id"], r["text"].encode()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    counts = Counter()
    for t in rows.values():
        w = hash_words(t.encode())
        if len(w) >= 3:
            counts.update(decontaminate.ngrams(w, 3).tolist())
    matcher = decontaminate.Matcher(items, counts)
    rows = {i: t for i, t in rows.items() if not matcher.leaks([t.encode()])[0]}

    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {p["doc_id"] for p in pieces} == set(rows)
    done = Counter()
    for p in pieces:
        done[p["doc_id"]] += p["length"]
    assert all(done[p["doc_id"]] == p["doc_tokens"] for p in pieces)


def test_stages_on_awkward_and_empty_tables(spark):
    """Nulls in any column, clashing names and no rows; all stages but the last keep the columns."""
    awkward = table(spark, awkward_texts()).withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id")))
    for df in (awkward, awkward.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SMALL)
            assert out.columns == df.columns and out.count() <= df.count(), name
        pieces = corpus_pipeline.STAGES[-1][1](spark, df, SMALL)
        assert pieces.count() >= df.count() and (pieces.count() > 0) == (df.count() > 0)
