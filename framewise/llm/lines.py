"""Line dedup by site-relative frequency, in DataFrame operations only.

A line (trimmed of spaces, tabs and carriage returns) is boilerplate on a host if it stands on more than `percent` % of its pages,
and is repeated at all: on `min_pages` pages, 2 unless set otherwise. A page counts once for a line however often it repeats it; every
occurrence of a boilerplate line is dropped from that host's pages. Lines are counted as (host, 64-bit hash) pairs, summed
on the map side first, so a hot host or line is one row for each task. A host has at most (mean lines per page * 100 /
percent) boilerplate lines, so they go in one array per host; the planner broadcasts that table only if its files are
small enough, and otherwise joins by host, where adaptive execution splits a hot host.

Defined results: null text stays null and counts as a page without lines; blank lines are never boilerplate; a null host
is a host of its own; repeated rows are pages of their own; a page may become empty but is never dropped; an empty table
gives no rows. Other columns stay; `lines_dropped` and `lines_kept` replace columns of those names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, read_table, replace_columns

PERCENT, MIN_PAGES = 10, 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", percent: int = PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(__host, __drop): the hashes of each host's boilerplate lines."""
    pages = pages.select(F.col(f"`{host}`").alias("__host"), F.col(f"`{text}`").alias("__text"))
    totals = pages.groupBy("__host").agg(F.count(F.lit(1)).alias("__pages"))
    keys = F.filter(F.transform(_lines(F.col("__text")), _key), lambda x: x != "")
    lines = pages.select("__host", F.explode(F.array_distinct(F.transform(keys, lambda x: F.xxhash64(x)))).alias("__line"))
    counts = lines.groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_pages)
    often = counts.alias("c").join(totals.alias("t"), F.col("c.__host").eqNullSafe(F.col("t.__host"))).where(F.col("__n") * 100 > F.col("__pages") * percent)
    return often.groupBy(F.col("c.__host").alias("__host")).agg(F.collect_list("__line").alias("__drop"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", percent: int = PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages without their hosts' boilerplate lines, with lines_kept and lines_dropped."""
    drop = materialize(boilerplate(pages, host, text, percent, min_pages), "boilerplate").withColumnRenamed("__host", "__of")
    keep = replace_columns(pages, ["lines_kept", "lines_dropped"])
    joined = pages.select(*[F.col(f"`{c}`") for c in keep]).join(drop, F.col(f"`{host}`").eqNullSafe(F.col("__of")), "left")
    kept = F.filter(F.col("__lines"), lambda x: ~F.coalesce(F.array_contains("__drop", F.xxhash64(_key(x))), F.lit(False)) | (_key(x) == ""))
    out = joined.withColumn("__lines", _lines(F.col(f"`{text}`"))).withColumn("__kept", F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(kept))
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("long")
    columns = [F.array_join("__kept", "\n").alias(text) if c == text else F.col(f"`{c}`") for c in keep]
    return out.select(*columns, size("__kept").alias("lines_kept"), (size("__lines") - size("__kept")).alias("lines_dropped"))


def clean(docs: DataFrame, host: str = "source", percent: int = PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with their own columns: boilerplate lines gone from text, and n_chars, where there is one, counted again."""
    own = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c.lower() in ("lines_kept", "lines_dropped")})
    out = drop_boilerplate(own, host, "text", percent, min_pages)
    count = lambda c: F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"`{c}`")
    return out.select(*[(count(c) if a == c else F.col(f"`{a}`")).alias(c) for a, c in zip(own.columns, docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "lines_kept", "lines_dropped", F.md5("text").alias("text_md5"))


SQL = f"""
WITH line AS (
  SELECT source, doc_id, i, x, trim(x, ' ' || chr(9) || chr(13)) AS k
  FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
total AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
often AS (
  SELECT c.source, c.k FROM (SELECT source, k, count(DISTINCT doc_id) AS n FROM line WHERE k <> '' GROUP BY source, k) c
  JOIN total t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= {MIN_PAGES} AND n * 100 > pages * {PERCENT}),
kept AS (
  SELECT l.doc_id, count(*) FILTER (WHERE o.k IS NULL) AS kept, count(o.k) AS dropped, coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (WHERE o.k IS NULL), '') AS clean
  FROM line l LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.k = o.k GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(kept, 0)::BIGINT AS lines_kept, coalesce(dropped, 0)::BIGINT AS lines_dropped,
       CASE WHEN d.text IS NOT NULL THEN md5(clean) END AS text_md5
FROM documents d LEFT JOIN kept USING (doc_id)
"""
