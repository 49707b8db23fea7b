"""Lists of files: text with one path a line, and what the paths name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The file endings of each format.
ENDINGS = {"fits": ("fits", "fit", "fts"), "xisf": ("xisf",)}


def format_of(path: Column) -> Column:
    """The format that a path's ending names, or null."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*[F.when(ending.isin(*endings), name) for name, endings in ENDINGS.items()])


def read_list(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """(entry, path, format) of a list's lines: blanks and lines that begin with # are left out, quotes and white space around a
    path too; a relative path is one beside the list."""
    base = (base or path.rsplit("/", 1)[0]).rstrip("/")
    entry = F.trim(F.replace(F.trim("value"), F.lit('"'), F.lit("")), F.lit(" \t\r﻿"))
    rows = spark.read.text(path).select(entry.alias("entry")).where((F.col("entry") != "") & ~F.col("entry").startswith("#"))
    whole = F.when(F.col("entry").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?/"), F.col("entry")).otherwise(F.concat(F.lit(base + "/"), F.col("entry")))
    return rows.select("entry", whole.alias("path")).withColumn("format", format_of(F.col("path")))


def with_files(listed: DataFrame, found: DataFrame) -> DataFrame:
    """listed with content and `error`: a listed file that isn't there, or is of no known format, is named, never left out. Schemes and
    repeated slashes at the start of paths don't count."""
    plain = lambda p: F.regexp_replace(p, r"^([A-Za-z][A-Za-z0-9+.-]*:)?/+", "/")
    files = found.select(plain(F.col("path")).alias("__plain"), "content")
    out = listed.join(files, plain(F.col("path")) == F.col("__plain"), "left")
    error = F.when(F.col("format").isNull(), "unknown format").when(F.col("__plain").isNull(), "no such file")
    return out.select("entry", "path", "format", "content", error.alias("error"))
