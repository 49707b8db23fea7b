"""Catalogue and project operations: screens, summaries, path rules, memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def screened_by(screens: list[tuple[str, Column]]) -> Column:
    """The first screen whose verdict is true, in order; an unjudged row (null) is never screened out."""
    return F.coalesce(*[F.when(F.coalesce(v, F.lit(False)), F.lit(name)) for name, v in screens])


def unjudged(df: DataFrame, screens: list[tuple[str, Column]]) -> DataFrame:
    """(screen, n): rows without a verdict, by screen."""
    counts = df.agg(*[F.count_if(v.isNull()).alias(name) for name, v in screens])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("screen"), F.col(name).alias("n")) for name, _ in screens])).alias("x")).select("x.*")


def rewrite(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The path with its first matching prefix replaced (letter case and slash direction don't matter), or null."""
    plain = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    return F.coalesce(*[F.when(F.startswith(plain(path), F.lit(old.replace("\\", "/").lower())), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))) for old, new in rules])


def locate_first(df: DataFrame, key: str, candidates: list[Column], existing: DataFrame, name: str) -> DataFrame:
    """(key, path): the first candidate, in order, that is among existing[name]; null if none is."""
    long = df.select(key, F.posexplode(F.array(*candidates)).alias("at", "__c"))
    found = long.join(existing.select(F.col(name).alias("__c")).distinct(), "__c", "left_semi").groupBy(key).agg(F.min_by("__c", "at").alias("path"))
    return df.select(key).join(found, key, "left")


def slug(name: Column, most: int = 40) -> Column:
    """Lower case, runs of other characters as single hyphens, at most `most` characters."""
    return F.btrim(F.substr(F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(1), F.lit(most)), F.lit("-"))


def latest(df: DataFrame, key: list[str], revision: str) -> DataFrame:
    """The rows of each key's largest revision."""
    top = df.groupBy(*key).agg(F.max(revision).alias(revision))
    return df.join(top, [*key, revision], "left_semi")


def ingest(members: DataFrame, arrivals: DataFrame, digest: str) -> DataFrame:
    """arrivals with status: duplicate (of a member, or of an earlier arrival) or new."""
    known = members.select(digest).distinct().withColumn("__known", F.lit(True))
    first = arrivals.groupBy(digest).agg(F.min("id").alias("__first"))
    out = arrivals.join(known, digest, "left").join(first, digest)
    return out.withColumn("status", F.when(F.col("__known") | (F.col("id") > F.col("__first")), "duplicate").otherwise("new")).drop("__known", "__first")


def review(members: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """members with the verdicts' reason where they have one, and whether it changed (null-safe)."""
    v = verdicts.select(key, F.col("reason").alias("__new"), F.lit(True).alias("__hit"))
    out = members.join(v, key, "left").withColumn("__r", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("reason")))
    return out.withColumn("changed", ~F.col("__r").eqNullSafe(F.col("reason"))).withColumn("reason", F.col("__r")).drop("__r", "__new", "__hit")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def without(df: DataFrame, listed: DataFrame, key: list[str]) -> DataFrame:
    return df.join(listed.select(*key).distinct(), key, "left_anti")


def numbered_by_group(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def bounded_digest(content: Column, part: int = 1 << 16) -> Column:
    """The first 16 hex digits of SHA-256 over the length (8 bytes, little-endian), the first `part` bytes and, of contents longer than
    two parts, the last: a bounded identity of contents of any size."""
    size = F.octet_length(content)
    digits = F.lpad(F.hex(size.cast("long")), 16, "0")
    length = F.unhex(F.concat(*[F.substring(digits, at, 2) for at in range(15, 0, -2)]))
    tail = F.when(size > 2 * part, F.substring(content, -part, part)).otherwise(F.lit(b""))
    return F.substring(F.sha2(F.concat(length, F.substring(content, 1, part), tail), 256), 1, 16)
