"""The driver's tables as frames, samples, ordered values, tiles and stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: (frame_id, grp, ts, day, cents, known): exposures in cents, unknown for status P."""
    o = table(spark, sf_dir, "orders")
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    return o.select(F.col("o_orderkey").alias("frame_id"), F.col("o_orderpriority").alias("grp"), F.col("o_orderdate").alias("ts"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("camera"), cents.alias("cents"), F.when(F.col("o_orderstatus") != "P", cents).alias("known"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: (frame_id, x, y, ch, q, w): quantities as values, percents of 100 less the discount as weights, both integers."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("frame_id"), (F.col("l_partkey") % 64).cast("int").alias("x"), (F.col("l_suppkey") % 64).cast("int").alias("y"), F.col("l_returnflag").alias("ch"), F.col("l_linestatus").alias("part"), F.col("l_quantity").cast("long").alias("q"), (100 - F.floor(F.col("l_discount") * 100 + 0.5)).cast("long").alias("w"))


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: (event_id, grp, ts, day, user_id, cents, props)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("grp"), "ts", F.to_date("ts").alias("day"), "user_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"), "props")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: (id, frame, x, y, flux) on a grid of millionths, so that squares are alike in any engine."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda i: F.floor(F.col("embedding")[i].cast("double") * 1000000 + 0.5)
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("frame"), (part(0) / 10000).alias("x"), (part(1) / 10000).alias("y"), (F.abs(part(2)) / 1000000).alias("flux"))


def mosaics(spark: SparkSession, sf_dir: str, wide: int = 8) -> DataFrame:
    """embeddings as tiles of larger frames: (frame, tx, ty, plane), `wide` by `wide` tiles of 8 by 8 sites in a frame, values on a grid of ten-thousandths."""
    e = table(spark, sf_dir, "embeddings")
    n = F.col("vec_id") % (wide * wide)
    values = F.transform("embedding", lambda v: F.floor(v.cast("double") * 10000 + 0.5) / 10000)
    return e.select(F.floor(F.col("vec_id") / (wide * wide)).alias("frame"), (n % wide).alias("tx"), F.floor(n / wide).alias("ty"), values.alias("plane"))
