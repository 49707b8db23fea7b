"""The catalogue's totals over streams of events (event_id, grp, ts, cents): watermarks bound the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks want timestamps with a zone; times without one are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def without_repeats(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, as long as its repeats come within `late` of it."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour", step: str | None = None) -> DataFrame:
    """(grp, window_start, n, cents, low, high): totals of each window, final once the watermark has passed it."""
    w = F.window("ts", size, step) if step else F.window("ts", size)
    totals = _timed(events, late).groupBy("grp", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.min("cents").alias("low"), F.max("cents").alias("high"))
    return totals.select("grp", F.col("w.start").alias("window_start"), "n", "cents", "low", "high")


def sessions(events: DataFrame, key: str, gap: str = "8 hours", late: str = "1 hour") -> DataFrame:
    """(key, session_start, session_end, n) of rows no more than `gap` apart."""
    s = _timed(events, late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("session_start"), F.max("ts").alias("session_end"))
    return s.select(key, "session_start", "session_end", "n")


def append_partials(stream: DataFrame, folder: str, checkpoint: str, key: list[str]):
    """Each micro-batch's partial sums (key, n, cents) as Parquet under its batch number; a batch that is run again replaces its own
    rows, so their sum counts each event once."""
    def put(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
        sums.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def combined(partials: DataFrame, key: list[str]) -> DataFrame:
    return partials.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
