"""Sinks: tables as CSV, lists, manifests, revisions that are never overwritten, and images as FITS bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fits import BLOCK, CARD, KINDS


def write_rows(rows: DataFrame, folder: str, order: list[str], digits: int = 6) -> None:
    """Rows as CSV with a header, sorted across the files; doubles with a fixed number of digits, so that equal tables are equal files."""
    shown = [F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    rows.orderBy(*order).select(*shown).write.option("header", "true").csv(folder)


def write_manifest(parts: dict[str, DataFrame], folder: str) -> None:
    """One JSON object for each named part and row."""
    rows = [df.select(F.lit(name).alias("part"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json")) for name, df in parts.items()]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    both.write.json(folder)


def write_list(paths: DataFrame, folder: str, column: str = "path") -> None:
    """One path a line, in a folder that must not exist yet."""
    paths.select(F.col(column).alias("value")).orderBy("value").write.mode("errorifexists").text(folder)


def publish(rows: DataFrame, folder: str, revision: int) -> None:
    """A revision as a folder of its own; one that exists is never overwritten."""
    rows.write.mode("errorifexists").parquet(f"{folder}/revision={revision}")


def latest(revisions: DataFrame) -> DataFrame:
    """The rows of the newest of the revisions read back together."""
    newest = revisions.agg(F.max("revision").alias("__newest"))  # one row
    return revisions.join(F.broadcast(newest), F.col("revision") == F.col("__newest")).drop("__newest")


def card(key: str, value) -> bytes:
    """An 80-character header line."""
    if isinstance(value, bool):
        text = ("T" if value else "F").rjust(20)
    elif isinstance(value, (int, float)):
        text = (f"{value:d}" if isinstance(value, int) else f"{value:.12G}").rjust(20)
    else:
        text = "'" + str(value).replace("'", "''").ljust(8) + "'"
    return f"{key:<8}= {text}"[:CARD].ljust(CARD).encode("ascii", "replace")


def fits_tiles(samples: DataFrame, image: str, width: int, height: int, tile: int = 1024) -> DataFrame:
    """(image, tile_x, tile_y, content) of samples (image, x, y, v): each tile as a FITS file of 32-bit floats with its origin (XORIGIN, YORIGIN)
    and the size of the whole; places without a sample are NaN. A task holds one tile at a time, however large the image is."""
    origin = lambda c: (F.floor(F.col(c) / tile) * tile).cast("int")
    placed = samples.select(image, origin("x").alias("tile_x"), origin("y").alias("tile_y"), "x", "y", F.col("v").cast("double").alias("v"))

    def encode(key: tuple, rows: pa.Table) -> pa.Table:
        x0, y0 = key[1].as_py(), key[2].as_py()
        plane = np.full((min(tile, height - y0), min(tile, width - x0)), np.nan)
        x, y = (rows.column(c).to_numpy() for c in ("x", "y"))
        ok = (x < width) & (y < height)
        plane[y[ok] - y0, x[ok] - x0] = rows.column("v").to_numpy()[ok]
        cards = [card("SIMPLE", True), card("BITPIX", -32), card("NAXIS", 2), card("NAXIS1", plane.shape[1]), card("NAXIS2", plane.shape[0]), card("XORIGIN", x0), card("YORIGIN", y0), card("WHOLE1", width), card("WHOLE2", height), b"END".ljust(CARD)]
        head, data = b"".join(cards), plane.astype(KINDS[-32]).tobytes()
        content = head.ljust(-(-len(head) // BLOCK) * BLOCK) + data + bytes(-len(data) % BLOCK)
        return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([content], pa.binary())], names=[image, "tile_x", "tile_y", "content"])

    schema = f"{image} {dict(samples.dtypes)[image]}, tile_x int, tile_y int, content binary"
    return placed.groupBy(image, "tile_x", "tile_y").applyInArrow(encode, schema)

