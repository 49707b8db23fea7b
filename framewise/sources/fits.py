"""Exposure files: headers and samples of FITS images, read through Spark's binary file source, so any store works.

A header is a run of 80-character cards in blocks of 2880 bytes, ended by END; samples follow, big-endian, BITPIX 8, 16, 32, 64,
-32 or -64, value = BZERO + BSCALE * raw. A file that isn't such an image gives a row with `error` and no header, and no samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, CARD = 2880, 80
# The sample type of each BITPIX.
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def parse_header(content: bytes) -> tuple[dict[str, str], int]:
    """(keys and values as text, where the data begin); a key that repeats has its last value."""
    if content[:6] != b"SIMPLE":
        raise ValueError("not a FITS file")
    keys, at = {}, 0
    while True:
        card = content[at : at + CARD]
        if len(card) < CARD:
            raise ValueError("the header has no end")
        at += CARD
        name = card[:8].decode("ascii", "replace").strip()
        if name == "END":
            return keys, -(-at // BLOCK) * BLOCK
        if card[8:10] == b"= ":
            value = card[10:].decode("ascii", "replace").strip()
            if value.startswith("'"):
                end = value.find("'", 1)
                while value[end + 1 : end + 2] == "'":
                    end = value.find("'", end + 2)
                value = value[1 : end if end > 0 else None].replace("''", "'").rstrip()
            else:
                value = value.split("/")[0].strip()
            keys[name] = value


def files(spark: SparkSession, path: str, pattern: str = "*.fit*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def headers(found: DataFrame) -> DataFrame:
    """(path, digest, keys, error) of files from files()."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("keys", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, errors = [], []
            for content in batch.column(2):
                try:
                    keys.append(list(parse_header(content.as_py())[0].items()))
                    errors.append(None)
                except ValueError as e:
                    keys.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.map_(pa.string(), pa.string())), pa.array(errors, pa.string())], names=schema.names)

    return found.select("path", F.sha2("content", 256).alias("digest"), "content").mapInArrow(run, schema)


def first_of(keys: Column, names: list[str], kind: str = "string") -> Column:
    """The value of the first of several synonyms that has one."""
    return F.coalesce(*[F.when(F.trim(keys[n]) != "", F.trim(keys[n])).try_cast(kind) for n in names])


def frame_facts(found: DataFrame) -> DataFrame:
    """headers() with what reconstruction needs of a frame: filter, exposure and gain, the pattern of its colours and its place on the sky."""
    k = F.col("keys")
    n = lambda *names: first_of(k, list(names), "double")
    return found.select(
        "path", "error", first_of(k, ["FILTER", "FILTER1", "FILTNAME"]).alias("filter"), n("EXPTIME", "EXPOSURE").alias("exposure_s"), n("GAIN", "EGAIN").alias("gain"),
        first_of(k, ["DATE-OBS", "DATE"]).alias("captured"), mosaic(k).alias("pattern"), plate_solution(k).alias("sky"),
    )


def mosaic(keys: Column) -> Column:
    """The colours of a 2 by 2 cell, moved by the header's offsets; null for frames without a pattern."""
    name = F.upper(first_of(keys, ["BAYERPAT", "BAYPAT", "COLORTYP"]))
    odd = lambda *names: F.coalesce(first_of(keys, list(names), "double").cast("int") % 2, F.lit(0))
    dx, dy = odd("XBAYROFF", "BAYOFFX"), odd("YBAYROFF", "BAYOFFY")
    at = lambda x, y: F.substring(name, (y + dy) % 2 * 2 + (x + dx) % 2 + 1, F.lit(1))
    return F.when(name.rlike("^[RGB]{4}$"), F.concat(*[at(F.lit(x), F.lit(y)) for y in (0, 1) for x in (0, 1)]))


def plate_solution(keys: Column) -> Column:
    """Struct (x0, y0, ra, dec, cd11, cd12, cd21, cd22) of a tangent projection, pixels from 0 and degrees; null without a usable one.
    The matrix is CD, or PC with CDELT, or CDELT turned by CROTA2."""
    n = lambda name: first_of(keys, [name], "double")
    d1, d2, turn = n("CDELT1"), n("CDELT2"), F.radians(F.coalesce(n("CROTA2"), F.lit(0.0)))
    spelled = [[n(f"CD{i}_{j}") for i, j in ((1, 1), (1, 2), (2, 1), (2, 2))], [n("PC1_1") * d1, n("PC1_2") * d1, n("PC2_1") * d2, n("PC2_2") * d2], [d1 * F.cos(turn), -d2 * F.sin(turn), d1 * F.sin(turn), d2 * F.cos(turn)]]
    names = ("cd11", "cd12", "cd21", "cd22")
    whole = lambda m: m[0].isNotNull() & m[1].isNotNull() & m[2].isNotNull() & m[3].isNotNull()
    cd = F.coalesce(*[F.when(whole(m), F.struct(*[v.alias(a) for v, a in zip(m, names)])) for m in spelled])
    scale = F.sqrt(F.abs(cd["cd11"] * cd["cd22"] - cd["cd12"] * cd["cd21"])) * 3600
    tan = F.upper(keys["CTYPE1"]).contains("TAN") & F.upper(keys["CTYPE2"]).contains("TAN")
    values = [(n("CRPIX1") - 1).alias("x0"), (n("CRPIX2") - 1).alias("y0"), n("CRVAL1").alias("ra"), n("CRVAL2").alias("dec"), *[cd[a].alias(a) for a in names]]
    known = n("CRPIX1").isNotNull() & n("CRPIX2").isNotNull() & n("CRVAL1").isNotNull() & (F.abs(n("CRVAL2")) <= 90)
    return F.when(tan & known & (scale > 0.01) & (scale < 3600), F.struct(*values))


def samples(found: DataFrame, rows: int = 64, rect: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(path, x, y, plane, v) of files from files(), a few image rows to a batch; only those of the rectangle (x0, y0, x1, y1), ends not included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                content = content.as_py()
                try:
                    keys, at = parse_header(content)
                    kind, axes = np.dtype(KINDS[int(keys["BITPIX"])]), int(keys.get("NAXIS", 0))
                    width, height, planes = (int(keys.get(f"NAXIS{i}", 1)) if i <= axes else 1 for i in (1, 2, 3))
                    raw = np.frombuffer(content, kind, width * height * planes if axes else 0, at).reshape(planes, height, width)
                except (ValueError, KeyError):
                    continue
                zero, scale = float(keys.get("BZERO", 0)), float(keys.get("BSCALE", 1))
                x0, y0, x1, y1 = (0, 0, width, height) if rect is None else (max(rect[0], 0), max(rect[1], 0), min(rect[2], width), min(rect[3], height))
                for p in range(planes):
                    for y in range(y0, y1, rows):
                        v = raw[p, y : min(y + rows, y1), x0:x1].astype(np.float64) * scale + zero
                        ys, xs = np.mgrid[y : y + len(v), x0 : x0 + v.shape[1]]
                        columns = [pa.array([path.as_py()] * v.size), pa.array(xs.ravel().astype(np.int32)), pa.array(ys.ravel().astype(np.int32)), pa.array(np.full(v.size, p, np.int32)), pa.array(v.ravel())]
                        yield pa.RecordBatch.from_arrays(columns, names=["path", "x", "y", "plane", "v"])

    return found.select("path", "content").mapInArrow(run, "path string, x int, y int, plane int, v double")
