"""Exposure files of the monolithic XISF kind, read through Spark's binary file source.

"XISF0100", the header's length (4 bytes, little-endian), 4 reserved bytes, an XML header, then data blocks. The first Image element
counts: geometry width:height:channels, a sample format, bounds, and a location: a block of the file, or base64 text in the header.
Blocks may be compressed (zlib, lz4) and byte-shuffled. A file that can't be read gives a row with `error` and no samples."""

from __future__ import annotations

import base64
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The sample formats of the format's definition.
KINDS = {"UInt8": "u1", "UInt16": "u2", "UInt32": "u4", "UInt64": "u8", "Float32": "f4", "Float64": "f8"}


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}")[-1]


def parse_header(content: bytes) -> ET.Element:
    """The first Image element of a file."""
    if content[:8] != b"XISF0100":
        raise ValueError("not an XISF file")
    size = int.from_bytes(content[8:12], "little")
    xml = content[16 : 16 + size].rstrip(b"\0")
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise ValueError("the header declares entities")
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        raise ValueError(f"the header is no XML: {e}") from None
    image = next((e for e in root.iter() if _name(e) == "Image"), None)
    if image is None:
        raise ValueError("the header has no image")
    return image


def keywords(image: ET.Element) -> dict[str, str]:
    """The FITS keywords and properties that the image carries, as text; of a repeated name the last."""
    found = {}
    for e in image:
        if _name(e) == "FITSKeyword":
            found[e.get("name", "")] = e.get("value", "").strip().strip("'").rstrip()
        elif _name(e) == "Property" and e.get("id"):
            found[e.get("id")] = (e.get("value") or e.text or "").strip()
    return found


def unshuffled(block: bytes, item: int) -> bytes:
    """Bytes that were regrouped (all first bytes of the items, then all second ones, ...), as items again; a short tail stays."""
    n = len(block) // item
    whole = np.frombuffer(block, np.uint8, n * item).reshape(item, n).T.tobytes()
    return whole + block[n * item :]


def _block(image: ET.Element, content: bytes) -> bytes:
    location = image.get("location", "").split(":")
    packing = image.get("compression", "")
    if location[0] == "attachment":
        raw = content[int(location[1]) : int(location[1]) + int(location[2])]
    elif location[0] in ("inline", "embedded"):
        holder = image if location[0] == "inline" else next((e for e in image if _name(e) == "Data"), None)
        if holder is None or (holder.get("encoding") or (location[1] if len(location) > 1 else "")) != "base64":
            raise ValueError("the image's data aren't base64")
        raw, packing = base64.b64decode("".join((holder.text or "").split())), packing or holder.get("compression", "")
    else:
        raise ValueError(f"the image is at {image.get('location')}")
    if not packing:
        return raw
    codec, size, *item = packing.split(":")
    name, shuffle = codec.removesuffix("+sh"), codec.endswith("+sh")
    if name == "zlib":
        out = zlib.decompress(raw)
    elif name in ("lz4", "lz4hc"):
        out = pa.decompress(raw, decompressed_size=int(size), codec="lz4_raw", asbytes=True)
    else:
        raise ValueError(f"compression {codec}")
    if len(out) != int(size):
        raise ValueError("the block has another size")
    return unshuffled(out, int(item[0])) if shuffle and item else out


def decode(content: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """(samples by channel, row and column, scaled to 0..1 by the bounds; keywords)."""
    image = parse_header(content)
    try:
        width, height, channels = map(int, image.get("geometry", "").split(":"))
        kind = np.dtype(("<" if image.get("byteOrder", "little") == "little" else ">") + KINDS[image.get("sampleFormat", "")])
    except (ValueError, KeyError):
        raise ValueError("geometry or sample format") from None
    raw = np.frombuffer(_block(image, content), kind, width * height * channels)
    if image.get("pixelStorage", "Planar") == "Normal":
        planes = raw.reshape(height, width, channels).transpose(2, 0, 1)
    else:
        planes = raw.reshape(channels, height, width)
    if "bounds" in image.attrib:
        low, high = map(float, image.get("bounds").split(":"))
    else:
        low, high = (0.0, 1.0) if kind.kind == "f" else (0.0, float(np.iinfo(kind).max))
    return (planes.astype(np.float64) - low) / (high - low), keywords(image)


def headers(found: DataFrame) -> DataFrame:
    """(path, digest, keys, error) of files (path, content)."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("keys", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, errors = [], []
            for content in batch.column(2):
                try:
                    keys.append(list(keywords(parse_header(content.as_py())).items()))
                    errors.append(None)
                except ValueError as e:
                    keys.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.map_(pa.string(), pa.string())), pa.array(errors, pa.string())], names=schema.names)

    return found.select("path", F.sha2("content", 256).alias("digest"), "content").mapInArrow(run, schema)


def samples(found: DataFrame, rows: int = 64) -> DataFrame:
    """(path, x, y, plane, v) of files (path, content), a few image rows to a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                try:
                    planes, _ = decode(content.as_py())
                except (ValueError, zlib.error, pa.ArrowInvalid, OSError):
                    continue
                for p, plane in enumerate(planes):
                    for y in range(0, len(plane), rows):
                        v = plane[y : y + rows]
                        ys, xs = np.mgrid[y : y + len(v), 0 : v.shape[1]]
                        columns = [pa.array([path.as_py()] * v.size), pa.array(xs.ravel().astype(np.int32)), pa.array(ys.ravel().astype(np.int32)), pa.array(np.full(v.size, p, np.int32)), pa.array(v.ravel())]
                        yield pa.RecordBatch.from_arrays(columns, names=["path", "x", "y", "plane", "v"])

    return found.select("path", "content").mapInArrow(run, "path string, x int, y int, plane int, v double")
