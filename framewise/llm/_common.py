"""Helpers shared by the operators: intermediate tables, Arrow passes over texts, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and driver and tasks are one machine, a folder in
    the session's warehouse; on a cluster nothing tells which folder is shared, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_framewise"
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read back, and where: lineage is cut, its size is known to the planner,
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    return written(df, tag)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def replace_columns(df: DataFrame, new: list[str]) -> list[str]:
    """The columns of df that a result keeps besides `new`; a new column replaces one of the same name."""
    taken = {c.lower() for c in new}
    return [c for c in df.columns if c.lower() not in taken]


def as_bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column


def map_texts(
    df: DataFrame,
    fn: Callable[[list], list],
    fields: list[T.StructField],
    text: str = "text",
    keep: list[str] | None = None,
    rows: int = 256,
) -> DataFrame:
    """Append columns computed from a text column, in one Arrow pass without a shuffle.

    fn takes a list of texts as UTF-8 bytes (None for null) and returns one list (or Arrow array) per field.
    `keep` names the input columns that stay (all by default)."""
    names = [f.name for f in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    col = text if text in keep else "__text"
    source = df.select(*[F.col(f"`{c}`") for c in keep], *([] if col == text else [F.col(f"`{text}`").alias(col)]))
    schema = T.StructType([source.schema[c] for c in keep] + fields)
    arrow_types = [to_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                found = fn(as_bytes(batch.column(batch.schema.get_field_index(col))).to_pylist())
                new = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(found, arrow_types)]
                old = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays(old + new, names=keep + names)

    return source.mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, to_arrow(f.dataType)) for f in kind.fields])
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "smallint": pa.int16(),
    }[kind.simpleString()]


P1, P2, P3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * P2
    x = (x ^ (x >> U64(27))) * P3
    return x ^ (x >> U64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER = _LOWER.astype(np.uint8)
_LANES = 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _hash_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [first, last), alike for both cases of A-Z. Spans are taken in lanes of eight bytes, each mixed before
    the next comes in, so that no sums or powers cancel; those of more than _LANES lanes take the start of their BLAKE2b digest."""
    low = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=low[: len(data)])
    lanes = np.ndarray((len(data) + 1,), "<u8", low, strides=(1,))
    size = last - first
    h = mix((lanes[first] & _MASKS[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64) + U64(0x51ED270B)))
    at = np.flatnonzero((size > 8) & (size <= 8 * _LANES))
    for k in range(1, _LANES):
        if not len(at):
            break
        rest = size[at] - 8 * k
        h[at] = mix(h[at] * P1 + (lanes[first[at] + 8 * k] & _MASKS[np.minimum(rest, 8)]))
        at = at[rest > 8]
    for i in np.flatnonzero(size > 8 * _LANES).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(low[first[i] : last[i]], digest_size=8).digest(), "little")
    return h


def words_in(data: np.ndarray, edges: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of the words between ASCII white space, or the bytes that `between` flags; a word ends at an edge as well."""
    word = ~between[data]
    flag = np.zeros(len(data) + 1, np.int8)
    flag[1:-1] = word[1:] != word[:-1]
    flag[0] = flag[-1] = 1
    inner = edges[(edges > 0) & (edges < len(data))]
    begin, end = flag[:-1].astype(bool), flag[1:].astype(bool)
    begin[inner] = True
    end[inner - 1] = True
    return np.flatnonzero(begin & word), np.flatnonzero(end & word) + 1


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the texts in them) of a column of texts; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def hash_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all the texts' words, A-Z lower-cased; words of each text). Nulls have no words."""
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data, offsets = bytes_of(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
    first, last = words_in(data, offsets)
    return _hash_spans(data, first, last), np.diff(np.searchsorted(first, offsets))


def hash_words(text: bytes | None) -> np.ndarray:
    """Of one text."""
    return hash_texts(pa.array([text], pa.binary()))[0]


def split_texts(column: pa.Array) -> list[np.ndarray]:
    """The word hashes of each text."""
    words, n = hash_texts(column)
    ends = np.cumsum(n)
    return [words[a:b] for a, b in zip((ends - n).tolist(), ends.tolist())]


def pieces(batch: pa.RecordBatch, text: int, rows: int = 4096, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with few rows and about `most` bytes of text, or one row."""
    column = batch.column(text).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < batch.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Give freed memory back to the system. Workers are used again, and would keep it beside what later stages take."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc
        ctypes.CDLL(None).malloc_trim(0)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams of a sequence of word hashes; of the whole sequence as one if it is shorter."""
    if not len(words):
        return words
    n = min(n, len(words))
    last = len(words) - n + 1
    h = words[:last]
    for i in range(1, n):
        h = h * P1 + words[i : i + last]
    return mix(h + U64(n))


def pack_ascending(values: np.ndarray) -> bytes:
    """Ascending values as differences, in as many bytes each as the largest needs."""
    d = np.concatenate((values[:1], np.diff(values))).astype("<u8")
    width = max(1, (int(d.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + d.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_ascending(blob: bytes) -> np.ndarray:
    width = blob[0]
    rows = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    d = np.zeros((len(rows), 8), np.uint8)
    d[:, :width] = rows
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)


def spread(df: DataFrame, share: int = 1) -> int:
    """A partition count for a keyed shuffle: what the session is set to, times `share`."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * share)
