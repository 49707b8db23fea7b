"""Token-id output: one concatenated id array with Elias-Fano encoded document boundaries.

Documents go to range partitions by doc_id, are sorted and encoded there, and are written by Spark as Parquet rows that each
hold a segment: the ids of whole documents (2 bytes each if the vocabulary allows it, else 4), their boundaries in
Elias-Fano form and their doc_ids. A boundary costs about 2 + log2(ids / documents) bits; select() finds one without
reading the others, from samples of 32 bits each. A segment is closed at `segment_ids` ids, so no row grows with the input, and
a row group holds few of them.

Defined results: null text is an empty document, whose only id is the end id; rows with equal doc_id follow one another, ordered
by a hash of their text (so that many of them are many range partitions); null doc_ids come first; an empty table gives no segments and no rows. Other columns aren't written."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_bytes, new_path, read_table, spread
from .tokens import ids_of, tokenizer_path

END, SEGMENT_IDS, SAMPLE = 1, 1_000_000, 64
GROUP_BYTES = 16 << 20  # of segments that the writer and a reader hold at once
_HEAD = struct.Struct("<IIB")  # values, bits of the upper part, lower bits of each value


class EliasFano:
    """Ascending integers: the low bits of each side by side, the high bits in unary, and the place of every 64th one-bit."""

    def __init__(self, blob: bytes):
        self.n, self.bits, self.low = _HEAD.unpack_from(blob)
        at = _HEAD.size
        size = (self.n * self.low + 7) // 8
        self.lower = np.frombuffer(blob, np.uint8, size, at)
        self.upper = np.frombuffer(blob, np.uint8, (self.bits + 7) // 8, at + size)
        self.samples = np.frombuffer(blob, "<u4", -(-self.n // SAMPLE), at + size + len(self.upper))

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> low) + np.arange(n)
        bits = int(ones[-1]) + 1 if n else 0
        upper = np.zeros(bits, np.uint8)
        upper[ones] = 1
        lower = ((values[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel()
        return b"".join((_HEAD.pack(n, bits, low), np.packbits(lower, bitorder="little").tobytes(), np.packbits(upper, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes()))

    def _low(self, k: int) -> int:
        at = k * self.low
        chunk = int.from_bytes(self.lower[at // 8 : (at + self.low + 7) // 8].tobytes(), "little")
        return chunk >> at % 8 & ((1 << self.low) - 1)

    def select(self, k: int) -> int:
        """The k-th value: from the nearest sample, past at most 63 one-bits."""
        one, left = int(self.samples[k // SAMPLE]), k % SAMPLE
        byte = one // 8
        seen = int(self.upper[byte] & ((1 << one % 8) - 1)).bit_count()
        left += seen
        while (here := int(self.upper[byte]).bit_count()) <= left:
            left, byte = left - here, byte + 1
        word = int(self.upper[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - k) << self.low | self._low(k)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.upper, count=self.bits, bitorder="little"))
        lower = np.unpackbits(self.lower, count=self.n * self.low, bitorder="little").reshape(self.n, self.low).astype(np.int64)
        return (ones - np.arange(self.n)) << self.low | (lower << np.arange(self.low)).sum(axis=1)


SEGMENT = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("width", T.IntegerType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("ends", T.BinaryType()), T.StructField("ids", T.BinaryType()),
])


def segments(docs: DataFrame, path: str | None = None, end: int = END, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Segments in ascending doc_id order: by part, then by before (the part's ids in earlier segments)."""
    path = path or tokenizer_path()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text"))
    ordered = ordered.withColumn("__tie", F.xxhash64("__text"))
    ordered = ordered.repartitionByRange(spread(docs), "doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").drop("__tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tail, part, before = ids_of(path), end.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        width = 2 if max(ids.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        doc_ids, blobs, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal before, held
            all_ids = np.frombuffer(b"".join(blobs), "<u4")
            ends = EliasFano.encode(np.cumsum([len(b) // 4 for b in blobs]))
            row = [part], [before], [len(all_ids)], [width], [list(doc_ids)], [ends], [all_ids.astype(f"<u{width}").tobytes()]
            before, held = before + len(all_ids), 0
            doc_ids.clear(), blobs.clear()
            types = pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names=SEGMENT.names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                blobs.append(ids.of(text.as_py()) + tail)
                doc_ids.append(doc)
                held += len(blobs[-1]) // 4
                if held >= segment_ids:
                    yield close()
        if blobs:
            yield close()

    return ordered.mapInArrow(run, SEGMENT)


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END, segment_ids: int = SEGMENT_IDS) -> None:
    # A row is megabytes, and Parquet's writer looks at the size of what it holds every hundred rows at the earliest.
    rows = max(1, GROUP_BYTES // (4 * segment_ids))
    segments(docs, path, end, segment_ids).write.option("compression", "zstd").option("parquet.block.row.count.limit", rows).parquet(folder)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids)."""
    stored = spark.read.schema(SEGMENT).parquet(folder)
    parts = stored.groupBy(F.col("part").alias("__part")).agg(F.sum("n_ids").alias("__n"))
    # One row for each partition of the writing job, whatever the input: few enough to sum up in one task and to broadcast.
    from pyspark.sql import Window

    first = parts.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__first"))
    placed = stored.join(F.broadcast(first), F.col("part") == F.col("__part")).select((F.col("__first") + F.col("before")).alias("first"), "width", "doc_ids", "ends", "ids")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names] + [T.StructField("ids", T.BinaryType())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, width, doc_ids, ends, blob in zip(*(batch.column(i) for i in range(5))):
                ends, ids = EliasFano(ends.as_py()).values(), np.frombuffer(blob.as_py(), f"<u{width.as_py()}").astype("<u4")
                starts = np.concatenate(([0], ends[:-1]))
                pieces = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
                columns = [doc_ids.values, pa.array(starts + first.as_py()), pa.array(ends - starts), pa.array([zlib.crc32(x) for x in pieces], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(pieces, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return placed.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-ids")
    write(read_table(spark, sf_dir, "documents"), folder)
    return read(spark, folder)
