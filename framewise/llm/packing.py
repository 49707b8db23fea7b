"""Packing by minimum bin slack.

A document is its token ids and an end id. Ids beyond a multiple of `size` are cut off as whole sequences; what remains, a
piece shorter than `size`, waits in a window. Each sequence starts with the longest waiting piece; a bitset subset-sum over
the multiset of waiting lengths (bit s of an integer: some pieces sum to s) finds the fill closest to the capacity, and
walking the layers back gives how many pieces of each length it takes. This is done within each input partition, without a
shuffle; only a partition's last sequences can be short. A sequence is padded to `size`, except when its pieces end at a
power of two.

Defined results: null text is an empty document, whose only id is the end id; repeated rows and rows with a null doc_id
are documents of their own; an empty table gives no rows. Result columns replace input columns of the same name."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import as_bytes, read_table
from .tokens import ids_of, tokenizer_path

SIZE, END, WINDOW = 4096, 2, 1024


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length to take so that their sum is the largest that is at most `room`."""
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            more = reach | ((reach << (length * k)) & mask)
            if more != reach:
                layers.append((reach, length, k))
                reach = more
            left, k = left - k, k * 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, defaultdict(int)
    for before, length, k in reversed(layers):
        if not before >> at & 1:
            taken[length] += k
            at -= length * k
    return dict(taken)


class Packer:
    """Packs one partition. A piece is a tuple whose second item is its length; sequences come out as lists of pieces."""

    def __init__(self, size: int = SIZE, window: int = WINDOW):
        self.size, self.window, self.waiting, self.n = size, window, defaultdict(deque), 0

    def _take(self, length: int) -> tuple:
        piece = self.waiting[length].popleft()
        if not self.waiting[length]:
            del self.waiting[length]
        self.n -= 1
        return piece

    def add(self, piece: tuple, length: int) -> None:
        self.waiting[length].append(piece)
        self.n += 1

    def next(self) -> list[tuple]:
        first = max(self.waiting)
        out = [self._take(first)]
        if self.waiting and first < self.size:
            for length, k in sorted(fullest({x: len(q) for x, q in self.waiting.items()}, self.size - first).items(), reverse=True):
                out += [self._take(length) for _ in range(k)]
        return out

    def ready(self, last: bool = False) -> Iterator[list[tuple]]:
        while self.n and (last or self.n >= self.window):
            yield self.next()


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, as little-endian unsigned 32-bit integers)."""
    path = path or tokenizer_path()
    source = docs.select("doc_id", F.col("text").alias("__text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([source.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names[1:]]] + [T.StructField("ids", T.BinaryType())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer, tail = ids_of(path), Packer(size, window), end.to_bytes(4, "little")
        number, rows, kind = TaskContext.get().partitionId() << 36, [], None

        def put(pieces: list[tuple]) -> None:
            nonlocal number
            at = 0
            for doc, start, length, crc, total, blob in pieces:
                rows.append((doc, start, length, crc, total, number, at, blob))
                at += length
            number += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            out = pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:7]]] + [pa.array(columns[7], pa.binary())] * with_ids, names=names + ["ids"] * with_ids)
            rows.clear()
            return out

        for batch in batches:
            kind = batch.column(0).type
            texts = as_bytes(batch.column(1))
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                blob = ids.of(text.as_py()) + tail
                total = len(blob) // 4
                for start in range(0, total, size):
                    part = blob[4 * start : 4 * (start + size)]
                    piece = (doc, start, len(part) // 4, zlib.crc32(part), total, part if with_ids else None)
                    if piece[2] == size:
                        put([piece])
                    else:
                        packer.add(piece, piece[2])
                for pieces in packer.ready():
                    put(pieces)
                if len(rows) >= 2000:
                    yield flush()
        for pieces in packer.ready(last=True):
            put(pieces)
        if rows:
            yield flush()

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
