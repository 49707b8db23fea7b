"""Similarity links between nodes (long ids): runs of equal signatures, exact checks, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bytes_of, materialize, mix, pack_ascending, release, remove, spread, unpack_ascending, written

CHAIN = 2  # earlier members of its run that a member is compared with, besides the first
WHOLE = CHAIN + 2  # in a run of so many members at most, that compares every two
COLLECTED, IN_RANGE = 400_000, 1_000_000  # signatures that a task collects before it sends them; that fall in a hash range, about
LONG = 32  # members of a run within a collection that go to the signature's range
BLOCK = 4096  # members of a run that are compared within one task
AT_ONCE = 100_000  # pairs that a task holds before it gives them, about
MOST_BITS = 1 << 29  # of a bitmap that is broadcast: 64 MB
LEAST_CLASSES, MOST_CLASSES, COARSE_CLASSES, WRAP = 256, 1 << 16, 256, 16  # of the sketch: how many elements of a set fall in each class, modulo WRAP


def sketches(elements: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Of sets laid end to end: elements in each class of a hash, modulo WRAP, two to a byte, in as many classes as the set has elements
    (a power of two, LEAST_CLASSES at least); then a 128-bit hash of the set."""
    out, end = [], np.cumsum(sizes)
    for a, b in zip((end - sizes).tolist(), end.tolist()):
        e, classes = elements[a:b], max(LEAST_CLASSES, min(1 << max(b - a - 1, 0).bit_length(), MOST_CLASSES))
        counts = (np.bincount((e & np.uint64(classes - 1)).astype(np.int64), minlength=classes) % WRAP).astype(np.uint8)
        out.append((counts[::2] << 4 | counts[1::2]).tobytes() + xxhash.xxh3_128_digest(e.tobytes()))
    return out


def _counts(packed: np.ndarray, classes: int) -> np.ndarray:
    """Rows of `classes` counts, of rows of sketches that have so many classes at least."""
    half = packed[:, :-16]
    counts = np.stack((half >> 4, half & 15), axis=2).reshape(len(packed), -1)
    return counts if counts.shape[1] == classes else counts.reshape(len(packed), -1, classes).sum(axis=1, dtype=np.int64).astype(np.uint8) & np.uint8(WRAP - 1)


def _unpack_all(blobs: list[bytes]) -> np.ndarray:
    """Rows of as many counts as the shortest of the sketches has."""
    length = np.array(list(map(len, blobs)))
    classes = 2 * (int(length.min()) - 16)
    out = np.empty((len(blobs), classes), np.uint8)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        out[at] = _counts(np.frombuffer(b"".join([blobs[i] for i in at]), np.uint8).reshape(len(at), -1), classes)
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the symmetric difference: counts differ by the shorter way around at least."""
    d = (x - y) & np.uint8(WRAP - 1)
    return np.minimum(d, WRAP - d).sum(axis=1, dtype=np.int64)


def pack_values(values: np.ndarray) -> bytes:
    """Integers in any order: the least, and the others less it in as many bytes each as the largest needs."""
    low = values.min() if len(values) else np.int64(0)
    rest = values.view(np.uint64) - low.view(np.uint64)
    width = max(1, (int(rest.max(initial=0)).bit_length() + 7) // 8)
    return low.tobytes() + bytes([width]) + rest.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_values(blob: bytes) -> np.ndarray:
    rows = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, blob[8])
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : blob[8]] = rows
    return (out.view(np.uint64).ravel() + np.frombuffer(blob, np.uint64, 1)).view(np.int64)


SENT = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("sigs", T.BinaryType()), T.StructField("nodes", T.BinaryType()), T.StructField("sizes", T.BinaryType())])
SENT = SENT.add("node", T.LongType()).add("n", T.LongType()).add("copy_of", T.LongType()).add("sketch", T.BinaryType())


class Sender:
    """Collects a task's signatures (64-bit hashes, of which the upper 48 bits count), nodes and sizes, and gives them as packed rows
    by hash range. A run of more than LONG members of one collection goes to a task of its own, and only its first member to the range,
    so a range receives at most LONG members of a signature from each collection, however common the signature is."""

    def __init__(self, n_ranges: int):
        self.n_ranges, self.held, self.n = n_ranges, [], 0

    def add(self, sig: np.ndarray, node: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((sig, node, n))
        self.n += len(sig)
        if self.n >= COLLECTED:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        sig, node, n = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n = [], 0
        sig = sig >> np.uint64(16)
        by = np.argsort(sig)
        sig, node, n = sig[by], node[by].astype(np.int64), n[by].astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(start, len(sig)))
        rows = []
        if (size > LONG).any():
            long = np.repeat(size > LONG, size)
            first = np.minimum.reduceat(node, start)
            rest = long & (node != np.repeat(first, size))
            own = long.nonzero()[0]
            for part in np.array_split(own, range(COLLECTED, len(own), COLLECTED)) if len(own) else []:
                key = -1 - int(xxhash.xxh3_64_intdigest(node[part].tobytes() + sig[part].tobytes()) >> 1)
                rows.append((key, sig[part], node[part], n[part]))
            sig, node, n = sig[~rest], node[~rest], n[~rest]
        step = (1 << 48) // self.n_ranges + 1
        edges = [*np.searchsorted(sig, np.arange(self.n_ranges, dtype=np.uint64) * np.uint64(step)), len(sig)]
        rows += [(i, sig[a:b], node[a:b], n[a:b]) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        for at in range(0, len(rows), 1000):
            k, s, v, m = zip(*rows[at : at + 1000])
            packed = [pa.array(k, pa.int64()), pa.array([x[:1].tobytes() + pack_ascending(x - x[0]) for x in s], pa.binary()), pa.array([pack_values(x) for x in v], pa.binary()), pa.array([pack_values(x) for x in m], pa.binary())]
            yield pa.RecordBatch.from_arrays(packed + [pa.nulls(len(k), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())], names=SENT.names)

    @staticmethod
    def facts(node: list, n: list, copy_of: list, sketch: list) -> pa.RecordBatch:
        """Facts about nodes, which go along: size, the node that it is a copy of, sketch."""
        key = mix(np.array([0 if x is None else x for x in node], np.int64).view(np.uint64)).view(np.int64)
        none = [pa.nulls(len(node), pa.binary())] * 3
        return pa.RecordBatch.from_arrays([pa.array(key), *none, pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(copy_of, pa.int64()), pa.array(sketch, pa.binary())], names=SENT.names)


def ranges(n_signatures: int) -> int:
    return max(1, -(-n_signatures // IN_RANGE))


def find_runs(rows: DataFrame, n_ranges: int) -> DataFrame:
    """From a Sender's rows: members of runs of equal sig, past the first, with the first and the members just before; and the facts,
    with sig null. One shuffle of packed rows; a task works on one hash range at a time."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("sig", "node", "n", "copy_of")] + [T.StructField("sketch", T.BinaryType())])
    schema = schema.add("m", T.LongType()).add("first", T.LongType()).add("first_n", T.LongType())
    for i in range(CHAIN):
        schema = schema.add(f"prev{i}", T.LongType()).add(f"prev{i}_n", T.LongType())
    ordered = rows.repartition(max(spread(rows), min(n_ranges, 20_000)), "bucket").sortWithinPartitions("bucket")

    def members(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sig = np.concatenate([unpack_ascending(x[0][8:]) + np.frombuffer(x[0], np.uint64, 1) for x in held]).view(np.int64)
        node, n = (np.concatenate([unpack_values(x[i]) for x in held]) for i in (1, 2))
        by = np.argsort(sig)
        sig = sig[by]
        same = sig[1:] == sig[:-1]
        some = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        sig, node, n = sig[some], node[by[some]], n[by[some]]
        by = np.lexsort((node, sig))
        sig, node, n = sig[by], node[by], n[by]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])  # a repeated row is one member
        sig, node, n = sig[fresh], node[fresh], n[fresh]
        if not len(sig):
            return
        start = np.concatenate(([True], sig[1:] != sig[:-1]))
        first = np.flatnonzero(start)[np.cumsum(start) - 1]
        place = np.arange(len(sig)) - first
        for new in np.array_split(np.flatnonzero(place), range(100_000, int((place > 0).sum()), 100_000)):
            columns = [pa.array(sig[new]), pa.array(node[new]), pa.array(n[new]), pa.nulls(len(new), pa.int64()), pa.nulls(len(new), pa.binary()), pa.array(place[new] + 1), pa.array(node[first[new]]), pa.array(n[first[new]])]
            for i in range(CHAIN):
                k = new - 1 - i
                no = k <= first[new]  # that is the first itself
                k = np.where(no, 0, k)
                columns += [pa.array(node[k], mask=no), pa.array(n[k], mask=no)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            facts = batch.filter(pc.is_null(batch.column(1)))
            if facts.num_rows:
                none = pa.nulls(facts.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, *facts.columns[4:]] + [none] * (3 + 2 * CHAIN), names=schema.names)
            packed = batch.filter(pc.is_valid(batch.column(1)))
            for key, *blobs in zip(packed.column(0).to_pylist(), *(packed.column(i) for i in (1, 2, 3))):
                if held and key != bucket:
                    yield from members(held)
                    held = []
                bucket = key
                held.append([x.as_py() for x in blobs])
        if held:
            yield from members(held)
        held = []
        release()

    return ordered.mapInArrow(run, schema)


def first_pairs(runs: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: each member with its run's first and the members just before it, if their sizes allow the similarity."""
    pair = lambda c: F.when(F.col(c).isNotNull() & _sizes_fit(F.col("n"), F.col(f"{c}_n"), percent), F.col(c))
    others = F.array_distinct(F.array_compact(F.array(pair("first"), *[pair(f"prev{i}") for i in range(CHAIN)])))
    found = runs.where("sig IS NOT NULL").select("node", F.explode(others).alias("other"))
    return found.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).where("a < b").distinct()


def _sizes_fit(n: F.Column, o: F.Column, percent: int) -> F.Column:
    return F.least(n, o) * 100 >= F.greatest(n, o) * percent


def _most_apart(n: np.ndarray, o: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of sets of n and o elements that have the similarity."""
    return (n + o) * (100 - percent) // (100 + percent)


def near_sketches(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """(a, b, same, n) of the pairs whose sketches allow the similarity; same: the sets are equal, with n elements. Other columns of pairs, all
    long, follow. facts: (node, n, sketch), one row for each node."""
    more = [c for c in pairs.columns if c not in ("a", "b")]
    side = lambda x: facts.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (x, at_x), (y, at_y) = (bytes_of(batch.column(i)) for i in (4, 5))
            n, o = (batch.column(i).to_numpy() for i in (2, 3))
            apart, same = np.empty(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            shape = np.diff(at_x) << 20 | np.diff(at_y)
            for key in np.unique(shape):
                size = int(key) >> 20, int(key) & (1 << 20) - 1
                at, step = np.flatnonzero(shape == key), max(1, (1 << 19) // max(size))
                for some in np.array_split(at, range(step, len(at), step)):
                    p, q = x[at_x[some][:, None] + np.arange(size[0])], y[at_y[some][:, None] + np.arange(size[1])]
                    classes = 2 * (min(size) - 16)
                    apart[some] = _apart(_counts(p, classes), _counts(q, classes))
                    if size[0] == size[1]:
                        same[some] = (p == q).all(axis=1)
            ok, same = pa.array(apart <= _most_apart(n, o, percent)), pa.array(same)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), same, batch.column(2), *batch.columns[6:]], names=["a", "b", "same", "n", *more]).filter(ok)
        release()

    return both.mapInArrow(run, ", ".join(["a long, b long, same boolean, n long", *(f"{c} long" for c in more)]))


def pack_set(elements: np.ndarray) -> bytes:
    """A sorted set for jaccard_links: the upper 54 bits of each 64-bit hash, as differences, which take 6 bytes each in long texts. Two
    elements of a pair of sets of a thousand fall together once in 10^10 pairs."""
    return pack_ascending(elements >> np.uint64(10))


def jaccard_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, common, either) of the pairs whose sets have the similarity, exactly; other columns of pairs, all long, follow.
    sets: (node, elements: from pack_set)."""
    more = [c for c in pairs.columns if c not in ("a", "b")]
    side = lambda x: sets.select(F.col("node").alias(x), F.col("elements").alias(f"e_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "e_a", "e_b", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, either = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = unpack_ascending(x.as_py()), unpack_ascending(y.as_py())
                if not len(x) or not len(y):
                    both = 0
                else:
                    at = np.searchsorted(x, y)
                    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                common.append(both)
                either.append(len(x) + len(y) - both)
            c, e = np.array(common, np.int64), np.array(either, np.int64)
            ok = pa.array((c * 100 >= e * percent) & (c > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c), pa.array(e), *batch.columns[4:]], names=["a", "b", "common", "either", *more]).filter(ok)
        release()

    return both.mapInArrow(run, ", ".join(["a long, b long, common long, either long", *(f"{c} long" for c in more)]))


def _folded(facts: DataFrame) -> DataFrame:
    """facts (node, n, sketch) with sketches of half the classes, COARSE_CLASSES at least: a little weaker, but half as large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob in batch.column(2).to_pylist():
                packed = np.frombuffer(blob, np.uint8)[None, :]
                counts = _counts(packed, max(COARSE_CLASSES, len(blob) - 16))[0]
                out.append((counts[::2] << 4 | counts[1::2]).tobytes() + bytes(16))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["node", "n", "sketch"])

    return facts.select("node", "n", "sketch").mapInArrow(run, "node long, n long, sketch binary")


def _close(own: np.ndarray, node: np.ndarray, comp: np.ndarray, n: np.ndarray, sk: np.ndarray, across: bool, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, c_a, c_b) of nodes, ascending in size n, of two components whose sizes and counts allow the similarity; across: and of two blocks.
    AT_ONCE pairs and those of one node are held at most."""
    found: tuple[list, list] = [], []

    def out() -> pa.RecordBatch:
        low, high = (np.concatenate(x) for x in found)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (node[low], node[high], comp[low], comp[high])], names=["a", "b", "c_a", "c_b"])

    count = 0
    for k in range(len(node) - 1):
        hi = np.searchsorted(n, n[k] * 100 // percent, side="right")  # sizes ascend
        r = slice(k + 1, hi)
        ok = comp[r] != comp[k]
        if across:
            ok &= own[r] != own[k]
        if ok.any():
            at = np.flatnonzero(ok) + k + 1
            at = at[_apart(sk[at], sk[k]) <= _most_apart(n[at], n[k], percent)]
            found[0].append(np.where(node[at] < node[k], at, k)), found[1].append(np.where(node[at] < node[k], k, at))
            count += len(at)
            if count >= AT_ONCE:
                yield out()
                found, count = ([], []), 0
    if count:
        yield out()


def other_pairs(runs: DataFrame, facts: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(a, b, c_a, c_b) of one run but of two components, c_a and c_b, whose sizes and folded sketches allow the similarity; for runs where not every two were compared.

    Runs whose members all are in their first's component need nothing more. The others go to tasks in blocks of BLOCK members, each two blocks of a run
    meeting in one task; only the pairs that pass leave it."""
    real = runs.where("sig IS NOT NULL")
    of = lambda node, comp: comps.select(F.col("node").alias(node), F.col("comp").alias(comp))
    stars = real.select("first", "node").distinct().join(of("node", "own"), "node", "left").join(of("first", "its"), "first", "left")
    apart = materialize(stars.where("coalesce(own, node) <> coalesce(its, first)").select("first", "node"), "apart")
    mixed = materialize(semi(real, apart, ["first", "node"]).select("sig").distinct(), "mixed")
    found = materialize(semi(real, mixed, ["sig"]).select("sig", F.explode(F.array("node", "first")).alias("node")).distinct(), "members")
    # sig + 0: an exchange of its own, so that adaptive execution can split a common signature.
    long = found.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > WHOLE).select((F.col("sig") + F.lit(0)).alias("sig"), "m")
    rows = found
    rows = rows.join(long, "sig").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(_folded(facts), "node")
    rows = rows.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "n", "sketch")
    ordered = rows.repartition(spread(rows), "sig", "i", "j").sortWithinPartitions("sig", "i", "j", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            own, node, comp, n = (t.column(c).to_numpy() for c in ("own", "node", "comp", "n"))
            sk = _unpack_all(t.column("sketch").to_pylist())
            return _close(own, node, comp, n, sk, t.column("i")[0].as_py() != t.column("j")[0].as_py(), percent)

        held: list[pa.Table] = []
        key = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("sig", "i", "j")])
            cuts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [t.num_rows]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if key is not None and tuple(keys[:, a]) != key:
                    yield from out(pa.concat_tables(held))
                    held = []
                key = tuple(keys[:, a])
                held.append(t.slice(a, b - a))
        if held:
            yield from out(pa.concat_tables(held))
        held = []
        release()

    return ordered.mapInArrow(run, "a long, b long, c_a long, c_b long").distinct()


def numbers(docs: DataFrame, size: Column) -> DataFrame:
    """(doc_id, digest, start): numbers from 0 for each distinct (doc_id, digest), ascending with doc_id; each takes as many as size
    says, the largest of its rows. docs: (doc_id, digest, ...); rows with a null doc_id get none."""
    sizes = docs.where("doc_id IS NOT NULL").groupBy("doc_id", "digest").agg(F.max(size).cast("long").alias("n"))
    ordered = sizes.repartitionByRange(spread(docs), "doc_id", "digest").sortWithinPartitions("doc_id", "digest").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            ends = total + np.cumsum(n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n)], names=["doc_id", "digest", "n", "part", "start"])
            total = int(ends[-1]) if len(ends) else total

    placed = materialize(ordered.mapInArrow(run, "doc_id long, digest long, n long, part int, start long"), "numbers")
    parts = placed.groupBy("part").agg(F.sum("n").alias("in_part"))  # one row for each writing task
    parts = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    return placed.join(F.broadcast(parts), "part").select("doc_id", "digest", (F.col("start") + F.col("before")).alias("start"), "n")


def facts_of(docs: DataFrame) -> tuple[int, bool, int, int, int]:
    """(bytes of text, whether a doc_id stands on different texts, least and greatest doc_id, bytes of the longest text)."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    by = docs.select("doc_id", F.xxhash64("text").alias("h"), size.alias("size")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.sum("size").alias("all"), F.max("size").alias("most"))
    found = by.agg(F.sum("all"), F.max((F.col("a") != F.col("b")) & F.col("doc_id").isNotNull()), F.min("doc_id"), F.max("doc_id"), F.max("most")).first()
    return found[0] or 0, bool(found[1]), found[2] or 0, found[3] or 0, found[4] or 0


def among(df: DataFrame, key: Column, keys: DataFrame, own: Column) -> DataFrame:
    """The rows of df whose key may be among those of a written table, where it may stand repeatedly; all that are, and few others. A bitmap of
    at most MOST_BITS bits, in rows of 4 KB, is broadcast, whatever the number of keys; the scan of df then drops rows without a shuffle."""
    bits, n = 1 << 15, keys.agg(F.approx_count_distinct(own)).first()[0]
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    maps = keys.select(place(own).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    found = df.withColumn("__p", place(key)).join(F.broadcast(maps), F.bitmap_bucket_number("__p") == F.col("__map"))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(bitmap_bit_position(__p) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    bit = F.expr("cast(shiftleft(1, cast(bitmap_bit_position(__p) % 8 as int)) as int)")
    return found.where(byte.bitwiseAND(bit) != 0).select(*[F.col(f"`{c}`") for c in df.columns])


def semi(df: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """The rows of df with a partner in a written table: first by its bitmap, then exactly."""
    both = F.xxhash64(*by)
    return among(df, both, keys, both).join(keys.select(*by), by, "left_semi")


def components(links: DataFrame, tag: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, comp): comp is the smallest node that links (a, b) reach; only linked nodes have rows.

    Large-star and small-star steps in turn, until no node has two edges to smaller ones; then each node takes its parent's parent, until edges end at
    roots. Minima are summed up on the map side, so a node with very many links is one row for each task; each round is written to the shared folder."""
    edges, path = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    # Minima are exchanged anew (u + 0), so that both sides of a join are shuffles and adaptive execution can split a hot u.
    lowest = lambda x, low: x.groupBy("u").agg(low.alias("low")).select((F.col("u") + F.lit(0)).alias("u"), "low")
    for _ in range(most_rounds):
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), (F.min("up") == 0).alias("below"))
        most, chained = ends.agg(F.max("up"), F.max(F.when(F.col("below"), F.col("up")))).first()
        if not most or most == 1 and not chained:
            break
        if most == 1:
            above = edges.select(F.col("u").alias("v"), F.col("v").alias("low"))
            after = edges.join(above, "v", "left").select("u", F.coalesce("low", "v").alias("v"))
        else:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = both.where("v > u").join(lowest(both, F.least(F.min("v"), F.col("u"))), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
            low = lowest(large, F.min("v"))
            small = large.join(low, "u").select(F.col("v").alias("x"), "low").where("x <> low").unionByName(low.select(F.col("u").alias("x"), "low"))
            after = small.select(F.greatest("x", "low").alias("u"), F.least("x", "low").alias("v")).distinct()
        last = path
        edges, path = written(after, tag)
        remove(links.sparkSession, last)
    else:
        raise RuntimeError("components: the links didn't settle")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("comp"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps once more, after links that have their ends' components as c_a, c_b: only these components are linked, not all nodes anew."""
    new = materialize(components(links.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))), "joined")
    old = comps.join(new.select(F.col("node").alias("__comp"), F.col("comp").alias("__low")), F.col("comp") == F.col("__comp"), "left")
    return old.select("node", F.coalesce("__low", "comp").alias("comp")).unionByName(new).groupBy("node").agg(F.min("comp").alias("comp"))


def resolve(runs: DataFrame, facts: DataFrame, sets_of, copies: DataFrame | None, percent: int) -> tuple[DataFrame, DataFrame]:
    """(components, links) of what the pairs of one run whose sets have the similarity connect; the links are enough to do so. facts: (node, n, sketch);
    sets_of(nodes) gives (node, elements) of nodes, which may be repeated; copies: links (a, b) already certain."""
    only = ("a", "b", "common", "either")

    def exact(pairs: DataFrame) -> DataFrame:
        return materialize(jaccard_links(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))), percent), "links")

    # A pair whose members are connected already needs no exact check: each node's pair with its smallest partner goes first.
    pairs = materialize(near_sketches(first_pairs(runs, percent), facts, percent), "pairs")
    links = pairs.where("same").select("a", "b", F.col("n").alias("common"), F.col("n").alias("either"))
    links = links.unionByName(exact(materialize(pairs.where("NOT same").groupBy("b").agg(F.min("a").alias("a")), "picked")))
    comps = materialize(components(links.select("a", "b") if copies is None else links.select("a", "b").unionByName(copies)), "comps")
    side = lambda x: comps.select(F.col("node").alias(x), F.col("comp").alias(f"c_{x}"))
    rest = pairs.where("NOT same").join(side("a"), "a", "left").join(side("b"), "b", "left").withColumns({f"c_{x}": F.coalesce(f"c_{x}", x) for x in "ab"})
    rest = materialize(rest.where("c_a <> c_b").select("a", "b", "c_a", "c_b"), "rest")
    if not rest.isEmpty():
        found = exact(rest)
        if not found.isEmpty():
            links, comps = links.unionByName(found.select(*only)), materialize(joined(comps, found), "comps")
    more = materialize(other_pairs(runs, facts, comps, percent).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if more.isEmpty():
        return comps, links
    more = materialize(near_sketches(more, facts, percent), "pairs")
    found = more.where("same").select("a", "b", F.col("n").alias("common"), F.col("n").alias("either"), "c_a", "c_b")
    if not (unsure := more.where("NOT same").select("a", "b", "c_a", "c_b")).isEmpty():
        found = found.unionByName(exact(unsure))
    if found.isEmpty():
        return comps, links
    return materialize(joined(comps, found), "comps"), links.unionByName(found.select(*only))
