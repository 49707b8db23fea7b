"""FITS files built here, and streams that replay the event table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.sources import fits, tables
from framewise.streaming import totals

SMALL = "/root/testdata/sf0.001"


def image(v, bitpix, keys=()):
    cards = ["SIMPLE  =                    T", f"BITPIX  = {bitpix:20d}", f"NAXIS   = {v.ndim:20d}"] + [f"NAXIS{i + 1}  = {n:20d}" for i, n in enumerate(v.shape[::-1])] + list(keys) + ["END"]
    head = "".join(c.ljust(80) for c in cards).encode()
    return head.ljust(-(-len(head) // 2880) * 2880) + v.astype(fits.KINDS[bitpix]).tobytes()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("fits")
    v = np.arange(70 * 5).reshape(70, 5)
    (d / "a.fits").write_bytes(image(v, 16, ["BZERO   =                32768", "FILTER  = 'Ha ''x'''          / band", "EXPTIME =                120.0 / s"]))
    (d / "b.fit").write_bytes(image(v[:3] / 4, -32))
    (d / "c.fits").write_bytes(b"SIMPLE  = T")
    (d / "d.fits").write_bytes(b"something else")
    return str(d)


def test_headers(spark, folder):
    got = {r["path"].rsplit("/")[-1]: r for r in fits.headers(fits.files(spark, folder)).collect()}
    assert got["a.fits"]["keys"]["FILTER"] == "Ha 'x'" and got["a.fits"]["keys"]["EXPTIME"] == "120.0" and got["a.fits"]["error"] is None
    assert got["c.fits"]["keys"] is None and got["d.fits"]["error"] == "not a FITS file"


def test_samples(spark, folder):
    got = fits.samples(fits.files(spark, folder)).toPandas()
    a = got[got.path.str.endswith("a.fits")].sort_values(["y", "x"])
    assert a.v.tolist() == [x + 32768.0 for x in range(350)] and len(got) == 350 + 15
    assert got[got.path.str.endswith("b.fit")].v.max() == 14 / 4


def stream(spark, tmp_path):
    e = tables.seq(spark, SMALL).drop("props")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), e


def test_partial_sums_of_a_stream_equal_one_pass(spark, tmp_path):
    live, e = stream(spark, tmp_path)
    for _ in range(2):  # nothing new the second time
        totals.append_partials(live, str(tmp_path / "out"), str(tmp_path / "cp"), ["grp"]).awaitTermination()
    got = totals.combined(spark.read.parquet(str(tmp_path / "out")), ["grp"])
    assert sorted(got.collect()) == sorted(e.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")).collect())


def test_windows_of_a_stream_equal_a_batch(spark, tmp_path):
    live, e = stream(spark, tmp_path)
    q = totals.windowed(live, late="60 days").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp"))
    q = q.start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("w").collect()) == sorted(totals.windowed(e, late="60 days").collect())


def test_repeats_and_sessions(spark, tmp_path):
    live, e = stream(spark, tmp_path)
    q = totals.without_repeats(live.unionByName(live), "60 days").writeStream.format("memory").queryName("u").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("u").count() == e.count()
    assert totals.sessions(e, "user_id").agg(F.sum("n")).first()[0] == e.count()
