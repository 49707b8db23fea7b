"""Lists, XISF files built here, header facts, and sinks read back."""

import base64
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_sources_streaming import image

from framewise.sources import fits, lists, sinks, xisf


def xisf_file(v, kind, packing="", inline=False, extra=""):
    raw = v.astype(kind).tobytes()
    item = np.dtype(kind).itemsize
    size = len(raw)
    codec = packing
    if packing.endswith("+sh"):
        raw = np.frombuffer(raw, np.uint8).reshape(-1, item).T.tobytes()
    if packing.startswith("zlib"):
        raw = zlib.compress(raw)
    elif packing.startswith("lz4"):
        raw = pa.compress(raw, codec="lz4_raw", asbytes=True)
    attr = f' compression="{codec}:{size}:{item}"' if packing.endswith("+sh") else f' compression="{codec}:{size}"' if packing else ""
    names = {"<u2": "UInt16", "<f4": "Float32", "<u1": "UInt8"}
    at = 4096
    place = "inline:base64" if inline else f"attachment:{at}:{len(raw)}"
    text = base64.b64encode(raw).decode() if inline else ""
    xml = f'<xisf xmlns="http://www.pixinsight.com/xisf" version="1.0"><Image geometry="{v.shape[2]}:{v.shape[1]}:{v.shape[0]}" sampleFormat="{names[kind]}" location="{place}"{attr} {extra}>{text}<FITSKeyword name="FILTER" value="\'OIII\'" comment=""/><Property id="Observation:Object:Name" type="String">M 31</Property></Image></xisf>'
    head = b"XISF0100" + len(xml.encode()).to_bytes(4, "little") + bytes(4) + xml.encode()
    return head if inline else head.ljust(at, b"\0") + raw


V = (np.arange(2 * 7 * 5).reshape(2, 7, 5) * 400).astype(float)


@pytest.mark.parametrize("kind,packing,inline", [("<u2", "", False), ("<u2", "zlib", False), ("<u2", "zlib+sh", False), ("<u2", "lz4+sh", False), ("<f4", "lz4", False), ("<u2", "", True), ("<u2", "zlib", True)])
def test_xisf_samples(kind, packing, inline):
    extra = 'bounds="0:65535"' if kind == "<f4" else ""
    planes, keys = xisf.decode(xisf_file(V, kind, packing, inline, extra))
    assert np.allclose(planes * 65535, V) and keys == {"FILTER": "OIII", "Observation:Object:Name": "M 31"}


@pytest.mark.parametrize("content", [b"", b"XISF0100", b"XISF0100" + (5).to_bytes(4, "little") + bytes(4) + b"<a/>x", b"XISF0100" + (4).to_bytes(4, "little") + bytes(4) + b"<a/>", b"SIMPLE  ="])
def test_broken_files_are_named(content):
    with pytest.raises(ValueError):
        xisf.decode(content)


def test_lists_and_files(spark, tmp_path):
    (tmp_path / "a.xisf").write_bytes(xisf_file(V, "<u2", "zlib+sh"))
    (tmp_path / "b.XISF").write_bytes(b"no")
    (tmp_path / "c.fits").write_bytes(image(np.arange(6).reshape(2, 3), 16))
    (tmp_path / "frames.txt").write_text(f'# mine\n\na.xisf\n"{tmp_path}/b.XISF"\r\n c.fits \ngone.fits\nnotes.doc\n')
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xisf,XISF,fits}").load(str(tmp_path))
    listed = lists.with_files(lists.read_list(spark, str(tmp_path / "frames.txt")), found)
    got = {r["entry"]: (r["format"], r["error"]) for r in listed.collect()}
    assert got == {"a.xisf": ("xisf", None), f"{tmp_path}/b.XISF": ("xisf", None), "c.fits": ("fits", None), "gone.fits": ("fits", "no such file"), "notes.doc": (None, "unknown format")}
    images = listed.where("format = 'xisf' AND error IS NULL")
    heads = {r["path"].rsplit("/")[-1]: r for r in xisf.headers(images).collect()}
    assert heads["a.xisf"]["keys"]["FILTER"] == "OIII" and heads["b.XISF"]["error"] == "not an XISF file"
    s = xisf.samples(images).orderBy("plane", "y", "x").toPandas()
    assert np.allclose(s.v * 65535, V.ravel()) and s.x.max() == 4 and s.y.max() == 6


def test_header_facts_and_windows(spark, tmp_path):
    cards = ["FILTER1 = 'Ha      '", "EXPTIME =                 30.5", "BAYERPAT= 'RGGB'", "XBAYROFF=                    1", "CTYPE1  = 'RA---TAN'", "CTYPE2  = 'DEC--TAN'", "CRPIX1  = 51.0", "CRPIX2  = 41.0", "CRVAL1  = 180.5", "CRVAL2  = -12.0", "CDELT1  = -0.001", "CDELT2  = 0.001", "CROTA2  = 90.0"]
    v = np.arange(100 * 80).reshape(80, 100)
    (tmp_path / "a.fits").write_bytes(image(v, 16, cards))
    (tmp_path / "b.fits").write_bytes(image(v[:2], 16, cards[4:6]))
    found = fits.files(spark, str(tmp_path))
    rows = {r["path"][-6:]: r for r in fits.frame_facts(fits.headers(found)).collect()}
    a = rows["a.fits"]
    assert (a["filter"], a["exposure_s"], a["pattern"]) == ("Ha", 30.5, "GRBG") and a["sky"]["x0"] == 50 and abs(a["sky"]["cd12"] + 0.001) < 1e-12 and abs(a["sky"]["cd11"]) < 1e-12
    assert rows["b.fits"]["sky"] is None and rows["b.fits"]["pattern"] is None and rows["b.fits"]["filter"] is None
    s = fits.samples(found.where("path LIKE '%a.fits'"), rect=(90, 70, 200, 75)).orderBy("y", "x").toPandas()
    assert s.v.tolist() == v[70:75, 90:].ravel().tolist() and s.x.min() == 90 and s.y.max() == 74


def test_fits_tiles_round_trip(spark):
    rows = [("m", x, y, float(x * 10 + y)) for x in range(37) for y in range(23) if (x, y) != (3, 4)]
    tiles = sinks.fits_tiles(spark.createDataFrame(rows, "name string, x int, y int, v double"), "name", 37, 23, tile=16)
    got = {}
    for t in tiles.collect():
        keys, at = fits.parse_header(bytes(t["content"]))
        w, h = int(keys["NAXIS1"]), int(keys["NAXIS2"])
        plane = np.frombuffer(t["content"], ">f4", w * h, at).reshape(h, w)
        assert len(t["content"]) % 2880 == 0 and int(keys["XORIGIN"]) == t["tile_x"]
        got |= {(t["tile_x"] + x, t["tile_y"] + y): plane[y, x] for x in range(w) for y in range(h)}
    assert len(got) == 37 * 23 and np.isnan(got[3, 4]) and all(got[x, y] == v for _, x, y, v in rows)


def test_rows_lists_manifests_and_revisions(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 0.5), (1, "a", 1 / 3)], "id long, path string, v double")
    sinks.write_rows(df, str(tmp_path / "rows"), ["id"])
    back = spark.read.option("header", "true").csv(str(tmp_path / "rows")).orderBy("id").collect()
    assert [r["v"] for r in back] == ["0.333333", "0.500000"]
    sinks.write_list(df, str(tmp_path / "list"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "list")).orderBy("value").collect()] == ["a", "b"]
    sinks.write_manifest({"frames": df, "totals": df.agg(F.sum("v").alias("v"))}, str(tmp_path / "manifest"))
    assert spark.read.json(str(tmp_path / "manifest")).count() == 3
    sinks.publish(df, str(tmp_path / "p"), 1)
    sinks.publish(df.where("id = 1"), str(tmp_path / "p"), 2)
    assert [r["id"] for r in sinks.latest(spark.read.parquet(str(tmp_path / "p"))).collect()] == [1]
    for again in (lambda: sinks.publish(df, str(tmp_path / "p"), 2), lambda: sinks.write_list(df, str(tmp_path / "list"))):
        with pytest.raises(Exception, match="(?i)exist"):
            again()
