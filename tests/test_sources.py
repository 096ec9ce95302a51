import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_proximity import wkb_point
from tilewright.functions import text
from tilewright.operators import points, raster, tiles
from tilewright.sources import formats
from tilewright.streaming.incremental import done_tiles, process_landing, rolling_counts


def test_tiles_round_trip(spark, tmp_path):
    path = str(tmp_path / "rts")
    df = spark.createDataFrame([("R1C1", 0, 0, 1.0, 2.0), ("R1C2", 1, 0, 3.0, 4.0)], "tile_name string, px int, py int, r double, g double")
    formats.write_tiles(df, path)
    formats.write_tiles(df.where("tile_name = 'R1C1'").withColumn("r", F.lit(9.0)), path)
    got = formats.read_tiles(spark, path, ["R1C1", "R1C2"], ["r"])
    assert {(r.tile_name, r.r) for r in got.collect()} == {("R1C1", 9.0), ("R1C2", 3.0)}
    plan = formats.read_tiles(spark, path, ["R1C1"], ["r"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "g" not in plan.split("ReadSchema:")[-1].split("\n")[0].replace("struct<px:int,py:int,r:double>", "")


def test_csv_json_and_metadata(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "file string, n int")
    formats.write_csv(df, str(tmp_path / "c"))
    assert formats.read_csv(spark, str(tmp_path / "c"), "file string, n int").collect() == df.collect()
    formats.write_metadata(df, str(tmp_path / "j"))
    assert formats.read_metadata(spark, str(tmp_path / "j"), "file string, n int").collect() == df.collect()
    calls = []
    m = formats.Metadata(spark, str(tmp_path / "m.json"), {"range": lambda: calls.append(1) or [0, 1]})
    assert m.get("range", "v1") == m.get("range", "v1") == [0, 1] and len(calls) == 1
    m.get("range", "v2")
    assert len(calls) == 2
    with pytest.raises(KeyError):
        m.get("colour", "v1")


def test_ascii_grid(spark, tmp_path):
    p = tmp_path / "g.asc"
    p.write_text("ncols 3\nnrows 2\nxllcorner 20\nyllcorner 10\ncellsize 2\nNODATA_value -1\n1 2 -1\n4 -1 6\n")
    (tmp_path / "g.prj").write_text("")
    got = {(r.px, r.py): r.value for r in formats.read_ascii_grids(spark, [str(p)]).collect()}
    assert got == {(10, 6): 1, (11, 6): 2, (10, 5): 4, (12, 5): 6}
    assert formats.companions(str(p)) == [str(p), str(tmp_path / "g.prj")]


def test_tiff(spark, tmp_path):
    a = np.array([[1, 2, 3], [4, 5, 255]], np.uint8)
    b = np.arange(6, dtype=np.float32).reshape(2, 3) / 2
    (tmp_path / "a.tif").write_bytes(formats.tiff_bytes([a, a + 0], 20, 14, 2.0, nodata=255))
    (tmp_path / "b.tif").write_bytes(formats.tiff_bytes([b], 20, 14, 2.0, e=">"))
    got = {(r.px, r.py): (r.band1, r.band2) for r in formats.read_tiffs(spark, [str(tmp_path / "a.tif")], 2).collect()}
    assert got == {(10, 6): (1, 1), (11, 6): (2, 2), (12, 6): (3, 3), (10, 5): (4, 4), (11, 5): (5, 5), (12, 5): (None, None)}
    assert {(r.px, r.py): r.band1 for r in formats.read_tiffs(spark, [str(tmp_path / "b.tif")]).collect()} == {(10 + j, 6 - i): b[i, j] for i in (0, 1) for j in (0, 1, 2)}
    (tmp_path / "c.tif").write_bytes(b"no such thing")
    with pytest.raises(Exception, match="not a TIFF"):
        formats.read_tiffs(spark, [str(tmp_path / "c.tif")]).collect()


def test_rasters_to_tiles(spark, tmp_path):
    v = np.arange(48, dtype=np.float64).reshape(6, 8)
    for name, x, part in (("a", 0, v[:, :5]), ("b", 4, v[:, 4:] + np.where(np.arange(4, 8) == 4, 100, 0))):
        (tmp_path / f"{name}.tif").write_bytes(formats.tiff_bytes([part], x, 6, 1.0))
    df = formats.read_tiffs(spark, [str(tmp_path / "a.tif"), str(tmp_path / "b.tif")])
    ts = tiles.scheme(spark, 1, 2, 4.0, 1.0)
    got = {(r.tile_name, r.px, r.py): r.band1 for r in raster.ingested(df, ["band1"], (0, 0, 1), ts, 1.0).collect()}
    # tiles have what lies in their buffers; the later file wins where both have a cell
    want = {("R1C1" if lo == 0 else "R1C2", x, y): v[5 - y, x] + (100 if x == 4 else 0) for lo in (0, 4) for x in range(max(lo - 1, 0), min(lo + 5, 8)) for y in range(5)}
    assert got == want
    assert {r.tile_name for r in raster.ingested(df, ["band1"], (0, 0, 1), ts, 1.0, done=ts.where("col = 1")).collect()} == {"R1C2"}
    assert raster.ingested(df, ["band1"], (0, 0, 1), ts, 1.0, done=ts).count() == 0


def test_dbf_attributes(spark, tmp_path):
    import struct

    fields = [(b"name", b"C", 6, 0), (b"n", b"N", 5, 0), (b"x", b"N", 8, 2), (b"ok", b"L", 1, 0)]
    rows = [" oak      7    1.50T", " elm           -2.25?", "*gone     1    0.00F"]
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(fields), 21)
    (tmp_path / "t.dbf").write_bytes(head + b"".join(n.ljust(11, b"\0") + t + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in fields) + b"\r" + b"".join(r[:7].encode() + r[7:].rjust(14).encode() for r in rows))
    got = formats.read_attributes(spark, [str(tmp_path / "t.dbf")])
    assert got.drop("filename").dtypes == [("name", "string"), ("n", "bigint"), ("x", "double"), ("ok", "boolean")]
    assert [tuple(r)[1:] for r in got.collect()] == [("oak", 7, 1.5, True), ("elm", None, -2.25, None)]


def test_cells_of_points_are_sorted_for_reads(spark, tmp_path):
    rng = np.random.default_rng(1)
    p = spark.createDataFrame([(float(x), float(y), 1.0) for x, y in rng.uniform(0, 100, (4000, 2))], "x double, y double, z double")
    points.indexed(p, 5.0, 4).write.parquet(str(tmp_path / "p"))
    got = spark.read.parquet(str(tmp_path / "p"))
    assert got.count() == 4000 and len(list((tmp_path / "p").glob("*.parquet"))) == 4
    # each file holds its own stretch of cells
    import pyarrow.parquet as pq

    spans = sorted((m.min, m.max) for f in (tmp_path / "p").glob("*.parquet") for m in [pq.ParquetFile(f).metadata.row_group(0).column(3).statistics])
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_las(spark, tmp_path):
    rng = np.random.default_rng(0)
    xyz, cls, rgb = np.round(rng.uniform(0, 100, (500, 3)), 2), rng.integers(1, 8, 500), rng.integers(0, 256, (500, 3))
    a, b, c = (tmp_path / f"{n}.las" for n in "abc")
    a.write_bytes(formats.las_bytes(xyz, cls, rgb))
    b.write_bytes(formats.las_bytes(xyz[:10], cls[:10]))
    c.write_bytes(formats.las_bytes(xyz, cls)[:-7])
    got = formats.read_las(spark, [str(a)]).toPandas()
    assert np.allclose(got[["x", "y", "z"]], xyz) and got.classification.tolist() == cls.tolist() and got[["r", "g", "b"]].to_numpy().tolist() == rgb.tolist()
    assert formats.read_las(spark, [str(b)]).where("r IS NULL AND return_no = 1").count() == 10
    status = {r.filename[-5:]: r.status for r in formats.las_status(spark, [str(a), str(b), str(c)]).collect()}
    assert status == {"a.las": "Valid", "b.las": "Valid", "c.las": "file is cut short"}


def test_gpkg(spark, tmp_path):
    p = str(tmp_path / "v.gpkg")
    con = sqlite3.connect(p)
    con.execute("CREATE TABLE layer (fid INTEGER PRIMARY KEY, geom BLOB, tile_name TEXT, height REAL)")
    con.executemany("INSERT INTO layer VALUES (?, ?, ?, ?)", [(1, b"GP\0\1" + b"\0" * 4 + wkb_point(1, 2), "R1C1", 2.5), (2, b"GP\0\x11" + b"\0" * 4, None, None), (3, None, "R1C2", 1.0)])
    con.commit()
    con.close()
    got = {r.fid: (bytes(r.geom) if r.geom else None, r.tile_name, r.height) for r in formats.read_gpkg(spark, [p], "layer").collect()}
    assert got == {1: (wkb_point(1, 2), "R1C1", 2.5), 2: (None, None, None), 3: (None, "R1C2", 1.0)}


def test_archives(spark, tmp_path):
    ts = tiles.scheme(spark, 3, 3, 1.0)
    plan = tiles.chunk_plan(ts, 4, "img")
    assert sorted({r.archive for r in plan.collect()}) == ["img1of3.zip", "img2of3.zip", "img3of3.zip"]
    out = formats.write_archives(ts.select("tile_name", "row", "col"), plan, str(tmp_path)).toPandas()
    assert sorted(out.tiles) == [1, 4, 4]
    with zipfile.ZipFile(tmp_path / "img1of3.zip") as z:
        assert z.namelist() == ["R1C1.csv", "R1C2.csv", "R1C3.csv", "R2C1.csv"] and z.read("R2C1.csv").decode().split() == ["row,col", "2,1"]


def test_text(spark):
    row = spark.range(1).select(
        text.frame_to_extent(F.lit("1200.5, 340.0 : 1310.25, 401.75")).alias("e"), text.frame_to_extent(F.lit("x")).alias("bad"),
        text.extent_filter(*(F.lit(float(x)) for x in (1, 2, 3, 4))).alias("f"), text.bracketed_numbers(F.lit("Upper Left (  440720.0, 100000.5) (x)")).alias("n"),
        text.epsg_code(F.lit('    ID["EPSG",32633]]')).alias("c"), text.elapsed(F.lit(90061)).alias("t"), text.elapsed(F.lit(61)).alias("u"),
        *(text.nice_int(F.lit(x)).alias(f"i{k}") for k, x in enumerate(("3", "NaN", "", "x"))), text.nice_bool(F.lit("Y")).alias("b"), text.nice_bool(F.lit("?")).alias("nb"), text.nice_float(F.lit("1.5")).alias("d"), text.nice_str(F.lit("na")).alias("s"),
    ).collect()[0]
    assert tuple(row.e) == (1200.5, 1310.25, 340.0, 401.75) and tuple(row.bad) == (None,) * 4
    assert row.f == "-keep_xy 1.0 2.0 3.0 4.0" and row.n == [440720.0, 100000.5] and row.c == 32633 and row.t == "1 days 01:01:01" and row.u == "00:01:01"
    assert (row.i0, row.i1, row.i2, row.i3, row.b, row.nb, row.d, row.s) == (3, None, None, None, True, None, 1.5, None)


def test_landing_tiles_are_processed_once(spark, tmp_path):
    land, out, reg, cp = (str(tmp_path / n) for n in ("land", "out", "reg", "cp"))
    kind = "tile_name string, px int, py int, v double"
    drop = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(land)
    run = lambda **k: process_landing(spark, land, kind, lambda df: df.withColumn("v", F.col("v") * 2), out, reg, "double", cp, **k).awaitTermination(120)
    drop([("R1C1", 0, 0, 1.0), ("R1C2", 1, 0, 2.0)])
    assert run()
    drop([("R1C1", 0, 0, 50.0), ("R2C1", 0, 1, 3.0)])
    assert run()
    assert {(r.tile_name, r.v) for r in spark.read.parquet(out).collect()} == {("R1C1", 2.0), ("R1C2", 4.0), ("R2C1", 6.0)}
    assert done_tiles(spark, reg, "double").count() == 3
    drop([("R1C1", 0, 0, 50.0)])
    assert run(overwrite=True)
    assert spark.read.parquet(out).where("tile_name = 'R1C1'").collect()[0].v == 100.0


def test_rolling_counts(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:09:00', 'a' UNION ALL SELECT timestamp'2024-01-01 00:11:00', 'a'")
    assert sorted(r.n for r in rolling_counts(df, "ts", "k").collect()) == [1, 2]
