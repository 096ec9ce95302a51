import pytest
from pyspark.sql import functions as F

from tests.test_proximity import wkb_polygon
from tilewright.operators import tiles
from tilewright.operators.proximity import with_rings
from tilewright.operators.spatial import merged_by_zone, renumbered_after


def names(df):
    return [r.tile_name for r in df.collect()]


def test_neighbours(spark):
    ts = tiles.scheme(spark, 5, 5, 1.0)
    assert names(tiles.tile_neighbours(ts, ["R3C3"])) == ["R2C2", "R2C3", "R2C4", "R3C2", "R3C3", "R3C4", "R4C2", "R4C3", "R4C4"]
    assert names(tiles.tile_neighbours(ts, ["R3C3"], "rook")) == ["R2C3", "R3C2", "R3C3", "R3C4", "R4C3"]
    assert names(tiles.tile_neighbours(ts, ["R1C1"])) == ["R1C1", "R1C2", "R2C1", "R2C2"]
    assert len(names(tiles.tile_neighbours(ts, ["R1C1", "R1C2", "R2C1"]))) == 8
    with pytest.raises(ValueError):
        tiles.tile_neighbours(ts, ["R1C1"], "king")


def test_scheme_bounds(spark):
    t = {r.tile_name: r for r in tiles.scheme(spark, 2, 2, 500.0, 40.0).collect()}
    assert tuple(t["R1C2"].core) == (500, 0, 1000, 500) and tuple(t["R1C2"].buff) == (460, -40, 1040, 540) and tuple(t["R1C2"].nbuff) == (500, -40, 1040, 500)


def test_queue_and_completeness(spark):
    ts = tiles.scheme(spark, 2, 2, 1.0)
    reg = tiles.add_attribute(spark.createDataFrame([], "tile_name string, attribute string, done boolean"), ts, "geom")
    assert tiles.add_attribute(reg, ts, "geom").count() == 4
    reg = tiles.register(reg, ts.where("row = 1"), "geom")
    assert sorted(names(tiles.tile_queue(ts, reg, "geom"))) == ["R2C1", "R2C2"]
    assert len(names(tiles.tile_queue(ts, reg, "geom", overwrite=True))) == 4
    assert names(tiles.tile_queue(ts, reg, "other", names=["R1C1"])) == ["R1C1"]
    with pytest.raises(ValueError, match="Following tile names do not exist: R9C9"):
        tiles.tile_queue(ts, reg, "geom", names=["R1C1", "R9C9"])
    assert names(tiles.missing_tiles(ts, reg, "geom", ["R1C1"])) == []
    assert sorted(names(tiles.missing_tiles(ts, reg, "geom", ["R1C1"], buffered=True))) == ["R2C1", "R2C2"]
    with pytest.raises(ValueError, match="R2C1, R2C2"):
        tiles.require_complete(ts, reg, "geom")
    assert {(r.tile_name, r.done) for r in tiles.has_tiles(ts, reg, "geom").collect()} == {("R1C1", True), ("R1C2", True), ("R2C1", False), ("R2C2", False)}
    assert [tuple(r) for r in tiles.registry_summary(reg).collect()] == [("geom", 2, 2)]
    assert tiles.delete_attribute(reg, "geom").count() == 0


def test_update_by_id_within_a_tile(spark):
    f = spark.createDataFrame([("R1C1", i, "abc"[i - 1]) for i in (1, 2, 3)] + [("R1C2", i, "z") for i in (1, 2, 3)], "tile_name string, poly_id int, myattr_char string")
    up = tiles.updated(f, spark.createDataFrame([(3, 40), (1, 50), (2, 60)], "poly_id int, myattr_num int"), "R1C1")
    got = {(r.tile_name, r.poly_id): (r.myattr_char, r.myattr_num) for r in up.collect()}
    assert [got["R1C1", i] for i in (1, 2, 3)] == [("a", 50), ("b", 60), ("c", 40)]
    assert all(got["R1C2", i] == ("z", None) for i in (1, 2, 3))
    # rows of the tile that the update lacks become null, not what they were
    again = {(r.tile_name, r.poly_id): r.myattr_num for r in tiles.updated(up, spark.createDataFrame([(2, 7)], "poly_id int, myattr_num int"), "R1C1").collect()}
    assert again["R1C1", 1] is None and again["R1C1", 2] == 7


def test_append_and_its_errors(spark):
    f = spark.createDataFrame([("R1C1", 1)], "tile_name string, poly_id int")
    reg = spark.createDataFrame([("R1C1", "geom", True), ("R1C2", "geom", False), ("R1C3", "geom", False)], "tile_name string, attribute string, done boolean")
    more = spark.createDataFrame([(1, "A")], "poly_id int, poly_name string")
    with pytest.raises(ValueError, match="Duplicate 'poly_id'"):
        tiles.appended(f, reg, more.union(more), "R1C2")
    with pytest.raises(ValueError, match="'R1C1' is there already"):
        tiles.appended(f, reg, more, "R1C1")
    with pytest.raises(ValueError, match="lack the id column 'poly_id'"):
        tiles.appended(f, reg, more.drop("poly_id"), "R1C2")
    g, r = tiles.appended(f, reg, more, "R1C2")
    assert {(x.tile_name, x.poly_id, x.poly_name) for x in g.collect()} == {("R1C1", 1, None), ("R1C2", 1, "A")}
    # an empty tile is done as well
    g, r = tiles.appended(g, r, more.limit(0), "R1C3")
    assert g.count() == 2 and {(x.tile_name, x.done) for x in r.collect()} == {("R1C1", True), ("R1C2", True), ("R1C3", True)}
    for bad in (more.drop("poly_id"), more.withColumn("tile_name", F.lit("R1C1"))):
        with pytest.raises(ValueError, match="Update data"):
            tiles.updated(f, bad, "R1C1")


def test_fields(spark):
    f = spark.createDataFrame([("R1C1", 1)], "tile_name string, poly_id int")
    g = tiles.add_field(tiles.add_field(f, "n", "int"), "n", "int")
    assert g.columns == ["tile_name", "poly_id", "n"] and tiles.delete_field(tiles.delete_field(g, "n"), "n").columns == f.columns


def test_vector_tileset(spark, tmp_path):
    ts = tiles.scheme(spark, 2, 2, 1.0)
    v = tiles.VectorTileset(spark, str(tmp_path / "segs"), "poly_id int, tile_name string").create(ts)
    assert v.features().count() == 0 and v.registry().where("done").count() == 0
    v.write(spark.createDataFrame([(1, "R1C1"), (2, "R1C1"), (1, "R1C2")], "poly_id int, tile_name string"))
    v.write(spark.createDataFrame([(5, "R1C2")], "poly_id int, tile_name string"))
    assert {(r.tile_name, r.poly_id) for r in v.features().collect()} == {("R1C1", 1), ("R1C1", 2), ("R1C2", 5)}
    assert v.registry().where("done").count() == 2 and v.registry().count() == 4
    assert [r.poly_id for r in v.read_tile("R1C2", ["poly_id"]).collect()] == [5]
    assert {(r.tile_name, r.n) for r in tiles.row_counts(ts, v.features()).collect()} == {("R1C1", 2), ("R1C2", 1), ("R2C1", 0), ("R2C2", 0)}
    to = v.backup(str(tmp_path), "a")
    assert spark.read.parquet(to).count() == 3
    with pytest.raises(Exception, match="(?i)already exists"):
        v.backup(str(tmp_path), "a")
    v.backup(str(tmp_path), "a", overwrite=True)


def test_tileset_tiles_one_by_one(spark, tmp_path):
    ts = tiles.scheme(spark, 1, 3, 1.0)
    v = tiles.VectorTileset(spark, str(tmp_path / "segs"), "poly_id int, tile_name string").create(ts)
    three = spark.createDataFrame([(3,), (1,), (2,)], "poly_id int")
    v.append(three, "R1C1")
    v.append(three, "R1C2")
    v.append(three.limit(0), "R1C3")
    assert v.features().count() == 6 and v.registry().where("done").count() == 3
    with pytest.raises(ValueError, match="already"):
        v.append(three.limit(0), "R1C3")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "segs/features/tile_name=R1C2").glob("*.parquet")}
    v.update(spark.createDataFrame([(1, 10), (3, 30)], "poly_id int, n int"), "R1C1", "count")
    got = {(r.tile_name, r.poly_id): r.n for r in v.features().collect()}
    assert got == {("R1C1", 1): 10, ("R1C1", 2): None, ("R1C1", 3): 30, **{("R1C2", i): None for i in (1, 2, 3)}}
    # the other tile's files weren't touched
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "segs/features/tile_name=R1C2").glob("*.parquet")} == before
    with pytest.raises(ValueError, match="'count' already"):
        v.update(spark.createDataFrame([(1, 11)], "poly_id int, n int"), "R1C1", "count")
    v.update(spark.createDataFrame([(1, 11)], "poly_id int, n int"), "R1C1", "count", overwrite=True)
    assert sorted((r.poly_id, r.n) for r in v.read_tile("R1C1").collect()) == [(1, 11), (2, None), (3, None)]
    # a result that reads the tileset itself, and a tile that turns out empty
    v.write(v.features().where("tile_name = 'R1C2'").withColumn("n", F.lit(5)), "count", ts.where("tile_name <> 'R1C1'"))
    assert {r.n for r in v.read_tile("R1C2").collect()} == {5} and v.registry().where("attribute = 'count' AND done").count() == 3
    v.write(v.features().where("poly_id > 9"), "count", ts.where("tile_name = 'R1C2'"))
    assert v.read_tile("R1C2").count() == 0 and v.read_tile("R1C1").count() == 3
    assert v.index("poly_id") and not v.index("poly_id") and v.read_tile("R1C1").count() == 3


def test_run_tiles_keeps_errors(spark):
    df = tiles.scheme(spark, 3, 3, 1.0).select("tile_name", "row", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("poly_id"))

    def worker(pdf):
        if pdf["row"].iloc[0] == 2:
            raise ValueError("no data")
        return pdf[["poly_id"]]

    out = tiles.run_tiles(df, worker, "poly_id int")
    assert out.where("status = 'success'").count() == 600 and out.where("status = 'error'").count() == 3
    s = {r.status: (r.message, r.tiles, r.names) for r in tiles.status_summary(out.select("tile_name", "status", "message").distinct()).collect()}
    assert s["error"] == ("no data", 3, "R2C1,R2C2,R2C3") and s["success"][1] == 6


def test_options(tmp_path):
    p = tmp_path / "o.json"
    p.write_text('{"overwrite": true, "tile_names": ["R1C1"], "unknown": 1}')
    assert tiles.EngineOptions.load(str(p)) == tiles.EngineOptions(tile_names=("R1C1",), overwrite=True)
    assert tiles.EngineOptions.load(str(p), tiles.EngineOptions(tile_names=("R2C2",)), override=False).tile_names == ("R2C2",)


def test_merge_by_zone_990(spark):
    def grid(n):
        a = [(2 * k + 1) / (2 * n) for k in range(n)]
        return [(r * 10 + c, f"R{r}C{c}", c - 1 + x, r - 1 + y) for r in (1, 2) for c in (1, 2) for x in a for y in a]

    rows = lambda n: spark.createDataFrame([(i, t, x, y) for i, (_, t, x, y) in enumerate(grid(n))], "fid long, tile_name string, x double, y double")
    sparse, dense = rows(10), rows(20)
    assert (sparse.count(), dense.count()) == (400, 1600)
    zones = spark.createDataFrame([("sparse", bytearray(wkb_polygon([(0, 0), (0, 2), (2, 2), (0, 0)])))], "zone_name string, geom binary")
    zones = with_rings(zones, "geom", "zone_name")
    got = merged_by_zone({"sparse": sparse, "<none>": dense}, zones, "zone_name")
    assert {r.zone_name: r["count"] for r in got.groupBy("zone_name").count().collect()} == {"sparse": 210, "<none>": 780}
    assert got.select("tile_name", "poly_id").distinct().count() == 990
    box = spark.createDataFrame([("sparse", 0.0, 0.0, 1.0, 2.0)], "zone_name string, minx double, miny double, maxx double, maxy double")
    assert merged_by_zone({"sparse": sparse, "<none>": dense}, box, "zone_name").count() == 200 + 800


def test_renumber_after(spark):
    df = spark.createDataFrame([("a", 5, True, 1.0), ("a", 9, True, 2.0), ("a", None, False, 4.0), ("a", None, False, 3.0), ("b", None, False, 1.0)], "tile_name string, poly_id int, own boolean, x double")
    got = {(r.tile_name, r.x): r.poly_id for r in renumbered_after(df, F.col("own"), ["x"]).collect()}
    assert got == {("a", 1.0): 5, ("a", 2.0): 9, ("a", 3.0): 10, ("a", 4.0): 11, ("b", 1.0): 1}
