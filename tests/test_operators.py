import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewright.operators import canopy, classify, metrics, pca, points, raster, report, segment, spatial, tiles
from tilewright.plans import blocks


def grid(spark, values, name="v", tile=lambda x, y: "R1C1"):
    """Rows of ``values`` as cells, the first row at py = 0."""
    rows = [(tile(x, y), x, y, float(v) if v is not None else None) for y, r in enumerate(values) for x, v in enumerate(r)]
    return spark.createDataFrame(rows, f"tile_name string, px int, py int, {name} double")


def cells(df, name="v"):
    return {(r.px, r.py): r[name] for r in df.collect()}


def test_division_by_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(raster.nan_div(F.col("a"), F.col("b"))).collect()]
    assert math.isnan(got[0]) and got[1:] == [math.inf, -math.inf, 0.5, None]


def test_pseudo_image_goes_to_254(spark):
    df = grid(spark, [[None, 0, 10, 20, 99]])
    got = [r.o for r in raster.pseudo_image(df, {"o": ("v", (0, 20))}).orderBy("px").collect()]
    assert got == [0, 0, 127, 254, 254]


def test_mask(spark):
    df, m = grid(spark, [[1, 2, 3, 4]]), spark.createDataFrame([(0, 0, 1), (1, 0, 0), (2, 0, None)], "px int, py int, m int")
    assert cells(raster.masked(df, m, "v", "m")) == {(0, 0): 1, (1, 0): None, (2, 0): 3, (3, 0): 4}
    assert cells(raster.masked(df, m, "v", "m", mask_na=True)) == {(0, 0): 1, (1, 0): None, (2, 0): None, (3, 0): None}


def test_jitter_repeats_and_is_small(spark):
    df = grid(spark, np.zeros((20, 20)))
    a, b = (cells(df.repartition(n).withColumn("v", raster.jitter("v"))) for n in (2, 5))
    assert a == b and 0 <= min(a.values()) and max(a.values()) <= 0.001 and len(set(a.values())) > 390


def test_opening(spark):
    v = np.zeros((9, 9))
    v[2:7, 2:7] = 1
    v[0, 8] = 1
    df = grid(spark, v)
    once = raster.opening(df, "v", 1)
    got = cells(once)
    # anti-extensive, idempotent, and single cells are gone
    assert all(got[x, y] <= v[y, x] for x, y in got) and got[8, 0] == 0 and got[4, 4] == 1
    assert cells(raster.opening(once, "v", 1)) == got
    # tiles make no seam
    assert cells(raster.opening(grid(spark, v, tile=lambda x, y: f"R{y // 3}C{x // 3}"), "v", 1)) == got
    with pytest.raises(ValueError, match="too small"):
        raster.opening(df, "v", 0.5)


def test_hillshade(spark):
    flat = cells(raster.hillshade(grid(spark, np.ones((4, 5))), "v"), "shade")
    assert set(flat) == {(x, y) for x in (1, 2, 3) for y in (1, 2)} and set(flat.values()) == {180}
    # the light comes from the north-west: a slope that falls to it is brighter
    rise = lambda f: set(cells(raster.hillshade(grid(spark, [[f(x, y) for x in range(3)] for y in range(3)]), "v"), "shade").values())
    assert min(rise(lambda x, y: x - y)) > 180 > max(rise(lambda x, y: y - x))


def test_resample(spark):
    v = np.arange(16).reshape(4, 4)
    df = grid(spark, v)
    assert cells(raster.resampled(df, ["v"], (0, 0, 1), (0, 0, 1), (0, 0, 4, 4))) == cells(df)
    half = cells(raster.resampled(df, ["v"], (0, 0, 1), (0, 0, 2), (0, 0, 2, 2)))
    assert all(cells(raster.resampled(df, ["v"], (0, 0, 1), (0, 0, 1), (0, 0, 4, 4), k)) == cells(df) for k in ("cubic", "near"))
    # a plane stays one inside
    wide = cells(raster.resampled(grid(spark, [[2.0 * x + y for x in range(12)] for y in range(12)]), ["v"], (0, 0, 1), (4, 4, 0.5), (0, 0, 6, 6), "cubic"))
    assert all(abs(v - (2 * (4 + (x + 0.5) / 2 - 0.5) + 4 + (y + 0.5) / 2 - 0.5)) < 1e-9 for (x, y), v in wide.items()) and len(wide) == 36
    assert half == {(x, y): v[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean() for x in (0, 1) for y in (0, 1)}
    holes = df.withColumn("v", F.when(F.col("px") > 0, F.col("v")))
    assert cells(raster.resampled(holes, ["v"], (0, 0, 1), (0, 0, 2), (0, 0, 1, 1))) == {(0, 0): 3.0}


def test_texture_by_hand(spark):
    px = grid(spark, [[0, 15], [15, None]], "b").withColumn("poly_id", F.lit(1))
    seg = spark.createDataFrame([("R1C1", 1), ("R1C1", 2)], "tile_name string, poly_id int")
    got = {r.poly_id: r for r in metrics.texture(px, seg, "b", (0, 16), "t").collect()}
    # pairs: 0-15 right, 0-15 down, 15-15 down left; counted both ways of six
    assert got[1].t_contrast == int(4 / 6 * 225 * 10000) and got[1].t_ASM == int(round(3 * 4 / 36 * 10000, 4)) and got[1].t_mean == int(10 * 10000)
    assert got[2].t_contrast == 0


def test_segments_of_tiles_with_few_points_are_zero(spark):
    p = spark.createDataFrame([("R1C1", 1, 5.0)] * 4 + [("R1C2", 1, 5.0)] * 5, "tile_name string, poly_id int, z double")
    seg = spark.createDataFrame([("R1C1", 1), ("R1C2", 1)], "tile_name string, poly_id int")
    got = {r.tile_name: (r.m_Z_mn, r.m_Z_sd, r.m_Z_over3) for r in metrics.height_metrics(p, seg, "m").collect()}
    assert got == {"R1C1": (0, 0, 0), "R1C2": (50000, 0, 10000)}


def test_stored_metrics(spark):
    v = [0.12345, -0.12345, None, float("nan"), float("inf"), 1e9, 0.3]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert [r[0] for r in df.select(metrics.stored(F.col("v"))).collect()] == [1234, -1234, 0, 0, 0, 0, 3000]


def test_null_colour_makes_the_metric_zero(spark):
    rows = [("a", 1, float(z), r, 10, 10) for z, r in ((1, 10), (2, 20), (3, 30), (4, 40), (5, 0))]
    got = metrics.colour_metrics(spark.createDataFrame(rows, "tile_name string, poly_id int, z double, r int, g int, b int"), spark.createDataFrame([("a", 1)], "tile_name string, poly_id int"), "c").collect()[0]
    assert got["c_R_mn"] == int((10 + 20 + 30 + 40 + 1) / 5 * 10000) and got["c_R_p50_mx"] == 400000 and got["c_R_p90_mn"] == 10000
    assert len(got) == 2 + 64


def test_normalisation_is_open_below_and_closed_above(spark):
    p = spark.createDataFrame([(0.5, 0.5, z) for z in (10.0, 10.1, 20.0, 20.1)] + [(5.5, 5.5, 11.0)], "x double, y double, z double")
    dem = spark.createDataFrame([(0, 0, 10.0), (5, 5, None)], "px int, py int, dem double")
    assert sorted(round(r.z, 6) for r in points.normalized(p, dem, 0, 10).collect()) == [0.1, 10.0]


def test_noise(spark):
    rows = [(float(x) / 10, 1.0, 1.0, 2) for x in range(20)] + [(90.0, 90.0, 90.0, 1)]
    out = points.classify_noise(spark.createDataFrame(rows, "x double, y double, z double, classification int"))
    assert [r.classification for r in out.where("x = 90").collect()] == [7] and points.remove_noise(out).count() == 20


def test_tin_reproduces_a_plane(spark):
    rng = np.random.default_rng(0)
    xy = np.vstack([rng.uniform(0, 10, (80, 2)), [[0, 0], [10, 0], [0, 10], [10, 10]]])
    rows = [("R1C1", float(x), float(y), float(2 * x - y + 3)) for x, y in xy] + [("R1C2", 0.0, 0.0, 1.0)] * 9
    got = points.terrain(spark.createDataFrame(rows, "tile_name string, x double, y double, z double"), spark.createDataFrame([(t, x, y) for t in ("R1C1", "R1C2") for x in range(10) for y in range(10)], "tile_name string, px int, py int")).toPandas()
    one = got[got.tile_name == "R1C1"]
    assert np.allclose(one.dem, 2 * (one.px + 0.5) - (one.py + 0.5) + 3)
    # three places or fewer make no surface
    assert got[got.tile_name == "R1C2"].dem.isna().all()


def test_terrain_over_wide_gaps(spark):
    # a gap of 150 cells within the tile and one of 100 at a side of it; the second tile has 3 points, which others still need
    rng = np.random.default_rng(8)
    x, y = rng.uniform(0, 220, 1500), rng.uniform(0, 220, 1500)
    keep = ~((x > 30) & (x < 180) & (y > 30) & (y < 180)) & ~((x > 190) & (y > 60) & (y < 160))
    xyz = [(float(a), float(b), float(10 + 5 * np.sin(a / 20) + b / 30)) for a, b in zip(x[keep], y[keep], strict=True)]
    few = [(225.0, 80.5, 3.0), (226.0, 110.5, 4.0), (224.5, 140.5, 5.0)]
    cells = [("R1C1", i, j) for i in range(0, 220, 3) for j in range(0, 220, 3)] + [("R1C2", 222, 80)]
    got = points.terrain(spark.createDataFrame([("R1C1", *r) for r in xyz] + [("R1C2", *r) for r in few], "tile_name string, x double, y double, z double"), spark.createDataFrame(cells, "tile_name string, px int, py int")).toPandas()
    assert len(got) == len(cells) and got[got.tile_name == "R1C2"].dem.isna().all()
    one = got[got.tile_name == "R1C1"]
    want = points.tin_surface(*np.array(xyz + few).T, one.px.to_numpy() + 0.5, one.py.to_numpy() + 0.5)
    assert np.allclose(one.dem.to_numpy(float), want, equal_nan=True)


def test_delaunay_circles_are_empty():
    p = np.random.default_rng(1).uniform(0, 1, (60, 2))
    tri = points._triangles(p)
    c = points._circles(p, tri)
    d = ((p[None] - c[:, None, :2]) ** 2).sum(-1)
    assert (d >= c[:, None, 2] - 1e-9).all() and len(tri) > 90


def test_treetops(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(0, 40, (25, 25))
    rad = lambda v: 1 + v / 20
    want = {(x, y) for y in range(25) for x in range(25) if h[y, x] >= 5 and not any(h[b, a] > h[y, x] and (a - x) ** 2 + (b - y) ** 2 <= rad(h[y, x]) ** 2 for b in range(25) for a in range(25))}
    got = segment.treetops(grid(spark, h, "chm"), rad, 3, 5)
    assert {(r.px, r.py) for r in got.collect()} == want
    # tiled and untiled are the same, as cells aren't kept twice
    assert {(r.px, r.py) for r in segment.treetops(grid(spark, h, "chm", lambda x, y: f"{x // 10}"), rad, 3, 5).collect()} == want


def test_windows_in_blocks_make_no_seams(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = rng.integers(0, 9, (70, 90)).astype(float)
    v[rng.random(v.shape) < 0.1] = np.nan
    df = grid(spark, v).where("px % 17 <> 3 OR py % 5 <> 2").withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    there = {(r.px, r.py): r.v for r in df.collect()}
    around = lambda at, x, y, rad: [at[x + i, y + j] for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= rad * rad and at.get((x + i, y + j)) is not None]
    for side in (16, 256):
        monkeypatch.setattr(raster, "over_blocks", lambda *a, side=side: blocks.over_blocks(*a, side=side))
        for rad in (1, 2.3, 3):
            low = {k: min(around(there, *k, rad), default=None) for k in there}
            want = {k: max(around(low, *k, rad), default=None) for k in there}
            assert cells(raster.opening(df, "v", rad)) == want
    assert raster.opening(df.limit(0), "v", 1).count() == 0 and raster.hillshade(df.limit(0), "v").count() == 0
    ints = spark.createDataFrame([(0, 0, 1), (1, 0, None), (2**30, -(2**30), 5)], "px int, py int, v int")
    assert {(r.px, r.v) for r in raster.focal(ints, "v", 1, ["max"]).collect()} == {(0, 1), (1, 1), (2**30, 5)}


def test_tops_of_tiles(spark):
    h = np.zeros((10, 40))
    h[5, [4, 19, 20, 33]] = [9, 8, 7, 6]
    df = grid(spark, h, "chm")
    got = segment.treetops(df, lambda v: v * 0 + 3, 3, 1, tiles=tiles.scheme(spark, 1, 2, 20.0, 2.0)).collect()
    # 20 is overruled across the border; the tile without heights has none
    assert {(r.tile_name, r.px) for r in got} == {("R1C1", 4), ("R1C1", 19), ("R1C2", 33)}
    assert segment.treetops(df.withColumn("chm", F.lit(None).cast("double")), lambda v: v, 3, 1).count() == 0


def test_watershed(spark):
    h = [[1, 3, 1, 0, 1, 4, 1]] * 2
    tops = spark.createDataFrame([("R1C1", 1, 0, 11, 3.0), ("R1C1", 5, 0, 22, 4.0)], "tile_name string, px int, py int, tree_id long, height double")
    c = segment.crowns(grid(spark, h, "chm"), tops, 0.5)
    assert {(r.px, r.tree_id) for r in c.collect()} == {(0, 11), (1, 11), (2, 11), (4, 22), (5, 22), (6, 22)}
    assert {(r.tree_id, r.height, r.crown_area) for r in segment.crown_table(c, tops, 0.5).collect()} == {(11, 3.0, 1.5), (22, 4.0, 1.5)}
    assert segment.crowns(grid(spark, h, "chm"), tops.limit(0), 0.5).count() == 0


def test_crowns_cross_tile_borders(spark):
    # tiles of 10 cells with 6 of buffer: the tree at 8 reaches to 11, that at 14 down to 12
    h = [1, 1, 1, 1, 1, 5, 6, 7, 9, 7, 6, 2, 6, 7, 8, 7, 6, 5, 4, 3]
    chm = spark.createDataFrame([(x, 0, float(v)) for x, v in enumerate(h)], "px int, py int, chm double")
    tops = spark.createDataFrame([(8, 0, 1, 9.0), (14, 0, 2, 8.0)], "px int, py int, tree_id long, height double")
    got = segment.tile_crowns(chm, tops, tiles.scheme(spark, 1, 2, 10.0, 6.0), least=1.5).collect()
    assert sorted((r.tile_name, r.tree_id, r.height, r.crown_area) for r in got) == [("R1C1", 1, 9.0, 7.0), ("R1C2", 2, 8.0, 8.0)]
    assert {r.tree_id for r in segment.tile_crowns(chm, tops, tiles.scheme(spark, 1, 2, 10.0, 6.0)).collect()} == {1, 2}


def test_mean_shift_finds_two_fields(spark):
    v = np.array([[10.0] * 5 + [200.0] * 5] * 6)
    v[2, 2] = 60
    got = segment.mean_shift_segments(grid(spark, v), ["v"], 2, 30, 5).toPandas()
    assert len(got) == 60 and got.poly_id.nunique() == 2 and got[got.px < 5].poly_id.nunique() == 1


def test_mean_shift_moves_in_space():
    # a smooth ramp: windows climb to the ends of the range they see, and all settle
    v = np.add.outer(np.zeros(12), np.arange(40) * 3.0)[..., None]
    got, unsettled = segment.mean_shift(v, np.ones(v.shape[:2], bool), 4, 12, 10)
    assert unsettled == 0 and got.min() == 1 and all(np.bincount(got.ravel())[1:] >= 10)
    # a cell moves towards like ones in reach, not through a gap that is wider
    w = np.array([[1.0, 1, 1, 0, 0, 0, 0, 1, 1, 1]])
    got, _ = segment.mean_shift(w[..., None], w > 0, 2, 5, 1)
    assert got.tolist() == [[1, 1, 1, 0, 0, 0, 0, 2, 2, 2]]


def test_small_segments_join_the_nearest():
    label = np.array([0, 0, 0, 1, 2, 2, 2, 3])
    pairs = np.array([[i, i + 1] for i in range(6)])
    got = segment.merged_small(label, pairs, np.array([[1.0], [1], [1], [4], [9], [9], [9], [9]]), 3)
    assert len({*got[:4]}) == 1 and len({*got[4:7]}) == 1 and len({*got}) == 3
    assert segment.merged_small(label, pairs[:0], np.ones((8, 1)), 9).tolist() == [0, 0, 0, 1, 2, 2, 2, 3]


def test_edits_are_a_fold(spark):
    seg = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, None)], "fid int, seg_class string")
    hits = [(f, 2, "B", "D") for f in (1, 2, 3)] + [(f, 1, "A  C\t", "B") for f in (1, 3)] + [(f, 3, " ", "Z") for f in (3, 4)] + [(2, 4, None, "Y")]
    got = classify.edited(seg, spark.createDataFrame(hits, "fid int, seq int, from_class string, to_class string"), ["fid"])
    assert {r.fid: r.seg_class for r in got.collect()} == {1: "D", 2: "Y", 3: "Z", 4: "Z"}


def test_extraction_prefers_polygons(spark):
    seg = spark.createDataFrame([(10, 0.0, 0.0, 1.0, 1.0, 5), (11, 1.0, 0.0, 2.0, 1.0, 6)], "fid int, minx double, miny double, maxx double, maxy double, spec_a int")
    pts = spark.createDataFrame([(1, 0.5, 0.5, 1, "C"), (2, 1.0, 0.5, 1, "D"), (3, 9.0, 9.0, 1, "E")], "fid int, x double, y double, training_set int, seg_class string")
    pol = spark.createDataFrame([(7, 1.5, 0.2, 3.0, 0.4, 1, "P")], "fid int, minx double, miny double, maxx double, maxy double, training_set int, seg_class string")
    got = {(r.fid, r.type, r.training_fid, r.seg_class, r.spec_a) for r in classify.extracted(pts, pol, seg, ["spec_a"]).collect()}
    # point 2 lies on both segments and takes the first, which point 1 has already; the polygon keeps 11
    assert got == {(10, 1, 1, "C", 5), (11, 2, 7, "P", 6)}
    done = spark.createDataFrame([(1, 1)], "type int, training_fid int")
    data = classify.extracted(pts, pol, seg, ["spec_a"], done)
    assert {(r.fid, r.training_fid) for r in data.collect()} == {(10, 2), (11, 7)}
    assert {r.training_fid for r in classify.hit_nothing(pts, data, 1).collect()} == {1, 3}
    with pytest.raises(ValueError, match="NA"):
        classify.require_whole(data.withColumn("spec_a", F.lit(None)), ["spec_a"])


def test_forest_on_separable_data(spark, tmp_path):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 600)
    pdf = pd.DataFrame({"row_id": np.arange(600), "seg_class": [["C", "D", "E"][k] for k in y], "spec_a": y * 10 + rng.normal(0, 1, 600), "spec_b": rng.normal(0, 1, 600)})
    df = spark.createDataFrame(pdf)
    m = classify.forest(df, classify.prefixed(df, ["spec"]), trees=20, depth=4)
    m.write().overwrite().save(str(tmp_path / "m"))
    m = classify.PipelineModel.load(str(tmp_path / "m"))
    assert classify.predictors_of(m) == ["spec_a", "spec_b"]
    got = classify.predicted(df.withColumnRenamed("seg_class", "seen"), m)
    assert got.where("seen = seg_class").count() > 590
    acc = classify.monte_carlo_accuracy(df, ["spec_a", "spec_b"], {"tree": ["C", "D"], "other": ["E"]}, iterations=2, trees=10).toPandas()
    assert len(acc) == 2 and (acc.pcc > 0.95).all() and (acc.kappa > 0.9).all()
    of = {r.seg_class: r for r in classify.monte_carlo_classes(df, ["spec_a", "spec_b"], {"tree": ["C", "D"], "other": ["E"], "none": ["X"]}, iterations=2, trees=10).collect()}
    assert of["tree"].users > 0.95 and of["other"].producers > 0.9 and of["none"].users is None


def test_classifier_of_chosen_sets(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 400)
    pdf = pd.DataFrame({"fid": np.arange(400), "type": 1, "training_fid": 1, "training_set": np.arange(400) % 4, "seg_class": [["C", "D"][k] for k in y], "spec_a": y * 10 + rng.normal(0, 1, 400), "spec_b": rng.normal(0, 1, 400)})
    # set 3 is labelled the wrong way round, and isn't chosen; a null is left out
    pdf.loc[pdf.training_set == 3, "seg_class"] = pdf.seg_class.map({"C": "D", "D": "C"})
    df = spark.createDataFrame(pdf).withColumn("spec_b", F.when(F.col("fid") != 8, F.col("spec_b")))
    assert classify.training_rows(df, [0, 1]).columns == ["seg_class", "spec_a", "spec_b"] and classify.training_rows(df, [0, 1]).count() == 199
    m, error = classify.created(df, [0, 1, 2], trees=10, depth=4, held_out=0.2)
    assert classify.predictors_of(m) == ["spec_a", "spec_b"] and error < 0.05
    m, error = classify.created(df, [0, 1, 2], ["spec_a"], trees=10, depth=4, held_out=0)
    assert classify.predictors_of(m) == ["spec_a"] and error is None
    for bad, match in (({"sets": [9]}, "No training rows"), ({"sets": [0], "predictors": ["nope"]}, "nope"), ({"sets": [0], "predictors": ["auto"]}, "automatically")):
        with pytest.raises(ValueError, match=match):
            classify.created(df, **bad)


def test_surface_algorithms(spark):
    p = spark.createDataFrame([(0.5, 0.5, 1.0), (0.4, 0.4, 3.0), (3.5, 0.5, 5.0), (0.5, 3.5, 5.0), (3.5, 3.5, 7.0)], "x double, y double, z double")
    g = spark.createDataFrame([("R1C1", x, y) for x in range(5) for y in range(4)], "tile_name string, px int, py int")
    assert cells(points.surface(p, 1.0), "z") == {(0, 0): 3, (3, 0): 5, (0, 3): 5, (3, 3): 7}
    disc = cells(points.surface(p, 1.0, algorithm="circle", radius=0.6), "z")
    assert disc[0, 0] == 3 and disc[-1, 0] == 3 and disc[4, 3] == 7 and (1, 0) in disc and (1, 1) not in disc
    tin = cells(points.surface(p, 1.0, grid=g, algorithm="tin", fill=-1), "z")
    assert tin[1, 2] == pytest.approx(5, abs=0.7) and 3 < tin[1, 1] < 5 and tin[4, 0] == -1 and len(tin) == 20
    with pytest.raises(ValueError, match="algorithm"):
        points.surface(p, algorithm="other")


def test_noise_within_a_radius(spark):
    rng = np.random.default_rng(6)
    xyz = np.vstack([rng.uniform(0, 10, (150, 3)), np.repeat([[30.0, 30, 30]], 5, axis=0)])
    rows = [(*map(float, r), 2) for r in xyz] + [(None, 1.0, 1.0, 2)]
    got = points.classify_noise(spark.createDataFrame(rows, "x double, y double, z double, classification int"), 1.5, 3, "radius").collect()
    d = ((xyz[:, None] - xyz) ** 2).sum(-1) <= 2.25
    assert sum(r.classification == 7 for r in got) == int((d.sum(1) - 1 <= 3).sum()) > 20 and len(got) == 155
    # five in one place are four others to each
    assert {r.classification for r in got if r.x == 30} == {2}


def test_metrics_find_out_what_the_points_have(spark):
    p = spark.createDataFrame([("a", 1, float(z), 1, 0, 0, 0) for z in range(6)], "tile_name string, poly_id int, z double, classification int, r int, g int, b int")
    seg = spark.createDataFrame([("a", 1), ("b", 1)], "tile_name string, poly_id int")
    got = metrics.las_metrics(p, seg, "m")
    assert got.columns == ["tile_name", "poly_id", *(f"m_{c}" for c in ("Z_qmn", "Z_mn", "Z_sd", "Z_iq", "Z_p50", "Z_p75", "Z_p90", "Z_over1", "Z_over2", "Z_over3"))]
    assert {r.tile_name: r.m_Z_mn for r in got.collect()} == {"a": 25000, "b": 0}
    more = metrics.las_metrics(p.withColumns({"classification": F.lit(2), "r": F.lit(9)}), seg, "m")
    assert len(more.columns) == 2 + 10 + 1 + 64 and len(metrics.las_metrics(p, seg, "m", full=True, ground=True).columns) == 2 + 10 + 13


def test_polygons_into_tiles(spark):
    from tests.test_proximity import wkb_polygon
    from tilewright.operators.proximity import with_rings

    ts = tiles.scheme(spark, 1, 2, 10.0, 1.0)
    # within a buffer; a comb whose teeth lie in the other tile; a frame across the border; outside
    rings = {1: [[(8, 1), (10.5, 1), (10.5, 2), (8, 2)]], 2: [[(8, 3), (14, 3), (14, 4), (9, 4), (9, 5), (14, 5), (14, 6), (8, 6)]], 3: [[(7, 7), (13, 7), (13, 9), (7, 9)], [(8, 7.5), (12, 7.5), (12, 8.5), (8, 8.5)]], 4: [[(90, 1), (91, 1), (91, 2)]]}
    df = spark.createDataFrame([(k, bytearray(wkb_polygon(*r)), "x") for k, r in rings.items()] + [(5, None, "x"), (6, bytearray(b"1"), "x")], "fid int, g binary, tile_name string")
    got = spatial.tile_polygons(with_rings(df, "g", "fid"), ts, "fid").collect()
    assert sorted((r.tile_name, r.fid, round(r.area, 9)) for r in got) == [("R1C1", 1, 2.5), ("R1C1", 2, 5.0), ("R1C1", 3, 4.0), ("R1C2", 2, 4.0), ("R1C2", 2, 4.0), ("R1C2", 3, 4.0)]
    assert {(r.tile_name, r.poly_id) for r in got} == {("R1C1", 1), ("R1C1", 2), ("R1C1", 3), ("R1C2", 1), ("R1C2", 2), ("R1C2", 3)}
    empty = with_rings(df.limit(0), "g", "fid")
    assert spatial.tile_polygons(empty, ts, "fid").count() == 0 and spatial.rasterized(empty.withColumn("poly_id", F.lit(1))).count() == 0
    # rectangles and polygons meet
    box = spark.createDataFrame([("in the gap", 10.0, 4.2, 13.0, 4.8), ("on a tooth", 13.0, 5.5, 20.0, 5.7), ("in the frame", 9.0, 7.8, 11.0, 8.2)], "name string, minx double, miny double, maxx double, maxy double")
    poly = with_rings(df, "g", "fid")
    assert {(r.name, r.fid) for r in spatial.read_from_areas(box, poly, "name", ["fid"]).collect()} == {("on a tooth", 2)}
    assert {r.fid for r in spatial.semi_shapes(poly, box, ["fid"]).collect()} == {2} and {r.fid for r in spatial.semi_shapes(poly, box, ["fid"], inside=False).collect()} == {1, 3, 4}
    pts = spark.createDataFrame([(1, 13.0, 5.5), (2, 12.0, 4.5), (3, 14.0, 5.0), (None, 1.0, 1.0)], "k int, x double, y double")
    assert {(r.k, r.fid) for r in spatial.read_from_points(pts, poly.drop("tile_name"), "k", ["fid"], ["fid"]).collect()} == {(1, 2), (2, None), (3, 2), (None, None)}
    assert spatial.shapes_meet(poly, poly.limit(0)).count() == 0


def test_accuracy_by_hand(spark):
    pairs = spark.createDataFrame([("a", "a")] * 40 + [("a", "b")] * 10 + [("b", "b")] * 45 + [("b", "a")] * 5, "observed string, elected string")
    r = classify.accuracy(pairs, ["a", "b", "c"]).collect()[0]
    assert r.pcc == pytest.approx(0.85) and r.kappa == pytest.approx(0.7) and r.sensitivity == pytest.approx((0.8 + 0.9) / 2)
    c = {x.seg_class: (x.users, x.producers) for x in classify.class_accuracy(pairs, ["a", "b", "c"]).collect()}
    assert c["a"] == (pytest.approx(40 / 45), 0.8) and c["c"] == (None, None)
    two = pairs.withColumn("k", F.lit(1)).unionByName(pairs.where("observed = 'a'").withColumn("k", F.lit(2)))
    got = {x.k: (x.pcc, x.kappa) for x in classify.accuracy(two, ["a", "b", "c"], ["k"]).collect()}
    assert got == {1: (pytest.approx(0.85), pytest.approx(0.7)), 2: (pytest.approx(0.8), pytest.approx(0))}
    none = classify.accuracy(pairs.limit(0), ["a", "b"]).collect()
    assert [tuple(x) for x in none] == [(None, None, None, None)]


def test_empty_layers(spark):
    assert all(classify.empty_layer(spark, n, 32633).count() == 0 for n in classify.LAYERS)
    with pytest.raises(ValueError, match="Invalid CRS"):
        classify.empty_layer(spark, "points", "nowhere")


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 3)) @ rng.normal(0, 1, (3, 3)) + 100
    df = spark.createDataFrame(pd.DataFrame({"tile_name": ["a"] * 200 + ["b"] * 200, "px": np.arange(400, dtype=np.int32), "py": np.int32(0), "r": x[:, 0], "g": x[:, 1], "b": x[:, 2]}))
    m = pca.pca_model(df, ["r", "g", "b"])
    w, v = pca.components_of(x.mean(0), np.cov(x, rowvar=False))
    assert np.allclose(m.variance, w) and np.allclose(m.loadings, v) and np.allclose(pca.PCAModel.of_row(m.row()).mean, x.mean(0))
    got = pca.scored(df, m, 2).orderBy("px").toPandas()
    assert np.allclose(got[["pc1", "pc2"]], (x - x.mean(0)) @ v[:, :2])
    local = pca.pca_local(df, ["r", "g", "b"]).orderBy("px").toPandas()
    a = x[:200] - x[:200].mean(0)
    assert np.allclose(local.pc1[:200], a @ pca.components_of(None, np.cov(a, rowvar=False))[1][:, 0])
    with pytest.raises(ValueError):
        pca.pca_model(df.limit(1), ["r", "g", "b"])


def test_pca_sample_drops_black_and_null(spark):
    df = spark.createDataFrame([("a", i, 0, float(i % 5), 1.0 if i % 5 else 0.0) for i in range(500)] + [("a", 900, 0, None, 1.0)], "tile_name string, px int, py int, r double, g double")
    n = pca.sampled(df, ["r", "g"], 100).count()
    assert 60 < n < 140 and pca.sampled(df, ["r", "g"], 10_000).count() == 400


def test_canopy_edits_overrule(spark):
    k = grid(spark, np.ones((5, 5)), "class_id").withColumn("class_id", F.col("class_id").cast("int"))
    e = spark.createDataFrame([(0, 0, 0), (9, 9, 1), (1, 1, None)], "px int, py int, canopy int")
    got = cells(canopy.canopy_mask(k, k, [1], 1, 1, e), "canopy")
    assert got[0, 0] is None and got[1, 1] == 1 and len(got) == 25


def test_boxes_meet_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = (np.column_stack([xy := rng.uniform(-20, 20, (60, 2)), xy + rng.choice([0.0, 1, 8, 50], (60, 2))]) for _ in range(2))
    df = lambda v, k: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], f"{k} int, minx double, miny double, maxx double, maxy double")
    got = [(r.i, r.j_b) for r in spatial.boxes_meet(df(a, "i"), df(b, "j")).collect()]
    want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]}
    assert set(got) == want and len(got) == len(want)


def test_pie_shares_sum_to_one(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("b", 2)] * 96 + [("b", 1)], "k string, d int")
    p = report.pie(df, "k").toPandas()
    assert p.ratio.sum() == pytest.approx(1) and p.end1.iloc[-1] == pytest.approx(2 * math.pi) and p.label.tolist() == ["a\n(3.0%)", "b\n(97.0%)"]
    d = report.donut(df, "k", "d").toPandas()
    assert len(d) == 4 and d[(d.k == "a") & (d.d == 2)].freq.iloc[0] == 0 and d[d.freq == 0].label.iloc[0] == "" and d.ratio.sum() == pytest.approx(1)
