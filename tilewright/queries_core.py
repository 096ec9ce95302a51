"""Queries of the core operators over a dataset folder, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright import queries_polygons
from tilewright.fixtures import expanded, fixture
from tilewright.functions import text
from tilewright.operators import canopy, classify, metrics, pca, points, raster, report, segment, spatial, tiles
from tilewright.sources.tables import table

SEG = ["tile_name", "poly_id"]
BOX = ["minx", "miny", "maxx", "maxy"]
#: The fixture grid of tiles: 5 x 10 of 20 cells, 2 cells of buffer.
GRID = (5, 10, 20.0, 2.0)


def _rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _pixels(s, d):
    return fixture(s, d, "fx_pixels_t")


def _scheme(s):
    return tiles.scheme(s, *GRID)


def _training(s, d):
    return fixture(s, d, "fx_training")


def _selected_data(s, d):
    return table(s, d, "training_data").select("fid", "type", "training_set", "training_fid", "seg_class", "spec_mean_r", "spec_mean_g", "spec_ndvi")


def _seg_registry(s, d):
    """Tiles of the fixture's segments, all done but the first."""
    return fixture(s, d, "SELECT DISTINCT tile_name, 'geom' AS attribute, tile_name <> 'R1C1' AS done FROM fx_segments")


def _trees(s, d):
    return segment.treetops(fixture(s, d, "fx_pixels"), lambda h: 1 + h * 0.04, 3, 10)


def _seg_fid(s, d):
    return fixture(s, d, "SELECT CAST(minx / 5 + 1000 * (miny / 5) AS INT) AS fid, minx, miny, maxx, maxy, n_px AS spec_n, tile_name, poly_id FROM fx_segments")


def _labelled(s, d):
    """Segments with a class and a few metrics, for a forest."""
    seg = fixture(s, d, "fx_seg_class")
    p = _pixels(s, d).groupBy(*SEG).agg(F.avg("r").alias("spec_r"), F.avg("g").alias("spec_g"), F.avg("ir").alias("spec_ir"))
    return seg.join(p, SEG)


def _forest(s, d):
    x = _labelled(s, d)
    m = classify.forest(x, classify.prefixed(x, ["spec"]), trees=50, depth=6)
    return classify.class_ids(classify.predicted(x.drop("seg_class"), m), fixture(s, d, "fx_class_table")).select(*SEG, "seg_class", "class_id")


def _files(s, d):
    return fixture(s, d, "SELECT concat('f', CAST(b % 16 AS VARCHAR(10))) AS filename, x, y, z, classification, r, g, b FROM fx_points")


def _local_files(s, d):
    """Point files that each hold a stretch of 25 along x."""
    return fixture(s, d, "SELECT concat('x', CAST(CAST(floor(x / 25) AS INT) AS VARCHAR(10))) AS filename, x, y FROM fx_points")


def _qc(s, d):
    p = _files(s, d)
    f = p.groupBy("filename").agg(F.count(F.lit(1)).alias("size")).withColumn("status", F.when(F.col("size") % 2 == 0, "Valid").otherwise("truncated"))
    done = s.createDataFrame([("f1", "Valid"), ("f2", "bad header")], "filename string, status string")
    return points.quality(f, p, done)


def _segs_with_class_id(s, d):
    return fixture(s, d, "SELECT tile_name, poly_id, minx, miny, maxx, maxy, CAST(n_px AS DOUBLE) AS height, CAST(n_px * 2 AS DOUBLE) AS crown_area, CASE WHEN poly_id % 7 <> 0 THEN poly_id % 6 END AS class_1 FROM fx_segments")


def _status(s, d):
    df = table(s, d, "tile_reg").select("tile_name", "row_no", "col_no")

    def worker(pdf):
        if pdf["row_no"].iloc[0] % 9 == 0:
            raise ValueError("no data")
        return pdf[["col_no"]]

    return tiles.status_summary(tiles.run_tiles(df, worker, "col_no int"))


def _zone_sources(s, d):
    name = "concat('R', CAST(CAST(floor(y / 20) AS INT) + 1 AS VARCHAR(10)), 'C', CAST(CAST(floor(x / 20) AS INT) + 1 AS VARCHAR(10))) AS tile_name"
    a = fixture(s, d, f"SELECT tree_id AS fid, x, y, height, {name} FROM fx_treetops")
    b = fixture(s, d, f"SELECT fid, x, y, seg_class, {name} FROM fx_training")
    return {"west": a, "east": b, "<none>": a}


def _pca(s, d):
    e = table(s, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)))
    m = pca.pca_model(e, [f"e{i}" for i in range(64)])
    return s.createDataFrame([(k + 1, float(v)) for k, v in enumerate(m.variance)], "component int, variance double")


def _pca_sums(s, d):
    """What no choice of axes changes: the sum of the variances, and of their squares."""
    return _rounded(_pca(s, d).agg(F.sum("variance").alias("total"), F.sum(F.col("variance") * F.col("variance")).alias("squares")), "total", "squares", digits=8)


def _pca_global(s, d):
    p = _pixels(s, d)
    m = pca.pca_model(pca.sampled(p, ["r", "g", "b"]), ["r", "g", "b"])
    return pca.scored(p, m).select("tile_name", "px", "py", "pc1", "pc2")


def _pca_two_bands(s, d):
    p = _pixels(s, d)
    # a sample larger than any tile is all of it
    m = pca.pca_model(pca.sampled(p, ["b", "ir"], 1_000_000_000), ["b", "ir"])
    return _rounded(pca.scored(p, m).select("tile_name", "px", "py", "pc1", "pc2"), "pc1", "pc2", digits=5)


def _crown_cover(s, d):
    """How many cells the crowns of each tile's buffered area have: those of height that a top can be reached from."""
    tops = _trees(s, d).withColumn("tree_id", (F.col("py") * 1000 + F.col("px")).cast("bigint"))
    cells = segment.crowns(raster.crop(fixture(s, d, "SELECT px, py, chm FROM fx_pixels"), _scheme(s), "buff"), raster.crop(tops.select("px", "py", "tree_id"), _scheme(s), "buff"))
    return cells.groupBy("tile_name").agg(F.count(F.lit(1)).alias("cells"))


def _dem_plane(s, d):
    """The terrain of points on a plane: wherever there is one, it is the plane."""
    p = fixture(s, d, "fx_points_t").withColumn("z", 2 * F.col("x") - F.col("y") + 3)
    dem = points.terrain(points.ground_points(p.select("tile_name", "x", "y", "z", "classification")), _pixels(s, d), enough=points.tiles_with_ground(p))
    plane = 2 * (F.col("px") + 0.5) - (F.col("py") + 0.5) + 3
    return dem.select("tile_name", "px", "py", F.coalesce(F.abs(F.col("dem") - plane) < 1e-6, F.lit(True)).alias("on_plane"))


def _dem(s, d):
    p = fixture(s, d, "fx_points_t")
    return points.terrain(points.ground_points(p.select("tile_name", "x", "y", "z", "classification")), _pixels(s, d), enough=points.tiles_with_ground(p))


def _accuracy_pairs(s, d):
    return fixture(s, d, "SELECT seg_class AS observed, CASE (poly_id + CASE WHEN poly_id % 3 = 0 THEN 1 ELSE 0 END) % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'D' WHEN 2 THEN 'E' WHEN 3 THEN 'B' ELSE 'H' END AS elected FROM fx_seg_class")


CODES = ["C", "D", "E", "B", "H"]

QUERIES = {
    # spectral metrics and tile reads
    "seg_metrics_spec_ir": lambda s, d: metrics.zonal(_pixels(s, d), fixture(s, d, "fx_segments"), {"r": F.col("r"), "ir": F.col("ir"), **raster.ir_indices()}, ["mean", "sd"], "spec"),
    "seg_metrics_spec_rgb": lambda s, d: metrics.zonal(_pixels(s, d), fixture(s, d, "fx_segments"), raster.rgb_indices(), ["mean", "sd"], "spec"),
    "read_tile": lambda s, d: tiles.read_tile(fixture(s, d, "fx_segments"), "R2C3", ["poly_id", "n_px"]),
    # cell math
    "ras_diff": lambda s, d: raster.difference(_pixels(s, d).withColumnRenamed("chm", "z"), fixture(s, d, "SELECT t.tile_name, d.px, d.py, d.dem AS z FROM fx_dem d JOIN fx_pixels_t t ON d.px = t.px AND d.py = t.py"), "z"),
    "pseudo_img": lambda s, d: raster.pseudo_image(_pixels(s, d), {"red": ("r", None), "height": ("chm", (5, 45)), "gap": (F.nullif(F.col("b"), F.lit(0.0)), (0, 255))}),
    "mask_rts": lambda s, d: raster.masked(_pixels(s, d).select("tile_name", "px", "py", "r"), fixture(s, d, "SELECT px, py, CASE WHEN b < 200 THEN CAST(b AS INT) % 2 END AS m FROM fx_pixels WHERE px % 3 <> 0"), "r", "m"),
    "mask_rts_na": lambda s, d: raster.masked(_pixels(s, d).select("tile_name", "px", "py", "r"), fixture(s, d, "SELECT px, py, CASE WHEN b < 200 THEN CAST(b AS INT) % 2 END AS m FROM fx_pixels WHERE px % 3 <> 0"), "r", "m", mask_na=True),
    "reclass_binary": lambda s, d: fixture(s, d, "fx_class_cells").select("tile_name", "px", "py", raster.reclass_binary("class_id", [1, 2, 5]).alias("canopy"), raster.reclass_binary("class_id", [1, 2, 5], None).alias("final")),
    "classify_seg_ras": lambda s, d: raster.class_raster(_pixels(s, d).select("tile_name", "px", "py", "poly_id"), _segs_with_class_id(s, d), "class_1"),
    "cover": lambda s, d: _pixels(s, d).select("tile_name", "px", "py", raster.cover(raster.zero_to_null(F.col("b")), F.col("r")).alias("v"), raster.fill_zero(F.nullif(F.col("b"), F.col("r"))).alias("filled")),
    "overview": lambda s, d: _rounded(raster.overview(fixture(s, d, "fx_pixels"), ["r", "g", "ir"], 4), "r", "g", "ir"),
    "mosaic_tiles": lambda s, d: raster.mosaic(raster.crop(fixture(s, d, "fx_pixels"), _scheme(s), "nbuff"), ["r", "chm"]),
    "crop_buffs": lambda s, d: raster.crop(fixture(s, d, "SELECT px, py, r FROM fx_pixels"), _scheme(s), "buff"),
    "band_range": lambda s, d: raster.band_range(fixture(s, d, "fx_pixels"), ["r", "g", "b", "ir", "chm"]),
    "to_rts": lambda s, d: _rounded(raster.resampled(fixture(s, d, "fx_pixels"), ["r", "ir"], (0, 0, 1), (0, 0, 2), (0, 0, 100, 50)), "r", "ir"),
    "to_rts_cubic": lambda s, d: _rounded(raster.resampled(fixture(s, d, "fx_pixels"), ["r"], (0, 0, 1), (0, 0, 2), (0, 0, 100, 50), "cubic"), "r"),
    "to_rts_tiles": lambda s, d: _rounded(raster.ingested(fixture(s, d, "fx_pixels"), ["r", "ir"], (0, 0, 1), _scheme(s), 2.0, done=_scheme(s).where("row = 2")), "r", "ir"),
    # registry, definition and change of data
    "tile_queue": lambda s, d: tiles.tile_queue(table(s, d, "tile_reg"), fixture(s, d, "fx_registry"), "spec"),
    "tile_queue_overwrite": lambda s, d: tiles.tile_queue(table(s, d, "tile_reg"), fixture(s, d, "fx_registry"), "spec", True, ["R1C1", "R2C2"]),
    "complete_input": lambda s, d: tiles.missing_tiles(table(s, d, "tile_reg").withColumnsRenamed({"row_no": "row", "col_no": "col"}), fixture(s, d, "fx_registry"), "las", ["R1C1", "R3C3", "R50C50"], buffered=True),
    "has_tiles": lambda s, d: tiles.has_tiles(table(s, d, "tile_reg"), fixture(s, d, "fx_registry"), "geom"),
    "registry_summary": lambda s, d: tiles.registry_summary(fixture(s, d, "fx_registry")),
    "register_tiles": lambda s, d: tiles.register(fixture(s, d, "fx_registry"), table(s, d, "tile_reg").where("row_no = 1"), "las"),
    "tile_neibs_queen": lambda s, d: tiles.neighbour_pairs(*2 * [table(s, d, "tile_reg").withColumnsRenamed({"row_no": "row", "col_no": "col"})]),
    "tile_neibs_rook": lambda s, d: tiles.tile_neighbours(table(s, d, "tile_reg").withColumnsRenamed({"row_no": "row", "col_no": "col"}), ["R3C3", "R1C1"], "rook"),
    "update_data": lambda s, d: tiles.updated(fixture(s, d, "fx_segments"), fixture(s, d, "SELECT poly_id, CAST(n_px * 10 AS BIGINT) AS n_px, poly_id * 2 AS extra FROM fx_segments WHERE tile_name = 'R1C2' AND poly_id % 3 = 0"), "R1C2"),
    "append_geom": lambda s, d: tiles.appended(fixture(s, d, "fx_segments").where("tile_name <> 'R1C1'"), _seg_registry(s, d), fixture(s, d, "SELECT poly_id, minx, miny, maxx, maxy, n_px, 'new' AS note FROM fx_segments WHERE tile_name = 'R1C1'"), "R1C1")[0],
    "append_geom_registry": lambda s, d: tiles.appended(fixture(s, d, "fx_segments").where("tile_name <> 'R1C1'"), _seg_registry(s, d), fixture(s, d, "SELECT poly_id, n_px FROM fx_segments WHERE tile_name = 'none'"), "R1C1")[1],
    "vts_row_count": lambda s, d: tiles.row_counts(table(s, d, "tile_reg"), table(s, d, "seg_vts")),
    "status_summary": _status,
    "add_field": lambda s, d: tiles.add_field(tiles.delete_field(fixture(s, d, "fx_segments"), "n_px"), "note", "int"),
    "zip_chunk_plan": lambda s, d: tiles.chunk_plan(table(s, d, "tile_reg"), 25, "img"),
    # spatial selection
    "read_from_pts": lambda s, d: spatial.read_from_points(fixture(s, d, "fx_treetops"), fixture(s, d, "fx_segments"), "tree_id", ["tile_name", "poly_id", "n_px"], ["tile_name", "poly_id"]),
    "read_from_polys": lambda s, d: spatial.read_from_areas(fixture(s, d, "fx_training_polys"), fixture(s, d, "fx_segments"), "fid", [*SEG, "n_px"]),
    "tile_poly": lambda s, d: spatial.tile_rectangles(fixture(s, d, "fx_training_polys"), _scheme(s), "fid"),
    "poly_to_ras": lambda s, d: spatial.rasterized(fixture(s, d, "fx_segments")),
    "merge_vts": lambda s, d: spatial.merged_by_zone(_zone_sources(s, d), fixture(s, d, "fx_zones"), "zone_name"),
    "final_trees": lambda s, d: canopy.final_trees(_segs_with_class_id(s, d), "class_1", fixture(s, d, "fx_class_table"), fixture(s, d, "fx_zones")),
    "las_coverage": lambda s, d: spatial.uncovered_area(fixture(s, d, "fx_segments"), fixture(s, d, "fx_zones"), 1.0),
    "las_tiles_outside": lambda s, d: points.files_meeting(points.footprints(_local_files(s, d)), (60.0, 0.0, 101.0, 50.0), meet=False),
    "renumber_after": lambda s, d: spatial.renumbered_after(fixture(s, d, "SELECT tile_name, CASE WHEN n_px > 20 THEN poly_id END AS poly_id, n_px, minx, miny FROM fx_segments"), F.col("n_px") > 20, ["minx", "miny"]),
    # lidar
    "read_las_tile": lambda s, d: points.read_tile_points(fixture(s, d, "fx_points"), (20, 20, 40, 40), [2, 3], ["x", "y", "z", "classification"]),
    "distinct_points": lambda s, d: points.distinct_points(fixture(s, d, "fx_points").select("x", "y", "z", "classification")),
    "normalize_las": lambda s, d: points.normalized(fixture(s, d, "fx_points").select("x", "y", "z", "classification"), fixture(s, d, "fx_dem"), 0, 40),
    "las_presence": lambda s, d: points.presence(_files(s, d), ["filename"]),
    "las_grid": lambda s, d: points.footprints(_files(s, d)),
    "las_qc": _qc,
    "noise_filter": lambda s, d: points.remove_noise(points.classify_noise(fixture(s, d, "fx_points").select("x", "y", "z", "classification"), 5.0, 20)),
    "surface_dsm": lambda s, d: points.surface(fixture(s, d, "fx_points"), 1.0),
    "surface_ndsm": lambda s, d: points.surface(points.normalized(fixture(s, d, "fx_points").select("x", "y", "z"), fixture(s, d, "fx_dem"), 0, 40), 1.0, 0.0, fixture(s, d, "fx_pixels")),
    "surface_dem": _dem,
    "surface_dem_plane": _dem_plane,
    "seg_metrics_las_z": lambda s, d: metrics.height_metrics(fixture(s, d, "fx_points_t"), fixture(s, d, "fx_segments"), "las"),
    "seg_metrics_las_rgb": lambda s, d: metrics.colour_metrics(fixture(s, d, "fx_points_t"), fixture(s, d, "fx_segments"), "las"),
    "seg_metrics_las_class": lambda s, d: metrics.class_metrics(fixture(s, d, "fx_points_t"), fixture(s, d, "fx_segments"), "las"),
    # neighbourhoods
    "detect_trees": _trees,
    "canopy_mask": lambda s, d: canopy.canopy_mask(fixture(s, d, "fx_class_cells"), fixture(s, d, "fx_pixels"), [1, 2, 3, 5]),
    "canopy_mask_edits": lambda s, d: canopy.canopy_mask(fixture(s, d, "fx_class_cells"), fixture(s, d, "fx_pixels"), [1, 2, 3, 5], edits=fixture(s, d, "SELECT px, py, CASE WHEN px < 30 THEN 1 ELSE 0 END AS canopy FROM fx_pixels WHERE px BETWEEN 20 AND 40 AND py < 50")),
    "final_canopy": lambda s, d: canopy.final_canopy(fixture(s, d, "fx_class_cells"), fixture(s, d, "fx_class_table"), (10.0, 10.0, 90.0, 60.0), 5.0),
    "hillshade": lambda s, d: raster.hillshade(fixture(s, d, "fx_dem"), "dem"),
    "seg_metrics_tex": lambda s, d: metrics.texture(_pixels(s, d), fixture(s, d, "fx_segments"), "ir", (0, 250), "tex"),
    "detect_trees_by_tile": lambda s, d: segment.treetops(fixture(s, d, "fx_pixels"), lambda h: 1 + h * 0.04, 3, 10, tiles=_scheme(s)),
    "sample_tiles": lambda s, d: spatial.read_from_points(fixture(s, d, "SELECT tree_id, x * 1.1 AS x, y FROM fx_treetops"), _scheme(s).select("tile_name", "core.*"), "tree_id", ["tile_name"], ["tile_name"]),
    "seg_metrics_las": lambda s, d: metrics.las_metrics(fixture(s, d, "fx_points_t"), fixture(s, d, "fx_segments"), "las"),
    "surface_circle": lambda s, d: points.surface(fixture(s, d, "fx_points"), 1.0, algorithm="circle", radius=0.5).withColumn("z", F.col("z").cast("double")),
    "noise_radius": lambda s, d: points.remove_noise(points.classify_noise(fixture(s, d, "fx_points").select("x", "y", "z", "classification"), 2.0, 3, algorithm="radius")),
    # learning
    "classifier_rows": lambda s, d: classify.training_rows(_selected_data(s, d), [1, 3]),
    "monte_carlo_accuracy": lambda s, d: classify.monte_carlo_accuracy(_labelled(s, d).withColumn("row_id", F.xxhash64(*SEG)), ["spec_r", "spec_g", "spec_ir"], {"tree": ["C", "D", "E", "H"], "other": ["B"]}, iterations=3, trees=20, depth=6),
    "training_data_extract": lambda s, d: classify.extracted(_training(s, d), fixture(s, d, "fx_training_polys"), _seg_fid(s, d), ["spec_n"]),
    "training_fids_without_hit": lambda s, d: classify.hit_nothing(_training(s, d), classify.extracted(_training(s, d), fixture(s, d, "fx_training_polys"), _seg_fid(s, d), ["spec_n"]), 1),
    "training_summary": lambda s, d: classify.training_summary(_training(s, d), {"tree": ["C", "D", "H"], "other": ["B"]}),
    "class_edits_fold": lambda s, d: classify.edited(fixture(s, d, "fx_seg_class"), classify.edit_hits(fixture(s, d, "fx_edits"), fixture(s, d, "fx_seg_class"), SEG), SEG).select(*SEG, "seg_class"),
    "accuracy_from_confusion": lambda s, d: _rounded(classify.accuracy(_accuracy_pairs(s, d), CODES), "pcc", "kappa", "sensitivity", "specificity"),
    "class_accuracy": lambda s, d: _rounded(classify.class_accuracy(_accuracy_pairs(s, d), CODES), "users", "producers"),
    "pca_model": _pca,
    "pca_global": _pca_global,
    "pca_model_sums": _pca_sums,
    "pca_global_two_bands": _pca_two_bands,
    "pca_local_two_bands": lambda s, d: _rounded(pca.pca_local(_pixels(s, d), ["b", "ir"]), "pc1", "pc2", digits=5),
    "pca_local": lambda s, d: pca.pca_local(_pixels(s, d), ["r", "g", "b"]),
    "classify_seg_poly": _forest,
    # reports and scalars
    "pie_donut_pie": lambda s, d: _rounded(report.pie(table(s, d, "events"), "event_type"), "start1", "end1", "mid", "ratio", "labelx", "labely"),
    "pie_donut_donut": lambda s, d: _rounded(report.donut(table(s, d, "events").withColumn("kind", F.col("user_id") % 3), "event_type", "kind"), "start1", "end1", "mid", "ratio", "ratio_in_pie", "labelx", "labely"),
    "qgis_frame_to_ext": lambda s, d: table(s, d, "tile_reg").select("tile_name", text.frame_to_extent(F.concat(F.concat_ws(", ", "minx", "miny"), F.lit(" : "), F.concat_ws(", ", "maxx", "maxy"))).alias("e")).select("tile_name", "e.*"),
    "ext_to_las_filt": lambda s, d: table(s, d, "tile_reg").select("tile_name", text.extent_filter(*map(F.col, BOX)).alias("filter")),
    "nice_args": lambda s, d: table(s, d, "events").select("event_id", text.nice_int(F.regexp_extract("props", r"(\d+)", 1)).alias("k"), text.nice_float(F.col("value").cast("string")).alias("v"), text.nice_bool(F.when(F.col("event_type") == "click", F.lit("Yes")).when(F.col("event_type") == "view", F.lit("n")).otherwise(F.col("event_type"))).alias("b"), text.nice_str(F.when(F.col("event_type") == "error", F.lit("NaN")).otherwise(F.col("event_type"))).alias("t")),
    "latest_project": lambda s, d: report.latest_project(table(s, d, "events").groupBy(F.col("event_type").alias("project")).agg(F.min("ts").alias("created"))).select("project"),
    # algorithms by tile
    "segment_watershed": lambda s, d: segment.tile_crowns(fixture(s, d, "fx_pixels"), _trees(s, d).withColumn("tree_id", (F.col("py") * 1000 + F.col("px")).cast("bigint")), _scheme(s)),
    "segment_watershed_trees": lambda s, d: QUERIES["segment_watershed"](s, d).select("tile_name", "tree_id", "height", (F.col("crown_area") >= 1).alias("has_area")),
    "segment_watershed_cover": _crown_cover,
    "segment_mss": lambda s, d: segment.mean_shift_segments(_pixels(s, d), ["r", "g", "b"], 3, 40, 6),
}
QUERIES |= queries_polygons.QUERIES


def _stored(x: str) -> str:
    r = f"round(({x}) * 10000, 4)"
    return f"CASE WHEN ({x}) IS NULL OR isnan({x}) OR abs({r}) > 2147483647 THEN 0 ELSE CAST(trunc({r}) AS INTEGER) END"


def _zonal_sql(layers: dict[str, str], prefix: str = "spec") -> str:
    cols = [(f"{prefix}_{n}_{f}", f"{g}({n})") for n in layers for f, g in (("mean", "avg"), ("sd", "stddev_samp"))]
    return f"""WITH v AS (SELECT tile_name, poly_id, {", ".join(f"{e} AS {n}" for n, e in layers.items())} FROM fx_pixels_t),
a AS (SELECT tile_name, poly_id, {", ".join(f"{e} AS {k}" for k, e in cols)} FROM v GROUP BY tile_name, poly_id)
SELECT s.tile_name, s.poly_id, {", ".join(f"{_stored('a.' + k)} AS {k}" for k, _ in cols)} FROM fx_segments s LEFT JOIN a ON s.tile_name = a.tile_name AND s.poly_id = a.poly_id"""


_USABLE = "SELECT p.* FROM fx_points_t p WHERE poly_id IS NOT NULL AND tile_name IN (SELECT tile_name FROM fx_points_t GROUP BY tile_name HAVING count(*) >= 5)"


def _las_sql(cols: dict[str, str], source: str = "u", extra: str = "") -> str:
    return f"""WITH u AS ({_USABLE}){extra},
a AS (SELECT tile_name, poly_id, {", ".join(f"{e} AS {k}" for k, e in cols.items())} FROM {source} GROUP BY tile_name, poly_id)
SELECT s.tile_name, s.poly_id, {", ".join(f"coalesce({_stored('a.' + k)}, 0) AS las_{k}" for k in cols)} FROM fx_segments s LEFT JOIN a ON s.tile_name = a.tile_name AND s.poly_id = a.poly_id"""


def _z_cols() -> dict[str, str]:
    q = {p: f"quantile_cont(z, {v})" for p, v in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9))}
    out = {"Z_qmn": "sqrt(avg(z * z))", "Z_mn": "avg(z)", "Z_sd": "stddev_samp(z)", "Z_iq": f"{q['p75']} - {q['p25']}", "Z_p50": q["p50"], "Z_p75": q["p75"], "Z_p90": q["p90"]}
    return out | {f"Z_over{t}": f"avg(CASE WHEN z > {t} THEN CAST(1 AS DOUBLE) ELSE 0 END)" for t in (1, 2, 3)}


def _class_cols() -> dict[str, str]:
    out = {"grnd": "avg(CASE WHEN classification = 2 THEN CAST(1 AS DOUBLE) ELSE 0 END)"}
    for t in (0, 1, 2, 3):
        for n, k in (("lvg", "3"), ("hvg", "4, 5"), ("bld", "6")):
            out[n + (f"_over{t}" if t else "")] = f"avg(CASE WHEN classification IN ({k}) THEN CAST(1 AS DOUBLE) ELSE 0 END)" + (f" FILTER (z > {t})" if t else "")
    return out


def _colour_sql() -> str:
    made = {"R": "rr", "G": "gg", "B": "bb", "NGI": "(gg - rr) / (gg + rr)", "NGB": "(gg - bb) / (gg + bb)", "NRB": "(rr - bb) / (rr + bb)", "VAg": "(gg - rr) / (gg + rr - bb + CAST(0.01 AS DOUBLE))", "GLI": "(2 * gg - rr - bb) / (2 * gg + rr + bb)"}
    one = ", ".join(f"CASE WHEN {c} = 0 THEN CAST(1 AS DOUBLE) ELSE CAST({c} AS DOUBLE) END AS {c}{c}" for c in "rgb")
    extra = f""",
w AS (SELECT tile_name, poly_id, z, {one} FROM u),
i AS (SELECT tile_name, poly_id, z, {", ".join(f"CASE WHEN isfinite({e}) THEN {e} END AS v{n}" for n, e in made.items())} FROM w),
q AS (SELECT tile_name, poly_id, quantile_cont(z, 0.5) AS p50, quantile_cont(z, 0.75) AS p75, quantile_cont(z, 0.9) AS p90 FROM u GROUP BY tile_name, poly_id),
j AS (SELECT i.*, p50, p75, p90 FROM i JOIN q ON i.tile_name = q.tile_name AND i.poly_id = q.poly_id)"""
    cols = {}
    for at in ("", "p50", "p75", "p90"):
        f = f" FILTER (z >= {at})" if at else ""
        for n in made:
            k = f"{n}_{at}" if at else n
            for s, g in (("mn", "avg"), ("mx", "max")):
                cols[f"{k}_{s}"] = f"CASE WHEN count(*){f} = count(v{n}){f} THEN {g}(v{n}){f} END"
    return _las_sql(cols, "j", extra)


_TEX = {
    "contrast": "con / t", "dissimilarity": "dis / t", "homogeneity": "hom / t", "ASM": "n2 / (t * t)", "entropy": "ln(t) - nl / t", "mean": "s / t",
    "variance": "ss / t - (s / t) * (s / t)", "correlation": "CASE WHEN round(ss / t - (s / t) * (s / t), 9) <> 0 THEN (sh / t - (s / t) * (s / t)) / (ss / t - (s / t) * (s / t)) END",
}
_TEXTURE = f"""WITH g AS (SELECT tile_name, poly_id, px, py, CAST(least(floor(least(greatest(ir, 0), 250) / 250 * 16), 15) AS INTEGER) AS g FROM fx_pixels_t),
o AS (SELECT 1 AS i, 0 AS j UNION ALL SELECT 1, 1 UNION ALL SELECT 0, 1 UNION ALL SELECT -1, 1),
p AS (SELECT a.tile_name, a.poly_id, a.g AS g, b.g AS h FROM g b JOIN o ON true JOIN g a ON a.tile_name = b.tile_name AND a.poly_id = b.poly_id AND a.px = b.px + o.i AND a.py = b.py + o.j),
n AS (SELECT tile_name, poly_id, g, h, CAST(count(*) AS DOUBLE) AS n FROM (SELECT * FROM p UNION ALL SELECT tile_name, poly_id, h, g FROM p) GROUP BY tile_name, poly_id, g, h),
a AS (SELECT tile_name, poly_id, sum(n) AS t, sum(n * (g - h) * (g - h)) AS con, sum(n * abs(g - h)) AS dis, sum(n / (1 + (g - h) * (g - h))) AS hom, sum(n * n) AS n2, sum(n * ln(n)) AS nl, sum(n * g) AS s, sum(n * g * g) AS ss, sum(n * g * h) AS sh FROM n GROUP BY tile_name, poly_id),
m AS (SELECT tile_name, poly_id, {", ".join(f"{e} AS {k}" for k, e in _TEX.items())} FROM a)
SELECT s.tile_name, s.poly_id, {", ".join(f"{_stored('m.' + k)} AS tex_{k}" for k in _TEX)} FROM fx_segments s LEFT JOIN m ON s.tile_name = m.tile_name AND s.poly_id = m.poly_id"""

_SCHEME = """SELECT tile_name, row_no, col_no, minx - 2 AS ox, miny - 2 AS oy, maxx + 2 AS ox2, maxy + 2 AS oy2,
  CASE col_no WHEN 1 THEN minx - 2 ELSE minx END AS nx, CASE row_no WHEN 1 THEN miny - 2 ELSE miny END AS ny, CASE col_no WHEN 10 THEN maxx + 2 ELSE maxx END AS nx2, CASE row_no WHEN 5 THEN maxy + 2 ELSE maxy END AS ny2 FROM fx_tiles"""
_CENTRE = "CAST(p.px AS DOUBLE) + CAST(0.5 AS DOUBLE)", "CAST(p.py AS DOUBLE) + CAST(0.5 AS DOUBLE)"
_MEET = "a.minx <= b.maxx AND a.maxx >= b.minx AND a.miny <= b.maxy AND a.maxy >= b.miny"
_MASK = "SELECT px, py, CASE WHEN b < 200 THEN CAST(b AS INTEGER) % 2 END AS m FROM fx_pixels WHERE px % 3 <> 0"


_FOLD = f"""WITH e AS (SELECT a.tile_name, a.poly_id, list({{'s': '', 'f': string_split(b.from_class, ' '), 't': b.to_class}} ORDER BY b.seq) AS steps FROM fx_seg_class a JOIN fx_edits b ON {_MEET} GROUP BY a.tile_name, a.poly_id)
SELECT c.tile_name, c.poly_id, CASE WHEN e.steps IS NULL THEN c.seg_class ELSE list_reduce(e.steps, lambda a, x: {{'s': CASE WHEN x.f = [''] OR list_contains(x.f, a.s) THEN x.t ELSE a.s END, 'f': x.f, 't': x.t}}, {{'s': c.seg_class, 'f': [''], 't': ''}}).s END AS seg_class
FROM fx_seg_class c LEFT JOIN e ON e.tile_name = c.tile_name AND e.poly_id = c.poly_id"""
_CANOPY = f"""WITH base AS (SELECT p.px, p.py, CASE WHEN c.class_id IN (1, 2, 3, 5) THEN 1 WHEN c.class_id IS NOT NULL THEN 0 END AS v FROM fx_pixels p LEFT JOIN fx_class_cells c ON p.px = c.px AND p.py = c.py),
off AS (SELECT 0 AS i, 0 AS j UNION ALL SELECT 1, 0 UNION ALL SELECT -1, 0 UNION ALL SELECT 0, 1 UNION ALL SELECT 0, -1),
er AS (SELECT p.px, p.py, min(q.v) AS v FROM base p JOIN off ON true LEFT JOIN base q ON q.px = p.px + i AND q.py = p.py + j GROUP BY p.px, p.py),
di AS (SELECT p.px, p.py, max(q.v) AS v FROM er p JOIN off ON true LEFT JOIN er q ON q.px = p.px + i AND q.py = p.py + j GROUP BY p.px, p.py)"""

_SHADE = """WITH o AS (SELECT 0 AS d UNION ALL SELECT 1 UNION ALL SELECT -1),
z AS (SELECT p.px, p.py, count(*) AS n, sum(CASE WHEN i.d = 1 THEN (CASE WHEN j.d = 0 THEN 2 ELSE 1 END) * q.dem WHEN i.d = -1 THEN -(CASE WHEN j.d = 0 THEN 2 ELSE 1 END) * q.dem ELSE 0 END) / 8 AS gx,
  sum(CASE WHEN j.d = 1 THEN (CASE WHEN i.d = 0 THEN 2 ELSE 1 END) * q.dem WHEN j.d = -1 THEN -(CASE WHEN i.d = 0 THEN 2 ELSE 1 END) * q.dem ELSE 0 END) / 8 AS gy
  FROM fx_dem p JOIN o i ON true JOIN o j ON true JOIN fx_dem q ON q.px = p.px + i.d AND q.py = p.py + j.d GROUP BY p.px, p.py)
SELECT px, py, CAST(floor(greatest((cos(radians(45)) - gx * sin(radians(45)) * sin(radians(315)) - gy * sin(radians(45)) * cos(radians(315))) / sqrt(1 + gx * gx + gy * gy), 0) * 255 + CAST(0.5 AS DOUBLE)) AS INTEGER) AS shade FROM z WHERE n = 9"""

_SEG_FID = "SELECT CAST(trunc(minx / 5 + 1000 * (miny / 5)) AS INTEGER) AS fid, minx, miny, maxx, maxy, n_px AS spec_n FROM fx_segments"
_EXTRACT = f"""WITH b AS ({_SEG_FID}),
pol AS (SELECT 2 AS type, a.training_set, a.fid AS training_fid, a.seg_class, b.spec_n, b.fid FROM fx_training_polys a JOIN b ON {_MEET}),
pts AS (SELECT 1 AS type, a.training_set, a.fid AS training_fid, a.seg_class, b.spec_n, b.fid FROM fx_training a JOIN b ON a.x BETWEEN b.minx AND b.maxx AND a.y BETWEEN b.miny AND b.maxy QUALIFY row_number() OVER (PARTITION BY a.fid ORDER BY b.fid) = 1),
ex AS (SELECT fid, type, training_set, training_fid, seg_class, spec_n FROM (SELECT * FROM pol UNION ALL SELECT * FROM pts) QUALIFY row_number() OVER (PARTITION BY fid ORDER BY type DESC, training_fid) = 1)"""
_PAIRS = "SELECT seg_class AS observed, CASE (poly_id + CASE WHEN poly_id % 3 = 0 THEN 1 ELSE 0 END) % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'D' WHEN 2 THEN 'E' WHEN 3 THEN 'B' ELSE 'H' END AS elected FROM fx_seg_class"
_MARGIN = f"""WITH k AS ({_PAIRS}), c AS (SELECT unnest(['C', 'D', 'E', 'B', 'H']) AS seg_class),
m AS (SELECT c.seg_class, CAST((SELECT count(*) FROM k WHERE observed = c.seg_class) AS DOUBLE) AS obs, CAST((SELECT count(*) FROM k WHERE elected = c.seg_class) AS DOUBLE) AS ele, CAST((SELECT count(*) FROM k WHERE elected = c.seg_class AND observed = c.seg_class) AS DOUBLE) AS hit, CAST((SELECT count(*) FROM k) AS DOUBLE) AS total FROM c)"""
_PLACE = "round({r} * sin(mid), 6) AS labelx, round({r} * cos(mid), 6) AS labely, CASE WHEN mid - floor(mid / (2 * pi())) * 2 * pi() > pi() THEN 1 ELSE 0 END AS hjust, CASE WHEN mid - floor(mid / (2 * pi())) * 2 * pi() < pi() / 2 OR mid - floor(mid / (2 * pi())) * 2 * pi() > pi() * 3 / 2 THEN 0 ELSE 1 END AS vjust"
_FILES = "SELECT concat('f', CAST(b % 16 AS VARCHAR)) AS filename, x, y, z, classification, r, g, b FROM fx_points"
_NAME = "concat('R', CAST(CAST(floor(y / 20) AS INTEGER) + 1 AS VARCHAR), 'C', CAST(CAST(floor(x / 20) AS INTEGER) + 1 AS VARCHAR)) AS tile_name"
_CLASS_1 = "SELECT tile_name, poly_id, minx, miny, maxx, maxy, CAST(n_px AS DOUBLE) AS height, CAST(n_px * 2 AS DOUBLE) AS crown_area, CASE WHEN poly_id % 7 <> 0 THEN poly_id % 6 END AS class_1 FROM fx_segments"
_NORM = "SELECT p.*, p.z - d.dem AS zz, d.px, d.py FROM fx_points p JOIN fx_dem d ON CAST(floor(p.x) AS INTEGER) = d.px AND CAST(floor(p.y) AS INTEGER) = d.py WHERE p.z - d.dem > 0 AND p.z - d.dem <= 40"

_CUBIC = "CASE WHEN {d} < 1 THEN (CAST(1.5 AS DOUBLE) * {d} - CAST(2.5 AS DOUBLE)) * {d} * {d} + 1 WHEN {d} < 2 THEN ((CAST(-0.5 AS DOUBLE) * {d} + CAST(2.5 AS DOUBLE)) * {d} - 4) * {d} + 2 ELSE 0 END"


def _two_bands(by: str) -> str:
    """Components of two bands in closed form, by tile or over all."""
    group, on = (f"GROUP BY {by}", f"USING ({by})") if by else ("", "ON true")
    key = f"{by}, " if by else ""
    return f"""WITH m AS (SELECT {key}avg(b) AS mx, avg(ir) AS mz, var_samp(b) AS a, covar_samp(b, ir) AS b, var_samp(ir) AS c FROM fx_pixels_t {group}),
l AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS big FROM m),
u AS (SELECT *, CASE WHEN a >= c THEN big - c ELSE b END AS ux, CASE WHEN a >= c THEN b ELSE big - a END AS uz FROM l),
n AS (SELECT *, CASE WHEN abs(ux) >= abs(uz) THEN sign(ux) ELSE sign(uz) END * sqrt(ux * ux + uz * uz) AS len, CASE WHEN abs(ux) >= abs(uz) THEN sign(ux) ELSE -sign(uz) END * sqrt(ux * ux + uz * uz) AS len2 FROM u)
SELECT p.tile_name, p.px, p.py, round(((p.b - mx) * ux + (p.ir - mz) * uz) / len, 5) AS pc1, round(((p.ir - mz) * ux - (p.b - mx) * uz) / len2, 5) AS pc2 FROM fx_pixels_t p JOIN n {on}"""


_TOPS = "SELECT p.px, p.py, p.chm AS height FROM fx_pixels p WHERE p.chm >= 10 AND NOT EXISTS (SELECT 1 FROM fx_pixels q WHERE q.px BETWEEN p.px - 3 AND p.px + 3 AND q.py BETWEEN p.py - 3 AND p.py + 3 AND (p.px - q.px) * (p.px - q.px) + (p.py - q.py) * (p.py - q.py) <= least(1 + p.chm * CAST(0.04 AS DOUBLE), 3) * least(1 + p.chm * CAST(0.04 AS DOUBLE), 3) AND q.chm > p.chm)"

_SQL = {
    "seg_metrics_spec_ir": _zonal_sql({"r": "r", "ir": "ir", "NDVI": "(ir - r) / (ir + r)", "EVI2": "(ir - r) / (ir + CAST(2.4 AS DOUBLE) * r + 1)", "MSAVI2": "(2 * ir + 1 - sqrt((2 * ir + 1) * (2 * ir + 1) - 8 * (ir - r))) / 2", "SAVI": "CAST(1.5 AS DOUBLE) * (ir - r) / (ir + r + CAST(0.5 AS DOUBLE))"}),
    "seg_metrics_spec_rgb": _zonal_sql({"GLI": "(2 * g - r - b + CAST(0.01 AS DOUBLE)) / (2 * g + r + b + CAST(0.01 AS DOUBLE))", "VARI": "(g - r) / (g + r - b + CAST(0.01 AS DOUBLE))", "NGRDI": "(g - r) / (g + r)", "NGBDI": "(g - b) / (g + b)", "NRBDI": "(r - b) / (r + b)"}),
    "read_tile": "SELECT poly_id, n_px FROM fx_segments WHERE tile_name = 'R2C3'",
    "ras_diff": "SELECT t.tile_name, t.px, t.py, t.chm - d.dem AS z FROM fx_pixels_t t JOIN fx_dem d ON t.px = d.px AND t.py = d.py",
    "pseudo_img": "SELECT tile_name, px, py, CAST(floor(least(greatest(r, 0), 255)) AS INTEGER) AS red, CAST(floor((least(greatest(chm, 5), 45) - 5) / 40 * 254) AS INTEGER) AS height, CAST(floor(least(greatest(b, 0), 255) / 255 * 254) AS INTEGER) AS gap FROM fx_pixels_t",
    "mask_rts": f"SELECT p.tile_name, p.px, p.py, CASE WHEN m.m <> 1 THEN NULL ELSE p.r END AS r FROM fx_pixels_t p LEFT JOIN ({_MASK}) m ON p.px = m.px AND p.py = m.py",
    "mask_rts_na": f"SELECT p.tile_name, p.px, p.py, CASE WHEN m.m = 1 THEN p.r END AS r FROM fx_pixels_t p LEFT JOIN ({_MASK}) m ON p.px = m.px AND p.py = m.py",
    "reclass_binary": "SELECT tile_name, px, py, CASE WHEN class_id IN (1, 2, 5) THEN 1 ELSE 0 END AS canopy, CASE WHEN class_id IN (1, 2, 5) THEN 1 END AS final FROM fx_class_cells",
    "classify_seg_ras": f"SELECT p.tile_name, p.px, p.py, p.poly_id, s.class_1 FROM fx_pixels_t p LEFT JOIN ({_CLASS_1}) s ON p.tile_name = s.tile_name AND p.poly_id = s.poly_id",
    "cover": "SELECT tile_name, px, py, CASE WHEN b <> 0 THEN b ELSE r END AS v, CASE WHEN b <> r THEN b ELSE 0 END AS filled FROM fx_pixels_t",
    "overview": "SELECT CAST(floor(px / 4) AS INTEGER) AS px, CAST(floor(py / 4) AS INTEGER) AS py, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(ir), 6) AS ir FROM fx_pixels GROUP BY CAST(floor(px / 4) AS INTEGER), CAST(floor(py / 4) AS INTEGER)",
    "mosaic_tiles": "SELECT px, py, r, chm FROM fx_pixels",
    "crop_buffs": f"WITH t AS ({_SCHEME}) SELECT t.tile_name, p.px, p.py, p.r FROM fx_pixels p JOIN t ON {_CENTRE[0]} >= ox AND {_CENTRE[0]} < ox2 AND {_CENTRE[1]} >= oy AND {_CENTRE[1]} < oy2",
    "band_range": " UNION ALL ".join(f"SELECT '{b}' AS band, min({b}) AS min, max({b}) AS max FROM fx_pixels" for b in ("r", "g", "b", "ir", "chm")),
    "to_rts": """WITH w AS (SELECT t.px, t.py, p.r, p.ir, greatest(1 - abs((2 * t.px + 1) - (p.px + CAST(0.5 AS DOUBLE))), 0) * greatest(1 - abs((2 * t.py + 1) - (p.py + CAST(0.5 AS DOUBLE))), 0) AS w
FROM (SELECT CAST(a.range AS INTEGER) AS px, CAST(b.range AS INTEGER) AS py FROM range(100) a, range(50) b) t JOIN fx_pixels p ON p.px BETWEEN 2 * t.px AND 2 * t.px + 1 AND p.py BETWEEN 2 * t.py AND 2 * t.py + 1)
SELECT px, py, round(sum(r * w) / sum(w), 6) AS r, round(sum(ir * w) / sum(w), 6) AS ir FROM w WHERE w > 0 GROUP BY px, py""",
    "to_rts_tiles": f"""WITH t AS ({_SCHEME}), w AS (SELECT c.px, c.py, p.r, p.ir, greatest(1 - abs((2 * c.px + 1) - (p.px + CAST(0.5 AS DOUBLE))), 0) * greatest(1 - abs((2 * c.py + 1) - (p.py + CAST(0.5 AS DOUBLE))), 0) AS w
FROM (SELECT CAST(a.range AS INTEGER) AS px, CAST(b.range AS INTEGER) AS py FROM range(-1, 101) a, range(-1, 51) b) c JOIN fx_pixels p ON p.px BETWEEN 2 * c.px AND 2 * c.px + 1 AND p.py BETWEEN 2 * c.py AND 2 * c.py + 1),
v AS (SELECT px, py, round(sum(r * w) / sum(w), 6) AS r, round(sum(ir * w) / sum(w), 6) AS ir FROM w WHERE w > 0 GROUP BY px, py)
SELECT t.tile_name, v.px, v.py, v.r, v.ir FROM v JOIN t ON 2 * v.px + 1 >= ox AND 2 * v.px + 1 < ox2 AND 2 * v.py + 1 >= oy AND 2 * v.py + 1 < oy2 WHERE t.row_no <> 2""",
    "to_rts_cubic": f"""WITH d AS (SELECT t.px, t.py, p.r, abs((2 * t.px + 1) - (p.px + CAST(0.5 AS DOUBLE))) AS dx, abs((2 * t.py + 1) - (p.py + CAST(0.5 AS DOUBLE))) AS dy
FROM (SELECT CAST(a.range AS INTEGER) AS px, CAST(b.range AS INTEGER) AS py FROM range(100) a, range(50) b) t JOIN fx_pixels p ON p.px BETWEEN 2 * t.px - 1 AND 2 * t.px + 2 AND p.py BETWEEN 2 * t.py - 1 AND 2 * t.py + 2),
w AS (SELECT px, py, r, ({_CUBIC.format(d="dx")}) * ({_CUBIC.format(d="dy")}) AS w FROM d)
SELECT px, py, round(sum(r * w) / sum(w), 6) AS r FROM w WHERE w <> 0 GROUP BY px, py""",
    "tile_queue": "SELECT tile_name FROM tile_reg WHERE NOT spec",
    "tile_queue_overwrite": "SELECT tile_name FROM tile_reg WHERE tile_name IN ('R1C1', 'R2C2')",
    "complete_input": "SELECT DISTINCT n.tile_name FROM tile_reg t JOIN tile_reg n ON abs(t.row_no - n.row_no) <= 1 AND abs(t.col_no - n.col_no) <= 1 WHERE t.tile_name IN ('R1C1', 'R3C3', 'R50C50') AND NOT n.las",
    "has_tiles": "SELECT tile_name, geom AS done FROM tile_reg",
    "registry_summary": "SELECT attribute, count(*) FILTER (done) AS done, count(*) FILTER (NOT done) AS missing FROM fx_registry GROUP BY attribute",
    "register_tiles": "SELECT r.tile_name, r.attribute, r.done OR (r.attribute = 'las' AND t.row_no = 1) AS done FROM fx_registry r JOIN tile_reg t ON r.tile_name = t.tile_name",
    "tile_neibs_queen": "SELECT t.tile_name, n.tile_name AS neighbour FROM tile_reg t JOIN tile_reg n ON n.row_no BETWEEN t.row_no - 1 AND t.row_no + 1 AND n.col_no BETWEEN t.col_no - 1 AND t.col_no + 1",
    "tile_neibs_rook": "SELECT DISTINCT n.tile_name FROM tile_reg t JOIN tile_reg n ON abs(t.row_no - n.row_no) + abs(t.col_no - n.col_no) <= 1 WHERE t.tile_name IN ('R3C3', 'R1C1')",
    "update_data": "SELECT tile_name, poly_id, minx, miny, maxx, maxy, CASE WHEN tile_name <> 'R1C2' THEN n_px WHEN poly_id % 3 = 0 THEN n_px * 10 END AS n_px, CASE WHEN tile_name = 'R1C2' AND poly_id % 3 = 0 THEN poly_id * 2 END AS extra FROM fx_segments",
    "append_geom": "SELECT tile_name, poly_id, minx, miny, maxx, maxy, n_px, CASE WHEN tile_name = 'R1C1' THEN 'new' END AS note FROM fx_segments",
    "append_geom_registry": "SELECT DISTINCT tile_name, 'geom' AS attribute, true AS done FROM fx_segments",
    "vts_row_count": "SELECT t.tile_name, count(s.tile_name) AS n FROM tile_reg t LEFT JOIN seg_vts s ON t.tile_name = s.tile_name GROUP BY t.tile_name",
    "status_summary": "SELECT CASE WHEN row_no % 9 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN row_no % 9 = 0 THEN 'no data' END AS message, count(*) AS tiles, string_agg(tile_name, ',' ORDER BY tile_name) AS names FROM tile_reg GROUP BY 1, 2",
    "add_field": "SELECT tile_name, poly_id, minx, miny, maxx, maxy, CAST(NULL AS INTEGER) AS note FROM fx_segments",
    "zip_chunk_plan": "WITH c AS (SELECT tile_name, CAST(ceil(row_number() OVER (ORDER BY tile_name) / 25) AS INTEGER) AS chunk, CAST(ceil(count(*) OVER () / 25) AS INTEGER) AS of FROM tile_reg) SELECT tile_name, chunk, concat('img', CAST(chunk AS VARCHAR), 'of', CAST(of AS VARCHAR), '.zip') AS archive FROM c",
    "read_from_pts": "SELECT t.tree_id, s.tile_name, s.poly_id, s.n_px FROM fx_treetops t LEFT JOIN fx_segments s ON t.x BETWEEN s.minx AND s.maxx AND t.y BETWEEN s.miny AND s.maxy QUALIFY row_number() OVER (PARTITION BY t.tree_id ORDER BY s.tile_name, s.poly_id) = 1",
    "read_from_polys": f"SELECT a.fid, b.tile_name, b.poly_id, b.n_px FROM fx_training_polys a JOIN fx_segments b ON {_MEET}",
    "tile_poly": f"""WITH t AS ({_SCHEME}),
whole AS (SELECT DISTINCT p.fid, p.minx, p.miny, p.maxx, p.maxy FROM fx_training_polys p JOIN t ON p.minx >= ox AND p.miny >= oy AND p.maxx <= ox2 AND p.maxy <= oy2),
cut AS (SELECT p.fid, greatest(p.minx, nx) AS minx, greatest(p.miny, ny) AS miny, least(p.maxx, nx2) AS maxx, least(p.maxy, ny2) AS maxy FROM fx_training_polys p JOIN t ON greatest(p.minx, nx) < least(p.maxx, nx2) AND greatest(p.miny, ny) < least(p.maxy, ny2) WHERE p.fid NOT IN (SELECT fid FROM whole)),
piece AS (SELECT * FROM whole UNION ALL SELECT * FROM cut)
SELECT t.tile_name, fid, minx, miny, maxx, maxy, CAST(row_number() OVER (PARTITION BY t.tile_name ORDER BY fid, minx, miny, maxx, maxy) AS INTEGER) AS poly_id FROM piece JOIN t ON (minx + maxx) / 2 >= nx AND (minx + maxx) / 2 < nx2 AND (miny + maxy) / 2 >= ny AND (miny + maxy) / 2 < ny2""",
    "poly_to_ras": "SELECT tile_name, px, py, min(poly_id) AS poly_id FROM (SELECT tile_name, poly_id, px, unnest(range(CAST(miny AS INTEGER), CAST(maxy AS INTEGER)))::INTEGER AS py FROM (SELECT *, unnest(range(CAST(minx AS INTEGER), CAST(maxx AS INTEGER)))::INTEGER AS px FROM fx_segments)) GROUP BY tile_name, px, py",
    "merge_vts": f"""WITH f AS (SELECT 'west' AS zone_name, tree_id AS fid, x, y, height, CAST(NULL AS VARCHAR) AS seg_class, {_NAME} FROM fx_treetops WHERE x <= 60
UNION ALL SELECT 'east', fid, x, y, NULL, seg_class, {_NAME} FROM fx_training WHERE x >= 140
UNION ALL SELECT '<none>', tree_id, x, y, height, NULL, {_NAME} FROM fx_treetops WHERE x > 60 AND x < 140)
SELECT *, CAST(row_number() OVER (PARTITION BY tile_name ORDER BY zone_name, fid) AS INTEGER) AS poly_id FROM f""",
    "final_trees": f"WITH a AS ({_CLASS_1}) SELECT DISTINCT a.tile_name, a.poly_id, a.height, a.crown_area, c.label AS class FROM a JOIN fx_class_table c ON a.class_1 = c.id JOIN fx_zones b ON {_MEET}",
    "las_coverage": f"""WITH c AS (SELECT x.range + CAST(0.5 AS DOUBLE) AS x, y.range + CAST(0.5 AS DOUBLE) AS y FROM range(200) x, range(100) y), inside AS (SELECT c.x, c.y FROM c JOIN fx_zones z ON x >= z.minx AND x < z.maxx AND y >= z.miny AND y < z.maxy)
SELECT CAST(count(*) AS DOUBLE) AS area FROM inside i WHERE NOT EXISTS (SELECT 1 FROM fx_segments s WHERE i.x >= s.minx AND i.x < s.maxx AND i.y >= s.miny AND i.y < s.maxy)""",
    "las_tiles_outside": "SELECT concat('x', CAST(CAST(floor(x / 25) AS INTEGER) AS VARCHAR)) AS filename, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, count(*) AS n FROM fx_points GROUP BY 1 HAVING max(x) < 60 OR min(x) > 101 OR min(y) > 50",
    "renumber_after": """WITH s AS (SELECT tile_name, CASE WHEN n_px > 20 THEN poly_id END AS poly_id, n_px, minx, miny FROM fx_segments)
SELECT tile_name, CAST(CASE WHEN n_px > 20 THEN poly_id ELSE coalesce(max(poly_id) OVER (PARTITION BY tile_name), 0) + row_number() OVER (PARTITION BY tile_name, n_px > 20 ORDER BY minx, miny) END AS INTEGER) AS poly_id, n_px, minx, miny FROM s""",
    "read_las_tile": "SELECT x, y, z, classification FROM fx_points WHERE x BETWEEN 20 AND 40 AND y BETWEEN 20 AND 40 AND classification IN (2, 3)",
    "distinct_points": "SELECT x, y, z, min(classification) AS classification FROM fx_points GROUP BY x, y, z",
    "normalize_las": f"SELECT x, y, zz AS z, classification, px, py FROM ({_NORM})",
    "las_presence": f"SELECT filename, bool_or(classification = 2) AS is_ground, bool_or(classification IN (3, 4, 5, 6)) AS is_full, bool_or(greatest(r, g, b) > 0) AS is_rgb FROM ({_FILES}) GROUP BY filename",
    "las_grid": f"SELECT filename, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, count(*) AS n FROM ({_FILES}) GROUP BY filename",
    "las_qc": f"""WITH p AS ({_FILES}), f AS (SELECT filename, count(*) AS size FROM p GROUP BY filename),
s AS (SELECT filename, CASE filename WHEN 'f1' THEN 'Valid' WHEN 'f2' THEN 'bad header' ELSE CASE WHEN size % 2 = 0 THEN 'Valid' ELSE 'truncated' END END AS status FROM f)
SELECT filename AS biggest, bool_or(greatest(r, g, b) > 0) AS has_rgb, {", ".join(f"bool_or(classification = {n}) AS has_{k.lower().replace(' ', '_')}" for k, n in points.CLASSES.items())},
(SELECT count(*) FROM s) AS files, (SELECT count(*) FROM s WHERE status <> 'Valid') AS invalid FROM p WHERE filename = (SELECT filename FROM f ORDER BY size DESC, filename DESC LIMIT 1) GROUP BY filename""",
    "noise_filter": """WITH v AS (SELECT x, y, z, classification, CAST(floor(x / 5) AS BIGINT) AS vx, CAST(floor(y / 5) AS BIGINT) AS vy, CAST(floor(z / 5) AS BIGINT) AS vz FROM fx_points),
n AS (SELECT vx, vy, vz, count(*) AS n FROM v GROUP BY vx, vy, vz), o AS (SELECT unnest([-1, 0, 1]) AS d),
a AS (SELECT p.vx, p.vy, p.vz, sum(q.n) AS n FROM n p JOIN o i ON true JOIN o j ON true JOIN o k ON true JOIN n q ON q.vx = p.vx + i.d AND q.vy = p.vy + j.d AND q.vz = p.vz + k.d GROUP BY p.vx, p.vy, p.vz)
SELECT x, y, z, classification FROM v JOIN a ON v.vx = a.vx AND v.vy = a.vy AND v.vz = a.vz WHERE a.n - 1 > 20 AND classification <> 7""",
    "surface_dsm": "SELECT CAST(floor(x) AS INTEGER) AS px, CAST(floor(y) AS INTEGER) AS py, max(z) AS z FROM fx_points GROUP BY CAST(floor(x) AS INTEGER), CAST(floor(y) AS INTEGER)",
    "surface_ndsm": f"SELECT p.px, p.py, coalesce(s.z, 0) AS z FROM fx_pixels p LEFT JOIN (SELECT px, py, max(zz) AS z FROM ({_NORM}) GROUP BY px, py) s ON p.px = s.px AND p.py = s.py",
    "seg_metrics_las_z": _las_sql(_z_cols()),
    "seg_metrics_las_rgb": _colour_sql(),
    "seg_metrics_las_class": _las_sql(_class_cols()),
    "detect_trees_by_tile": f"WITH t AS ({_SCHEME}), tops AS ({_TOPS}) SELECT t.tile_name, p.px, p.py, p.height FROM tops p JOIN t ON {_CENTRE[0]} >= nx AND {_CENTRE[0]} < nx2 AND {_CENTRE[1]} >= ny AND {_CENTRE[1]} < ny2",
    "sample_tiles": "SELECT p.tree_id, min(t.tile_name) AS tile_name FROM fx_treetops p LEFT JOIN fx_tiles t ON p.x * CAST(1.1 AS DOUBLE) BETWEEN t.minx AND t.maxx AND p.y BETWEEN t.miny AND t.maxy GROUP BY p.tree_id",
    "surface_circle": """WITH o AS (SELECT CAST(0 AS DOUBLE) AS dx, CAST(0 AS DOUBLE) AS dy UNION ALL SELECT CAST(0.5 AS DOUBLE) * cos(k * pi() / 4), CAST(0.5 AS DOUBLE) * sin(k * pi() / 4) FROM (SELECT unnest(range(8)) AS k))
SELECT CAST(floor(x + dx) AS INTEGER) AS px, CAST(floor(y + dy) AS INTEGER) AS py, max(z) AS z FROM fx_points JOIN o ON true GROUP BY 1, 2""",
    "noise_radius": """WITH p AS (SELECT x, y, z, min(classification) AS c0, count(*) AS n FROM fx_points GROUP BY x, y, z),
k AS (SELECT *, CAST(floor(x / 2) AS BIGINT) AS cx, CAST(floor(y / 2) AS BIGINT) AS cy, CAST(floor(z / 2) AS BIGINT) AS cz FROM p), o AS (SELECT unnest([-1, 0, 1]) AS d),
a AS (SELECT p.x, p.y, p.z, sum(q.n) - 1 AS others FROM k p JOIN o i ON true JOIN o j ON true JOIN o h ON true JOIN k q ON q.cx = p.cx + i.d AND q.cy = p.cy + j.d AND q.cz = p.cz + h.d WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) <= 4 GROUP BY p.x, p.y, p.z)
SELECT f.x, f.y, f.z, f.classification FROM fx_points f JOIN a ON f.x = a.x AND f.y = a.y AND f.z = a.z WHERE a.others > 3 AND f.classification <> 7""",
    "classifier_rows": "SELECT seg_class, spec_mean_r, spec_mean_g, spec_ndvi FROM training_data WHERE training_set IN (1, 3) AND seg_class IS NOT NULL AND spec_mean_r IS NOT NULL AND spec_mean_g IS NOT NULL AND spec_ndvi IS NOT NULL",
    "detect_trees": _TOPS,
    "canopy_mask": _CANOPY + " SELECT px, py, nullif(v, 0) AS canopy FROM di",
    "canopy_mask_edits": _CANOPY + " SELECT px, py, nullif(CASE WHEN px BETWEEN 20 AND 40 AND py < 50 THEN CASE WHEN px < 30 THEN 1 ELSE 0 END ELSE v END, 0) AS canopy FROM di",
    "final_canopy": f"SELECT DISTINCT p.px, p.py, 1 AS canopy FROM fx_class_cells p WHERE class_id IN (1, 2, 3, 5) AND {_CENTRE[0]} BETWEEN 5 AND 95 AND {_CENTRE[1]} BETWEEN 5 AND 65",
    "hillshade": _SHADE,
    "seg_metrics_tex": _TEXTURE,
    "training_data_extract": _EXTRACT + " SELECT fid, type, training_set, training_fid, seg_class, spec_n FROM ex",
    "training_fids_without_hit": _EXTRACT + " SELECT fid AS training_fid FROM fx_training WHERE fid NOT IN (SELECT training_fid FROM ex WHERE type = 1)",
    "training_summary": "SELECT CASE WHEN seg_class IN ('C', 'D', 'H') THEN 'tree' WHEN seg_class = 'B' THEN 'other' ELSE seg_class END AS seg_class, count(*) AS n FROM fx_training GROUP BY 1",
    "class_edits_fold": _FOLD,
    "accuracy_from_confusion": _MARGIN + " SELECT round(sum(hit) / max(total), 6) AS pcc, round((sum(hit) / max(total) - sum(obs * ele) / (max(total) * max(total))) / (1 - sum(obs * ele) / (max(total) * max(total))), 6) AS kappa, round(avg(hit / nullif(obs, 0)), 6) AS sensitivity, round(avg((total - obs - ele + hit) / nullif(total - obs, 0)), 6) AS specificity FROM m",
    "class_accuracy": _MARGIN + " SELECT seg_class, round(hit / nullif(ele, 0), 6) AS users, round(hit / nullif(obs, 0), 6) AS producers FROM m",
    "pca_model_sums": """WITH v AS (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding) AS x FROM embeddings), c AS (SELECT vec_id, k, x - avg(CAST(x AS DOUBLE)) OVER (PARTITION BY k) AS x FROM v),
q AS (SELECT a.k AS i, b.k AS j, sum(a.x * b.x) / ((SELECT count(*) FROM embeddings) - 1) AS cov FROM c a JOIN c b USING (vec_id) GROUP BY a.k, b.k)
SELECT round(sum(CASE WHEN i = j THEN cov ELSE 0 END), 8) AS total, round(sum(cov * cov), 8) AS squares FROM q""",
    "pca_global_two_bands": _two_bands(""),
    "pca_local_two_bands": _two_bands("tile_name"),
    "surface_dem_plane": "SELECT tile_name, px, py, true AS on_plane FROM fx_pixels_t",
    "segment_watershed_trees": f"WITH t AS ({_SCHEME}), tops AS ({_TOPS}) SELECT t.tile_name, CAST(p.py * 1000 + p.px AS BIGINT) AS tree_id, p.height, true AS has_area FROM tops p JOIN t ON {_CENTRE[0]} >= nx AND {_CENTRE[0]} < nx2 AND {_CENTRE[1]} >= ny AND {_CENTRE[1]} < ny2",
    "segment_watershed_cover": f"""WITH RECURSIVE t AS ({_SCHEME}), tops AS ({_TOPS}),
c AS (SELECT t.tile_name, p.px, p.py FROM fx_pixels p JOIN t ON {_CENTRE[0]} >= ox AND {_CENTRE[0]} < ox2 AND {_CENTRE[1]} >= oy AND {_CENTRE[1]} < oy2 WHERE p.chm >= CAST(0.3 AS DOUBLE)),
reach AS (SELECT c.tile_name, c.px, c.py FROM c JOIN tops p ON p.px = c.px AND p.py = c.py
  UNION SELECT c.tile_name, c.px, c.py FROM reach r JOIN c ON c.tile_name = r.tile_name AND abs(c.px - r.px) + abs(c.py - r.py) = 1)
SELECT tile_name, count(*) AS cells FROM reach GROUP BY tile_name""",
    "pie_donut_pie": f"""WITH f AS (SELECT event_type, count(*) AS freq FROM events GROUP BY event_type),
e AS (SELECT *, sum(freq) OVER (ORDER BY event_type) AS upto, sum(freq) OVER () AS total FROM f),
c AS (SELECT event_type, CAST(freq AS BIGINT) AS freq, (upto - freq) * 2 * pi() / total AS start1, upto * 2 * pi() / total AS end1, ((upto - freq) * 2 * pi() / total + upto * 2 * pi() / total) / 2 AS mid, freq / total AS ratio FROM e)
SELECT event_type, freq, round(start1, 6) AS start1, round(end1, 6) AS end1, round(mid, 6) AS mid, round(ratio, 6) AS ratio, CASE WHEN ratio >= CAST(0.02 AS DOUBLE) THEN concat(event_type, chr(10), '(', printf('%.1f', round(ratio * 100, 1)), '%)') ELSE event_type END AS label, {_PLACE.format(r="CAST(0.65 AS DOUBLE)")} FROM c""",
    "pie_donut_donut": f"""WITH v AS (SELECT event_type, user_id % 3 AS kind FROM events), f AS (SELECT event_type, kind, count(*) AS freq FROM v GROUP BY event_type, kind),
g AS (SELECT p.event_type, k.kind, CAST(coalesce(f.freq, 0) AS BIGINT) AS freq FROM (SELECT DISTINCT event_type FROM f) p CROSS JOIN (SELECT DISTINCT kind FROM f) k LEFT JOIN f ON f.event_type = p.event_type AND f.kind = k.kind),
e AS (SELECT *, sum(freq) OVER (ORDER BY event_type, kind) AS upto, sum(freq) OVER () AS total, CAST(sum(freq) OVER (PARTITION BY event_type) AS BIGINT) AS of_pie FROM g),
c AS (SELECT event_type, kind, freq, of_pie, (upto - freq) * 2 * pi() / total AS start1, upto * 2 * pi() / total AS end1, ((upto - freq) * 2 * pi() / total + upto * 2 * pi() / total) / 2 AS mid, freq / total AS ratio, freq / of_pie AS ratio_in_pie FROM e)
SELECT event_type, kind, freq, of_pie, round(start1, 6) AS start1, round(end1, 6) AS end1, round(mid, 6) AS mid, round(ratio, 6) AS ratio, round(ratio_in_pie, 6) AS ratio_in_pie, CASE WHEN ratio < CAST(0.02 AS DOUBLE) THEN '' ELSE concat(CAST(kind AS VARCHAR), chr(10), '(', printf('%.1f', round(ratio_in_pie * 100, 1)), '%)') END AS label, {_PLACE.format(r="CAST(1.1 AS DOUBLE)")} FROM c""",
    "qgis_frame_to_ext": "SELECT tile_name, minx, maxx, miny, maxy FROM tile_reg",
    "ext_to_las_filt": "SELECT tile_name, concat('-keep_xy ', CAST(minx AS VARCHAR), ' ', CAST(miny AS VARCHAR), ' ', CAST(maxx AS VARCHAR), ' ', CAST(maxy AS VARCHAR)) AS filter FROM tile_reg",
    "nice_args": "SELECT event_id, TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k, value AS v, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS b, CASE WHEN event_type <> 'error' THEN event_type END AS t FROM events",
    "latest_project": "SELECT event_type AS project FROM events GROUP BY event_type ORDER BY min(ts) DESC, event_type DESC LIMIT 1",
}

_SQL["seg_metrics_las"] = f"SELECT * FROM ({_SQL['seg_metrics_las_z']}) JOIN ({_SQL['seg_metrics_las_rgb']}) USING (tile_name, poly_id) JOIN ({_SQL['seg_metrics_las_class']}) USING (tile_name, poly_id)"

ORACLE = {k: expanded(v) for k, v in _SQL.items()} | queries_polygons.ORACLE
