"""Spatial selection on points, rectangles and polygons with equi-joins on grid cells.

Rectangles are ``minx``, ``miny``, ``maxx``, ``maxy``; a table that also has the
columns ``xs``, ``ys``, ``ends`` of :func:`proximity.with_rings` holds polygons
with these bounds. Candidates meet by their bounds, then polygons are tested
exactly in numpy. Predicates are closed: touching counts, unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geometry import Rings, clip, meet, parts
from tilewright.operators.proximity import _cell, _levels, points_in_rings, region_candidates
from tilewright.plans.rank import ranked
from tilewright.plans.skew import split_join
from tilewright.plans.stage import materialize

_BOX = ("minx", "miny", "maxx", "maxy")
_RINGS = ("xs", "ys", "ends")


def boxes_meet(a: DataFrame, b: DataFrame, strict: bool = False) -> DataFrame:
    """Pairs of rectangles that intersect; the columns of ``b`` get the suffix _b. Each pair once.

    A rectangle's level is the power of two that its longer side needs. A pair
    meets on cells as wide as the larger of its two levels, where each of them
    lies in four cells at most, so a large rectangle is never cut into small
    cells. It meets in the cell that holds the lower left corner of the
    intersection, so no pair is repeated.
    """
    r, of_b = _levels(b.withColumnsRenamed({c: f"{c}_b" for c in b.columns}).withColumnsRenamed({f"{c}_b": c for c in _BOX}))
    left, of_a = _levels(a)
    among = lambda ns: F.array(*map(F.lit, ns)) if ns else F.array().cast("array<int>")
    w = F.pow(F.lit(2.0), F.col("at"))
    ends = lambda c: F.explode(F.array_distinct(F.array(_cell(F.col(f"min{c}"), w), _cell(F.col(f"max{c}"), w)))).alias(f"c{c}")
    spans = lambda df: df.select("*", ends("x")).select("*", ends("y"))
    right = spans(r.withColumn("at", F.explode(F.array_distinct(F.transform(among(of_a), lambda k: F.greatest(k, F.col("lv")))))))
    right = right.withColumnsRenamed({c: f"{c}_b" for c in _BOX})
    left = left.withColumnRenamed("lv", "_own").withColumn("lv", F.explode(among(of_b))).withColumn("at", F.greatest("_own", "lv")).drop("_own")
    got = split_join(spans(left), right, ["lv", "at", "cx", "cy"], _BOX, [f"{c}_b" for c in _BOX])
    lo = lambda c: F.greatest(F.col(f"min{c}"), F.col(f"min{c}_b"))
    hi = lambda c: F.least(F.col(f"max{c}"), F.col(f"max{c}_b"))
    meet = (lo("x") < hi("x")) & (lo("y") < hi("y")) if strict else (lo("x") <= hi("x")) & (lo("y") <= hi("y"))
    return got.where(meet & (_cell(lo("x"), w) == F.col("cx")) & (_cell(lo("y"), w) == F.col("cy"))).drop("lv", "at", "cx", "cy")


def is_polygons(df: DataFrame) -> bool:
    return "xs" in df.columns


def with_box_rings(df: DataFrame) -> DataFrame:
    """Rectangles as polygons; polygons stay."""
    if is_polygons(df):
        return df
    list_of = lambda *c: F.array(*map(F.col, c))
    return df.withColumns({"xs": list_of("minx", "maxx", "maxx", "minx"), "ys": list_of("miny", "miny", "maxy", "maxy"), "ends": F.array(F.lit(4))})


def _kept(df: DataFrame, test, drop: Sequence[str]) -> DataFrame:
    """Rows whose batch passes ``test`` (a mask of them), without some columns."""
    names = [c for c in df.columns if c not in drop]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.select(names).filter(pa.array(test(b)))

    return df.mapInArrow(run, schema)


def shapes_meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of shapes that have a point in common, as :func:`boxes_meet`; vertices are left out."""
    if not is_polygons(a) and not is_polygons(b):
        return boxes_meet(a, b)
    near = boxes_meet(with_box_rings(a), with_box_rings(b))
    return _kept(near, lambda t: meet(Rings.of(t), Rings.of(t, "_b")), [*_RINGS, *(f"{c}_b" for c in _RINGS)])


def points_in_shapes(points: DataFrame, shapes: DataFrame, spread: str) -> DataFrame:
    """Pairs of points (x, y) and the shapes that hold them, closed; vertices are left out. Column names must differ."""
    near = region_candidates(points, shapes, spread)
    return _kept(near, lambda t: points_in_rings(t, True), _RINGS) if is_polygons(shapes) else near


def _shape(df: DataFrame) -> list[str]:
    return [*_BOX, *(_RINGS if is_polygons(df) else ())]


def read_from_points(points: DataFrame, features: DataFrame, key: str, fields: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first feature by ``order`` at every point, nulls where there is none: ``key`` and ``fields``."""
    hit = points_in_shapes(points.select(key, "x", "y"), features, key)
    best = hit.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("f")).select(key, "f.*")
    return points.select(key).join(best, key, "left")


def read_from_areas(areas: DataFrame, features: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """All features that meet each area: ``key`` of the area and ``fields`` of the features, closed."""
    return shapes_meet(areas.select(key, *_shape(areas)), features).select(key, *(F.col(f"{f}_b").alias(f) for f in fields))


def semi_points(points: DataFrame, shapes: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Points inside any, or outside all, of the shapes; closed."""
    hit = points_in_shapes(points.select(key, "x", "y"), shapes.select(*_shape(shapes)), key).select(key).distinct()
    return points.join(hit, key, "left_semi" if inside else "left_anti")


def semi_shapes(df: DataFrame, others: DataFrame, keys: Sequence[str], inside: bool = True) -> DataFrame:
    """Shapes that meet any, or none, of the others."""
    hit = shapes_meet(df.select(*keys, *_shape(df)), others.select(*_shape(others))).select(*keys).distinct()
    return df.join(hit, list(keys), "left_semi" if inside else "left_anti")


def renumbered(df: DataFrame, order: Sequence[str | Column], key: str = "poly_id") -> DataFrame:
    """1..n within each tile by ``order``, also in tiles that hold a large part of the rows."""
    out = ranked(df, ["tile_name"], order, key)
    return out.withColumn(key, F.col(key).cast("int"))


def renumbered_after(df: DataFrame, kept: Column, order: Sequence[str | Column], key: str = "poly_id") -> DataFrame:
    """Rows that aren't ``kept`` get the numbers after their tile's greatest kept one."""
    top = df.groupBy("tile_name").agg(F.coalesce(F.max(F.when(kept, F.col(key))), F.lit(0)).alias("_top"))
    n = ranked(df.withColumn("_kept", kept), ["tile_name", "_kept"], order, "_rank").join(top, "tile_name")
    return n.withColumn(key, F.when(F.col("_kept"), F.col(key)).otherwise(F.col("_top") + F.col("_rank")).cast("int")).select(*df.columns)


def tile_rectangles(polys: DataFrame, tiles: DataFrame, key: str) -> DataFrame:
    """Rectangles cut into tiles: those within a tile's ``buff`` stay whole, others are clipped to the ``nbuff`` of each tile; a piece belongs to the tile whose ``nbuff`` holds its centre, half-open; ids are renumbered by tile.

    Pieces without area are dropped. Rectangles stay rectangles under clipping,
    so no general overlay is needed.
    """
    t = lambda b: tiles.select("tile_name", f"{b}.*")
    near = materialize(boxes_meet(polys.select(key, *_BOX), t("buff")), "tile-near")
    within = (F.col("minx") >= F.col("minx_b")) & (F.col("miny") >= F.col("miny_b")) & (F.col("maxx") <= F.col("maxx_b")) & (F.col("maxy") <= F.col("maxy_b"))
    whole = near.where(within).select(key, *_BOX).distinct()
    rest = polys.select(key, *_BOX).join(whole.select(key), key, "left_anti")
    cut = boxes_meet(rest, t("nbuff"), strict=True).select(key, *(F.greatest(F.col(c), F.col(f"{c}_b")).alias(c) for c in _BOX[:2]), *(F.least(F.col(c), F.col(f"{c}_b")).alias(c) for c in _BOX[2:]))
    pieces = materialize(whole.unionByName(cut), "tile-pieces").withColumns({"x": (F.col("minx") + F.col("maxx")) / 2, "y": (F.col("miny") + F.col("maxy")) / 2})
    home = t("nbuff").withColumnsRenamed({c: f"_{c}" for c in _BOX})
    at = region_candidates(pieces.withColumnsRenamed({c: f"p_{c}" for c in _BOX}), home.withColumnsRenamed({f"_{c}": c for c in _BOX}), key)
    at = at.where((F.col("x") < F.col("maxx")) & (F.col("y") < F.col("maxy"))).select("tile_name", key, *(F.col(f"p_{c}").alias(c) for c in _BOX))
    return renumbered(at, [key, *_BOX])


def tile_polygons(polys: DataFrame, tiles: DataFrame, key: str, least: float = 1e-9) -> DataFrame:
    """Polygons cut into tiles: tile_name, ``key``, poly_id, bounds, vertices, area.

    Those within a tile's ``buff`` stay whole; others are clipped to the
    ``nbuff`` of each tile they meet. Several parts become several polygons,
    those of an area up to ``least`` are dropped. A polygon belongs to the tile
    whose ``nbuff`` holds its centroid, half-open, and ids are renumbered by
    tile. ``key`` is unique in ``polys``.
    """
    t = lambda b: tiles.select("tile_name", f"{b}.*")
    p = materialize(polys.select(key, *_BOX, *_RINGS), "tile-polygons")
    # which polygon meets which tile is found out by bounds alone; vertices are joined once
    near = boxes_meet(p.select(key, *_BOX), t("buff"))
    within = (F.col("minx") >= F.col("minx_b")) & (F.col("miny") >= F.col("miny_b")) & (F.col("maxx") <= F.col("maxx_b")) & (F.col("maxy") <= F.col("maxy_b"))
    whole = materialize(near.where(within).select(key).distinct(), "tile-whole")
    rest = materialize(p.select(key, *_BOX).join(whole, key, "left_anti"), "tile-rest")
    cross = boxes_meet(rest, t("nbuff"), strict=True).select(key, *(f"{c}_b" for c in _BOX))
    # a whole polygon is clipped by nothing
    wide = [F.lit(v).alias(f"{c}_b") for c, v in zip(_BOX, (float("-inf"),) * 2 + (float("inf"),) * 2, strict=True)]
    both = p.select(key, *_RINGS).join(whole.select(key, *wide).unionByName(cross), key)
    names = [*_BOX, *_RINGS, "area", "x", "y"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = Rings.of(b)
            box = np.column_stack([b.column(f"{c}_b").to_numpy() for c in _BOX])
            whole = np.isinf(box).all(1)
            plain = whole & (np.bincount(r.ring_row, minlength=b.num_rows) == 1)
            if plain.any():
                yield measured(b.select([key, *_RINGS]).filter(pa.array(plain)))
            rows, made = [], []
            for i in np.flatnonzero(~plain).tolist():
                rings = r.rings(i)
                for part in parts(rings if whole[i] else clip(rings, tuple(box[i])), least):
                    rows.append(i)
                    made.append(part)
            if made:
                flat = [np.concatenate(m) for m in made]
                at = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in flat]))), pa.int32())
                xy = np.concatenate(flat)
                lists = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(xy[:, k]))) for k in (0, 1)]
                ends = pa.array([np.cumsum([len(q) for q in m]).tolist() for m in made], pa.list_(pa.int32()))
                yield measured(pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows)), *lists, ends], names=[key, *_RINGS]))

    def measured(b: pa.RecordBatch) -> pa.RecordBatch:
        """With bounds, area and centroid, where there is an area."""
        r = Rings.of(b)
        area, cx, cy = r.moments()
        bounds = [f.reduceat(v, r.first) for f in (np.minimum, np.maximum) for v in (r.x, r.y)]
        out = pa.RecordBatch.from_arrays([b.column(key), *map(pa.array, bounds), *(b.column(c) for c in _RINGS), *map(pa.array, (area, cx, cy))], names=[key, *names])
        return out.filter(pa.array(area > least))

    kind = polys.schema[key].dataType.simpleString()
    pieces = both.mapInArrow(cut, f"`{key}` {kind}, minx double, miny double, maxx double, maxy double, xs array<double>, ys array<double>, ends array<int>, area double, x double, y double")
    home = t("nbuff").withColumnsRenamed({c: f"_{c}" for c in _BOX})
    at = region_candidates(pieces.withColumnsRenamed({c: f"p_{c}" for c in (*_BOX, *_RINGS)}), home.withColumnsRenamed({f"_{c}": c for c in _BOX}), key)
    at = at.where((F.col("x") < F.col("maxx")) & (F.col("y") < F.col("maxy"))).select("tile_name", key, *(F.col(f"p_{c}").alias(c) for c in (*_BOX, *_RINGS)), "area")
    # written, as the ranges that rows are numbered by are sampled first
    return renumbered(materialize(at, "tile-pieces"), [key, *_BOX, "area"])


def rasterized(features: DataFrame, width: float = 1.0) -> DataFrame:
    """tile_name, px, py, poly_id of the cells whose centre a shape holds, half-open; the smallest poly_id wins. Cells without one are missing."""
    if is_polygons(features):
        keys = ["tile_name", "poly_id"]
        kinds = ", ".join(f"{k} {features.schema[k].dataType.simpleString()}" for k in keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, py, first, last = Rings.of(b).spans(width)
                own = [b.column(k).take(pa.array(row)) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(py), pa.array(first), pa.array(last)], names=[*keys, "py", "_from", "_to"])

        e = features.select(*keys, *_RINGS).mapInArrow(run, f"{kinds}, py bigint, _from bigint, _to bigint")
        e = e.select(*keys, "py", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("px"))
    else:
        first = lambda c: F.ceil(F.col(c) / width - 0.5)
        e = features.select("tile_name", "poly_id", "miny", "maxy", F.explode(F.when(first("minx") < first("maxx"), F.sequence(first("minx"), first("maxx") - 1))).alias("px"))
        e = e.select("tile_name", "poly_id", "px", F.explode(F.when(first("miny") < first("maxy"), F.sequence(first("miny"), first("maxy") - 1))).alias("py"))
    return e.groupBy("tile_name", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py")).agg(F.min("poly_id").alias("poly_id"))


def merged_by_zone(sources: dict[str, DataFrame], zones: DataFrame, zone_field: str, key: str = "fid", outside: str = "<none>") -> DataFrame:
    """Point features of each zone from the zone's own source, and from ``sources[outside]`` what lies in no zone; ids 1..n by tile.

    A source is named after its zone. Columns that a source lacks are null.
    Zones are rectangles or polygons, closed.
    """
    parts = None
    for name, df in sources.items():
        one = semi_points(df, zones, key, inside=False) if name == outside else semi_points(df, zones.where(F.col(zone_field) == name), key)
        one = one.withColumn("_zone", F.lit(name))
        parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
    return renumbered(parts, ["_zone", key]).withColumnRenamed("_zone", zone_field)


def uncovered_area(shapes: DataFrame, boundary: DataFrame, width: float) -> DataFrame:
    """Area of the boundary's cells whose centre no shape holds: one row, area. Cells of ``width`` stand in for an exact overlay."""
    cells = lambda df: rasterized(df.withColumns({"tile_name": F.lit(""), "poly_id": F.lit(0)}), width).select("px", "py")
    return cells(boundary).join(cells(shapes), ["px", "py"], "left_anti").agg((F.count(F.lit(1)) * F.lit(float(width) ** 2)).alias("area"))
