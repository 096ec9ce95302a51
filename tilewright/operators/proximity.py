"""Points near other points, and the regions that contain points (problem 4).

Both are equi-joins on grid cells followed by an exact test: no range join and
no cross join. Near points use cells as wide as the radius and half of the
neighbouring cells, so that each pair meets once. Regions choose the cell width
by their own size, a power of two, and so lie in four cells at most, however
large they are; a point looks into one cell of every width in use.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geometry import Rings
from tilewright.functions.wkb import read_points, read_polygons
from tilewright.plans.latest import latest_rows
from tilewright.plans.skew import hot_counts, split_join
from tilewright.plans.stage import materialize

#: Cell numbers stay within this, so that far-away points don't overflow; the exact test decides.
FAR_CELL = 4.0e18
_HALF = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]
#: Mean radius of the earth in metres.
EARTH = 6371008.8


def with_point_xy(df: DataFrame, geom: str, key: str) -> DataFrame:
    """``key``, ``x`` and ``y`` (and the other columns but ``geom``) of the rows with a readable, non-empty point."""
    rest = [c for c in df.columns if c != geom]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), "x double", "y double"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = read_points(b.column(geom).to_pylist())
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(x), pa.array(y)], names=[*rest, "x", "y"])
            yield out.filter(pa.array(~np.isnan(x)))

    return df.select(*rest, geom).where(F.col(geom).isNotNull()).mapInArrow(read, schema)


def with_rings(df: DataFrame, geom: str, key: str) -> DataFrame:
    """``key`` and the other columns but ``geom``, bounds, vertices ``xs``, ``ys`` and the ring ends ``ends`` of the rows with a readable, non-empty polygon."""
    made = ("minx", "miny", "maxx", "maxy", "xs", "ys", "ends")
    rest = [c for c in df.columns if c != geom and c not in made]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), *(f"{c} double" for c in made[:4]), "xs array<double>", "ys array<double>", "ends array<int>"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, xs, ys, n, ends = read_polygons(b.column(geom).to_pylist())
            if not len(rows):
                continue
            at = np.concatenate(([0], np.cumsum(n)))
            box = [pa.array(f.reduceat(v, at[:-1])) for f, v in ((np.minimum, xs), (np.minimum, ys), (np.maximum, xs), (np.maximum, ys))]
            rings = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v)) for v in (xs, ys)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows)) for c in rest), *box, *rings, pa.array(ends, pa.list_(pa.int32()))], names=[*rest, *made])

    return df.select(*rest, geom).where(F.col(geom).isNotNull()).mapInArrow(read, schema)


def _cell(v: Column, width: Column | float) -> Column:
    return F.least(F.greatest(F.floor(v / width).cast("double"), F.lit(-FAR_CELL)), F.lit(FAR_CELL)).cast("bigint")


def _beside(hot: DataFrame, cells: Sequence[str], offsets: Sequence[tuple[int, ...]]) -> DataFrame:
    """Hot cells of rows that are sent to neighbouring cells: those that the rows of hot cells go to."""
    off = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"o{c}") for v, c in zip(o, cells, strict=True))) for o in offsets))).alias("o")
    to = hot.select(*cells, "_parts", off).select(*((F.col(c) + F.col(f"o.o{c}")).alias(c) for c in cells), "_parts")
    return to.groupBy(*cells).agg(F.sum("_parts").cast("int").alias("_parts"))


def near_pairs(points: DataFrame, radius: float, key: str = "fid") -> DataFrame:
    """``key_a``, ``key_b`` (the smaller key first) and ``dist`` of points at most ``radius`` apart, each pair once.

    ``points`` holds ``key``, ``x`` and ``y``. Rows with a null key or a null or
    NaN coordinate have no neighbours. Repeated keys at different places are
    different points, but a key isn't its own neighbour. The radius is closed.
    """
    p = points.where(F.col(key).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    p = p.select(F.col(key).alias("k"), "x", "y", _cell(F.col("x"), radius).alias("cx"), _cell(F.col("y"), radius).alias("cy"))
    own = p.select(F.col("k").alias("k1"), F.col("x").alias("x1"), F.col("y").alias("y1"), "cx", "cy")
    off = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _HALF))).alias("o")
    other = p.select(F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", off)
    other = other.select("k2", "x2", "y2", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("same"))
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    d2 = dx * dx + dy * dy
    hot = materialize(hot_counts(p, ["cx", "cy"]), "hot")
    both = split_join(own, other, ["cx", "cy"], ["k1", "x1", "y1"], ["k2", "x2", "y2"], hot, _beside(hot, ["cx", "cy"], _HALF)).where((d2 <= F.lit(float(radius) ** 2)) & (F.col("k1") != F.col("k2")) & (~F.col("same") | (F.col("k1") < F.col("k2"))))
    return both.select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"), F.sqrt(d2).alias("dist"))


def near_pairs_on_sphere(points: DataFrame, radius: float, key: str = "fid", lon: str = "lon", lat: str = "lat", earth: float = EARTH) -> DataFrame:
    """As :func:`near_pairs` for degrees and the great-circle distance in metres.

    Points become places in space; a great-circle distance is one chord length,
    so cubes as wide as the radius's chord do for any place: poles and the date
    line are nothing special. Null or non-finite degrees have no neighbours.
    """
    chord = 2 * earth * math.sin(min(radius / (2 * earth), math.pi / 2))
    good = points.where(F.col(key).isNotNull() & (F.abs(F.col(lon)) < float("inf")) & (F.abs(F.col(lat)) < float("inf")))
    a, b = F.radians(F.col(lon).cast("double")), F.radians(F.col(lat).cast("double"))
    p = good.select(F.col(key).alias("k"), (F.cos(b) * F.cos(a) * earth).alias("x"), (F.cos(b) * F.sin(a) * earth).alias("y"), (F.sin(b) * earth).alias("z"))
    p = p.withColumns({f"c{c}": _cell(F.col(c), chord) for c in "xyz"})
    half = [o for o in itertools.product((-1, 0, 1), repeat=3) if o[::-1] >= (0, 0, 0)]
    own = p.withColumnsRenamed({c: f"{c}1" for c in "kxyz"})
    off = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"o{c}") for v, c in zip(o, "xyz", strict=True))) for o in half))).alias("o")
    other = p.select("*", off).select(*(F.col(c).alias(f"{c}2") for c in "kxyz"), *((F.col(f"c{c}") + F.col(f"o.o{c}")).alias(f"c{c}") for c in "xyz"), (F.greatest(*(F.abs(F.col(f"o.o{c}")) for c in "xyz")) == 0).alias("same"))
    d2 = sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0))
    cells = ["cx", "cy", "cz"]
    hot = materialize(hot_counts(p, cells), "hot")
    got = split_join(own, other, cells, ["k1", "x1", "y1", "z1"], ["k2", "x2", "y2", "z2"], hot, _beside(hot, cells, half)).where((F.col("k1") != F.col("k2")) & (~F.col("same") | (F.col("k1") < F.col("k2"))))
    dist = 2 * earth * F.asin(F.least(F.sqrt(d2) / (2 * earth), F.lit(1.0)))
    return got.withColumn("dist", dist).where(F.col("dist") <= float(radius)).select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"), "dist")


def _levels(regions: DataFrame) -> tuple[DataFrame, list[int]]:
    wide = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(1e-6))
    r = regions.withColumn("lv", F.least(F.greatest(F.ceil(F.log2(wide)).cast("int"), F.lit(-20)), F.lit(60)))
    # 81 levels at most
    return r, sorted(x.lv for x in r.select("lv").distinct().collect())


def region_candidates(points: DataFrame, regions: DataFrame, spread: str = "fid") -> DataFrame:
    """Pairs of points (``x``, ``y``) and regions whose bounds (``minx`` .. ``maxy``) hold them, closed."""
    r, levels = _levels(regions)
    w = F.pow(F.lit(2.0), F.col("lv"))
    box = [F.explode(F.array_distinct(F.array(_cell(F.col(f"min{a}"), w), _cell(F.col(f"max{a}"), w)))).alias(f"c{a}") for a in "xy"]
    r = r.select("*", box[0]).select("*", box[1])
    p = points.withColumn("lv", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    p = p.withColumns({f"c{a}": _cell(F.col(a), w) for a in "xy"})
    got = split_join(p, r, ["lv", "cx", "cy"], [spread, "x", "y"], ["minx", "miny", "maxx", "maxy"]).drop("lv", "cx", "cy")
    return got.where(F.col("x").between(F.col("minx"), F.col("maxx")) & F.col("y").between(F.col("miny"), F.col("maxy")))


def containing_regions(points: DataFrame, regions: DataFrame, point_key: str = "fid", region_key: str = "seg", closed: bool = False) -> DataFrame:
    """``point_key`` and ``region_key`` of every point inside a region's outline and outside its holes.

    ``points`` holds ``x`` and ``y``; ``regions`` is from :func:`with_rings`.
    Points on an outline may go either way; with ``closed`` they are inside.
    Even-odd rule, in numpy over all edges of a batch of candidates.
    """
    c = region_candidates(points.select(point_key, "x", "y"), regions, point_key).select(point_key, region_key, "x", "y", "xs", "ys", "ends")
    kinds = {f.name: f.dataType.simpleString() for f in c.schema.fields}

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.select([point_key, region_key]).filter(pa.array(points_in_rings(b, closed)))

    return c.mapInArrow(inside, f"`{point_key}` {kinds[point_key]}, `{region_key}` {kinds[region_key]}")


def points_in_rings(b: pa.RecordBatch, closed: bool = False) -> np.ndarray:
    """For each row whether (x, y) is inside the rings xs, ys that end at ends, or, if ``closed``, within a billionth of their lines."""
    return Rings.of(b).holds(np.arange(b.num_rows), b.column("x").to_numpy(), b.column("y").to_numpy(), closed)


def p4_found(points: DataFrame, segments: DataFrame, tiles: DataFrame, radius: float = 2.0) -> DataFrame:
    """Cases of problem 4: relation, key_a, key_b.

    Latest row of each fid; null fids and unreadable, empty or non-finite
    geometry are left out. Empty tables give no rows. Columns other than the
    named ones are ignored.
    """
    p = latest_rows(points.select("fid", "geometry", "tile_name", "saved_at"), "fid", "saved_at", ["geometry", "tile_name"])
    p = materialize(with_point_xy(p.select("fid", "tile_name", "geometry"), "geometry", "fid"), "p4-points")
    s = latest_rows(segments.select("fid", "geom", "loaded_at"), "fid", "loaded_at", ["geom"])
    s = materialize(with_rings(s.select("fid", "geom"), "geom", "fid").withColumnRenamed("fid", "seg"), "p4-segments")
    near = near_pairs(p, radius).select(F.lit("near").alias("relation"), "key_a", F.col("key_b").cast("string").alias("key_b"))
    seg = containing_regions(p, s).select(F.lit("segment").alias("relation"), F.col("fid").alias("key_a"), F.col("seg").cast("string").alias("key_b"))
    t = tiles.select(F.col("tile_name").alias("_in"), "minx", "miny", "maxx", "maxy").dropna()
    tile = region_candidates(p, t).where((F.col("x") < F.col("maxx")) & (F.col("y") < F.col("maxy")) & ~F.col("_in").eqNullSafe(F.col("tile_name")))
    tile = tile.select(F.lit("tile").alias("relation"), F.col("fid").alias("key_a"), F.col("_in").alias("key_b"))
    return near.unionByName(seg).unionByName(tile)
