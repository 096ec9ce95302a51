"""Cell-wise and neighbourhood operators on pixel tables.

A pixel table has ``tile_name``, ``px``, ``py`` and band columns, every cell
once. Missing cells are missing rows or nulls; 0/0 is NaN and poisons means, a
null is skipped by them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.plans.blocks import Block, extreme, over_blocks, shifted
from tilewright.plans.skew import broadcast_if_small

CELL = ("px", "py")


def nan_div(a: Column, b: Column) -> Column:
    """a / b where x/0 is not finite instead of an error: NaN for 0/0, an infinity else."""
    zero = F.when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def _num(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def rgb_indices(r: str = "r", g: str = "g", b: str = "b") -> dict[str, Column]:
    """The published visible-light indices GLI, VARI, NGRDI, NGBDI, NRBDI; GLI and VARI with .01 against division by zero."""
    r, g, b = map(_num, (r, g, b))
    e = F.lit(0.01).cast("double")
    return {
        "GLI": nan_div(2 * g - r - b + e, 2 * g + r + b + e),
        "VARI": nan_div(g - r, g + r - b + e),
        "NGRDI": nan_div(g - r, g + r),
        "NGBDI": nan_div(g - b, g + b),
        "NRBDI": nan_div(r - b, r + b),
    }


def ir_indices(r: str = "r", ir: str = "ir") -> dict[str, Column]:
    """NDVI, EVI2 without the 2.5 gain, MSAVI2 and SAVI."""
    r, i = _num(r), _num(ir)
    return {
        "NDVI": nan_div(i - r, i + r),
        "EVI2": nan_div(i - r, i + 2.4 * r + 1),
        "MSAVI2": (2 * i + 1 - F.sqrt((2 * i + 1) * (2 * i + 1) - 8 * (i - r))) / 2,
        "SAVI": nan_div(1.5 * (i - r), i + r + 0.5),
    }


def difference(a: DataFrame, b: DataFrame, band: str, keys: Sequence[str] = ("tile_name", *CELL)) -> DataFrame:
    """A - B of the cells that both have."""
    return a.select(*keys, F.col(band).alias("_a")).join(b.select(*keys, F.col(band).alias("_b")), list(keys)).select(*keys, (F.col("_a") - F.col("_b")).alias(band))


def clamp(c: str | Column, low: float, high: float) -> Column:
    """Below low is low, above high is high; null stays null."""
    v = _num(c)
    return F.when(v.isNull(), v).otherwise(F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))))


def pseudo_image(df: DataFrame, bands: Mapping[str, tuple[str, tuple[float, float] | None]], keys: Sequence[str] = ("tile_name", *CELL)) -> DataFrame:
    """8-bit bands: null is 0; with a range, the range is stretched to 0 .. 254 and what lies beyond is clamped; fractions are cut."""
    out = []
    for name, (column, limits) in bands.items():
        v = F.coalesce(_num(column), F.lit(0.0))
        if limits:
            low, high = map(float, limits)
            v = (clamp(v, low, high) - low) / (high - low) * 254
        out.append(F.floor(clamp(v, 0, 255)).cast("int").alias(name))
    return df.select(*keys, *out)


def masked(df: DataFrame, mask: DataFrame, band: str, mask_band: str, mask_na: bool = False, keys: Sequence[str] = CELL) -> DataFrame:
    """The band is null where the mask isn't 1; where the mask is null or missing only if ``mask_na``. Cells meet by place, so a tile sees its neighbours' mask too."""
    m = mask.select(*keys, F.col(mask_band).alias("_m"))
    hide = (F.col("_m") != 1) | (F.col("_m").isNull() if mask_na else F.lit(False))
    return df.join(m, list(keys), "left").withColumn(band, F.when(F.coalesce(hide, F.lit(False)), F.lit(None)).otherwise(F.col(band))).drop("_m")


def reclass_binary(c: str | Column, classes: Sequence[int], others: int | None = 0) -> Column:
    """1 for the listed classes, ``others`` (0 or null) for the rest; null stays null if others is null, else it is others."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(list(classes)), F.lit(1)).otherwise(F.lit(others).cast("int"))


def class_raster(segment_pixels: DataFrame, segments: DataFrame, class_column: str) -> DataFrame:
    """Class of each cell's segment; null without one. Segments are unique by tile and poly_id."""
    return segment_pixels.join(segments.select("tile_name", "poly_id", class_column), ["tile_name", "poly_id"], "left")


def cover(first: str | Column, second: str | Column) -> Column:
    """The first where it isn't null, else the second."""
    return F.coalesce(first, second)


def zero_to_null(c: str | Column) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(0))


def fill_zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def jitter(c: str | Column, most: float = 0.001, keys: Sequence[str] = CELL) -> Column:
    """Adds 0 .. most by a hash of the cell, to break ties of neighbours alike in every run."""
    return (F.col(c) if isinstance(c, str) else c) + F.pmod(F.xxhash64(*keys), F.lit(1_000_003)) / F.lit(1_000_003.0) * F.lit(float(most))


def overview(df: DataFrame, bands: Sequence[str], factor: int = 2) -> DataFrame:
    """Means of factor x factor cells; nulls are skipped. One shuffle, pre-aggregated."""
    at = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in CELL]
    return df.groupBy(*at).agg(*(F.avg(b).alias(b) for b in bands))


def band_range(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Least and greatest value of each band over all tiles: band, min, max. Nulls and NaN are skipped."""
    one = df.agg(*(f(F.when(~F.isnan(_num(b)), _num(b))).alias(f"{b}_{n}") for b in bands for n, f in (("min", F.min), ("max", F.max))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(f"{b}_min").alias("min"), F.col(f"{b}_max").alias("max")) for b in bands))).alias("e")).select("e.*")


def crop(df: DataFrame, tiles: DataFrame, bounds: str, width: float = 1.0) -> DataFrame:
    """Cells whose centre lies in a tile's ``bounds`` (core, buff or nbuff), under the tile's name: with ``buff`` a cell appears in every tile that needs it.

    Each cell finds its tiles in the grid of bounds by equality on coarse cells,
    not by a range join; a small scheme is broadcast.
    """
    side = tiles.select(F.max(F.greatest(F.col(f"{bounds}.maxx") - F.col(f"{bounds}.minx"), F.col(f"{bounds}.maxy") - F.col(f"{bounds}.miny")))).scalar()
    t = tiles.select(F.col("tile_name").alias("_tile"), f"{bounds}.*").withColumn("_w", side)
    for a in "xy":
        t = t.withColumn(f"_c{a}", F.explode(F.sequence(F.floor(F.col(f"min{a}") / F.col("_w")), F.floor(F.col(f"max{a}") / F.col("_w")))))
    x, y = ((F.col(c) + 0.5) * width for c in CELL)
    p = df.withColumns({"_x": x, "_y": y}).withColumn("_side", side)
    p = p.withColumns({"_cx": F.floor(F.col("_x") / F.col("_side")), "_cy": F.floor(F.col("_y") / F.col("_side"))})
    got = p.join(broadcast_if_small(t), ["_cx", "_cy"]).where((F.col("_x") >= F.col("minx")) & (F.col("_x") < F.col("maxx")) & (F.col("_y") >= F.col("miny")) & (F.col("_y") < F.col("maxy")))
    return got.select(F.col("_tile").alias("tile_name"), *(c for c in df.columns if c != "tile_name"))


def mosaic(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """One raster of all tiles: a cell that several tiles hold is taken from the first by name."""
    return df.groupBy(*CELL).agg(*(F.min_by(b, "tile_name").alias(b) for b in bands))


def circle(radius: float) -> list[tuple[int, int]]:
    """Offsets within the radius; an error if that is the cell alone."""
    n = int(radius)
    got = [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= radius * radius]
    if len(got) < 2:
        raise ValueError("'opening_radius' is too small")
    return got


def _as_double(df: DataFrame, band: str) -> DataFrame:
    return df.select(*CELL, _num(band).alias("_v"))


def _back(grid: np.ndarray) -> pa.Array:
    """Values with nulls for NaN."""
    return pa.array(grid, mask=np.isnan(grid))


def focal(df: DataFrame, band: str, radius: float, how: Sequence[str]) -> DataFrame:
    """``band`` of each cell after least ("min") and greatest ("max") values within a circle, one step after the other; nulls and NaN don't count.

    All steps are done in blocks, with a halo as wide as all of them reach.
    Only cells of ``df`` have values, also between steps.
    """
    circle(radius)

    def work(b: Block) -> pa.Table:
        v, there = b.grid("_v"), b.there()
        for step in how:
            v = np.where(there, extreme(v, radius, step), np.nan)
        return b.rows(CELL, {"v": _back(b.at_own(v))})

    kind = df.schema[band].dataType
    out = over_blocks(_as_double(df, band), ["_v"], int(radius) * len(how), work, "px int, py int, v double")
    return out.select(*CELL, F.col("v").cast(kind).alias(band))


def opening(df: DataFrame, band: str, radius: float, times: int = 1) -> DataFrame:
    """Morphological opening: erosion, then dilation by a circle, so often. ``df`` is the dense grid; cells beyond it don't count."""
    return focal(df, band, radius, ["min", "max"] * times) if times else df.select(*CELL, band)


def hillshade(df: DataFrame, band: str, azimuth: float = 315.0, altitude: float = 45.0, width: float = 1.0) -> DataFrame:
    """Horn's 3x3 shade 0 .. 255 of cells with all eight neighbours, none of them null or NaN; y grows north."""
    zenith, az = math.radians(90 - altitude), math.radians(azimuth)

    def work(b: Block) -> pa.Table:
        v = b.grid("_v")
        z = {(i, j): b.at_own(shifted(v, i, j)) for i in (-1, 0, 1) for j in (-1, 0, 1)}
        gx = ((z[1, 1] + 2 * z[1, 0] + z[1, -1]) - (z[-1, 1] + 2 * z[-1, 0] + z[-1, -1])) / (8.0 * width)
        gy = ((z[-1, 1] + 2 * z[0, 1] + z[1, 1]) - (z[-1, -1] + 2 * z[0, -1] + z[1, -1])) / (8.0 * width)
        # the light's direction against the surface's normal (-gx, -gy, 1)
        light = (math.cos(zenith) - gx * (math.sin(zenith) * math.sin(az)) - gy * (math.sin(zenith) * math.cos(az))) / np.sqrt(1 + gx * gx + gy * gy)
        full = np.isfinite(light) & ~np.isnan(z[0, 0])
        shade = np.floor(np.maximum(np.where(full, light, 0), 0) * 255 + 0.5).astype(np.int32)
        return b.rows(CELL, {"shade": pa.array(shade)}, full)

    return over_blocks(_as_double(df, band), ["_v"], 1, work, "px int, py int, shade int")


def _tent(d: Column) -> Column:
    return F.greatest(1 - d, F.lit(0.0))


def _cubic(d: Column) -> Column:
    """The published cubic convolution kernel with a = -0.5."""
    return F.when(d < 1, (1.5 * d - 2.5) * d * d + 1).when(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2).otherwise(0.0)


def _near(d: Column) -> Column:
    return F.when(d <= 0.5, 1.0).otherwise(0.0)


#: Weight by distance in source cells, and how far it reaches.
KERNELS = {"bilinear": (_tent, 1.0), "cubic": (_cubic, 2.0), "near": (_near, 0.5)}


def resampled(df: DataFrame, bands: Sequence[str], source: tuple[float, float, float], target: tuple[float, float, float], bounds: tuple[int, int, int, int], kernel: str = "bilinear") -> DataFrame:
    """Cells px0 <= px < px1, py0 <= py < py1 (``bounds``: px0, py0, px1, py1) of a target grid out of a source grid.

    A grid is (x of its corner, y of its corner, cell width). Each target cell
    takes the source cells around its centre by the kernel's weights; cells with
    a missing neighbour take the weighted mean of those present, cells with none
    are left out. Every source cell is sent to the target cells it can touch,
    and one aggregate adds up.
    """
    weight, reach = KERNELS[kernel]
    (sx, sy, sw), (tx, ty, tw), (x0, y0, x1, y1) = source, target, bounds
    cx, cy = (F.lit(float(o)) + (F.col(c) + 0.5) * float(sw) for o, c in ((sx, "px"), (sy, "py")))
    d = df.select(cx.alias("_x"), cy.alias("_y"), *bands)
    for a, o, lo, hi in (("x", tx, x0, x1), ("y", ty, y0, y1)):
        first = F.greatest(F.ceil((F.col(f"_{a}") - reach * float(sw) - float(o)) / float(tw) - 0.5), F.lit(lo))
        last = F.least(F.floor((F.col(f"_{a}") + reach * float(sw) - float(o)) / float(tw) - 0.5), F.lit(hi - 1))
        d = d.where(first <= last).withColumn(f"p{a}", F.explode(F.sequence(first, last)))
    w = F.lit(1.0)
    for a, o in (("x", tx), ("y", ty)):
        w = w * weight(F.abs(F.lit(float(o)) + (F.col(f"p{a}") + 0.5) * float(tw) - F.col(f"_{a}")) / float(sw))
    d = d.withColumn("_w", w).where("_w <> 0")
    agg = [F.try_divide(F.sum(_num(b) * F.col("_w")), F.sum(F.when(F.col(b).isNotNull(), F.col("_w")))).alias(b) for b in bands]
    return d.groupBy(F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py")).agg(*agg)


def ingested(df: DataFrame, bands: Sequence[str], source: tuple[float, float, float], tiles: DataFrame, width: float, kernel: str = "bilinear", done: DataFrame | None = None, bounds: str = "buff") -> DataFrame:
    """A raster tileset out of a source grid's cells: tile_name, px, py and bands of every tile's buffered extent on a grid of ``width`` from the origin.

    Tiles in ``done`` (tile_name) are skipped. Cells are resampled once for all
    tiles, then given to each tile that they lie in. Where files overlap, a
    cell's greatest filename wins if ``df`` has that column.
    """
    if done is not None:
        tiles = tiles.join(done.select("tile_name"), "tile_name", "left_anti")
    e = tiles.agg(*(f(f"{bounds}.{c}").alias(c) for f, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy")))).first()
    if e.minx is None:
        return df.select(F.lit(None).cast("string").alias("tile_name"), *CELL, *(_num(b).alias(b) for b in bands)).limit(0)
    if "filename" in df.columns:
        df = df.groupBy(*CELL).agg(F.max_by(F.struct(*bands), "filename").alias("_b")).select(*CELL, "_b.*")
    box = (math.floor(e.minx / width), math.floor(e.miny / width), math.ceil(e.maxx / width), math.ceil(e.maxy / width))
    return crop(resampled(df, bands, source, (0.0, 0.0, width), box, kernel), tiles, bounds, width)
