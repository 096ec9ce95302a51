"""Metrics of segments: spectral, texture, and lidar heights, colours and classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.points import presence
from tilewright.operators.raster import nan_div
from tilewright.plans.blocks import Block, over_blocks

SEGMENT = ("tile_name", "poly_id")
#: Aggregates by name, for zonal statistics.
FUNCTIONS = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def stored(v: Column) -> Column:
    """A metric as it is kept: null, NaN and overflow are 0, else the value times 10,000 without its fraction.

    Eight decimals are rounded first, so that the order of a sum doesn't decide on a unit.
    """
    x = F.round(v * 10000, 4)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) > 2147483647), F.lit(0)).otherwise(x).cast("int")


def attach(segments: DataFrame, metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every segment with its metrics; 0 where it has none."""
    return segments.select(*SEGMENT).join(metrics, list(SEGMENT), "left").select(*SEGMENT, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns))


def zonal(pixels: DataFrame, segments: DataFrame, layers: Mapping[str, Column], functions: Sequence[str], prefix: str) -> DataFrame:
    """``<prefix>_<layer>_<function>`` of every segment. One aggregate over the pixels, combined before its shuffle; NaN poisons, null is skipped."""
    p = pixels.select(*SEGMENT, *(c.alias(n) for n, c in layers.items()))
    names = {f"{prefix}_{n}_{f}": FUNCTIONS[f](n) for n in layers for f in functions}
    m = p.groupBy(*SEGMENT).agg(*(a.alias(k) for k, a in names.items())).select(*SEGMENT, *(stored(F.col(k)).alias(k) for k in names))
    return attach(segments, m, list(names))


#: Offsets of the texture's pixel pairs: right, down right, down, down left.
SHIFTS = ((1, 0), (1, 1), (0, 1), (-1, 1))


def texture(pixels: DataFrame, segments: DataFrame, band: str, limits: tuple[float, float], prefix: str, n_grey: int = 16, shifts: Sequence[tuple[int, int]] = SHIFTS) -> DataFrame:
    """Haralick metrics of each segment's grey-level co-occurrence.

    The band is clamped to ``limits`` and cut into ``n_grey`` equal levels 0 ..
    n_grey - 1. Pairs lie within a segment, are counted both ways over all
    shifts and made shares. Pairs are counted in blocks of cells that have the
    partners as a halo; up to n_grey squared counts a segment and block are
    shuffled. Null and NaN pixels pair with none.
    """
    low, high = map(float, limits)
    v = F.least(F.greatest(F.col(band).cast("double"), F.lit(low)), F.lit(high))
    level = F.least(F.floor((v - low) / (high - low) * n_grey), F.lit(n_grey - 1)).cast("int")
    p = pixels.where(F.col(band).isNotNull() & ~F.isnan(F.col(band).cast("double"))).select(*SEGMENT, "px", "py", level.alias("g"))
    halo = max(max(abs(i), abs(j)) for i, j in shifts)

    def work(b: Block) -> pa.Table:
        first = pd.DataFrame({c: b.table[c].to_pandas() for c in SEGMENT})
        code = first.groupby(list(SEGMENT), sort=False, dropna=True).ngroup().to_numpy()
        seg, g = np.full(b.shape, -1), np.zeros(b.shape, np.int64)
        seg[b.i, b.j], g[b.i, b.j] = code, b.table["g"].to_numpy()
        i, j = b.i[b.own], b.j[b.own]
        found = [np.zeros(0, np.int64)]
        for dx, dy in shifts:
            same = (seg[i, j] >= 0) & (seg[i + dy, j + dx] == seg[i, j])
            y, x = i[same], j[same]
            found.append((seg[y, x] * n_grey + g[y + dy, x + dx]) * n_grey + g[y, x])
        key, n = np.unique(np.concatenate(found), return_counts=True)
        at = np.zeros(code.max(initial=-1) + 1, np.int64)
        at[code[code >= 0]] = np.flatnonzero(code >= 0)
        own = b.table.select(list(SEGMENT)).take(pa.array(at[key // n_grey**2]))
        for name, x in (("g", key // n_grey % n_grey), ("h", key % n_grey)):
            own = own.append_column(name, pa.array(x.astype(np.int32)))
        return own.append_column("n", pa.array(n))

    kinds = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in SEGMENT)
    one = over_blocks(p, [*SEGMENT, "g"], halo, work, f"{kinds}, g int, h int, n bigint")
    both = one.select(*SEGMENT, F.explode(F.array(F.struct("g", "h", "n"), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), "n"))).alias("e")).select(*SEGMENT, "e.*")
    pairs = both.groupBy(*SEGMENT, "g", "h").agg(F.sum("n").cast("double").alias("n"))
    d = F.abs(F.col("g") - F.col("h")).cast("double")
    sums = pairs.groupBy(*SEGMENT).agg(
        F.sum("n").alias("t"), F.sum(F.col("n") * d * d).alias("con"), F.sum(F.col("n") * d).alias("dis"), F.sum(F.col("n") / (1 + d * d)).alias("hom"),
        F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.ln("n")).alias("nl"), F.sum(F.col("n") * F.col("g")).alias("s"),
        F.sum(F.col("n") * F.col("g") * F.col("g")).alias("ss"), F.sum(F.col("n") * F.col("g") * F.col("h")).alias("sh"),
    )
    t, mean = F.col("t"), F.col("s") / F.col("t")
    var = F.col("ss") / t - mean * mean
    out = {
        "contrast": F.col("con") / t, "dissimilarity": F.col("dis") / t, "homogeneity": F.col("hom") / t, "ASM": F.col("n2") / (t * t),
        "entropy": F.ln(t) - F.col("nl") / t, "mean": mean, "variance": var, "correlation": F.when(F.round(var, 9) != 0, (F.col("sh") / t - mean * mean) / var),
    }
    m = sums.select(*SEGMENT, *(stored(c).alias(f"{prefix}_{k}") for k, c in out.items()))
    return attach(segments, m, [f"{prefix}_{k}" for k in out])


def point_indices(points: DataFrame) -> DataFrame:
    """Adds NGI, NGB, NRB, VAg and GLI of points; zeros in r, g, b become 1 first, what isn't finite is null."""
    p = points.withColumns({c: F.when(F.col(c) == 0, F.lit(1)).otherwise(F.col(c)).cast("double") for c in "rgb"})
    r, g, b = (F.col(c) for c in "rgb")
    made = {"NGI": nan_div(g - r, g + r), "NGB": nan_div(g - b, g + b), "NRB": nan_div(r - b, r + b), "VAg": nan_div(g - r, g + r - b + 0.01), "GLI": nan_div(2 * g - r - b, 2 * g + r + b)}
    return p.withColumns({k: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) for k, v in made.items()})


def usable(points: DataFrame, least: int = 5) -> DataFrame:
    """Points of tiles with at least ``least`` points that lie in a segment; only these."""
    have = points.where(F.col("poly_id").isNotNull())
    few = have.groupBy("tile_name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("tile_name")
    return have.join(few, "tile_name", "left_semi")


def _heights() -> dict[str, Column]:
    z = F.col("z").cast("double")
    q = F.percentile(z, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9))))
    return {"Z_qmn": F.sqrt(F.avg(z * z)), "Z_mn": F.avg(z), "Z_sd": F.stddev_samp(z), "_q": q, **{f"Z_over{t}": F.avg(F.when(z > t, 1.0).otherwise(0.0)) for t in (1, 2, 3)}}


def _of_percentiles() -> dict[str, Column]:
    q = F.col("_q")
    return {"Z_qmn": F.col("Z_qmn"), "Z_mn": F.col("Z_mn"), "Z_sd": F.col("Z_sd"), "Z_iq": q[2] - q[0], "Z_p50": q[1], "Z_p75": q[2], "Z_p90": q[3], **{f"Z_over{t}": F.col(f"Z_over{t}") for t in (1, 2, 3)}}


COLOURS = ("R", "G", "B", "NGI", "NGB", "NRB", "VAg", "GLI")


def _colours() -> dict[str, Column]:
    """Of points with their segment's ``_q``."""
    out: dict[str, Column] = {}
    for i, at in enumerate(("", "_p50", "_p75", "_p90")):
        inside = F.lit(True) if i == 0 else F.col("z").cast("double") >= F.col("_q")[i]
        for c in COLOURS:
            v = F.when(inside, F.col(c).cast("double"))
            whole = F.max(F.when(inside & F.col(c).isNull(), 1).otherwise(0)) == 0
            out[f"{c}{at}_mn"] = F.when(whole, F.avg(v))
            out[f"{c}{at}_mx"] = F.when(whole, F.max(v))
    return out


def _classes(ground: bool = True, full: bool = True) -> dict[str, Column]:
    z, k = F.col("z").cast("double"), F.col("classification")
    out = {"grnd": F.avg(F.when(k == 2, 1.0).otherwise(0.0))} if ground else {}
    for t in (0, 1, 2, 3) if full else ():
        inside = F.lit(True) if t == 0 else z > t
        n = F.sum(F.when(inside, 1.0).otherwise(0.0))
        for name, codes in (("lvg", [3]), ("hvg", [4, 5]), ("bld", [6])):
            out[name + (f"_over{t}" if t else "")] = F.try_divide(F.sum(F.when(inside & k.isin(codes), 1.0).otherwise(0.0)), n)
    return out


def _kept(df: DataFrame, cols: Mapping[str, Column], prefix: str) -> DataFrame:
    return df.select(*SEGMENT, *(stored(v).alias(f"{prefix}_{k}") for k, v in cols.items()))


def las_metrics(points: DataFrame, segments: DataFrame, prefix: str, ground: bool | None = None, full: bool | None = None, rgb: bool | None = None) -> DataFrame:
    """All lidar metrics of segments: heights, and where the cloud has them shares of ground and of other classes, and colours.

    What is None is found out from the points. Heights and classes are one
    aggregate; colours are a second one, as they need the first one's percentiles.
    """
    if None in (ground, full, rgb):
        seen = presence(points).first().asDict()
        ground, full, rgb = (seen.get(k, False) if v is None else v for k, v in (("is_ground", ground), ("is_full", full), ("is_rgb", rgb)))
    p = usable(points)
    shares = _classes(ground, full)
    one = p.groupBy(*SEGMENT).agg(*(v.alias(k) for k, v in (_heights() | shares).items()))
    out = _kept(one, _of_percentiles() | {k: F.col(k) for k in shares}, prefix)
    if rgb:
        colours = _colours()
        two = point_indices(p).join(one.select(*SEGMENT, "_q"), list(SEGMENT)).groupBy(*SEGMENT).agg(*(v.alias(k) for k, v in colours.items()))
        out = out.join(_kept(two, {k: F.col(k) for k in colours}, prefix), list(SEGMENT), "left")
    return attach(segments, out, [c for c in out.columns if c not in SEGMENT])


def height_metrics(points: DataFrame, segments: DataFrame, prefix: str) -> DataFrame:
    """Quadratic mean, mean, sd, interquartile range, exact percentiles and shares above 1, 2, 3 of Z."""
    return las_metrics(points, segments, prefix, ground=False, full=False, rgb=False)


def colour_metrics(points: DataFrame, segments: DataFrame, prefix: str) -> DataFrame:
    """Mean and greatest value of the colours and indices, over all points and over those at or above the percentiles 50, 75 and 90 of Z: 64 columns. A null among them makes the metric 0."""
    p = usable(points)
    cut = p.groupBy(*SEGMENT).agg(_heights()["_q"].alias("_q"))
    a = point_indices(p).join(cut, list(SEGMENT)).groupBy(*SEGMENT).agg(*(v.alias(k) for k, v in _colours().items()))
    return attach(segments, _kept(a, {k: F.col(k) for k in _colours()}, prefix), [f"{prefix}_{k}" for k in _colours()])


def class_metrics(points: DataFrame, segments: DataFrame, prefix: str) -> DataFrame:
    """Shares of ground (2), and of low (3) and high (4, 5) vegetation and buildings (6) among all points and among those above 1, 2, 3; 0 where there are none."""
    a = usable(points).groupBy(*SEGMENT).agg(*(v.alias(k) for k, v in _classes().items()))
    return attach(segments, _kept(a, {k: F.col(k) for k in _classes()}, prefix), [f"{prefix}_{k}" for k in _classes()])
