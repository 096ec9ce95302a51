"""Lidar point clouds: tiled reads, quality, noise, height normalisation and surfaces.

Points have x, y, z and classification, and may have r, g, b. Cells are
half-open: floor(x / width).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geometry import chunks, ranges
from tilewright.operators.raster import jitter
from tilewright.plans.skew import split_join
from tilewright.plans.stage import materialize

NOISE = 7
#: The standard's class numbers by name.
CLASSES = {"Unclassified": 1, "Ground": 2, "Buildings": 6, "Low Veg": 3, "Med Veg": 4, "High Veg": 5, "Noise": 7}


def cell(df: DataFrame, width: float = 1.0) -> DataFrame:
    """With px, py of the cell that holds the point."""
    return df.withColumns({f"p{a}": F.floor(F.col(a) / float(width)).cast("int") for a in "xy"})


def read_tile_points(points: DataFrame, bounds: tuple[float, float, float, float], classes: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Points in closed bounds (minx, miny, maxx, maxy) of these classes; bounds, classes and columns reach the scan. An empty result has no rows."""
    minx, miny, maxx, maxy = map(float, bounds)
    df = points.where(F.col("x").between(minx, maxx) & F.col("y").between(miny, maxy))
    if classes is not None:
        df = df.where(F.col("classification").isin(list(classes)))
    return df.select(*columns) if columns else df


def files_meeting(files: DataFrame, bounds: tuple[float, float, float, float], meet: bool = True) -> DataFrame:
    """Files whose footprint meets, or doesn't meet, closed bounds: plain filters on the footprint's columns."""
    minx, miny, maxx, maxy = map(float, bounds)
    hit = (F.col("minx") <= maxx) & (F.col("maxx") >= minx) & (F.col("miny") <= maxy) & (F.col("maxy") >= miny)
    return files.where(hit if meet else ~hit)


def footprints(points: DataFrame) -> DataFrame:
    """Bounds and number of points of every file."""
    return points.groupBy("filename").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"), F.count(F.lit(1)).alias("n"))


def write_footprints(points: DataFrame, path: str) -> None:
    """The footprints of the files as Parquet, over what was there."""
    footprints(points).write.mode("overwrite").parquet(path)


def indexed(points: DataFrame, width: float, partitions: int) -> DataFrame:
    """Points in ranges of cells, sorted by cell inside: written so, row-group statistics prune bounds."""
    return cell(points, width).repartitionByRange(partitions, "px", "py").sortWithinPartitions("px", "py")


def distinct_points(points: DataFrame) -> DataFrame:
    """One point for equal x, y, z: the smallest classification. A partial aggregate, not a sort."""
    rest = [c for c in points.columns if c not in ("x", "y", "z", "classification")]
    return points.groupBy("x", "y", "z").agg(F.min(F.struct("classification", *rest)).alias("_p")).select("x", "y", "z", "_p.*")


def _isolated(points: DataFrame, width: float, most: int) -> DataFrame:
    """Cubes are counted first, so only cube counts are exploded, not points."""
    keys = ["vx", "vy", "vz"]
    v = points.withColumns({f"v{a}": F.floor(F.col(a) / float(width)).cast("bigint") for a in "xyz"})
    n = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    off = F.explode(F.array(*(F.struct(*(F.lit(o).alias(a) for o, a in zip(d, "xyz", strict=True))) for d in np.ndindex(3, 3, 3)))).alias("o")
    around = n.select(*keys, "n", off).groupBy(*((F.col(f"v{a}") + F.col(f"o.{a}") - 1).alias(f"v{a}") for a in "xyz")).agg(F.sum("n").alias("_n"))
    return v.join(around, keys).withColumn("_noise", F.col("_n") - 1 <= most)


def _lonely(points: DataFrame, radius: float, most: int) -> DataFrame:
    """Equal places are counted first; places meet those of the 27 cubes around, and each place's neighbours are counted by part before they are added up."""
    place = points.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n"))
    cells = ["cx", "cy", "cz"]
    p = place.withColumns({f"c{a}": F.floor(F.col(a) / float(radius)).cast("bigint") for a in "xyz"})
    off = F.explode(F.array(*(F.struct(*(F.lit(o - 1).alias(a) for o, a in zip(d, "xyz", strict=True))) for d in np.ndindex(3, 3, 3)))).alias("o")
    other = p.select(*(F.col(a).alias(f"{a}2") for a in "xyz"), F.col("n").alias("n2"), *cells, off).select("x2", "y2", "z2", "n2", *((F.col(f"c{a}") + F.col(f"o.{a}")).alias(f"c{a}") for a in "xyz"))
    near = sum(((F.col(a) - F.col(f"{a}2")) * (F.col(a) - F.col(f"{a}2")) for a in "xyz"), F.lit(0.0)) <= float(radius) ** 2
    met = split_join(p.drop("n"), other, cells, ["x", "y", "z"], ["x2", "y2", "z2"]).where(near)
    around = met.groupBy("x", "y", "z").agg((F.sum("n2") - 1).alias("_n"))
    return points.join(around, ["x", "y", "z"]).withColumn("_noise", F.col("_n") <= most)


#: How noise is told: by few points in the 27 cubes around (``width`` is a cube's), or within a distance (``width``).
NOISE_ALGORITHMS = {"voxels": _isolated, "radius": _lonely}


def classify_noise(points: DataFrame, width: float = 5.0, most: int = 6, algorithm: str = "voxels") -> DataFrame:
    """Class 7 for points with at most ``most`` others around, by one of NOISE_ALGORITHMS. Points without a place are left out."""
    out = NOISE_ALGORITHMS[algorithm](points.dropna(subset=["x", "y", "z"]), width, most)
    return out.withColumn("classification", F.when(F.col("_noise"), F.lit(NOISE)).otherwise(F.col("classification"))).select(*points.columns)


def remove_noise(points: DataFrame) -> DataFrame:
    return points.where(F.col("classification") != NOISE)


def normalized(points: DataFrame, dem: DataFrame, z_min: float = 0.0, z_max: float = 100.0, width: float = 1.0) -> DataFrame:
    """z above the ground of the containing cell, kept where z_min < z <= z_max; points off the DEM are dropped.

    The ground isn't interpolated between cells.
    """
    j = cell(points, width).join(dem.where(F.col("dem").isNotNull()).select("px", "py", "dem"), ["px", "py"])
    z = F.col("z") - F.col("dem")
    return j.where((z > float(z_min)) & (z <= float(z_max))).withColumn("z", z).drop("dem")


def presence(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whether any point is ground, a vegetation or building class, has colour, has intensity (where those columns are)."""
    k = F.col("classification")
    has = {"is_ground": k == 2, "is_full": k.isin(3, 4, 5, 6)}
    if {"r", "g", "b"} <= set(points.columns):
        has["is_rgb"] = F.greatest(*(F.coalesce(F.col(c), F.lit(0)) for c in "rgb")) > 0
    if "intensity" in points.columns:
        has["is_intensity"] = F.coalesce(F.col("intensity"), F.lit(0)) > 0
    return points.groupBy(*by).agg(*(F.coalesce(F.bool_or(v), F.lit(False)).alias(n) for n, v in has.items()))


def quality(files: DataFrame, points: DataFrame, checked: DataFrame) -> DataFrame:
    """Classes of the biggest file, whether it has colour, and the number of invalid files: one row.

    ``files`` is filename, size, status (Valid or an error's text) as read;
    ``checked`` is filename and status of earlier runs, which hold.
    """
    status = checked.select("filename", "status").unionByName(files.join(checked, "filename", "left_anti").select("filename", "status"))
    bad = status.agg(F.count_if(F.col("status") != "Valid").alias("invalid"), F.count(F.lit(1)).alias("files"))
    top = files.agg(F.max_by("filename", F.struct("size", "filename")).alias("biggest"))
    p = points.join(F.broadcast(top), points["filename"] == top["biggest"])
    seen = p.groupBy("biggest").agg(F.coalesce(F.bool_or(F.greatest("r", "g", "b") > 0), F.lit(False)).alias("has_rgb"), *(F.coalesce(F.bool_or(F.col("classification") == n), F.lit(False)).alias("has_" + k.lower().replace(" ", "_")) for k, n in CLASSES.items()))
    return seen.withColumns({"files": bad.select("files").scalar(), "invalid": bad.select("invalid").scalar()})


def _discs(points: DataFrame, radius: float) -> DataFrame:
    """Each point and eight places at the radius around it."""
    at = [(0.0, 0.0)] + [(radius * math.cos(k * math.pi / 4), radius * math.sin(k * math.pi / 4)) for k in range(8)]
    off = F.explode(F.array(*(F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i, j in at))).alias("o")
    return points.select("x", "y", "z", off).select((F.col("x") + F.col("o.x")).alias("x"), (F.col("y") + F.col("o.y")).alias("y"), "z")


def surface(points: DataFrame, width: float = 0.25, fill: float | None = None, grid: DataFrame | None = None, jittered: bool = False, algorithm: str = "highest", radius: float = 0.0) -> DataFrame:
    """Surface of the points by cell: px, py, z. With ``grid`` every cell of it, ``fill`` where there is no value.

    ``algorithm`` is 'highest', the greatest z in a cell; 'circle', the same
    with each point as a disc of ``radius``; or 'tin', the highest points of
    cells triangulated and read at the centres of the ``grid`` (tile_name, px,
    py), which it needs. Duplicates don't matter to a maximum.
    """
    if algorithm not in ("highest", "circle", "tin"):
        raise ValueError("algorithm must be 'highest', 'circle' or 'tin'")
    p = _discs(points, radius) if algorithm == "circle" else points
    if algorithm == "tin":
        top = cell(p, width).groupBy("px", "py").agg(F.max_by(F.struct("x", "y", "z"), "z").alias("p")).select(F.lit("").alias("tile_name"), "p.*")
        s = terrain(top, grid.select(F.lit("").alias("tile_name"), "px", "py"), width).select("px", "py", F.col("dem").alias("z"))
    else:
        s = cell(p, width).groupBy("px", "py").agg(F.max("z").alias("z"))
    if grid is not None:
        s = grid.select("px", "py").join(s, ["px", "py"], "left")
        if fill is not None:
            s = s.withColumn("z", F.coalesce("z", F.lit(float(fill))))
    return s.withColumn("z", jitter("z")) if jittered else s


def tiles_with_ground(points: DataFrame, least: int = 4) -> DataFrame:
    """Names of the tiles with at least ``least`` points of class 2, as delivered."""
    return points.where(F.col("classification") == 2).groupBy("tile_name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("tile_name")


def ground_points(points: DataFrame, classes: Sequence[int] = (2, 9)) -> DataFrame:
    """Ground and water points, duplicates removed."""
    return distinct_points(points.where(F.col("classification").isin(list(classes))))


def _curve(xy: np.ndarray) -> np.ndarray:
    """Order of the points along a curve that keeps neighbours near one another: bits of x and y in turn, rows back and forth."""
    low, span = xy.min(0), max(np.ptp(xy, axis=0).max(), 1e-300)
    k = max(1, int(math.sqrt(len(xy) / 4)))
    cell = np.minimum(((xy - low) / span * k).astype(np.int64), k - 1)
    back = np.where(cell[:, 1] % 2 == 0, xy[:, 0], -xy[:, 0])
    return np.lexsort((back, cell[:, 1]))


def _triangles(xy: np.ndarray) -> np.ndarray:
    """Delaunay triangles of distinct points.

    Points are inserted along a curve; each is found by a walk from the last
    one's triangle, and the triangles whose circle holds it give way to new
    ones. So a point costs a few steps, however many there are.
    """
    n = len(xy)
    if n < 3:
        return np.zeros((0, 3), np.int64)
    mid, size = (xy.min(0) + xy.max(0)) / 2, max(np.ptp(xy, axis=0).max(), 1e-9) * 1000
    x, y = ((xy[:, k] - mid[k]).tolist() + v for k, v in ((0, [-size, size, 0.0]), (1, [-size, -size, size])))
    # vertices counter-clockwise and the triangle across from each, three numbers a triangle; -1 is none
    tri, nbr, dead = [n, n + 1, n + 2], [-1, -1, -1], []
    at = 0
    for p in _curve(xy).tolist():
        qx, qy = x[p], y[p]
        came, steps = -1, 0
        while True:
            base = 3 * at
            for i in (0, 1, 2):
                to = nbr[base + i]
                if to == came or to < 0:
                    continue
                a, b = tri[base + (i + 1) % 3], tri[base + (i + 2) % 3]
                if (x[b] - x[a]) * (qy - y[a]) - (y[b] - y[a]) * (qx - x[a]) < 0:
                    break
            else:
                break
            came, at, steps = at, to, steps + 1
            if steps > 3 * len(tri):
                break
        # the cavity, and its border in turn: vertices and the triangle outside
        cavity, stack, border = {at}, [at], []
        while stack:
            t = stack.pop()
            for i in (0, 1, 2):
                o = nbr[3 * t + i]
                if o in cavity:
                    continue
                if o >= 0:
                    a, b, c = tri[3 * o], tri[3 * o + 1], tri[3 * o + 2]
                    ax, ay, bx, by, cx, cy = x[a] - qx, y[a] - qy, x[b] - qx, y[b] - qy, x[c] - qx, y[c] - qy
                    aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
                    u, v, w = aa * (bx * cy - cx * by), bb * (ax * cy - cx * ay), cc * (ax * by - bx * ay)
                    if u - v + w > 1e-13 * (abs(u) + abs(v) + abs(w)):
                        cavity.add(o)
                        stack.append(o)
                        continue
                border.append((tri[3 * t + (i + 1) % 3], tri[3 * t + (i + 2) % 3], o, t))
        # a triangle may have joined the cavity after its neighbour met it as the outside
        border = [e for e in border if e[2] not in cavity]
        if len({e[0] for e in border}) < len(border):
            # rounding left a border that isn't one ring: the triangle that holds the point will do
            cavity = {at}
            border = [(tri[3 * at + (i + 1) % 3], tri[3 * at + (i + 2) % 3], nbr[3 * at + i], at) for i in (0, 1, 2)]
        dead += cavity
        by_start = {}
        for a, b, o, t in border:
            if dead:
                k = dead.pop()
            else:
                k = len(tri) // 3
                tri += (0, 0, 0)
                nbr += (-1, -1, -1)
            tri[3 * k], tri[3 * k + 1], tri[3 * k + 2] = p, a, b
            nbr[3 * k] = o
            if o >= 0:
                # the side of the outer triangle that is across from its third vertex
                for i in (0, 1, 2):
                    if tri[3 * o + i] != a and tri[3 * o + i] != b:
                        nbr[3 * o + i] = k
            by_start[a] = k
        for k in by_start.values():
            # the next one around p starts where this one ends
            m = by_start[tri[3 * k + 2]]
            nbr[3 * k + 1], nbr[3 * m + 2] = m, k
        at = k
    got = np.array(tri, np.int64).reshape(-1, 3)
    keep = (got < n).all(1)
    keep[dead] = False
    got = got[keep]
    a, b, c = xy[got[:, 0]], xy[got[:, 1]], xy[got[:, 2]]
    # three points in a line make no triangle
    return got[np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) > 1e-12]


def _circles(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Centre and squared radius of each triangle's circle."""
    a = p[tri[:, 0]]
    b, c = p[tri[:, 1]] - a, p[tri[:, 2]] - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    bb, cc = (b * b).sum(1), (c * c).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.column_stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d])
    return np.column_stack([a + u, (u * u).sum(1)])


def tin_surface(x: np.ndarray, y: np.ndarray, z: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """z at the places by linear interpolation in the Delaunay triangle that holds each; NaN outside the hull."""
    xy = np.column_stack([x, y]).astype(float)
    return _interpolated(xy, z, _triangles(xy), px, py)[0]


def _interpolated(xy: np.ndarray, z: np.ndarray, tri: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """z at the places and the number of the triangle that holds each; NaN and -1 outside all.

    Places lie in a grid of about one each, and each triangle is tried for those in its bounds.
    """
    out, holder = np.full(len(px), np.nan), np.full(len(px), -1)
    if not len(px) or not len(tri):
        return out, holder
    x0, y0 = px.min(), py.min()
    w = max(math.sqrt(max(np.ptp(px) * np.ptp(py), 1e-18) / len(px)), np.ptp(px) / len(px), np.ptp(py) / len(px), 1e-9)
    nx, ny = int(np.ptp(px) / w) + 1, int(np.ptp(py) / w) + 1
    place = ((py - y0) / w).astype(np.int64) * nx + ((px - x0) / w).astype(np.int64)
    order = np.argsort(place, kind="stable")
    edge = np.searchsorted(place[order], np.arange(nx * ny + 1))
    corner = xy[tri]
    low, high = ((f(corner, 1) - [x0, y0]) / w for f in (np.min, np.max))
    i0, i1 = (np.clip(np.floor(v), -1, [nx, ny]).astype(np.int64) for v in (low, high))
    i0, i1 = np.maximum(i0, 0), np.minimum(i1, [nx - 1, ny - 1])
    rows = np.maximum(i1[:, 1] - i0[:, 1] + 1, 0) * (i1[:, 0] >= i0[:, 0])
    # a row of the grid is one stretch of places
    t = np.repeat(np.arange(len(tri)), rows)
    line = ranges(i0[:, 1], rows) * nx
    first, last = edge[line + i0[t, 0]], edge[line + i1[t, 0] + 1]
    for lo, hi in chunks(last - first):
        n = last[lo:hi] - first[lo:hi]
        of, k = np.repeat(t[lo:hi], n), order[ranges(first[lo:hi], n)]
        a, b, c = (corner[of, j] for j in (0, 1, 2))
        d = (b[:, 1] - c[:, 1]) * (a[:, 0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (a[:, 1] - c[:, 1])
        u = ((b[:, 1] - c[:, 1]) * (px[k] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (py[k] - c[:, 1])) / d
        v = ((c[:, 1] - a[:, 1]) * (px[k] - c[:, 0]) + (a[:, 0] - c[:, 0]) * (py[k] - c[:, 1])) / d
        hit = np.flatnonzero((u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9))
        zt = z[tri[of[hit]]]
        out[k[hit]] = u[hit] * zt[:, 0] + v[hit] * zt[:, 1] + (1 - u - v)[hit] * zt[:, 2]
        holder[k[hit]] = of[hit]
    return out, holder


def _within(circ: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Whether circles lie in the box: no point outside of it can be in them."""
    r = np.sqrt(circ[:, 2])
    return (circ[:, 0] - r >= box[0]) & (circ[:, 1] - r >= box[1]) & (circ[:, 0] + r <= box[2]) & (circ[:, 1] + r <= box[3])


def terrain(points: DataFrame, cells: DataFrame, width: float = 1.0, least: int = 4, block: int = 64, halo: int = 32, enough: DataFrame | None = None) -> DataFrame:
    """Bare earth of ``cells`` (tile_name, px, py) out of ground ``points`` (tile_name, x, y, z): a triangulated surface.

    A tile that isn't in ``enough`` (tile_name), or has fewer than ``least``
    distinct ground points where that isn't given, is null, and so are cells
    outside the hull. Points of all tiles count, so tiles make no
    seams; of points at one place the lowest, those of a null tile last. The surface is made in blocks of
    ``block`` cells with the points of ``halo`` more cells around. A cell is
    settled if the circle of its triangle lies in that window, as it then is a
    triangle of all points. The other cells, at gaps and edges, are made again
    tile by tile, with the points as far around the tile as its longer side, or
    ``block`` + ``halo`` cells if that is more. There only points at gaps and
    edges are needed: a point whose triangles all have circles of half the halo
    at most is in none that an unsettled cell could need.
    """
    if enough is None:
        enough = points.select("tile_name", "x", "y").distinct().groupBy("tile_name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("tile_name")
    p = points.join(enough.withColumn("_ok", F.lit(True)), "tile_name", "left").groupBy("x", "y").agg(F.coalesce(F.min(F.when(F.col("_ok"), F.col("z"))), F.min("z")).cast("double").alias("z"))
    for a in "xy":
        at = F.floor(F.col(a) / float(width))
        p = p.withColumn(f"b{a}", F.explode(F.sequence(F.floor((at - halo) / block), F.floor((at + halo) / block))))
    c = cells.select("tile_name", "px", "py").join(enough.withColumn("_ok", F.lit(True)), "tile_name", "left")
    c = c.withColumns({f"b{a}": F.floor(F.col(f"p{a}") / block) for a in "xy"})

    def one(key: tuple, p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        dem, settled = np.full(len(c), np.nan), c["_ok"].isna().to_numpy(bool)
        some = np.flatnonzero(~settled)
        keep = np.ones(len(p), bool)
        xy, z = p[["x", "y"]].to_numpy(float), p["z"].to_numpy(float)
        corner = np.array(key if len(p) == 0 else (p["bx"].iloc[0], p["by"].iloc[0]), float) * block
        if len(p) >= least and len(c):
            tri = _triangles(xy)
            circ = _circles(xy, tri)
            sure = _within(circ, (*((corner - halo) * width), *((corner + block + halo) * width)))
            dem[some], holder = _interpolated(xy, z, tri, (c["px"].to_numpy()[some] + 0.5) * width, (c["py"].to_numpy()[some] + 0.5) * width)
            settled[some] = (holder >= 0) & sure[holder] if len(tri) else False
            # a vertex with as many edges as triangles is inside the hull
            small = sure & (circ[:, 2] <= (halo * width / 2) ** 2)
            edges = np.unique(np.sort(np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]]), axis=1), axis=0)
            inside = np.bincount(tri.ravel(), minlength=len(xy)) == np.bincount(edges.ravel(), minlength=len(xy))
            keep = ~inside | (np.bincount(tri[~small].ravel(), minlength=len(xy)) > 0)
        keep &= (np.floor(xy / width) // block * block == corner).all(1)
        n, k = len(c), int(keep.sum())
        pad = lambda v, m, first: np.concatenate([v, np.full(m, np.nan)] if first else [np.full(m, np.nan), v])
        got = {"tile_name": np.concatenate([c["tile_name"].to_numpy(object), np.full(k, None, object)]), "settled": np.concatenate([settled, np.ones(k, bool)])}
        for a in ("px", "py"):
            got[a] = np.concatenate([c[a].to_numpy(np.int32), np.zeros(k, np.int32)])
        got["dem"] = pad(dem, k, True)
        got |= {a: pad(v[keep], n, False) for a, v in (("x", xy[:, 0]), ("y", xy[:, 1]), ("z", z))}
        got["point"] = np.arange(n + k) >= n
        return pd.DataFrame(got)

    columns = "tile_name string, settled boolean, px int, py int, dem double, x double, y double, z double, point boolean"
    first = materialize(p.groupBy("bx", "by").cogroup(c.groupBy("bx", "by")).applyInPandas(one, columns), "terrain")
    made = first.where(~F.col("point"))
    null = lambda d: F.when(~F.isnan(d), d).alias("dem")
    done = made.where("settled").select("tile_name", "px", "py", null(F.col("dem")))
    rest = made.where(~F.col("settled")).select("tile_name", "px", "py")
    # a row for each tile with unsettled cells and each block around it
    box = cells.groupBy("tile_name").agg(*(f(c).alias(f"{n}_{c}") for c in ("px", "py") for n, f in (("min", F.min), ("max", F.max)))).join(rest.select("tile_name").distinct(), "tile_name", "left_semi")
    box = box.withColumn("_m", F.greatest(F.col("max_px") - F.col("min_px") + 1, F.col("max_py") - F.col("min_py") + 1, F.lit(block + halo)))
    near = box
    for a in "xy":
        near = near.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(f"min_p{a}") - F.col("_m")) / block), F.floor((F.col(f"max_p{a}") + F.col("_m")) / block))))
    cell_of = {a: F.floor(F.col(a) / float(width)) for a in "xy"}
    q = first.where("point").select("x", "y", "z", *(F.floor(cell_of[a] / block).alias(f"b{a}") for a in "xy")).join(near, ["bx", "by"])
    for a in "xy":
        q = q.where(cell_of[a].between(F.col(f"min_p{a}") - F.col("_m"), F.col(f"max_p{a}") + F.col("_m")))

    def whole(key: tuple, p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        dem = np.full(len(c), np.nan)
        if len(p) >= 3 and len(c):
            dem = tin_surface(p["x"].to_numpy(), p["y"].to_numpy(), p["z"].to_numpy(float), (c["px"].to_numpy() + 0.5) * width, (c["py"].to_numpy() + 0.5) * width)
        return pd.DataFrame({"tile_name": c["tile_name"].to_numpy(object), "px": c["px"].to_numpy(np.int32), "py": c["py"].to_numpy(np.int32), "dem": dem})

    again = q.select("tile_name", "x", "y", "z").groupBy("tile_name").cogroup(rest.groupBy("tile_name")).applyInPandas(whole, "tile_name string, px int, py int, dem double")
    return done.unionByName(again.select("tile_name", "px", "py", null(F.col("dem"))))
