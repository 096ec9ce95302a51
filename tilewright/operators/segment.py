"""Treetops and segments out of pixel tables."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.raster import crop
from tilewright.plans.blocks import Block, over_blocks


def treetops(chm: DataFrame, radius: Callable[[Column], Column], most: float, least: float, band: str = "chm", tiles: DataFrame | None = None, width: float = 1.0) -> DataFrame:
    """Cells of height ``least`` or more with no higher cell within ``radius(height)`` cells: px, py, height.

    ``most`` is the greatest radius, and the halo of the blocks that cells are
    searched in, the nearest neighbours first: few cells need many. Equal
    neighbours are both tops unless the band is jittered. Null and NaN heights
    are no tops and overrule none. With a scheme of ``tiles``, tops in the
    ``nbuff`` of one, with its tile_name; tiles without a finite height have
    none, as there is nothing to search.
    """
    n = int(math.floor(most))
    off = sorted((i * i + j * j, i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if (i or j) and i * i + j * j <= most * most)
    kind = chm.schema[band].dataType
    h = F.col(band).cast("double")
    d = chm.where(F.col(band).isNotNull() & ~F.isnan(h)).select("px", "py", h.alias("h"), F.when(h >= least, F.least(radius(F.col(band)), F.lit(float(most)))).cast("double").alias("r"))

    def work(b: Block) -> pa.Table:
        h, r = b.grid("h"), b.grid("r")
        i, j = b.i[b.own], b.j[b.own]
        left = np.flatnonzero(~np.isnan(r[i, j]))
        i, j = i[left], j[left]
        own, reach = h[i, j], r[i, j] ** 2
        for d2, dx, dy in off:
            top = (reach < d2) | ~(h[i + dy, j + dx] > own)
            left, i, j, own, reach = left[top], i[top], j[top], own[top], reach[top]
        keep = np.zeros(len(b.own), bool)
        keep[left] = True
        return b.rows(["px", "py"], {"height": pa.array(b.at_own(h))}, keep)

    tops = over_blocks(d, ["h", "r"], n, work, "px int, py int, height double").withColumn("height", F.col("height").cast(kind))
    if tiles is None:
        return tops
    return crop(tops, tiles, "nbuff", width).select("tile_name", "px", "py", "height")


def watershed(height: np.ndarray, markers: np.ndarray, least: float) -> np.ndarray:
    """Marker number of each cell: regions grow from the markers downwards, the highest cell first, by four neighbours, over cells of ``least`` and more. Ties go to the region that was there first."""
    out = np.where(height >= least, markers, 0)
    heap = [(-height[i, j], k, i, j) for k, (i, j) in enumerate(zip(*np.nonzero(out), strict=True))]
    heapq.heapify(heap)
    k = len(heap)
    while heap:
        _, _, i, j = heapq.heappop(heap)
        for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
            if 0 <= a < height.shape[0] and 0 <= b < height.shape[1] and out[a, b] == 0 and height[a, b] >= least:
                out[a, b] = out[i, j]
                heapq.heappush(heap, (-height[a, b], k, a, b))
                k += 1
    return out


def crowns(chm: DataFrame, tops: DataFrame, least: float = 0.3, width: float = 1.0, band: str = "chm") -> DataFrame:
    """tile_name, px, py, tree_id of the cells of each tree's crown: a marker-controlled watershed by tile.

    ``chm`` and ``tops`` (tile_name, px, py, tree_id) hold each tile with its
    buffer; a tile must fit in a task. Cells below ``least`` or out of reach of
    a top are left out.
    """

    def one(key: tuple, c: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(t):
            return pd.DataFrame({"tile_name": np.array([], object), "px": np.array([], np.int32), "py": np.array([], np.int32), "tree_id": np.array([], np.int64)})
        x0, y0 = c["px"].min(), c["py"].min()
        h = np.full((c["py"].max() - y0 + 1, c["px"].max() - x0 + 1), -np.inf)
        h[c["py"] - y0, c["px"] - x0] = c[band].fillna(-np.inf)
        m = np.zeros(h.shape, np.int64)
        t = t[(t["px"] >= x0) & (t["py"] >= y0) & (t["px"] < x0 + h.shape[1]) & (t["py"] < y0 + h.shape[0])].sort_values("tree_id", ascending=False).reset_index(drop=True)
        m[t["py"] - y0, t["px"] - x0] = np.arange(len(t)) + 1
        got = watershed(h, m, least)
        i, j = np.nonzero(got)
        return pd.DataFrame({"tile_name": key[0], "px": (j + x0).astype(np.int32), "py": (i + y0).astype(np.int32), "tree_id": t["tree_id"].to_numpy()[got[i, j] - 1]})

    cells = chm.select("tile_name", "px", "py", F.col(band).cast("double").alias(band)).groupBy("tile_name")
    return cells.cogroup(tops.select("tile_name", "px", "py", F.col("tree_id").cast("bigint").alias("tree_id")).groupBy("tile_name")).applyInPandas(one, "tile_name string, px int, py int, tree_id bigint")


def crown_table(cells: DataFrame, tops: DataFrame, width: float = 1.0) -> DataFrame:
    """tile_name, tree_id, height of the top and crown_area of each tree."""
    area = cells.groupBy("tile_name", "tree_id").agg((F.count(F.lit(1)) * F.lit(float(width) ** 2)).alias("crown_area"))
    return area.join(tops.select("tile_name", F.col("tree_id").cast("bigint").alias("tree_id"), "height"), ["tile_name", "tree_id"])


def tile_crowns(chm: DataFrame, tops: DataFrame, tiles: DataFrame, least: float = 0.3, width: float = 1.0, band: str = "chm") -> DataFrame:
    """The crown table of each tile of a scheme: crowns of its buffered area, where the buffer's tops compete, then those whose top lies in its nbuff.

    ``chm`` and ``tops`` (px, py, tree_id, height) hold each cell and top once.
    """
    cells = crowns(crop(chm.select("px", "py", band), tiles, "buff", width), crop(tops.select("px", "py", "tree_id"), tiles, "buff", width), least, width, band)
    return crown_table(cells, crop(tops, tiles, "nbuff", width), width)


def mean_shift(values: np.ndarray, there: np.ndarray, spatial: float, spectral: float, smallest: int, rounds: int = 100, tolerance: float = 0.1) -> tuple[np.ndarray, int]:
    """Segment numbers 1.. of a (rows, columns, bands) image, 0 where there is nothing, and how many cells had not settled after ``rounds``.

    Each cell starts a window at its place and colour, which moves to the mean
    place and colour of the cells within ``spatial`` of the one and
    ``spectral`` of the other, until it moves by less than ``tolerance``, by the
    sum of both distances. Four-neighbours whose windows end within both distances
    of one another join; segments below ``smallest`` join the neighbour with the
    nearest mean colour, the smallest first.
    """
    rows, cols, bands = values.shape
    n = int(math.ceil(spatial))
    off = [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1)]
    # place and colour of every cell, with a rim of nothing around the image
    wide = cols + 2 * (n + 1)
    pad = np.full((rows + 2 * (n + 1), wide, 2 + bands), np.nan)
    y, x = np.mgrid[:rows, :cols]
    inner = pad[n + 1 : n + 1 + rows, n + 1 : n + 1 + cols]
    inner[...] = np.where(there[..., None], np.concatenate([np.stack([y, x], -1), values], -1), np.nan)
    flat = pad.reshape(-1, 2 + bands)
    cells = np.flatnonzero(there.ravel())
    mode = inner.reshape(-1, 2 + bands)[cells]
    live = np.arange(len(cells))
    for _ in range(rounds):
        if not len(live):
            break
        at = mode[live]
        middle = (np.floor(at[:, 0] + 0.5).astype(np.int64) + n + 1) * wide + np.floor(at[:, 1] + 0.5).astype(np.int64) + n + 1
        total, count = np.zeros_like(at), np.zeros(len(at))
        for i, j in off:
            v = flat[middle + i * wide + j]
            d = (v - at) ** 2
            with np.errstate(invalid="ignore"):
                ok = (d[:, 0] + d[:, 1] <= spatial * spatial) & (d[:, 2:].sum(1) <= spectral * spectral)
            total[ok] += v[ok]
            count += ok
        new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], at)
        mode[live] = new
        live = live[np.sqrt(((new - at)[:, :2] ** 2).sum(1)) + np.sqrt(((new - at)[:, 2:] ** 2).sum(1)) >= tolerance]
    idx = np.full(rows * cols, -1)
    idx[cells] = np.arange(len(cells))
    idx = idx.reshape(rows, cols)
    pairs = np.concatenate([np.column_stack([idx[:, :-1].ravel(), idx[:, 1:].ravel()]), np.column_stack([idx[:-1].ravel(), idx[1:].ravel()])])
    pairs = pairs[(pairs >= 0).all(1)]
    d = (mode[pairs[:, 0]] - mode[pairs[:, 1]]) ** 2
    near = (d[:, :2].sum(1) <= spatial * spatial) & (d[:, 2:].sum(1) <= spectral * spectral)
    label = joined(len(cells), pairs[near])
    label = merged_small(label, pairs, values.reshape(-1, bands)[cells], smallest)
    out = np.zeros(rows * cols, np.int64)
    out[cells] = np.unique(label, return_inverse=True)[1] + 1
    return out.reshape(rows, cols), len(live)


def joined(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest of each cell's component under the pairs."""
    parent = np.arange(n)
    a, b = pairs[:, 0], pairs[:, 1]
    while len(a):
        x, y = parent[a], parent[b]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
    return parent


def merged_small(label: np.ndarray, pairs: np.ndarray, values: np.ndarray, smallest: int) -> np.ndarray:
    """Labels after segments below ``smallest`` have joined the neighbour with the nearest mean, the smallest first.

    Sizes, sums and neighbours are kept by segment, so a merge costs what its
    neighbours number. A segment without neighbours stays.
    """
    ids, of = np.unique(label, return_inverse=True)
    size = np.bincount(of, minlength=len(ids)).astype(float)
    total = np.column_stack([np.bincount(of, v, len(ids)) for v in values.T])
    ab = of[pairs]
    ab = np.unique(np.sort(ab[ab[:, 0] != ab[:, 1]], axis=1), axis=0)
    beside: dict[int, set[int]] = {}
    for a, b in ab.tolist():
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    into = np.arange(len(ids))
    heap = [(size[k], k) for k in np.flatnonzero(size < smallest).tolist()]
    heapq.heapify(heap)
    while heap:
        n, s = heapq.heappop(heap)
        if into[s] != s or n != size[s] or not beside.get(s):
            continue
        around = sorted(beside[s])
        means = total[around] / size[around][:, None]
        k = around[int(((means - total[s] / size[s]) ** 2).sum(1).argmin())]
        into[s] = k
        size[k] += size[s]
        total[k] += total[s]
        for o in beside.pop(s):
            beside[o].discard(s)
            if o != k:
                beside[o].add(k)
                beside[k].add(o)
        if size[k] < smallest:
            heapq.heappush(heap, (size[k], k))
    while not np.array_equal(up := into[into], into):
        into = up
    return into[of]


def mean_shift_segments(pixels: DataFrame, bands: Sequence[str], spatial: float = 19.5, spectral: float = 17.0, smallest: int = 40, rounds: int = 100) -> DataFrame:
    """tile_name, px, py, poly_id, unsettled: mean-shift segments by tile. A cell with a null band belongs to none. A tile must fit in a task.

    ``unsettled`` is how many of the tile's windows still moved after ``rounds``, normally none.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = pdf["px"].min(), pdf["py"].min()
        v = np.full((pdf["py"].max() - y0 + 1, pdf["px"].max() - x0 + 1, len(bands)), np.nan)
        v[pdf["py"] - y0, pdf["px"] - x0] = pdf[list(bands)]
        there = ~np.isnan(v).any(-1)
        got, unsettled = mean_shift(np.nan_to_num(v), there, spatial, spectral, smallest, rounds)
        i, j = np.nonzero(got)
        return pd.DataFrame({"tile_name": pdf["tile_name"].iloc[0], "px": (j + x0).astype(np.int32), "py": (i + y0).astype(np.int32), "poly_id": got[i, j].astype(np.int32), "unsettled": np.int32(unsettled)})

    return pixels.select("tile_name", "px", "py", *(F.col(b).cast("double").alias(b) for b in bands)).groupBy("tile_name").applyInPandas(one, "tile_name string, px int, py int, poly_id int, unsettled int")
