"""Cells in square blocks with a halo, for windows that numpy slides over arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells along a block's side.
SIDE = 256


class Block:
    """A block's rows in ``columns`` and where they lie in a dense array of the block and its halo."""

    def __init__(self, table: pa.Table, halo: int, side: int) -> None:
        self.table = table
        bx, by = table["_bx"][0].as_py(), table["_by"][0].as_py()
        self.halo, self.shape = halo, (side + 2 * halo,) * 2
        px, py = (table[c].to_numpy() for c in ("px", "py"))
        self.i, self.j = py - (by * side - halo), px - (bx * side - halo)
        #: rows of the block itself
        self.own = np.flatnonzero((self.i >= halo) & (self.i < halo + side) & (self.j >= halo) & (self.j < halo + side))

    def grid(self, column: str) -> np.ndarray:
        """The column as an array of doubles, NaN where a cell or its value is missing."""
        out = np.full(self.shape, np.nan)
        out[self.i, self.j] = self.table[column].to_numpy().astype(float)
        return out

    def there(self) -> np.ndarray:
        """Whether there is a row for each cell."""
        out = np.zeros(self.shape, bool)
        out[self.i, self.j] = True
        return out

    def at_own(self, grid: np.ndarray) -> np.ndarray:
        """The values at the block's own rows."""
        return grid[self.i[self.own], self.j[self.own]]

    def rows(self, columns: Sequence[str], made: dict[str, pa.Array], keep: np.ndarray | None = None) -> pa.Table:
        """The block's own rows with some of their columns and new ones, those of ``keep`` only."""
        own = self.table.select(list(columns)).take(pa.array(self.own))
        for name, v in made.items():
            own = own.append_column(name, v)
        return own if keep is None else own.filter(pa.array(keep))


def over_blocks(df: DataFrame, columns: Sequence[str], halo: int, work: Callable[[Block], pa.Table], schema: str, side: int = SIDE) -> DataFrame:
    """``work`` on each block of ``side`` cells with ``halo`` more around it.

    A row (px, py, ``columns``; each cell once) is shuffled once, and once more
    for each neighbouring block that it is in the halo of: (1 + 2 halo / side)
    squared times on average. A block is bounded, so no task is large. Blocks
    that hold no row of their own, only a halo, give nothing.
    """
    side = max(side, 4 * halo)
    d = df.select("px", "py", *columns)
    for a in "xy":
        lo, hi = F.floor((F.col(f"p{a}") - halo) / side), F.floor((F.col(f"p{a}") + halo) / side)
        d = d.withColumn(f"_b{a}", F.explode(F.sequence(lo, hi)) if halo else lo)

    def run(table: pa.Table) -> pa.Table:
        return work(Block(table.combine_chunks(), halo, side))

    return d.groupBy("_bx", "_by").applyInArrow(run, schema)


def shifted(grid: np.ndarray, dx: int, dy: int, fill: float = np.nan) -> np.ndarray:
    """At each cell the value dx cells to the right and dy up."""
    out = np.full(grid.shape, fill, grid.dtype)
    h, w = grid.shape
    if abs(dx) < w and abs(dy) < h:
        out[max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)] = grid[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)]
    return out


def extreme(grid: np.ndarray, radius: float, how: str) -> np.ndarray:
    """Least ("min") or greatest ("max") value within a circle, NaN left out.

    The circle is a run of cells in each row; runs are made of two overlapping
    ones of a power of two, so a circle costs as many steps as it has rows.
    """
    pick, none = (np.minimum, np.inf) if how == "min" else (np.maximum, -np.inf)
    n = int(radius)
    v = np.pad(np.where(np.isnan(grid), none, grid), n, constant_values=none)
    runs = [v]
    while 2 ** len(runs) <= 2 * n + 1:
        k = 2 ** (len(runs) - 1)
        last = runs[-1]
        runs.append(np.concatenate([pick(last[:, :-k], last[:, k:]), np.full((len(last), k), none)], axis=1))
    h, w = grid.shape
    out = np.full(grid.shape, none)
    for dy in range(-n, n + 1):
        half = int(np.sqrt(radius * radius - dy * dy) + 1e-9)
        size = 2 * half + 1
        k = size.bit_length() - 1
        rows = slice(n + dy, n + dy + h)
        pick(out, runs[k][rows, n - half : n - half + w], out=out)
        end = n + half - 2**k + 1
        pick(out, runs[k][rows, end : end + w], out=out)
    return np.where(np.isinf(out), np.nan, out)
