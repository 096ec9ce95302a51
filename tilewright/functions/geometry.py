"""Plane geometry of polygons in numpy, for batches of rows.

A polygon is its rings, one after another, under the even-odd rule: outlines run
counter-clockwise, holes clockwise, whether or not the first vertex is repeated
at a ring's end. In tables these are ``xs`` and ``ys`` of all vertices and
``ends`` of the rings. What has no edge in common is decided exactly as
floating point allows; predicates are closed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Pairs of edges that are held in memory at a time.
CHUNK = 2_000_000


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of ``n`` numbers each, one range after another."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - n), n)


class Rings:
    """The polygons of a batch, a row each."""

    def __init__(self, xs: pa.ListArray, ys: pa.ListArray, ends: pa.ListArray) -> None:
        self.n = np.diff(xs.offsets.to_numpy()).astype(np.int64)
        self.x, self.y = xs.flatten().to_numpy(), ys.flatten().to_numpy()
        self.first = np.cumsum(self.n) - self.n
        rings = np.diff(ends.offsets.to_numpy())
        self.ring_row = np.repeat(np.arange(len(self.n)), rings)
        self.stop = ends.flatten().to_numpy() + self.first[self.ring_row]
        self.start = np.concatenate(([0], self.stop[:-1])) if len(self.stop) else self.stop
        #: the vertex after each; at a ring's end its first
        self.next = np.arange(1, len(self.x) + 1)
        self.next[self.stop - 1] = self.start
        self.row = np.repeat(np.arange(len(self.n)), self.n)

    @classmethod
    def of(cls, b: pa.RecordBatch, suffix: str = "") -> Rings:
        return cls(*(b.column(c + suffix) for c in ("xs", "ys", "ends")))

    def rings(self, row: int) -> list[np.ndarray]:
        """The row's rings as arrays of x and y."""
        lo, hi = np.searchsorted(self.ring_row, [row, row + 1])
        return [np.column_stack([self.x[a:z], self.y[a:z]]) for a, z in zip(self.start[lo:hi].tolist(), self.stop[lo:hi].tolist(), strict=True)]

    def moments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Area, and x and y of the centroid, of each row, holes left out; NaN for the centroid of no area."""
        # from each row's first vertex, so that far-away coordinates lose nothing
        ox, oy = self.x[self.first], self.y[self.first]
        x, y = self.x - ox[self.row], self.y - oy[self.row]
        x2, y2 = x[self.next], y[self.next]
        w = x * y2 - x2 * y
        total = lambda v: np.bincount(self.row, v, len(self.n))
        area = total(w) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            return area, ox + total((x + x2) * w) / (6 * area), oy + total((y + y2) * w) / (6 * area)

    def holds(self, row: np.ndarray, px: np.ndarray, py: np.ndarray, closed: bool = False) -> np.ndarray:
        """Whether each place is inside the polygon of its row, or, if ``closed``, within a billionth of its lines."""
        out = np.zeros(len(row), bool)
        for a, z in chunks(self.n[row]):
            r, qx, qy = row[a:z], px[a:z], py[a:z]
            who, e = np.repeat(np.arange(z - a), self.n[r]), ranges(self.first[r], self.n[r])
            vx, vy, x2, y2 = self.x[e], self.y[e], self.x[self.next[e]], self.y[self.next[e]]
            qx, qy = qx[who], qy[who]
            cross = (vy > qy) != (y2 > qy)
            with np.errstate(divide="ignore", invalid="ignore"):
                left = qx < (x2 - vx) * (qy - vy) / (y2 - vy) + vx
            got = np.bincount(who[cross & left], minlength=z - a) % 2 == 1
            if closed:
                dx, dy = x2 - vx, y2 - vy
                size = np.maximum(np.abs(dx), np.abs(dy))
                far = np.abs(dx * (qy - vy) - dy * (qx - vx)) > 1e-9 * size * np.maximum(size, 1)
                along = (np.minimum(vx, x2) <= qx) & (qx <= np.maximum(vx, x2)) & (np.minimum(vy, y2) <= qy) & (qy <= np.maximum(vy, y2))
                got |= np.bincount(who[along & ~far], minlength=z - a) > 0
            out[a:z] = got
        return out

    def spans(self, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, py, and px from (in) and to (out) of the runs of cells whose centres are inside, half-open."""
        x2, y2 = self.x[self.next], self.y[self.next]
        low, high = (np.ceil(f(self.y, y2) / width - 0.5).astype(np.int64) for f in (np.minimum, np.maximum))
        e = np.repeat(np.arange(len(self.x)), high - low)
        py = ranges(low, high - low)
        at = self.x[e] + ((py + 0.5) * width - self.y[e]) * (x2[e] - self.x[e]) / (y2[e] - self.y[e])
        order = np.lexsort((at, py, self.row[e]))
        row, py, px = self.row[e][order][::2], py[order][::2], np.ceil(at[order] / width - 0.5).astype(np.int64)
        some = px[::2] < px[1::2]
        return row[some], py[some], px[::2][some], px[1::2][some]


def chunks(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about CHUNK."""
    if not len(sizes):
        return []
    part = np.cumsum(sizes) // CHUNK
    cut = np.flatnonzero(np.diff(part)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(sizes)], strict=True))


def meet(a: Rings, b: Rings) -> np.ndarray:
    """Whether the polygons of each row have a point in common: edges that cross or touch, or one within the other."""
    out = np.zeros(len(a.n), bool)
    pairs = a.n * b.n
    for lo, hi in chunks(pairs):
        n = pairs[lo:hi]
        row, k = np.repeat(np.arange(lo, hi), n), ranges(np.zeros(hi - lo, np.int64), n)
        i, j = a.first[row] + k // b.n[row], b.first[row] + k % b.n[row]
        ax, ay, bx, by = a.x[i], a.y[i], a.x[a.next[i]], a.y[a.next[i]]
        cx, cy, dx, dy = b.x[j], b.y[j], b.x[b.next[j]], b.y[b.next[j]]
        side = lambda px, py, qx, qy, rx, ry: np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))
        near = (np.minimum(ax, bx) <= np.maximum(cx, dx)) & (np.minimum(cx, dx) <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= np.maximum(cy, dy)) & (np.minimum(cy, dy) <= np.maximum(ay, by))
        near &= side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) <= 0
        near &= side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) <= 0
        out[row[near]] = True
    # without a common edge point every ring lies in one face of the other polygon
    for p, q in ((a, b), (b, a)):
        some = ~out[p.ring_row]
        row, v = p.ring_row[some], p.start[some]
        out[row[q.holds(row, p.x[v], p.y[v])]] = True
    return out


def _opened(ring: np.ndarray) -> np.ndarray:
    return ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring


def ring_area(r: np.ndarray) -> float:
    """Positive if counter-clockwise."""
    p = r - r[0]
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def half_plane(rings: list[np.ndarray], axis: int, limit: float, sign: int) -> list[np.ndarray]:
    """What lies at or below the limit of a coordinate (at or above it if ``sign`` is -1).

    Each ring is cut into the chains that are inside. Along the cut, the
    polygon's inside begins and ends at every second crossing of all rings, so
    a chain goes on at the crossing that shares its stretch.
    """
    out, chains = [], []
    for r in rings:
        inside = sign * (r[:, axis] - limit) <= 0
        if inside.all():
            out.append(r)
            continue
        enter, leave = np.flatnonzero(~inside & np.roll(inside, -1)), np.flatnonzero(inside & ~np.roll(inside, -1))
        if not len(enter):
            continue
        if leave[0] < enter[0]:
            leave = np.roll(leave, -1)

        def cut(i: int, r: np.ndarray = r) -> np.ndarray:
            p, q = r[i], r[(i + 1) % len(r)]
            c = p + (q - p) * ((limit - p[axis]) / (q[axis] - p[axis]))
            c[axis] = limit
            return c

        for i, j in zip(enter.tolist(), leave.tolist(), strict=True):
            at = np.arange(i + 1, (j if j > i else j + len(r)) + 1) % len(r)
            chains.append(np.vstack([cut(i)[None], r[at], cut(j)[None]]))
    if not chains:
        return out
    other = 1 - axis
    t = np.array([[c[0, other], c[-1, other]] for c in chains]).ravel()
    order = np.argsort(t, kind="stable")
    mate = np.empty(len(t), np.int64)
    mate[order[::2]], mate[order[1::2]] = order[1::2], order[::2]
    after = mate[1::2]
    if (after % 2).any():
        # crossings in one place, as of spikes: each ring is closed along the cut by itself
        return out + chains
    left = set(range(len(chains)))
    while left:
        k = first = min(left)
        ring = []
        while k in left:
            left.discard(k)
            ring.append(chains[k])
            k = int(after[k]) // 2
        out.append(np.vstack(ring)) if k == first else out.extend(ring)
    return out


def clip(rings: list[np.ndarray], box: tuple[float, float, float, float]) -> list[np.ndarray]:
    """The rings within a box minx, miny, maxx, maxy."""
    out = [_opened(r) for r in rings]
    for axis, limit, sign in ((0, box[0], -1), (1, box[1], -1), (0, box[2], 1), (1, box[3], 1)):
        out = half_plane(out, axis, limit, sign)
    return out


def parts(rings: list[np.ndarray], least: float = 1e-9) -> list[list[np.ndarray]]:
    """The single polygons: each outline with its holes. Rings of an area up to ``least`` are dropped."""
    rings = [_opened(r) for r in rings]
    areas = [ring_area(r) for r in rings]
    out = [[r] for r, a in zip(rings, areas, strict=True) if a > least]
    sizes = [a for a in areas if a > least]
    for r, a in zip(rings, areas, strict=True):
        if a < -least:
            # the smallest outline around it
            around = [(s, k) for k, s in enumerate(sizes) if s >= -a * (1 - 1e-9) and _within(r, out[k][0])]
            if around:
                out[min(around)[1]].append(r)
    return out


def _within(r: np.ndarray, outline: np.ndarray) -> bool:
    """Whether most vertices of a ring are in an outline that it doesn't cross."""
    a, b = outline, np.roll(outline, -1, axis=0)
    x, y = r[:, :1], r[:, 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = ((a[:, 1] > y) != (b[:, 1] > y)) & (x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0])
    return (hit.sum(1) % 2 == 1).mean() >= 0.5
