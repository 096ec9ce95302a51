"""Well-known binary: points and polygons out of any of its encodings.

Read are both byte orders, ISO and extended (flagged) heights and measures,
and extended SRIDs. Heights and measures are ignored.
"""

from __future__ import annotations

import struct
from collections import defaultdict

import numpy as np

_POINT, _POLYGON, _MULTIPOINT, _MULTIPOLYGON = 1, 3, 4, 6


def _head(b: bytes, at: int) -> tuple[str, int, int, int] | None:
    """Byte order, kind, numbers a vertex and the offset of the body; None if this is no header."""
    if len(b) < at + 5 or b[at] > 1:
        return None
    e = "<" if b[at] else ">"
    (t,) = struct.unpack_from(e + "I", b, at + 1)
    dims = 2 + bool(t & 0x80000000) + bool(t & 0x40000000)
    start = at + 5 + 4 * bool(t & 0x20000000)
    iso, kind = divmod(t & 0x0FFFFFFF, 1000)
    if iso > 3:
        return None
    return e, kind, max(dims, (2, 3, 3, 4)[iso]), start


def read_points(blobs: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """x and y of each blob; NaN where it holds no readable, non-empty, finite single point.

    A multipoint of one point is that point. Blobs with the same first bytes
    and length are decoded together.
    """
    n = len(blobs)
    x, y = np.full(n, np.nan), np.full(n, np.nan)
    alike: dict[tuple[int, bytes], list[int]] = defaultdict(list)
    for i, b in enumerate(blobs):
        if b is not None and len(b) >= 21:
            # the kind and, in a multipoint, its count and its member's header as well
            alike[len(b), b[:18] if b[1 if b[0] else 4] == _MULTIPOINT else b[:5]].append(i)
    for (size, _), rows in alike.items():
        where = _place(blobs[rows[0]])
        if where is None:
            continue
        e, at = where
        raw = np.frombuffer(b"".join(blobs[i] for i in rows), np.uint8).reshape(len(rows), size)
        xy = np.ascontiguousarray(raw[:, at : at + 16]).view(e + "f8")
        x[rows], y[rows] = xy[:, 0], xy[:, 1]
    bad = ~(np.isfinite(x) & np.isfinite(y))
    x[bad] = y[bad] = np.nan
    return x, y


def _place(b: bytes) -> tuple[str, int] | None:
    """Byte order and offset of a single point's coordinates."""
    h = _head(b, 0)
    if h is None:
        return None
    e, kind, dims, at = h
    if kind == _MULTIPOINT:
        if len(b) < at + 4 or struct.unpack_from(e + "I", b, at)[0] != 1 or (h := _head(b, at + 4)) is None:
            return None
        e, kind, dims, at = h
    return (e, at) if kind == _POINT and len(b) >= at + 8 * dims else None


def read_polygon(b: bytes | None) -> tuple[np.ndarray, np.ndarray, list[int]] | None:
    """x, y and the end of each ring; None if there is no readable polygon with an area's worth of vertices.

    The rings of a multipolygon's parts follow one another; the even-odd rule
    over all rings is inside an outline and outside its holes. Outlines are
    turned counter-clockwise, holes clockwise.
    """
    if b is None:
        return None
    rings: list[np.ndarray] = []
    try:
        if _rings(b, 0, rings) is None or not rings:
            return None
    except (struct.error, ValueError):
        return None
    xy = np.concatenate(rings)
    if not np.isfinite(xy).all():
        return None
    return xy[:, 0], xy[:, 1], np.cumsum([len(r) for r in rings]).tolist()


def read_polygons(blobs: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """Numbers of the blobs that :func:`read_polygon` reads, and of these x and y of all vertices, how many each has, and the ends of its rings.

    Polygons of one ring with the same first bytes and length are decoded together.
    """
    got: list[tuple[np.ndarray, list[int]] | None] = [None] * len(blobs)
    alike: dict[tuple[int, bytes], list[int]] = defaultdict(list)
    for i, b in enumerate(blobs):
        if b is not None and len(b) >= 17:
            # an SRID, if flagged, lies between the kind and the numbers of rings and vertices
            alike[len(b), b[:5] + (b[9:17] if b[4 if b[0] else 1] & 0x20 else b[5:13])].append(i)
    for (size, _), rows in alike.items():
        b = blobs[rows[0]]
        h = _head(b, 0)
        k = 0
        if h is not None and h[1] == _POLYGON and len(b) >= h[3] + 8:
            e, _, dims, at = h
            n, k = struct.unpack_from(e + "2I", b, at)
            k = k if n == 1 and k >= 3 and size >= at + 8 + 8 * dims * k else 0
        if not k:
            for i in rows:
                one = read_polygon(blobs[i])
                if one is not None:
                    got[i] = np.column_stack(one[:2]), one[2]
            continue
        raw = np.frombuffer(b"".join(blobs[i] for i in rows), np.uint8).reshape(len(rows), size)
        xy = np.ascontiguousarray(raw[:, at + 8 : at + 8 + 8 * dims * k]).view(e + "f8").reshape(len(rows), k, dims)[:, :, :2].astype(float)
        good = np.isfinite(xy).all((1, 2))
        turned = _area(xy) < 0
        xy[turned] = xy[turned, ::-1]
        for i, v, ok in zip(rows, xy, good.tolist(), strict=True):
            got[i] = (v, [k]) if ok else None
    rows = np.array([i for i, g in enumerate(got) if g is not None], np.int64)
    flat = np.concatenate([got[i][0] for i in rows]) if len(rows) else np.zeros((0, 2))
    return rows, flat[:, 0], flat[:, 1], np.array([len(got[i][0]) for i in rows], np.int64), [got[i][1] for i in rows]


def _area(xy: np.ndarray) -> np.ndarray:
    """Signed areas of closed rings (the last two axes: vertices, coordinates)."""
    p = xy - xy[..., :1, :]
    q = np.roll(p, -1, axis=-2)
    with np.errstate(invalid="ignore", over="ignore"):
        return (p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]).sum(-1) / 2


def _rings(b: bytes, at: int, into: list[np.ndarray]) -> int | None:
    h = _head(b, at)
    if h is None:
        return None
    e, kind, dims, at = h
    (n,) = struct.unpack_from(e + "I", b, at)
    at += 4
    if kind == _MULTIPOLYGON:
        for _ in range(n):
            at = _rings(b, at, into)
            if at is None:
                return None
        return at
    if kind != _POLYGON:
        return None
    for i in range(n):
        (k,) = struct.unpack_from(e + "I", b, at)
        at += 4
        if len(b) < at + 8 * dims * k:
            return None
        if k >= 3:
            ring = np.frombuffer(b, e + "f8", k * dims, at).reshape(k, dims)[:, :2].astype("f8")
            into.append(ring[::-1] if (_area(ring) < 0) == (i == 0) else ring)
        at += 8 * dims * k
    return at
