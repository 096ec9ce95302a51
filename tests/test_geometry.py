import math

import numpy as np
import pyarrow as pa
import pytest

from tilewright.functions import geometry as g
from tilewright.functions.wkb import read_polygon, read_polygons

RNG = np.random.default_rng(0)


def star(x, y, n, low, high):
    """A polygon around (x, y), convex or not, counter-clockwise."""
    a = np.sort(RNG.uniform(0, 2 * math.pi, n))
    r = RNG.uniform(low, high, n)
    return np.column_stack([x + r * np.cos(a), y + r * np.sin(a)])


def rings_of(polys):
    flat = [np.concatenate(p) for p in polys]
    at = np.concatenate(([0], np.cumsum([len(f) for f in flat]))).astype(np.int32)
    xy = np.concatenate(flat)
    lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(xy[:, k]))) for k in (0, 1)]
    return g.Rings(*lists, pa.array([np.cumsum([len(r) for r in p]).tolist() for p in polys], pa.list_(pa.int32())))


def some(n):
    out = []
    for _ in range(n):
        x, y = RNG.uniform(-5, 5, 2)
        p = [star(x, y, int(RNG.integers(5, 12)), 2, 5)]
        if RNG.random() < 0.5:
            p.append(star(x, y, 6, 0.3, 0.6)[::-1])
        out.append(p)
    return out


def even_odd(p, x, y):
    inside = np.zeros(np.shape(x), bool)
    for r in p:
        for (ax, ay), (bx, by) in zip(r, np.roll(r, -1, axis=0), strict=True):
            if ay != by:
                inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside


def test_area_and_centroid():
    square = np.array([[1e6, 5e6], [1e6 + 4, 5e6], [1e6 + 4, 5e6 + 4], [1e6, 5e6 + 4]])
    hole = (square[::-1] - [1e6, 5e6]) / 4 + [1e6 + 2, 5e6 + 2]
    r = rings_of([[square], [square, hole], [np.vstack([square, square[:1]])]])
    area, x, y = r.moments()
    assert area.tolist() == [16, 15, 16]
    assert x - 1e6 == pytest.approx([2, (16 * 2 - 2.5) / 15, 2]) and y - 5e6 == pytest.approx([2, (16 * 2 - 2.5) / 15, 2])


def test_clip_keeps_what_is_in_the_box():
    px, py = (v.ravel() for v in np.meshgrid(np.linspace(-9, 9, 91) + 0.013, np.linspace(-9, 9, 91) + 0.017))
    for p in some(60):
        box = (*RNG.uniform(-4, 0, 2), *RNG.uniform(0, 4, 2))
        got = g.clip(p, box)
        want = even_odd(p, px, py) & (px >= box[0]) & (py >= box[1]) & (px <= box[2]) & (py <= box[3])
        assert (even_odd(got, px, py) == want).all()
        # as single polygons they cover the same places, each once, and areas are right
        single = g.parts(got)
        assert (sum(even_odd(s, px, py).astype(int) for s in single) == want).all() if single else not want.any()
        assert sum(g.ring_area(r) for r in got) == pytest.approx(sum(g.ring_area(r) for s in single for r in s), abs=1e-6)
        assert all(g.ring_area(s[0]) > 0 and all(g.ring_area(r) < 0 for r in s[1:]) for s in single)


def test_clip_of_a_comb_gives_its_teeth():
    comb = np.array([[0, 0], [7, 0], [7, 5], [6, 5], [6, 1], [5, 1], [5, 5], [4, 5], [4, 1], [3, 1], [3, 5], [2, 5], [2, 1], [1, 1], [1, 5], [0, 5]], float)
    got = g.parts(g.clip([comb], (-1, 2, 8, 9)))
    assert sorted(g.ring_area(p[0]) for p in got) == [3, 3, 3, 3]
    # a ring that crosses the cut through its hole is one piece; touching the box from outside gives nothing
    frame = [np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float), np.array([[1, 1], [1, 3], [3, 3], [3, 1]], float)]
    assert [(len(p), g.ring_area(p[0])) for p in g.parts(g.clip(frame, (0, 0, 2, 4)))] == [(1, 6)]
    assert [(len(p), sum(map(g.ring_area, p))) for p in g.parts(g.clip(frame, (0, 0, 9, 9)))] == [(2, 12)]
    assert g.parts(g.clip(frame, (4, 0, 9, 9))) == [] and g.parts(g.clip(frame, (5, 5, 9, 9))) == []


def test_meet_brute_force():
    a, b = some(150), some(150)
    shift = RNG.uniform(-9, 9, (150, 2))
    b = [[r + s for r in p] for p, s in zip(b, shift, strict=True)]
    got = g.meet(rings_of(a), rings_of(b))
    px, py = (v.ravel() for v in np.meshgrid(np.linspace(-24, 24, 961), np.linspace(-24, 24, 961)))
    both = np.array([(even_odd(p, px, py) & even_odd(q, px, py)).any() for p, q in zip(a, b, strict=True)])
    # a common sample point means they meet; where none is found, they may only touch in a sliver
    assert (got >= both).all() and (got != both).sum() <= 3 and 20 < got.sum() < 140


def test_meet_is_closed_and_minds_holes():
    sq = lambda x, y, w: np.array([[x, y], [x + w, y], [x + w, y + w], [x, y + w]], float)
    frame = [sq(0, 0, 10), sq(2, 2, 6)[::-1]]
    cases = [([sq(0, 0, 1)], [sq(1, 0, 1)], True), ([sq(0, 0, 1)], [sq(1, 1, 1)], True), ([sq(0, 0, 1)], [sq(1.001, 0, 1)], False), (frame, [sq(3, 3, 2)], False), (frame, [sq(2, 3, 2)], True), ([sq(-5, -5, 30)], frame, True), (frame, [sq(0.5, 0.5, 0.5)], True), ([sq(3, 3, 1), sq(0.5, 0.5, 1)], frame, True)]
    assert g.meet(rings_of([c[0] for c in cases]), rings_of([c[1] for c in cases])).tolist() == [c[2] for c in cases]


def test_spans_are_the_cells_by_centre(monkeypatch):
    monkeypatch.setattr(g, "CHUNK", 50)
    polys = some(40)
    r = rings_of(polys)
    got = {(int(k), int(x), int(y)) for k, y, a, z in zip(*r.spans(0.5), strict=True) for x in range(a, z)}
    cells = np.arange(-30, 30)
    px, py = (v.ravel() for v in np.meshgrid(cells, cells))
    want = {(k, int(x), int(y)) for k, p in enumerate(polys) for x, y in zip(*(v[even_odd(p, (px + 0.5) * 0.5, (py + 0.5) * 0.5)] for v in (px, py)), strict=True)}
    assert got == want
    rows = RNG.integers(0, 40, 500)
    x, y = RNG.uniform(-9, 9, (2, 500))
    assert r.holds(rows, x, y).tolist() == [bool(even_odd(polys[k], a, b)) for k, a, b in zip(rows, x, y, strict=True)]


def test_polygons_are_read_alike_in_batches():
    import struct

    def wkb(*rings, e="<", srid=None, flags=0, dims=2):
        out = struct.pack(e + "BI", e == "<", 3 | flags | (0x20000000 if srid else 0)) + (struct.pack(e + "I", srid) if srid else b"") + struct.pack(e + "I", len(rings))
        return out + b"".join(struct.pack(e + "I", len(r)) + b"".join(struct.pack(f"{e}{dims}d", *(list(p) + [9.0] * (dims - 2))) for p in r) for r in rings)

    sq = lambda x: [(x, 0), (x, 1), (x + 1, 1), (x + 1, 0), (x, 0)]
    blobs = [None, b"", *(wkb(sq(k), e=e, srid=s) for k in range(3) for e in "<>" for s in (None, 32633)), wkb(sq(0), sq(0.5)), wkb(sq(1), flags=0x80000000, dims=3), wkb(sq(1)[:2]), wkb(), wkb(sq(1))[:-1], wkb(sq(float("nan"))), struct.pack("<BII", 1, 6, 2) + wkb(sq(0)) + wkb(sq(5), e=">")]
    rows, x, y, n, ends = read_polygons(blobs)
    at = np.concatenate(([0], np.cumsum(n)))
    want = {i: w for i, b in enumerate(blobs) if (w := read_polygon(b)) is not None}
    assert rows.tolist() == sorted(want) and len(want) == 15
    for k, i in enumerate(rows.tolist()):
        assert x[at[k] : at[k + 1]].tolist() == want[i][0].tolist() and y[at[k] : at[k + 1]].tolist() == want[i][1].tolist() and ends[k] == want[i][2]
    # outlines counter-clockwise, holes clockwise
    assert g.ring_area(np.column_stack(want[2][:2])) == 1 and [g.ring_area(np.column_stack(want[14][:2])[a:z]) for a, z in ((0, 5), (5, 10))] == [1, -1]
