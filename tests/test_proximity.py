import struct
from datetime import datetime

import numpy as np
import pytest

from tilewright.functions.wkb import read_points, read_polygon
from tilewright.operators.proximity import EARTH, containing_regions, near_pairs, near_pairs_on_sphere, p4_found, with_rings
from tilewright.plans import skew

T = datetime(2024, 1, 1)


def wkb_point(x, y, z=None, e="<", srid=None, iso=False):
    t = 1 + (1000 if z is not None and iso else 0) | (0x80000000 if z is not None and not iso else 0) | (0x20000000 if srid else 0)
    return struct.pack(e + "BI", e == "<", t) + (struct.pack(e + "I", srid) if srid else b"") + struct.pack(e + "2d", x, y) + (struct.pack(e + "d", z) if z is not None else b"")


def wkb_polygon(*rings, e="<", srid=None):
    out = struct.pack(e + "BI", e == "<", 3 | (0x20000000 if srid else 0)) + (struct.pack(e + "I", srid) if srid else b"") + struct.pack(e + "I", len(rings))
    for r in rings:
        out += struct.pack(e + "I", len(r)) + b"".join(struct.pack(e + "2d", *p) for p in r)
    return out


def square(x, y, w):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]


def test_wkb_encodings():
    good = [wkb_point(1, 2), wkb_point(1, 2, e=">"), wkb_point(1, 2, z=9), wkb_point(1, 2, z=9, iso=True, e=">"), wkb_point(1, 2, srid=32633), wkb_point(1, 2, z=3, srid=32633, e=">")]
    good.append(struct.pack("<BII", 1, 4, 1) + wkb_point(1, 2, e=">"))
    bad = [None, b"", wkb_point(1, 2)[:14], wkb_point(1, 2, z=9)[:-1], wkb_point(float("nan"), float("nan")), b"\x07" * 21, struct.pack("<BII", 1, 4, 2) + 2 * wkb_point(1, 2), wkb_polygon(square(0, 0, 1))]
    x, y = read_points(good + bad)
    assert x[: len(good)].tolist() == [1] * len(good) and y[: len(good)].tolist() == [2] * len(good)
    assert np.isnan(x[len(good) :]).all()
    multi = struct.pack("<BII", 1, 6, 2) + wkb_polygon(square(0, 0, 1)) + wkb_polygon(square(5, 5, 1), e=">")
    assert read_polygon(multi)[2] == [5, 10]
    for b in (None, b"", multi[:-3], wkb_polygon(), wkb_point(1, 2)):
        assert read_polygon(b) is None


@pytest.mark.parametrize("hot", [False, True])
def test_near_pairs_brute_force(spark, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(skew, "HOT_ROWS", 3)
    rng = np.random.default_rng(1)
    xy = rng.uniform(-20, 20, (300, 2))
    if hot:
        xy[:100] = xy[0]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [(None, 0.0, 0.0), (900, None, 1.0), (901, float("nan"), 1.0), (902, 1e300, -1e300), (903, 1e300, -1e300)]
    got = near_pairs(spark.createDataFrame(rows, "fid long, x double, y double"), 2.0).collect()
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if ((xy[i] - xy[j]) ** 2).sum() <= 4} | {(902, 903)}
    assert len(got) == len(want) and {(r.key_a, r.key_b) for r in got} == want


def test_near_on_sphere_brute_force(spark):
    rng = np.random.default_rng(3)
    lon = np.concatenate([rng.uniform(-180, 180, 80), rng.uniform(179.9, 180.1, 60), rng.uniform(-180, 180, 60)])
    lat = np.concatenate([rng.uniform(-90, 90, 80), rng.uniform(-0.1, 0.1, 60), rng.uniform(89.9, 90, 60)])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat, strict=True))] + [(None, 0.0, 0.0), (900, None, 1.0), (901, float("nan"), 0.0)]
    a, b = np.radians(lon), np.radians(lat)
    h = np.sin((b[:, None] - b) / 2) ** 2 + np.cos(b[:, None]) * np.cos(b) * np.sin((a[:, None] - a) / 2) ** 2
    d = 2 * EARTH * np.arcsin(np.sqrt(h))
    for radius in (5000.0, 400_000.0):
        got = near_pairs_on_sphere(spark.createDataFrame(rows, "fid long, lon double, lat double"), radius).collect()
        want = {(i, j) for i in range(200) for j in range(i + 1, 200) if d[i, j] <= radius}
        assert len(got) == len(want) > 50 and {(r.key_a, r.key_b) for r in got} == want
        assert all(abs(r.dist - d[r.key_a, r.key_b]) < 1e-3 for r in got)


def test_containing_regions_brute_force(spark):
    rng = np.random.default_rng(2)
    polys = []
    for k in range(60):
        x, y = rng.uniform(-30, 30, 2)
        w = float(rng.choice([0.3, 2, 17, 60]))
        polys.append((k, float(x), float(y), w))
    regions = spark.createDataFrame([(k, bytearray(wkb_polygon(square(x, y, w), square(x + w / 4, y + w / 4, w / 2)))) for k, x, y, w in polys], "seg long, g binary")
    pts = rng.uniform(-40, 60, (400, 2))
    got = containing_regions(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "fid long, x double, y double"), with_rings(regions, "g", "seg"))
    box = lambda px, py, x, y, w: x < px < x + w and y < py < y + w
    want = {(i, k) for i, (px, py) in enumerate(pts) for k, x, y, w in polys if box(px, py, x, y, w) and not box(px, py, x + w / 4, y + w / 4, w / 2)}
    assert {(r.fid, r.seg) for r in got.collect()} == want


def test_p4_found_cases(spark):
    t2 = datetime(2024, 2, 1)
    p = [(1, bytearray(wkb_point(1, 1)), "R1C1", T), (2, bytearray(wkb_point(1, 3)), None, T), (3, bytearray(wkb_point(50, 50)), "R1C1", T), (3, bytearray(wkb_point(12, 1, e=">")), "r1c2", t2)]
    p += [(4, bytearray(b"\x01\x01"), "R1C1", t2), (4, bytearray(wkb_point(1, 1)), "R1C1", T), (None, bytearray(wkb_point(1, 1)), "R1C1", T), (5, None, None, None), (1, bytearray(wkb_point(1, 1)), "R1C1", T)]
    points = spark.createDataFrame([(*r, "x") for r in p], "fid long, geometry binary, tile_name string, saved_at timestamp, k1 string")
    segs = spark.createDataFrame([(7, bytearray(wkb_polygon(square(0, 0, 2))), T), (8, None, T), (7, bytearray(wkb_polygon(square(0, 0, 2))), T)], "fid long, geom binary, loaded_at timestamp")
    tiles = spark.createDataFrame([("R1C1", 0.0, 0.0, 10.0, 10.0), ("R1C2", 10.0, 0.0, 20.0, 10.0)], "tile_name string, minx double, miny double, maxx double, maxy double")
    got = {tuple(r) for r in p4_found(points, segs, tiles).collect()}
    assert got == {("near", 1, "2"), ("segment", 1, "7"), ("tile", 2, "R1C1"), ("tile", 3, "R1C2")}
    assert p4_found(points.limit(0), segs.limit(0), tiles.limit(0)).collect() == []
