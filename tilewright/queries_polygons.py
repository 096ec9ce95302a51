"""Queries over the polygons of seg_vts and edits, with SQL that reads their WKB and clips, tests and fills them by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import canopy, classify, proximity, spatial
from tilewright.plans.latest import latest_rows
from tilewright.sources.tables import table

#: A boundary for final products, not convex, in the corner of the scheme that all datasets fill.
BOUNDARY = ((400500.0, 5245500.0), (404500.0, 5245200.0), (404000.0, 5249000.0), (402500.0, 5246500.0), (401000.0, 5249500.0))
BUFFER = 5.0
ANY = ("minx", "miny", "maxx", "maxy", "xs", "ys", "ends")


def segments(s, d):
    """Latest readable segments: fid, tile_name, height, crown_area, class_1 and vertices."""
    seg = latest_rows(table(s, d, "seg_vts").select("fid", "tile_name", "height", "crown_area", "class_1", "geom", "loaded_at"), "fid", "loaded_at", ["geom"])
    return proximity.with_rings(seg.drop("loaded_at"), "geom", "fid")


def training_places(s, d):
    p = latest_rows(table(s, d, "training_points").select("fid", "training_set", F.upper(F.trim("seg_class")).alias("seg_class"), "geometry", "saved_at"), "fid", "saved_at", ["geometry"])
    return proximity.with_point_xy(p.drop("saved_at"), "geometry", "fid")


def edits(s, d):
    """Latest readable edits with a target class: seq, from_class, to_class and vertices."""
    e = latest_rows(table(s, d, "edits").select(F.col("edit_id").alias("seq"), F.upper("from_class").alias("from_class"), F.upper(F.trim("to_class")).alias("to_class"), "geometry", "received_at"), "seq", "received_at", ["geometry"])
    return proximity.with_rings(e.where("to_class <> ''").drop("received_at"), "geometry", "seq")


def scheme(s, d):
    """tile_reg with buffers: tile_name, buff, nbuff."""
    t = table(s, d, "tile_reg")
    lo = lambda c, at, n: F.col(c) - F.when(F.col(at) == n, F.lit(BUFFER)).otherwise(0.0)
    hi = lambda c, at, n: F.col(c) + F.when(F.col(at) == n, F.lit(BUFFER)).otherwise(0.0)
    buff = F.struct(*((F.col(c) + (-BUFFER if c[:3] == "min" else BUFFER)).alias(c) for c in ("minx", "miny", "maxx", "maxy")))
    # row 1 of this scheme is the uppermost
    nbuff = F.struct(lo("minx", "col_no", 1).alias("minx"), lo("miny", "row_no", 50).alias("miny"), hi("maxx", "col_no", 50).alias("maxx"), hi("maxy", "row_no", 1).alias("maxy"))
    return t.select("tile_name", buff.alias("buff"), nbuff.alias("nbuff"))


def boundary(s):
    xs, ys = zip(*BOUNDARY, strict=True)
    row = (min(xs), min(ys), max(xs), max(ys), list(xs), list(ys), [len(xs)])
    return s.createDataFrame([row], "minx double, miny double, maxx double, maxy double, xs array<double>, ys array<double>, ends array<int>")


def _fold(s, d):
    seg, codes = segments(s, d), table(s, d, "class_table").select(F.col("id").alias("class_1"), F.col("code").alias("seg_class"))
    seg = seg.join(F.broadcast(codes), "class_1", "left").select("fid", "seg_class", *ANY)
    return classify.edited(seg.select("fid", "seg_class"), classify.edit_hits(edits(s, d), seg, ["fid"]), ["fid"])


def _extract(s, d):
    seg = segments(s, d).withColumn("seg_area", F.col("crown_area"))
    areas = edits(s, d).select(F.col("seq").alias("fid"), F.lit(1).alias("training_set"), F.col("to_class").alias("seg_class"), *ANY)
    return classify.extracted(training_places(s, d), areas, seg, ["seg_area"])


def _tiled(s, d):
    cut = spatial.tile_polygons(segments(s, d), scheme(s, d), "fid")
    return cut.groupBy("tile_name", "fid").agg(F.round(F.sum("area"), 3).alias("area"))


QUERIES = {
    "vts_read_from_pts": lambda s, d: spatial.read_from_points(training_places(s, d), segments(s, d).select(F.col("fid").alias("seg"), "tile_name", *ANY), "fid", ["seg", "tile_name"], ["seg"]),
    "vts_read_from_polys": lambda s, d: spatial.read_from_areas(edits(s, d), segments(s, d), "seq", ["fid", "tile_name"]),
    "vts_tile_poly": _tiled,
    "vts_poly_to_ras": lambda s, d: spatial.rasterized(segments(s, d).select("tile_name", F.col("fid").alias("poly_id"), *ANY).where("tile_name IS NOT NULL")),
    "vts_training_extract": _extract,
    "vts_class_edits": _fold,
    "vts_coverage": lambda s, d: spatial.uncovered_area(segments(s, d).select(*ANY), boundary(s), 10.0),
    # points near points, and in regions
    "p4_found": lambda s, d: proximity.p4_found(table(s, d, "training_points"), table(s, d, "seg_vts"), table(s, d, "tile_reg")),
    "vts_final_trees": lambda s, d: canopy.final_trees(segments(s, d), "class_1", table(s, d, "class_table"), boundary(s), ["fid"]),
}


def _hex(at: str, n: int) -> str:
    """2n hex digits at a place (from 1) of h, the most significant byte first."""
    turned = " || ".join(f"h[{at} + {2 * k}:{at} + {2 * k + 1}]" for k in reversed(range(n)))
    return f"CAST('0x' || CASE WHEN le THEN {turned} ELSE h[{at}:{at} + {2 * n - 1}] END AS UBIGINT)"


def _double(bits: str) -> str:
    return f"CASE WHEN ({bits} >> 63) = 1 THEN -1 ELSE 1 END * (1 + CAST({bits} & 4503599627370495 AS DOUBLE) / CAST(4503599627370496 AS DOUBLE)) * pow(CAST(2 AS DOUBLE), CAST(({bits} >> 52) & 2047 AS INTEGER) - 1023)"


def _shapes(name: str, source: str) -> str:
    """Views <name>_v (id, ring, i, x, y), <name>_e (id, ring, x, y, x2, y2) and <name>_b (bounds) of polygons (id, h); of one ring or two, in one part."""
    return f"""{name}_a AS (SELECT id, h, h[1:2] = '01' AS le, CASE WHEN h[1:10] = '0106000000' THEN 29 WHEN h[1:10] = '0103000020' THEN 19 ELSE 11 END AS ofs FROM {source} WHERE h IS NOT NULL),
{name}_1 AS (SELECT *, {_hex("ofs", 4)} AS rings, CAST({_hex("(ofs + 8)", 4)} AS INTEGER) AS n FROM {name}_a),
{name}_r AS (SELECT id, h, le, 1 AS ring, n, ofs + 16 AS ofs FROM {name}_1
  UNION ALL SELECT id, h, le, 2, CAST({_hex("(ofs + 16 + 32 * n)", 4)} AS INTEGER), ofs + 24 + 32 * n FROM {name}_1 WHERE rings = 2),
{name}_w AS (SELECT id, ring, i, {_hex("(ofs + 32 * i)", 8)} AS bx, {_hex("(ofs + 32 * i + 16)", 8)} AS bz FROM (SELECT *, CAST(unnest(range(n)) AS INTEGER) AS i FROM {name}_r)),
{name}_v AS (SELECT id, ring, i, {_double("bx")} AS x, {_double("bz")} AS y FROM {name}_w),
{name}_e AS (SELECT id, ring, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {name}_v WINDOW w AS (PARTITION BY id, ring ORDER BY i)),
{name}_b AS (SELECT id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM {name}_v GROUP BY id)"""


_SEG = """seg_row AS (SELECT *, hex(geom) AS h, fid AS id FROM seg_vts WHERE fid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fid ORDER BY loaded_at DESC NULLS LAST, geom) = 1),
""" + _shapes("seg", "seg_row")
_PTS = f"""pt_row AS (SELECT *, hex(geometry) AS h FROM training_points WHERE fid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fid ORDER BY saved_at DESC NULLS LAST, geometry) = 1),
pt_a AS (SELECT fid, training_set, upper(trim(seg_class)) AS seg_class, h, h[1:2] = '01' AS le, CASE WHEN h[1:10] = '0104000000' THEN 29 WHEN h[1:10] IN ('0101000020', '0020000001') THEN 19 ELSE 11 END AS ofs FROM pt_row WHERE h IS NOT NULL AND len(h) >= 42),
pt_w AS (SELECT *, {_hex("ofs", 8)} AS bx, {_hex("(ofs + 16)", 8)} AS bz FROM pt_a),
pt AS (SELECT fid, training_set, seg_class, {_double("bx")} AS x, {_double("bz")} AS y FROM pt_w WHERE ((bx >> 52) & 2047) < 2047 AND ((bz >> 52) & 2047) < 2047)"""
_ED = """ed_row AS (SELECT edit_id AS id, upper(from_class) AS from_class, upper(trim(to_class)) AS to_class, hex(geometry) AS h FROM edits WHERE edit_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY edit_id ORDER BY received_at DESC NULLS LAST, geometry) = 1),
ed_ok AS (SELECT * FROM ed_row WHERE to_class <> ''),
""" + _shapes("ed", "ed_ok")


def _inside(point: str, edge: str) -> str:
    return f"(({edge}.y > {point}.y) <> ({edge}.y2 > {point}.y) AND {point}.x < ({edge}.x2 - {edge}.x) * ({point}.y - {edge}.y) / ({edge}.y2 - {edge}.y) + {edge}.x)"


_HIT = f"""hit AS (SELECT p.fid, b.id AS seg FROM pt p JOIN seg_b b ON p.x BETWEEN b.minx AND b.maxx AND p.y BETWEEN b.miny AND b.maxy JOIN seg_e e ON e.id = b.id AND e.x2 IS NOT NULL
  GROUP BY p.fid, b.id HAVING sum(CASE WHEN {_inside("p", "e")} THEN 1 ELSE 0 END) % 2 = 1)"""


def _side(a: str, b: str, c: str) -> str:
    (ax, ay), (bx, by), (cx, cy) = a.split(), b.split(), c.split()
    return f"sign(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


def _met(a: str, b: str) -> str:
    """View met (a, b) of the polygons of two sets of views that have a point in common."""
    p, p2, q, q2 = "p.x p.y", "p.x2 p.y2", "q.x q.y", "q.x2 q.y2"
    span = " AND ".join(f"least(p.{c}, p.{c}2) <= greatest(q.{c}, q.{c}2) AND least(q.{c}, q.{c}2) <= greatest(p.{c}, p.{c}2)" for c in "xy")
    cross = f"{span} AND {_side(p, p2, q)} * {_side(p, p2, q2)} <= 0 AND {_side(q, q2, p)} * {_side(q, q2, p2)} <= 0"
    within = lambda v, e, x, y: f"SELECT n.a, n.b FROM near n JOIN {v}_v p ON p.id = n.{x} AND p.i = 0 JOIN {e}_e e ON e.id = n.{y} AND e.x2 IS NOT NULL GROUP BY n.a, n.b, p.ring HAVING sum(CASE WHEN {_inside('p', 'e')} THEN 1 ELSE 0 END) % 2 = 1"
    return f"""near AS (SELECT a.id AS a, b.id AS b FROM {a}_b a JOIN {b}_b b ON a.minx <= b.maxx AND a.maxx >= b.minx AND a.miny <= b.maxy AND a.maxy >= b.miny),
met AS (SELECT n.a, n.b FROM near n JOIN {a}_e p ON p.id = n.a AND p.x2 IS NOT NULL JOIN {b}_e q ON q.id = n.b AND q.x2 IS NOT NULL WHERE {cross} UNION {within(a, b, "a", "b")} UNION {within(b, a, "b", "a")})"""


_LABEL = "SELECT s.fid, c.code AS seg_class FROM seg_row s JOIN seg_b USING (id) LEFT JOIN class_table c ON s.class_1 = c.id"
_EDGE = ", ".join(f"({x} - 400000, {y} - 5200000, {x2} - 400000, {y2} - 5200000)" for (x, y), (x2, y2) in zip(BOUNDARY, (*BOUNDARY[1:], BOUNDARY[0]), strict=True))

_BD = f"""bd_e AS (SELECT 0 AS id, x + 400000 AS x, y + 5200000 AS y, x2 + 400000 AS x2, y2 + 5200000 AS y2 FROM (VALUES {_EDGE}) AS v(x, y, x2, y2)),
bd_v AS (SELECT 0 AS id, 1 AS ring, CASE WHEN x = {BOUNDARY[0][0]} THEN 0 ELSE 1 END AS i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM bd_e),
bd_b AS (SELECT 0 AS id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM bd_e)"""


def _clipped(src: str, name: str, axis: str, limit: str, op: str) -> str:
    """Ring lists l with what is beyond a limit cut off, vertex by vertex."""
    p, q = "l[i + 1]", "l[(i + 1) % len(l) + 1]"
    other = "y" if axis == "x" else "x"
    at = f"{p}.{other} + ({q}.{other} - {p}.{other}) * ({limit} - {p}.{axis}) / ({q}.{axis} - {p}.{axis})"
    cut = f"{{'x': {limit}, 'y': {at}}}" if axis == "x" else f"{{'x': {at}, 'y': {limit}}}"
    keep = f"list_concat(CASE WHEN {p}.{axis} {op} {limit} THEN [{p}] END, CASE WHEN ({p}.{axis} {op} {limit}) <> ({q}.{axis} {op} {limit}) THEN [{cut}] END)"
    return f"{name} AS (SELECT * REPLACE (flatten(list_transform(range(len(l)), lambda i: {keep})) AS l) FROM {src})"


_TILE = f"""t AS (SELECT tile_name, minx - {BUFFER} AS ox, miny - {BUFFER} AS oy, maxx + {BUFFER} AS ox2, maxy + {BUFFER} AS oy2, minx - CASE col_no WHEN 1 THEN {BUFFER} ELSE 0 END AS nx, miny - CASE row_no WHEN 50 THEN {BUFFER} ELSE 0 END AS ny,
  maxx + CASE col_no WHEN 50 THEN {BUFFER} ELSE 0 END AS nx2, maxy + CASE row_no WHEN 1 THEN {BUFFER} ELSE 0 END AS ny2 FROM tile_reg),
whole AS (SELECT DISTINCT b.id FROM seg_b b JOIN t ON b.minx >= ox AND b.miny >= oy AND b.maxx <= ox2 AND b.maxy <= oy2),
l0 AS (SELECT v.id, v.ring, b.minx AS bx, b.miny AS bz, list({{'x': v.x - b.minx, 'y': v.y - b.miny}} ORDER BY v.i) AS l FROM seg_v v JOIN seg_b b USING (id) JOIN seg_r r ON r.id = v.id AND r.ring = v.ring WHERE v.i < r.n - 1 GROUP BY v.id, v.ring, b.minx, b.miny),
c0 AS (SELECT l0.*, t.tile_name, CAST(nx - bx AS DOUBLE) AS ax, CAST(ny - bz AS DOUBLE) AS ay, CAST(nx2 - bx AS DOUBLE) AS ax2, CAST(ny2 - bz AS DOUBLE) AS ay2 FROM l0 JOIN seg_b b USING (id) JOIN t ON greatest(b.minx, nx) < least(b.maxx, nx2) AND greatest(b.miny, ny) < least(b.maxy, ny2) WHERE id NOT IN (SELECT id FROM whole)),
{_clipped("c0", "c1", "x", "ax", ">=")},
{_clipped("c1", "c2", "y", "ay", ">=")},
{_clipped("c2", "c3", "x", "ax2", "<=")},
{_clipped("c3", "c4", "y", "ay2", "<=")},
ring AS (SELECT id, tile_name, ring, bx, bz, l FROM c4 WHERE len(l) >= 3 UNION ALL SELECT id, NULL, ring, bx, bz, l FROM l0 WHERE id IN (SELECT id FROM whole)),
term AS (SELECT id, tile_name, ring, bx, bz, unnest(list_transform(range(len(l)), lambda i: {{'w': l[i + 1].x * l[(i + 1) % len(l) + 1].y - l[(i + 1) % len(l) + 1].x * l[i + 1].y, 'x': l[i + 1].x + l[(i + 1) % len(l) + 1].x, 'y': l[i + 1].y + l[(i + 1) % len(l) + 1].y}})) AS u FROM ring),
one AS (SELECT id, tile_name, ring, bx, bz, sum(u.w) / 2 AS area, sum(u.w * u.x) / 6 AS mx, sum(u.w * u.y) / 6 AS mz FROM term GROUP BY id, tile_name, ring, bx, bz),
poly AS (SELECT id, tile_name, bx, bz, sum(CASE WHEN (ring = 1) = (area > 0) THEN area ELSE -area END) AS area, sum(CASE WHEN (ring = 1) = (area > 0) THEN mx ELSE -mx END) AS mx, sum(CASE WHEN (ring = 1) = (area > 0) THEN mz ELSE -mz END) AS mz FROM one GROUP BY id, tile_name, bx, bz)"""

ORACLE = {
    "vts_read_from_pts": f"WITH {_SEG},\n{_PTS},\n{_HIT}\nSELECT p.fid, f.seg, s.tile_name FROM pt p LEFT JOIN (SELECT fid, min(seg) AS seg FROM hit GROUP BY fid) f USING (fid) LEFT JOIN seg_row s ON s.fid = f.seg",
    "vts_read_from_polys": f"WITH {_SEG},\n{_ED},\n{_met('ed', 'seg')}\nSELECT m.a AS seq, s.fid, s.tile_name FROM met m JOIN seg_row s ON s.fid = m.b",
    "vts_tile_poly": f"""WITH {_SEG},
{_TILE}
SELECT tile_name, id AS fid, round(area, 3) AS area FROM poly WHERE tile_name IS NOT NULL AND area > 1e-9
UNION ALL SELECT t.tile_name, id, round(area, 3) FROM poly p JOIN t ON bx + mx / area >= nx AND bx + mx / area < nx2 AND bz + mz / area >= ny AND bz + mz / area < ny2 WHERE p.tile_name IS NULL AND area > 1e-9""",
    "vts_poly_to_ras": f"""WITH {_SEG},
cell AS (SELECT id, CAST(px AS INTEGER) AS px, CAST(unnest(range(CAST(floor(miny) AS BIGINT), CAST(ceil(maxy) AS BIGINT))) AS INTEGER) AS py FROM (SELECT *, unnest(range(CAST(floor(minx) AS BIGINT), CAST(ceil(maxx) AS BIGINT))) AS px FROM seg_b)),
cc AS (SELECT id, px, py, px + CAST(0.5 AS DOUBLE) AS x, py + CAST(0.5 AS DOUBLE) AS y FROM cell),
f AS (SELECT c.id, c.px, c.py FROM cc c JOIN seg_e e ON e.id = c.id AND e.x2 IS NOT NULL AND (e.y > c.y) <> (e.y2 > c.y) GROUP BY c.id, c.px, c.py HAVING sum(CASE WHEN {_inside("c", "e")} THEN 1 ELSE 0 END) % 2 = 1)
SELECT s.tile_name, f.px, f.py, min(f.id) AS poly_id FROM f JOIN seg_row s ON s.fid = f.id WHERE s.tile_name IS NOT NULL GROUP BY s.tile_name, f.px, f.py""",
    "vts_training_extract": f"""WITH {_SEG},
{_PTS},
{_HIT},
{_ED},
{_met("ed", "seg")},
cand AS (SELECT 2 AS type, 1 AS training_set, m.a AS training_fid, e.to_class AS seg_class, m.b AS fid FROM met m JOIN ed_ok e ON e.id = m.a
  UNION ALL SELECT 1, p.training_set, p.fid, p.seg_class, f.seg FROM pt p JOIN (SELECT fid, min(seg) AS seg FROM hit GROUP BY fid) f USING (fid)),
first AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY fid ORDER BY type DESC, training_fid, training_set, seg_class) = 1)
SELECT f.fid, f.type, f.training_set, f.training_fid, f.seg_class, s.crown_area AS seg_area FROM first f JOIN seg_row s USING (fid)""",
    "vts_class_edits": f"""WITH {_SEG},
{_ED},
{_met("ed", "seg")},
l AS ({_LABEL}),
e AS (SELECT m.b AS fid, list({{'s': '', 'f': coalesce(regexp_split_to_array(trim(regexp_replace(e.from_class, '\\s+', ' ', 'g')), ' '), ['']), 't': e.to_class}} ORDER BY e.id) AS steps FROM met m JOIN ed_ok e ON e.id = m.a GROUP BY m.b)
SELECT l.fid, CASE WHEN e.steps IS NULL THEN l.seg_class ELSE list_reduce(e.steps, lambda a, x: {{'s': CASE WHEN x.f = [''] OR coalesce(list_contains(x.f, a.s), false) THEN x.t ELSE a.s END, 'f': x.f, 't': x.t}}, {{'s': l.seg_class, 'f': [''], 't': ''}}).s END AS seg_class FROM l LEFT JOIN e USING (fid)""",
    "p4_found": f"""WITH {_SEG},
{_PTS},
{_HIT}
SELECT 'near' AS relation, a.fid AS key_a, CAST(b.fid AS VARCHAR) AS key_b FROM pt a JOIN pt b ON a.fid < b.fid AND b.x BETWEEN a.x - 2 AND a.x + 2 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4
UNION ALL SELECT 'segment', fid, CAST(seg AS VARCHAR) FROM hit
UNION ALL SELECT 'tile', p.fid, t.tile_name FROM pt p JOIN pt_row r USING (fid) JOIN tile_reg t ON p.x >= t.minx AND p.x < t.maxx AND p.y >= t.miny AND p.y < t.maxy WHERE r.tile_name IS DISTINCT FROM t.tile_name""",
    "vts_coverage": f"""WITH {_SEG},
{_BD},
k AS (SELECT px * 10 + CAST(5 AS DOUBLE) AS x, py * 10 + CAST(5 AS DOUBLE) AS y, px, py FROM (SELECT *, unnest(range(CAST(floor(miny / 10) AS BIGINT), CAST(ceil(maxy / 10) AS BIGINT))) AS py FROM (SELECT *, unnest(range(CAST(floor(minx / 10) AS BIGINT), CAST(ceil(maxx / 10) AS BIGINT))) AS px FROM bd_b))),
area AS (SELECT k.px, k.py FROM k JOIN bd_e e ON (e.y > k.y) <> (e.y2 > k.y) GROUP BY k.px, k.py HAVING sum(CASE WHEN {_inside("k", "e")} THEN 1 ELSE 0 END) % 2 = 1),
full_ AS (SELECT k.px, k.py, b.id FROM k JOIN seg_b b ON k.x BETWEEN b.minx AND b.maxx AND k.y BETWEEN b.miny AND b.maxy JOIN seg_e e ON e.id = b.id AND e.x2 IS NOT NULL GROUP BY k.px, k.py, b.id HAVING sum(CASE WHEN {_inside("k", "e")} THEN 1 ELSE 0 END) % 2 = 1)
SELECT CAST(count(*) * 100 AS DOUBLE) AS area FROM area a WHERE NOT EXISTS (SELECT 1 FROM full_ f WHERE f.px = a.px AND f.py = a.py)""",
    "vts_final_trees": f"""WITH {_SEG},
{_BD},
{_met("bd", "seg")}
SELECT DISTINCT s.fid, s.height, s.crown_area, c.label AS class FROM met m JOIN seg_row s ON s.fid = m.b JOIN class_table c ON c.id = s.class_1 WHERE c.label IS NOT NULL""",
}
