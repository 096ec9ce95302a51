"""Views that stand in for rasters, segments and points, as SQL that Spark and DuckDB both read.

They derive pixels, tiles, segments, points and training features from the
tables of a dataset folder, so that every operator has inputs of any size.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_pixels": """SELECT CAST(l_partkey % 200 AS INT) AS px, CAST(l_suppkey % 100 AS INT) AS py,
  CAST(min(l_linenumber) * 30 AS DOUBLE) AS r, CAST(max(l_linenumber) * 36 AS DOUBLE) AS g,
  CAST(sum(l_linenumber) % 256 AS DOUBLE) AS b, CAST(max(l_quantity) * 5 AS DOUBLE) AS ir, CAST(max(l_quantity) AS DOUBLE) AS chm
FROM lineitem GROUP BY CAST(l_partkey % 200 AS INT), CAST(l_suppkey % 100 AS INT)""",
    "fx_pixels_t": """SELECT concat('R', CAST(CAST(floor(py / 20) AS INT) + 1 AS VARCHAR(10)), 'C', CAST(CAST(floor(px / 20) AS INT) + 1 AS VARCHAR(10))) AS tile_name,
  px, py, r, g, b, ir, chm, CAST(floor((px % 20) / 5) + 4 * floor((py % 20) / 5) + 1 AS INT) AS poly_id
FROM fx_pixels""",
    "fx_segments": """SELECT tile_name, poly_id, CAST(min(floor(px / 5) * 5) AS DOUBLE) AS minx, CAST(min(floor(py / 5) * 5) AS DOUBLE) AS miny,
  CAST(min(floor(px / 5) * 5) + 5 AS DOUBLE) AS maxx, CAST(min(floor(py / 5) * 5) + 5 AS DOUBLE) AS maxy, count(*) AS n_px
FROM fx_pixels_t GROUP BY tile_name, poly_id""",
    "fx_points": """SELECT CAST((l_partkey % 200) + l_discount AS DOUBLE) AS x, CAST((l_suppkey % 100) + l_tax AS DOUBLE) AS y,
  CAST(l_quantity AS DOUBLE) AS z, CAST(l_linenumber AS INT) AS classification,
  CAST(l_linenumber * 30 AS INT) AS r, CAST(l_quantity * 5 AS INT) AS g, CAST(l_suppkey % 256 AS INT) AS b
FROM lineitem""",
    "fx_points_t": """SELECT p.*, concat('R', CAST(CAST(floor(y / 20) AS INT) + 1 AS VARCHAR(10)), 'C', CAST(CAST(floor(x / 20) AS INT) + 1 AS VARCHAR(10))) AS tile_name,
  CAST(floor((CAST(floor(x) AS INT) % 20) / 5) + 4 * floor((CAST(floor(y) AS INT) % 20) / 5) + 1 AS INT) AS poly_id
FROM fx_points p""",
    "fx_treetops": """SELECT CAST(s_suppkey AS INT) AS tree_id, CAST((s_suppkey * 37) % 200 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS x,
  CAST((s_suppkey * 53) % 100 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS y, CAST(s_acctbal AS DOUBLE) AS height
FROM supplier""",
    "fx_dem": "SELECT px, py, CAST((px + py) % 7 AS DOUBLE) AS dem FROM fx_pixels",
    "fx_training": """SELECT CAST(s_suppkey AS INT) AS fid, CAST((s_suppkey * 37) % 200 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS x,
  CAST((s_suppkey * 53) % 100 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS y, CAST(s_nationkey % 3 + 1 AS INT) AS training_set,
  CASE s_nationkey % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'D' WHEN 2 THEN 'E' WHEN 3 THEN 'B' ELSE 'H' END AS seg_class
FROM supplier""",
    "fx_training_polys": """SELECT CAST(n_nationkey AS INT) AS fid, CAST((n_nationkey * 31) % 190 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS minx, CAST((n_nationkey * 17) % 90 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS miny,
  CAST((n_nationkey * 31) % 190 AS DOUBLE) + CAST(8.5 AS DOUBLE) AS maxx, CAST((n_nationkey * 17) % 90 AS DOUBLE) + CAST(5.5 AS DOUBLE) AS maxy,
  CAST(n_regionkey % 3 + 1 AS INT) AS training_set, CASE n_regionkey WHEN 0 THEN 'C' WHEN 1 THEN 'D' ELSE 'E' END AS seg_class
FROM nation""",
    "fx_zones": """SELECT 'west' AS zone_name, CAST(0 AS DOUBLE) AS minx, CAST(0 AS DOUBLE) AS miny, CAST(60 AS DOUBLE) AS maxx, CAST(100 AS DOUBLE) AS maxy
UNION ALL SELECT 'east', CAST(140 AS DOUBLE), CAST(0 AS DOUBLE), CAST(200 AS DOUBLE), CAST(100 AS DOUBLE)""",
    "fx_class_table": """SELECT 1 AS id, 'C' AS code, 'coniferous' AS label, true AS is_tree UNION ALL SELECT 2, 'D', 'deciduous', true
UNION ALL SELECT 3, 'E', 'dead', true UNION ALL SELECT 4, 'B', 'building', false UNION ALL SELECT 5, 'H', 'cherry', true""",
    "fx_tiles": """SELECT concat('R', CAST(r.n_nationkey + 1 AS VARCHAR(10)), 'C', CAST(c.n_nationkey + 1 AS VARCHAR(10))) AS tile_name, CAST(r.n_nationkey + 1 AS INT) AS row_no, CAST(c.n_nationkey + 1 AS INT) AS col_no,
  CAST(c.n_nationkey * 20 AS DOUBLE) AS minx, CAST(r.n_nationkey * 20 AS DOUBLE) AS miny, CAST(c.n_nationkey * 20 + 20 AS DOUBLE) AS maxx, CAST(r.n_nationkey * 20 + 20 AS DOUBLE) AS maxy
FROM nation r CROSS JOIN nation c WHERE r.n_nationkey < 5 AND c.n_nationkey < 10""",
    "fx_registry": """SELECT tile_name, 'geom' AS attribute, geom AS done FROM tile_reg UNION ALL SELECT tile_name, 'spec', spec FROM tile_reg UNION ALL SELECT tile_name, 'las', las FROM tile_reg""",
    "fx_class_cells": "SELECT tile_name, px, py, CAST((CAST(r AS INT) + CAST(b AS INT)) % 5 AS INT) + 1 AS class_id FROM fx_pixels_t",
    "fx_edits": """SELECT CAST(n_nationkey AS INT) AS seq, CAST((n_nationkey * 13) % 180 AS DOUBLE) AS minx, CAST((n_nationkey * 29) % 80 AS DOUBLE) AS miny,
  CAST((n_nationkey * 13) % 180 + 40 AS DOUBLE) AS maxx, CAST((n_nationkey * 29) % 80 + 30 AS DOUBLE) AS maxy,
  CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'C D' WHEN 2 THEN 'E' ELSE 'B H C' END AS from_class,
  CASE n_nationkey % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'D' WHEN 2 THEN 'E' WHEN 3 THEN 'B' ELSE 'H' END AS to_class
FROM nation""",
    "fx_seg_class": "SELECT tile_name, poly_id, minx, miny, maxx, maxy, CASE poly_id % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'D' WHEN 2 THEN 'E' WHEN 3 THEN 'B' ELSE 'H' END AS seg_class FROM fx_segments",
}

def expanded(sql: str) -> str:
    """The statement behind WITH clauses for the views it uses, and those they use."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if name not in need:
                visit(VIEWS[name])
                need.append(name)

    visit(sql)
    if not need:
        return sql
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[14:]}"
    return f"WITH {views},\n{body[4:]}" if body.upper().startswith("WITH") else f"WITH {views}\n{body}"


def fixture(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """A view by name, or a statement over views and tables, on the tables of a folder."""
    text = expanded(f"SELECT * FROM {sql}" if re.fullmatch(r"fx_\w+", sql) else sql)
    tables = "lineitem|supplier|nation|tile_reg|events|customer|orders|part|region"
    return spark.sql(re.sub(rf"(FROM|JOIN)\s+({tables})\b", lambda m: f"{m[1]} parquet.`{folder}/{m[2]}.parquet`", text))
