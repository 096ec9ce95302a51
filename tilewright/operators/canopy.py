"""Canopy masks and the final products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.raster import mosaic, opening, reclass_binary, zero_to_null
from tilewright.operators.spatial import semi_shapes
from tilewright.plans.skew import broadcast_if_small


def canopy_mask(classes: DataFrame, grid: DataFrame, canopy: Sequence[int], radius: float = 1.0, openings: int = 1, edits: DataFrame | None = None, band: str = "class_id") -> DataFrame:
    """1 where there is canopy, null elsewhere: px, py, canopy for every cell of ``grid``.

    Listed classes become 1 and others 0; small patches are opened away; cells
    of ``edits`` (px, py, canopy, maybe null) overrule; 0 becomes null. Cells
    without a class don't count in the windows but get a value from them.
    """
    c = grid.select("px", "py").join(classes.select("px", "py", F.col(band).alias("_k")), ["px", "py"], "left")
    c = c.select("px", "py", F.when(F.col("_k").isNotNull(), reclass_binary("_k", canopy, 0)).alias("canopy"))
    if openings:
        c = opening(c, "canopy", radius, openings)
    if edits is not None:
        c = c.join(edits.select("px", "py", F.col("canopy").alias("_e")), ["px", "py"], "left").select("px", "py", F.coalesce("_e", "canopy").alias("canopy"))
    return c.select("px", "py", zero_to_null("canopy").alias("canopy"))


def final_canopy(classes: DataFrame, class_table: DataFrame, boundary: tuple[float, float, float, float], buffer: float = 0.0, band: str = "class_id", width: float = 1.0) -> DataFrame:
    """px, py, canopy = 1 of the cells of tree classes whose centre is within the buffered boundary, from all tiles, each cell once."""
    minx, miny, maxx, maxy = boundary
    x, y = ((F.col(c) + 0.5) * width for c in ("px", "py"))
    trees = class_table.where("is_tree").select(F.col("id").alias(band))
    inside = classes.where(x.between(minx - buffer, maxx + buffer) & y.between(miny - buffer, maxy + buffer))
    return mosaic(inside.join(broadcast_if_small(trees), band, "left_semi"), [band]).select("px", "py", F.lit(1).alias("canopy"))


def final_trees(segments: DataFrame, class_column: str, class_table: DataFrame, boundary: DataFrame, keys: Sequence[str] = ("tile_name", "poly_id")) -> DataFrame:
    """Keys, height, crown_area and class (label) of the labelled segments that meet the boundary's shapes, each once."""
    label = class_table.select(F.col("id").alias(class_column), F.col("label").alias("class"))
    inside = semi_shapes(segments.where(F.col(class_column).isNotNull()), boundary, keys)
    return inside.join(broadcast_if_small(label), class_column).where(F.col("class").isNotNull()).select(*keys, "height", "crown_area", "class")
