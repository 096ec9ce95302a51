"""Tables behind pie and donut charts, and the newest project."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TWO_PI = 2 * math.pi


def frequencies(df: DataFrame, by: list[str], count: str | None = None) -> DataFrame:
    """Rows, or the sum of ``count``, of each value. Nulls in ``by`` are left out."""
    return df.dropna(subset=by).groupBy(*by).agg((F.sum(count) if count else F.count(F.lit(1))).alias("freq"))


def percent(share: Column) -> Column:
    """Share in per cent with one decimal."""
    return F.format_string("%.1f%%", F.round(share * 100, 1))


def _circle(df: DataFrame, order: list[str], start: float) -> DataFrame:
    """Ends and starts of a running total as angles. The groups of a chart are few, so one task ranks them."""
    w = Window.orderBy(*order)
    d = df.withColumn("end", F.sum("freq").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("begin", F.lag("end", 1, 0).over(w)).withColumn("total", F.sum("freq").over(Window.partitionBy()))
    angle = lambda c: F.col(c) * F.lit(_TWO_PI) / F.col("total") + F.lit(float(start))
    return d.withColumns({"start1": angle("begin"), "end1": angle("end")}).withColumn("mid", (F.col("start1") + F.col("end1")) / 2)


def _placed(d: DataFrame, radius: float) -> DataFrame:
    turn = F.pmod(F.col("mid"), F.lit(_TWO_PI))
    return d.withColumns({
        "labelx": F.lit(radius) * F.sin("mid"), "labely": F.lit(radius) * F.cos("mid"),
        "hjust": F.when(turn > math.pi, 1).otherwise(0), "vjust": F.when((turn < math.pi / 2) | (turn > math.pi * 3 / 2), 0).otherwise(1),
    })


def pie(df: DataFrame, by: str, count: str | None = None, start: float = 0.0, threshold: float = 0.02, r0: float = 0.3, r1: float = 1.0) -> DataFrame:
    """One row a slice, by value: freq, angles, ratio, label (with its share from ``threshold`` on) and the label's place."""
    d = _circle(frequencies(df, [by], count), [by], start).withColumn("ratio", F.col("freq") / F.col("total"))
    name = F.col(by).cast("string")
    label = F.when(F.col("ratio") >= threshold, F.concat(name, F.lit("\n("), percent(F.col("ratio")), F.lit(")"))).otherwise(name)
    return _placed(d.withColumn("label", label), (r0 + r1) / 2).select(by, "freq", "start1", "end1", "mid", "ratio", "label", "labelx", "labely", "hjust", "vjust")


def donut(df: DataFrame, pie_by: str, donut_by: str, count: str | None = None, start: float = 0.0, threshold: float = 0.02, r1: float = 1.0, r2: float = 1.2, by_group: bool = True) -> DataFrame:
    """One row for each pie and donut value, absent pairs with 0: freq, its pie's total, shares overall and in the pie, angles, label ("" below ``threshold``) and its place."""
    f = frequencies(df, [pie_by, donut_by], count)
    # the grid of two small sets of values, made inside one row each, without a join of the data
    pies = f.agg(F.array_sort(F.collect_set(pie_by)).alias("p"), F.array_sort(F.collect_set(donut_by)).alias("d"))
    grid = pies.select(F.explode("p").alias(pie_by), "d").select(pie_by, F.explode("d").alias(donut_by))
    g = grid.join(f, [pie_by, donut_by], "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    g = g.withColumn("of_pie", F.sum("freq").over(Window.partitionBy(pie_by)))
    d = _circle(g, [pie_by, donut_by], start).withColumns({"ratio": F.col("freq") / F.col("total"), "ratio_in_pie": F.col("freq") / F.col("of_pie")})
    share = F.col("ratio_in_pie" if by_group else "ratio")
    label = F.when((F.col("ratio") == 0) | (F.col("ratio") < threshold), F.lit("")).otherwise(F.concat(F.col(donut_by).cast("string"), F.lit("\n("), percent(share), F.lit(")")))
    return _placed(d.withColumn("label", label), (r1 + r2) / 2).select(pie_by, donut_by, "freq", "of_pie", "start1", "end1", "mid", "ratio", "ratio_in_pie", "label", "labelx", "labely", "hjust", "vjust")


def latest_project(projects: DataFrame) -> DataFrame:
    """The project created last, on ties the last by name: one row, project and created."""
    return projects.agg(F.max(F.struct("created", "project")).alias("p")).select("p.project", "p.created")
