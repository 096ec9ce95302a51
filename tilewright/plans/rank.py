"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.plans.stage import materialize


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """With ``name`` = 1..n within each group ``by`` in ``order``; no group is sorted in one task.

    Rows are dealt into ranges of (by, order); a range's rows are numbered by
    themselves, and the counts of a group's earlier ranges are added. Rows that
    tie on the whole order are numbered in any way, so give one that decides.
    Nulls come first.
    """
    by = list(by)
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    ranges = df.repartitionByRange(*(F.col(b) for b in by), *keys).withColumn("_range", F.spark_partition_id())
    ranges = materialize(ranges, "ranges")
    n = ranges.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each group and range that holds some of it
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*keys))
    out = ranges.withColumn("_own", own).join(before.withColumnsRenamed({b: f"_b_{b}" for b in by}).withColumnRenamed("_range", "_b_range"), [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by] + [F.col("_range") == F.col("_b_range")])
    cols = [c for c in df.columns if c != name]
    return out.select(*cols, (F.col("_own") + F.col("_before")).alias(name))
