"""Current version of revised rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str | Sequence[str], at: str, tie: Sequence[str | Column] = ()) -> DataFrame:
    """The row with the greatest ``at`` of every key; all columns are kept.

    One shuffle on the key; the engine filters ``rank = 1`` before it. Rows
    without a key are left out. A null ``at`` loses against any time. Ties on
    ``at`` go to the smallest ``tie`` values, so repeated runs agree.
    """
    keys = [key] if isinstance(key, str) else list(key)
    taken = {c.lower() for c in df.columns}
    rank = "_rank"
    while rank in taken:
        rank += "_"
    order = [F.col(at).desc_nulls_last(), *(F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in tie)]
    have = df.where(F.forall(F.array(*(F.col(k).isNotNull() for k in keys)), lambda x: x)) if len(keys) > 1 else df.where(F.col(keys[0]).isNotNull())
    return have.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)
