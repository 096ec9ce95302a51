"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 128
#: A key with no more rows isn't worth cutting.
HOT_ROWS = 1000


def heavy_hitters(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys (no null in them) that hold more than ``share`` of the rows: 1 / share rows at most.

    Rows are pre-aggregated by the partial hash aggregate, so a hot key costs
    one row per input partition.
    """
    counts = df.where(_all_set(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_all")).scalar()
    return counts.where(F.col("_n") > total * F.lit(float(share))).select(*keys)


def hot_counts(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """The heavy hitters of more than HOT_ROWS rows with ``_parts``: how many times ``share`` of the rows each of them holds, rounded up."""
    counts = df.where(_all_set(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = F.greatest(df.agg(F.count(F.lit(1)).alias("_all")).scalar() * F.lit(float(share)), F.lit(float(HOT_ROWS)))
    return counts.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_by: Sequence[str], right_by: Sequence[str], hot_left: DataFrame | None = None, hot_right: DataFrame | None = None, share: float = HOT_SHARE) -> DataFrame:
    """Inner join in which a hot key of either side is cut: m parts of the left rows meet n parts of the right rows in m x n tasks.

    Parts follow the counts, so none holds much more than ``share`` of a side.
    ``left_by`` and ``right_by`` are columns that differ from row to row;
    ``hot_left`` and ``hot_right`` are :func:`hot_counts` of the sides where
    the caller knows them, and have 1 / share rows at most. Null keys meet none.
    """
    keys = list(keys)
    a = (hot_counts(left, keys, share) if hot_left is None else hot_left).select(*keys, F.col("_parts").alias("_m"), F.lit(1).alias("_n"))
    b = (hot_counts(right, keys, share) if hot_right is None else hot_right).select(*keys, F.lit(1).alias("_m"), F.col("_parts").alias("_n"))
    # a row for each hot key of a side, so a bounded broadcast
    hot = F.broadcast(a.unionByName(b).groupBy(*keys).agg(F.max("_m").alias("_m"), F.max("_n").alias("_n")))

    def cut(df: DataFrame, by: Sequence[str], own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*by), F.coalesce(f"_{own}", F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(f"_{other}", F.lit(1)) - 1))
        return df.join(hot, keys, "left").select(*df.columns, part.alias(f"_at_{own}"), every.alias(f"_at_{other}"))

    on = [*keys, "_at_m", "_at_n"]
    return cut(left, left_by, "m", "n").join(cut(right, right_by, "n", "m"), on).drop("_at_m", "_at_n")


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Marked for broadcast if it has no more than ``rows`` rows, which a small job counts; else as it is, and the planner joins it by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _all_set(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))


def lookup_join(df: DataFrame, lookup: DataFrame, keys: Sequence[str], spread: Column, share: float = HOT_SHARE, salts: int = 4096, count: str | None = None) -> DataFrame:
    """Left join to a lookup that holds each key once; hot and null keys don't gather in one task.

    The lookup's rows of hot keys (1 / share at most, so the broadcast is
    bounded) are joined map-side. Only the other rows are shuffled by key; rows
    that need no lookup any more, as their key is hot or null, are spread over
    ``salts`` by ``spread``, a column of the left side that differs from row to
    row. Keys that the lookup lacks get nulls. Column names of the two sides
    must differ but for the keys. If the lookup's column ``count`` says how many
    of the left rows a key has, as when it was aggregated from them, the hot
    keys are read off it, else they are counted.
    """
    keys = list(keys)
    values = [c for c in lookup.columns if c not in keys]
    if count is None:
        top = lookup.join(F.broadcast(heavy_hitters(df, keys, share)), keys, "left_semi")
    else:
        # a share of what the lookup counts: 1 / share rows at most as well
        top = lookup.where(F.col(count) > lookup.agg(F.sum(count)).scalar() * F.lit(float(share)))
    top = top.select(*keys, F.struct(*values).alias("_hot"))
    out = df.join(F.broadcast(top), keys, "left")
    cold = _all_set(keys) & F.col("_hot").isNull()
    out = out.withColumn("_salt", F.when(cold, F.lit(-1)).otherwise(F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")))
    for k in keys:
        out = out.withColumn(f"_k_{k}", F.when(cold, F.col(k)).otherwise(F.lit(0).cast(df.schema[k].dataType)))
    side = lookup.select(*(F.col(k).alias(f"_r_{k}") for k in keys), F.struct(*values).alias("_cold"), F.lit(-1).alias("_r_salt"))
    on = reduce(lambda a, b: a & b, (F.col(f"_k_{k}") == F.col(f"_r_{k}") for k in keys), F.col("_salt") == F.col("_r_salt"))
    out = out.join(side, on, "left").withColumn("_got", F.coalesce("_hot", "_cold"))
    return out.select(*df.columns, *(F.col("_got")[v].alias(v) for v in values))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by ``key`` if the scan has fewer partitions than the cluster has cores, as for heavy work on a single small file; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
