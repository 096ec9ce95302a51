"""A sample whose shares follow target proportions (problem 2).

Available rows are counted by category, each set's quotas come from a largest
remainder with floors and caps, and each category gives its rows with the
smallest random keys. The key is a hash of the row's id, so the same rows give
the same sample on any cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.plans.latest import latest_rows
from tilewright.plans.skew import broadcast_if_small, lookup_join
from tilewright.plans.stage import materialize

#: Random keys fall into 2**BUCKET_BITS ranges; only the range that a quota ends in is ranked.
BUCKET_BITS = 16
_SPACE = r"^[\s\p{Z}\x0b\x1c-\x1f\x85]+|[\s\p{Z}\x0b\x1c-\x1f\x85]+$"


def clean_class(c: Column) -> Column:
    """Without surrounding white space, in upper case."""
    return F.upper(F.regexp_replace(c, _SPACE, ""))


def quotas(share: np.ndarray, floor: np.ndarray, there: np.ndarray, total: int) -> np.ndarray:
    """Integer quotas that sum to ``total`` where floors and availability allow it.

    Each quota is at least min(floor, there) and at most there. Between these
    bounds quotas are share x total, where categories that hit a bound are
    fixed there and the rest is divided again by share; integers come from the
    largest remainder, ties to the earlier category. If the floors alone exceed
    the total, the floors hold; if all rows are too few, all are taken.
    """
    low = np.minimum(floor, there).astype(np.int64)
    high = there.astype(np.int64)
    want = min(max(int(total), int(low.sum())), int(high.sum()))
    fixed = np.zeros(len(share), bool)
    q = low.astype(float)
    while not fixed.all():
        rest = want - q[fixed].sum()
        weight = np.where(fixed, 0, share).astype(float)
        if weight.sum() <= 0:
            weight = np.where(fixed, 0, high - low + 1e-9)
        ideal = rest * weight / weight.sum()
        over, under = ~fixed & (ideal > high), ~fixed & (ideal < low)
        if not over.any() and not under.any():
            q[~fixed] = ideal[~fixed]
            break
        # water filling: fix the side that is violated more
        if (ideal - high)[over].sum() >= (low - ideal)[under].sum():
            q[over], fixed = high[over], fixed | over
        else:
            q[under], fixed = low[under], fixed | under
    out = np.clip(np.floor(q + 1e-9).astype(np.int64), low, high)
    left = want - int(out.sum())
    rem = q - out
    while left > 0:
        room = out < high
        if not room.any():
            break
        take = np.flatnonzero(room)[np.argsort(-rem[room], kind="stable")][:left]
        out[take] += 1
        rem[take] -= 1
        left -= len(take)
    return out


def eligible(data: DataFrame, classes: DataFrame) -> DataFrame:
    """training_set, seg_class (a known code), fid of the latest row of each fid. Rows without fid, set or known code are left out."""
    d = latest_rows(data.select("fid", "training_set", clean_class(F.col("seg_class")).alias("seg_class"), "row_id", "extracted_at"), "fid", "extracted_at", ["row_id"])
    d = d.where(F.col("training_set").isNotNull())
    return d.join(classes.select(F.col("code").alias("seg_class")).distinct(), "seg_class", "left_semi").select("training_set", "seg_class", "fid")


def quota_plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each target: training_set, seg_class, available, wanted, quota, shortfall, reason.

    ``counts`` is (training_set, seg_class, available). ``wanted`` is the
    greater of min_rows and target_share x sample_rows, ``shortfall`` what the
    quota lacks of it. ``reason`` says why, null where nothing lacks:
    'availability' if there are too few rows, 'rounding' if a fraction of a
    row lacks, 'floors' if floors above the shares of other classes took the
    rows, 'size' if the set's targets together exceed its size. A set's targets,
    as many as classes, meet in one task. Null shares, floors and sizes count as
    0; targets without set or class are left out; of repeated targets the
    largest is taken.
    """
    t = targets.groupBy("training_set", "seg_class").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("target_share", "min_rows", "sample_rows"))).where(F.col("training_set").isNotNull() & F.col("seg_class").isNotNull())
    t = t.join(counts, ["training_set", "seg_class"], "left").fillna(0, ["available"])
    share = F.round(F.col("target_share") * F.col("sample_rows"), 6)
    t = t.select("training_set", "seg_class", "target_share", "min_rows", "sample_rows", "available", share.alias("ideal"), F.ceil(F.greatest(F.col("min_rows").cast("double"), share)).cast("bigint").alias("wanted"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_class", kind="stable")
        q = quotas(pdf["target_share"].to_numpy(float), pdf["min_rows"].to_numpy(), pdf["available"].to_numpy(), int(pdf["sample_rows"].max()))
        wanted, there, ideal = (pdf[c].to_numpy() for c in ("wanted", "available", "ideal"))
        raised = (np.minimum(pdf["min_rows"].to_numpy(), there) > ideal).any()
        why = np.select([q >= wanted, there < wanted, q > wanted - 1, q >= np.floor(ideal), raised], [None, "availability", "rounding", "rounding", "floors"], "size")
        return pdf[["training_set", "seg_class", "available", "wanted"]].assign(quota=q, shortfall=np.maximum(wanted - q, 0), reason=why)

    kind = t.schema["training_set"].dataType.simpleString()
    return t.groupBy("training_set").applyInPandas(one, f"training_set {kind}, seg_class string, available bigint, wanted bigint, quota bigint, shortfall bigint, reason string")


def smallest_keys(rows: DataFrame, quota: DataFrame, by: list[str], key: str, seed: int = 0) -> DataFrame:
    """Of each category ``by`` the ``quota`` rows with the smallest random keys; ties by ``key``.

    No category is sorted in one task: the hashes' top bits are counted by
    bucket, whole buckets below the quota are taken, and only the bucket in
    which it ends, about a 2**-16th of the category, is ranked.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    rows = rows.select("*", h.alias("_h")).withColumn("_b", (F.shiftright("_h", 64 - BUCKET_BITS) + F.lit(2 ** (BUCKET_BITS - 1))).cast("int"))
    quota = quota.select(*by, "quota").where("quota > 0")
    # counted before any join: at most 2**BUCKET_BITS rows a category
    sizes = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")).join(quota, by)
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b"))
    # the bucket that the quota ends in, and what it gives; past the last bucket where all rows are taken
    cut = sizes.withColumn("_to", upto).groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("_to") > F.col("quota"), F.col("_b"))), F.lit(2**BUCKET_BITS)).alias("_at"), F.max(F.when(F.col("_to") <= F.col("quota"), F.col("_to"))).alias("_whole"), F.max("quota").alias("_quota"))
    cut = materialize(cut.select(*by, "_at", (F.col("_quota") - F.coalesce("_whole", F.lit(0))).alias("_rest")), "cuts")
    small = broadcast_if_small(cut)
    got = rows.join(small, by) if small is not cut else lookup_join(rows, cut, by, F.col(key))
    whole = got.where(F.col("_b") < F.col("_at"))
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    part = got.where(F.col("_b") == F.col("_at")).withColumn("_r", rank).where(F.col("_r") <= F.col("_rest")).drop("_r")
    return whole.unionByName(part).drop("_h", "_b", "_at", "_rest")


def _counts(e: DataFrame) -> DataFrame:
    return e.groupBy("training_set", "seg_class").agg(F.count(F.lit(1)).alias("available"))


def p2_sample(data: DataFrame, targets: DataFrame, classes: DataFrame, seed: int = 0) -> DataFrame:
    """training_set, seg_class, fid of the sample; empty without targets or eligible rows."""
    e = materialize(eligible(data, classes), "p2-eligible")
    return smallest_keys(e, quota_plan(_counts(e), targets), ["training_set", "seg_class"], "fid", seed)


def p2_report(data: DataFrame, targets: DataFrame, classes: DataFrame) -> DataFrame:
    """Every target with what is available, its quota, its shortfall and the reason of that."""
    return quota_plan(_counts(eligible(data, classes)), targets)


def p2_found(data: DataFrame, targets: DataFrame, classes: DataFrame) -> DataFrame:
    """training_set, seg_class of the targets that the rows there are can't fill."""
    return p2_report(data, targets, classes).where(F.col("reason") == "availability").select("training_set", "seg_class")


def p2_totals(data: DataFrame, targets: DataFrame, classes: DataFrame, seed: int = 0) -> DataFrame:
    """training_set, quota, sampled: rows of each set's sample as planned and as drawn."""
    e = materialize(eligible(data, classes), "p2-eligible")
    plan = materialize(quota_plan(_counts(e), targets), "p2-plan")
    drawn = smallest_keys(e, plan, ["training_set", "seg_class"], "fid", seed).groupBy("training_set").agg(F.count(F.lit(1)).alias("sampled"))
    return plan.groupBy("training_set").agg(F.sum("quota").alias("quota")).join(drawn, "training_set", "left").select("training_set", "quota", F.coalesce("sampled", F.lit(0)).alias("sampled"))
