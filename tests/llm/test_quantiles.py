import math
from datetime import datetime

import numpy as np

from tilewright.llm import quantiles as q

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
TREES = "fid long, batch_id int, tile_name string, height double, crown_area double, class string, delivered_at timestamp, node string, n int"
CLASSES = "id int, code string, label string, is_tree boolean"


def rank_error(values, v, p):
    """How far, as a share of all values, the quantized v is from rank p."""
    lv = np.sort(np.floor((np.log2(values) - q.LOW) * 2**q.BITS / (q.HIGH - q.LOW)).clip(0, 2**q.BITS - 1))
    at = np.floor((np.log2(v) - q.LOW) * 2**q.BITS / (q.HIGH - q.LOW))
    lo, hi = np.searchsorted(lv, at, "left"), np.searchsorted(lv, at, "right")
    want = math.ceil(p * len(values))
    return max(lo + 1 - want, want - hi, 0) / len(values)


def test_rank_error_is_bounded_after_merges():
    rng = np.random.default_rng(0)
    k = 200
    parts = [np.exp(rng.normal(m, s, n)) for m, s, n in ((0, 1, 40_000), (3, 0.1, 30_000), (-2, 2, 7), (1, 0.0001, 50_000))]
    every = np.concatenate(parts)
    nodes, counts = [], []
    for v in parts:
        lv = np.floor((np.log2(v) - q.LOW) * 2**q.BITS / (q.HIGH - q.LOW)).clip(0, 2**q.BITS - 1).astype(int) + 2**q.BITS
        g, n, c = q.compressed(np.zeros(len(lv), int), lv, np.ones(len(lv), int), k)
        assert c.sum() == len(v) and len(n) <= 3 * k + 1
        nodes.append(n)
        counts.append(c)
    n, c = np.concatenate(nodes), np.concatenate(counts)
    g, n, c = q.compressed(np.zeros(len(n), int), n, c, k)
    assert c.sum() == len(every) and len(n) <= 3 * k + 1
    at = (0.01, 0.25, 0.5, 0.9, 0.999)
    got, size = q.quantiles_of(g, n, c, at)
    assert size.tolist() == [len(every)]
    assert all(rank_error(every, v, p) <= q.BITS / k for v, p in zip(got[0], at, strict=True))


def test_groups_are_independent():
    rng = np.random.default_rng(1)
    group, node = rng.integers(0, 5, 20_000), rng.integers(2**q.BITS, 2 ** (q.BITS + 1), 20_000)
    g, n, c = q.compressed(group, node, np.ones(20_000, int), 50)
    for k in range(5):
        _, one, oc = q.compressed(np.zeros((group == k).sum(), int), node[group == k], np.ones((group == k).sum(), int), 50)
        assert n[g == k].tolist() == one.tolist() and c[g == k].tolist() == oc.tolist()


def test_digests_in_spark(spark):
    rng = np.random.default_rng(2)
    v = np.exp(rng.normal(2, 1, 5000))
    rows = [(["a", "b", None][i % 3], float(x)) for i, x in enumerate(v)] + [("a", x) for x in (None, float("nan"), float("inf"), 0.0, -3.0)] + [("z", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    d = q.digests(df, ["g"], "v")
    got = {(r.g, r.pct): (r.value, r.n) for r in q.percentiles(d, ["g"], [50, 90]).collect()}
    assert {g for g, _ in got} == {"a", "b", None}
    for i, g in enumerate(["a", "b", None]):
        own = v[i::3]
        for p in (50, 90):
            assert got[g, p][1] == len(own)
            assert rank_error(own, got[g, p][0], p / 100) <= q.BITS / q.K
    whole = q.percentiles(q.merged(d.withColumnRenamed("g", "x").selectExpr("1 AS one", "nodes", "counts", "ends"), ["one"]), ["one"], [50]).collect()
    assert whole[0].n == 5000 and abs(whole[0].value / np.median(v) - 1) < 0.02


def test_values_beyond_the_universe_are_told(spark):
    rows = [("a", float(x)) for x in (1e-9, 1e12, 1e300, *range(1, 998))] + [("b", 5.0)]
    d = q.digests(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 50)
    assert {r.g: r.ends for r in d.collect()} == {"a": 3, "b": 0}
    m = q.merged(d.unionByName(d).selectExpr("1 AS one", "nodes", "counts", "ends"), ["one"], 50)
    got = q.percentiles(m, ["one"], [50]).collect()[0]
    assert (got.n, got.ends) == (2002, 6) and abs(got.value / 500 - 1) < 0.6


def trees(spark, rows):
    return spark.createDataFrame([(f, b, "R1C1", h, c, k, t, "x", 1) for f, b, h, c, k, t in rows], TREES)


def test_p1_found(spark):
    classes = spark.createDataFrame([(1, "C", "coniferous", True), (2, "G", "grass", False)], CLASSES)
    rows = [(i, 1, 10.0 + i % 3, 5.0, " Coniferous\t", T1) for i in range(3000)]
    # a batch whose heights are twice as high; its rows' first versions don't count
    rows += [(10_000 + i, 2, 22.0 + i % 3, 5.0, "CONIFEROUS", T2) for i in range(100)] + [(10_000 + i, 1, 1.0, 1.0, "grass", T1) for i in range(100)]
    # 99 values are too few
    rows += [(20_000 + i, 3, 99.0, 5.0, "coniferous", T1) for i in range(99)] + [(20_200, 3, float("nan"), None, "coniferous", T1), (20_201, 3, -1.0, 0.0, "coniferous", None)]
    rows += [(None, 2, 500.0, 500.0, "coniferous", T1), (30_000, None, 10.0, 5.0, "coniferous", T1), (30_001, 2, 1e300, 1e300, "grass", T1), (30_002, 2, 9.0, 9.0, None, T1)] + rows[:5]
    df = trees(spark, rows)
    assert {tuple(r) for r in q.p1_found(df, classes).collect()} == {(2, "coniferous", "height", 50), (2, "coniferous", "height", 90)}
    every = {(r.batch_id, r.measure, r.pct): r for r in q.p1_percentiles(df, classes, (50,)).collect()}
    assert every[None, "height", 50].n == 3000 + 100 + 99 + 1
    assert abs(every[2, "height", 50].value / 23 - 1) < 0.01


def test_p1_empty(spark):
    classes = spark.createDataFrame([], CLASSES)
    assert q.p1_found(trees(spark, []), classes).collect() == []
    assert q.p1_percentiles(trees(spark, [(1, 1, 1.0, 1.0, "x", T1)]), classes).collect() == []
