from collections import Counter
from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import quota_sample as qs

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
DATA = "row_id long, fid long, training_set int, seg_class string, extracted_at timestamp, quota string, _b int"


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 20), st.integers(0, 60)), min_size=1, max_size=8), st.integers(0, 200))
@settings(max_examples=300, deadline=None)
def test_quotas_keep_bounds_and_total(rows, total):
    share, floor, there = (np.array(x) for x in zip(*rows, strict=True))
    q = qs.quotas(share, floor, there, total)
    low = np.minimum(floor, there)
    assert (q >= low).all() and (q <= there).all()
    assert q.sum() == min(max(total, low.sum()), there.sum())


def test_quotas_largest_remainder():
    assert qs.quotas(np.array([0.5, 0.3, 0.2]), np.zeros(3), np.full(3, 100), 7).tolist() == [4, 2, 1]
    assert qs.quotas(np.array([0.9, 0.1]), np.array([0, 3]), np.array([100, 100]), 10).tolist() == [7, 3]
    assert qs.quotas(np.array([0.9, 0.1]), np.zeros(2), np.array([5, 100]), 10).tolist() == [5, 5]


def frames(spark, rows, targets):
    data = spark.createDataFrame([(*r, "x", 0) for r in rows], DATA)
    t = spark.createDataFrame(targets, "training_set int, seg_class string, target_share double, min_rows int, sample_rows int")
    c = spark.createDataFrame([(1, "C"), (2, "D"), (3, "E")], "id int, code string")
    return data, t, c


def test_found_report_and_sample(spark):
    rows = [(i, i, 1, "\t d\n", T1) for i in range(400)] + [(1000 + i, 1000 + i, 1, "C", T1) for i in range(30)]
    # fid 1000 becomes an E later; rows without fid, set or known code don't count; a repeated row counts once
    rows += [(5000, 1000, 1, "E", T2), (5001, None, 1, "E", T1), (5002, 9001, None, "E", T1), (5003, 9002, 1, "EE", T1), (5004, 9003, 1, None, T1), (5005, 0, 1, "D", T1), (5006, 9004, 1, "  ", T1)]
    data, targets, classes = frames(spark, rows, [(1, "D", 0.7, 0, 100), (1, "C", 0.2, 5, 100), (1, "E", 0.1, 3, 100), (2, "C", 0.0, 1, 10), (2, "D", 0.0, 0, 10)])
    report = {(r.training_set, r.seg_class): r for r in qs.p2_report(data, targets, classes).collect()}
    assert {k: (r.available, r.wanted, r.quota, r.shortfall) for k, r in report.items()} == {(1, "D"): (400, 70, 77, 0), (1, "C"): (29, 20, 22, 0), (1, "E"): (1, 10, 1, 9), (2, "C"): (0, 1, 0, 1), (2, "D"): (0, 0, 0, 0)}
    assert {k: r.reason for k, r in report.items() if r.reason} == {(1, "E"): "availability", (2, "C"): "availability"}
    assert {tuple(r) for r in qs.p2_found(data, targets, classes).collect()} == {(1, "E"), (2, "C")}
    got = [tuple(r) for r in qs.p2_sample(data, targets, classes).collect()]
    assert Counter(k for _, k, _ in got) == {"D": 77, "C": 22, "E": 1} and len(set(got)) == 100
    assert sorted(got) == sorted(tuple(r) for r in qs.p2_sample(data.repartition(7), targets, classes).collect())


def test_report_names_what_quotas_lack(spark):
    rows = [(i, i, s, "CDE"[i % 3], T1) for i in range(3000) for s in (1 + i % 4,)]
    shares = {1: ((0.9, 0), (0.05, 30), (0.05, 30)), 2: ((0.9, 0), (0.9, 0), (0.2, 0)), 3: ((1 / 3, 0), (1 / 3, 0), (1 / 3, 0)), 4: ((0.5, 0), (0.3, 0), (0.2, 0))}
    targets = [(k, c, float(a), f, 100) for k, v in shares.items() for c, (a, f) in zip("CDE", v, strict=True)]
    data, targets, classes = frames(spark, rows, targets)
    got = {(r.training_set, r.seg_class): (r.quota, r.wanted, r.shortfall, r.reason) for r in qs.p2_report(data, targets, classes).collect()}
    assert got[1, "C"] == (40, 90, 50, "floors") and got[1, "D"] == got[1, "E"] == (30, 30, 0, None)
    assert got[2, "C"] == (45, 90, 45, "size") and got[2, "E"] == (10, 20, 10, "size")
    assert sorted(got[3, c] for c in "CDE") == [(33, 34, 1, "rounding"), (33, 34, 1, "rounding"), (34, 34, 0, None)]
    assert [got[4, c][3] for c in "CDE"] == [None] * 3 and qs.p2_found(data, targets, classes).collect() == []


def test_smallest_keys_are_the_smallest(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id AS fid", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS g")
    quota = spark.createDataFrame([("a", 17), ("b", 1999)], "g string, quota long")
    got = {(r.g, r.fid) for r in qs.smallest_keys(rows, quota, ["g"], "fid").collect()}
    monkeypatch.setattr(qs, "broadcast_if_small", lambda df: df)
    assert {(r.g, r.fid) for r in qs.smallest_keys(rows, quota, ["g"], "fid").collect()} == got
    assert qs.smallest_keys(rows, quota.selectExpr("g", "2 * quota AS quota"), ["g"], "fid").where("g = 'b'").count() == 2000
    keys = [(r.g, r.h, r.fid) for r in rows.selectExpr("g", "xxhash64(0, fid) AS h", "fid").collect()]
    want = {(g, f) for g, n in (("a", 17), ("b", 1999)) for _, _, f in sorted(x for x in keys if x[0] == g)[:n]}
    assert got == want


def test_empty(spark):
    data, targets, classes = frames(spark, [], [])
    for f in (qs.p2_found, qs.p2_report, qs.p2_sample):
        assert f(data, targets, classes).collect() == []
    _, targets, _ = frames(spark, [], [(1, "C", 1.0, 2, 10), (None, "C", 1.0, 2, 10)])
    assert [tuple(r) for r in qs.p2_found(data, targets, classes).collect()] == [(1, "C")]
