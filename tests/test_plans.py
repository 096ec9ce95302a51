import subprocess
import sys
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.plans import broadcast_if_small, heavy_hitters, latest_rows, lookup_join, materialize, ranked, release, skew, split_join, stage, stages


def test_latest_rows(spark):
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [(1, t[0], "a"), (1, t[2], "b"), (1, t[1], "c"), (2, None, "d"), (3, None, "e"), (3, t[0], "f"), (None, t[0], "g"), (4, t[0], "z"), (4, t[0], "y"), (4, t[0], None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "k int, at timestamp, v string, _rank int")
    got = latest_rows(df, "k", "at", ["v"])
    assert got.columns == df.columns and {r.k: r.v for r in got.collect()} == {1: "b", 2: "d", 3: "f", 4: "y"}
    assert latest_rows(df.limit(0), "k", "at").count() == 0
    assert latest_rows(df, ["k", "v"], "at").count() == 8


def test_lookup_join_with_hot_and_null_keys(spark):
    rng = np.random.default_rng(0)
    keys = [None if rng.random() < 0.2 else 7 if rng.random() < 0.4 else int(rng.integers(0, 3000)) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(keys)), "id int, k int")
    assert [r.k for r in heavy_hitters(df, ["k"]).collect()] == [7]
    side = spark.createDataFrame([(k, k * 2) for k in range(0, 2000)], "k int, v int")
    got = {r.id: r.v for r in lookup_join(df, side, ["k"], F.col("id")).collect()}
    assert got == {i: None if k is None or k >= 2000 else 2 * k for i, k in enumerate(keys)}
    counted = df.dropna().groupBy("k").agg(F.count("id").alias("n"), F.min("id").alias("v"))
    got = {r.id: (r.v, r.n) for r in lookup_join(df, counted, ["k"], F.col("id"), count="n").collect()}
    assert got == {i: (None, None) if k is None else (keys.index(k), keys.count(k)) for i, k in enumerate(keys)}
    assert lookup_join(df.limit(0), side, ["k"], F.col("id")).count() == 0


@pytest.mark.parametrize("shape", ["even", "one"])
def test_ranked(spark, shape):
    rng = np.random.default_rng(1)
    rows = [("a" if shape == "one" else "abc"[i % 3], int(v)) for i, v in enumerate(rng.permutation(3000))] + [(None, 1), (None, 0)]
    out = ranked(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"], "n").toPandas()
    assert len(out) == 3002
    for _, part in out.groupby("g", dropna=False):
        part = part.sort_values("v")
        assert part.n.tolist() == list(range(1, len(part) + 1))


def test_stages_and_checked_broadcast(spark):
    df = materialize(spark.range(10).select("id", F.lit("x").alias("s")))
    assert df.count() == 10 and df.schema["s"].dataType.simpleString() == "string"
    release(df)
    assert "broadcast" in broadcast_if_small(spark.range(5))._jdf.queryExecution().toString().lower()
    assert "broadcast" not in broadcast_if_small(spark.range(5), 4)._jdf.queryExecution().toString().lower()


def test_split_join_cuts_hot_keys_of_both_sides(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rng = np.random.default_rng(2)
    pick = lambda n, hot: [None if rng.random() < 0.05 else hot if rng.random() < 0.4 else int(rng.integers(0, 200)) for _ in range(n)]
    a, b = pick(500, 7), pick(400, 7) + [9] * 90
    left, right = spark.createDataFrame(list(enumerate(a)), "i int, k int"), spark.createDataFrame(list(enumerate(b)), "j int, k int")
    hot = {r.k: r._parts for r in skew.hot_counts(left, ["k"]).collect()}
    assert set(hot) >= {7} and hot[7] > 20
    want = sorted((i, j, k) for i, k in enumerate(a) for j, m in enumerate(b) if k is not None and k == m)
    assert sorted((r.i, r.j, r.k) for r in split_join(left, right, ["k"], ["i"], ["j"]).collect()) == want
    # too few hot keys, or none, change the tasks only
    assert sorted((r.i, r.j, r.k) for r in split_join(left, right, ["k"], ["i"], ["j"], skew.hot_counts(left, ["k"]), skew.hot_counts(left.limit(0), ["k"])).collect()) == want
    assert split_join(left.limit(0), right, ["k"], ["i"], ["j"]).count() == 0


def test_stages_end_with_their_scope(spark):
    import os

    with stages():
        df = materialize(spark.range(3))
        assert df.count() == 3 and os.path.exists(df._stage_path)
    assert not os.path.exists(df._stage_path)


def test_stages_dont_outlive_the_program(tmp_path):
    code = """
from tilewright.session import session
from tilewright.plans import materialize
s = session("x", "local[1]", **{"spark.ui.enabled": "false", "spark.checkpoint.dir": "%s"})
df = materialize(s.range(3))
assert df.count() == 3
%s
"""
    for end in ("", "s.stop()"):
        subprocess.run([sys.executable, "-c", code % (tmp_path, end)], check=True, timeout=120, cwd=Path(__file__).resolve().parent.parent)
        assert not list(tmp_path.glob("stage-*"))


def test_a_cluster_needs_a_shared_folder(spark):
    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        stage.shared_dir(Elsewhere)
