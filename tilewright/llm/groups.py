"""Splits that keep related records together (problem 3).

Union-find over local forests that are merged level by level. Each key's rows
are first tied to the key's smallest row, so the graph has one edge a row at
most and its nodes are row ids. At a level every task makes a forest of its own
share of the edges, whatever share that is, with roots by a random order that
changes by level. Every node that is no root in all of its tasks hangs under
one of its roots and leaves the graph; only what tasks disagree on goes up,
with both ends moved to the tops of their trees. A node stays only if it comes
first among all it is tied to, so at least half of the nodes leave at a level
on average, whatever the shape of the graph, and the forests of several tasks
become one until one task holds the rest. No task ever holds more than
EDGES_PER_TASK edges and the driver holds none.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.plans.skew import lookup_join
from tilewright.plans.stage import materialize, release

#: Edges that one task merges in memory: about 100 bytes each.
EDGES_PER_TASK = 1_000_000
#: Groups are assigned in tiers by size, each down to this share of the tier's largest size: the first has 1 / TIER groups at most.
TIER = 1 / 2000
#: Counts of a group's rows in a stratum that one task assigns: about 100 bytes each.
COUNTS_PER_TASK = 500_000


def _order(nodes: np.ndarray, level: int) -> np.ndarray:
    """A random number for each node, another one at each level; 0, the nodes' own order, is for the last level."""
    x = nodes.astype(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def local_forest(u: np.ndarray, v: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each node that isn't the first of its component: the smallest, or at a level above 0 the first in that level's random order."""
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    by = np.lexsort((nodes, _order(nodes, level))) if level else np.arange(len(nodes))
    rank = np.empty(len(nodes), np.int64)
    rank[by] = np.arange(len(nodes))
    a, b = rank[inv[: len(u)]], rank[inv[len(u) :]]
    parent = np.arange(len(nodes))
    while len(a):
        x, y = parent[a], parent[b]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[by[child]], nodes[by[parent[child]]]


def _forests(edges: DataFrame, level: int = 0) -> DataFrame:
    """One forest a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            node, root = local_forest(*(np.concatenate(x) for x in zip(*got, strict=True)), level)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

    return edges.mapInArrow(run, "node bigint, root bigint")


def _followed(pairs: DataFrame, tops: DataFrame, column: str) -> DataFrame:
    """``pairs`` with ``column`` replaced by the root that ``tops`` (node, root) has for it, if any; ``_moved`` tells."""
    top = tops.select(F.col("node").alias(column), F.col("root").alias("_over"))
    other = next(c for c in pairs.columns if c != column)
    got = lookup_join(pairs, top, [column], F.col(other))
    return got.select(*(F.coalesce("_over", c).alias(c) if c == column else F.col(c) for c in pairs.columns), F.col("_over").isNotNull().alias("_moved"))


def _contracted(edges: DataFrame, tasks: int, level: int) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the nodes that leave the graph at a level, and the edges (u, v) among those that stay."""
    # any share of the edges will do, so they are dealt out by both ends and the level: no hot node fills a task
    forest = materialize(_forests(edges.repartition(tasks, F.xxhash64("u", "v", F.lit(level))), level), f"forest-{level}")
    # a root comes before its nodes in the level's order, so pointers to any of them make no circle
    first = materialize(forest.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("_last")), f"first-{level}")
    torn = first.where(F.col("root") != F.col("_last")).select("node", F.col("root").alias("v"))
    # a node is in the forest once a task at most, so this join has no hot keys
    clash = materialize(forest.join(torn, "node").where(F.col("root") != F.col("v")).select(F.col("root").alias("u"), "v").distinct(), f"clash-{level}")
    release(forest)
    tops = first.select("node", "root")
    while True:
        # each pass doubles the distance; chains in a random order are short
        nxt = materialize(_followed(tops, tops, "root"), f"tops-{level}")
        release(first)
        first, tops = nxt, nxt.select("node", "root")
        if nxt.where("_moved").limit(1).count() == 0:
            break
    up = _followed(_followed(clash, tops, "u").select("u", "v"), tops, "v").where(F.col("u") != F.col("v"))
    up = materialize(up.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"edges-{level}")
    release(clash)
    return nxt, up


def components(edges: DataFrame, per_task: int = EDGES_PER_TASK, trace: list[int] | None = None) -> DataFrame:
    """(node, root) of every node but each component's smallest, its root.

    ``edges`` has two bigint columns; loops tie nothing, null ends are left
    out. ``trace`` takes the number of edges of each level.
    """
    e = edges.toDF("u", "v").dropna()
    e = materialize(e.where(F.col("u") != F.col("v")), "edges-0")
    trace = [] if trace is None else trace
    left: list[DataFrame] = []
    trace.append(e.count())
    while trace[-1] > per_task:
        gone, up = _contracted(e, -(-trace[-1] // per_task), len(trace))
        release(e)
        left.append(gone)
        e = up
        trace.append(e.count())
    labels = materialize(_forests(e.repartition(1)), "labels")
    release(e)
    if not left:
        return labels
    for gone in reversed(left):
        below = materialize(_followed(gone.select("node", "root"), labels, "root").select("node", "root").unionByName(labels), "labels")
        release(gone)
        release(labels)
        labels = below
    # from the random root of each component to its smallest node
    least = labels.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("_least"), F.count(F.lit(1)).alias("_n"))
    least = materialize(least, "least")
    out = lookup_join(labels, least, ["root"], F.col("node"), count="_n").select("node", F.col("_least").alias("root"))
    out = materialize(out.unionByName(least.select(F.col("root").alias("node"), F.col("_least").alias("root"))).where(F.col("node") != F.col("root")), "components")
    release(labels)
    release(least)
    return out


def grouped(data: DataFrame, per_task: int = EDGES_PER_TASK, **more: Column) -> DataFrame:
    """row_id, group_id, tied of every row with a row_id, and the columns ``more``.

    Rows with the same fid, or the same type and training_fid, share a group,
    and so on from row to row; null keys and a training_fid below 1 tie
    nothing. ``group_id`` is the smallest row_id of the group; ``tied`` is
    whether the group has two rows or more. Rows without row_id are left out.
    """
    rows = data.select("row_id", "fid", "type", F.when(F.col("training_fid") >= 1, F.col("training_fid")).alias("feature"), *(c.alias(k) for k, c in more.items())).where(F.col("row_id").isNotNull())
    rows = rows.withColumn("kind", F.when(F.col("feature").isNotNull(), F.col("type"))).drop("type")
    least = lambda by, a, n: materialize(rows.dropna(subset=by).groupBy(*by).agg(F.min("row_id").alias(a), F.count(F.lit(1)).alias(n)), f"p3-{a}")
    linked = lookup_join(rows, least(["fid"], "a", "na"), ["fid"], F.col("row_id"), count="na")
    linked = lookup_join(linked, least(["kind", "feature"], "b", "nb"), ["kind", "feature"], F.col("row_id"), count="nb")
    tied = (F.coalesce("na", F.lit(1)) > 1) | (F.coalesce("nb", F.lit(1)) > 1)
    linked = materialize(linked.select("row_id", F.coalesce("a", "b").alias("root"), "a", "b", tied.alias("tied"), *more), "p3-linked")
    edges = linked.where(F.col("a") != F.col("b")).select("a", "b").distinct()
    up = components(edges, per_task).select(F.col("node").alias("root"), F.col("root").alias("top"))
    out = lookup_join(linked.drop("a", "b"), up, ["root"], F.col("row_id"))
    return out.select("row_id", F.coalesce("top", "root", "row_id").alias("group_id"), "tied", *more)


def assigned(sizes: np.ndarray, strata: np.ndarray, totals: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Split of each group (rows of ``sizes``, groups x strata counts), the largest first."""
    group, stratum = np.nonzero(strata)
    return _dealt(group, stratum[:, None], strata[group, stratum], shares[:, None] * totals[None, :])


def _dealt(group: np.ndarray, strata: np.ndarray, n: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Split of each group 0.., the largest first.

    ``n`` rows of ``group`` lie in each of the ``strata`` of the same row of
    that array. A group goes where it adds least to the squares of the rows
    that the splits (rows of ``target``) are off their targets, over all strata.
    """
    sizes = np.bincount(group, n)
    by = np.argsort(group, kind="stable")
    edge = np.append(0, np.cumsum(np.bincount(group)))
    strata, n = strata[by], n[by].astype(float)
    off = -target
    out = np.zeros(len(sizes), np.int64)
    for g in np.argsort(-sizes, kind="stable").tolist():
        own = slice(edge[g], edge[g + 1])
        s, w = strata[own].T.ravel(), np.tile(n[own], strata.shape[1])
        out[g] = k = int((off[:, s] @ w).argmin())
        np.add.at(off[k], s, w)
    return out


def _targets(n: np.ndarray, need: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Whole rows of strata (columns) for each split, ``n`` a stratum: what it needs in proportion, rounded up or down by chance so that the mean is exact."""
    edge = np.floor(np.cumsum(need, 0) * n + rng.random(len(n)))
    edge[-1] = n
    return np.diff(edge, axis=0, prepend=0)


def _raked(lack: np.ndarray, of: list[np.ndarray], shares: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Each split's part (rows) of what is left of each stratum (columns).

    In proportion to what the splits lack of the stratum. A split that has too
    much of one stratum already would get too much in all, so parts are scaled
    in turn until what the splits get of the strata of each set and each class
    (``of``: lists of the number of each stratum's) is what they lack of it.
    Where a split has too much of a whole set or class, as of a group too large
    for it, nothing is scaled: others keep their shares.
    """
    rest = np.maximum(lack.sum(0), 0)
    # a little of everything, so that scaling can move it
    m = np.maximum(lack, 0) + 0.02 * shares[:, None] * rest
    for _ in range(rounds):
        for k in of:
            want, have = (np.stack([np.bincount(k, r) for r in x]) for x in (lack, m))
            can = (have > 0) & (want >= 0).all(0)
            m *= np.divide(want, have, out=np.ones_like(have), where=can)[:, k]
        total = m.sum(0)
        m *= np.divide(rest, total, out=np.zeros_like(rest), where=total > 0)
    total = m.sum(0)
    return np.where(total > 0, m / np.where(total > 0, total, 1), shares[:, None])


def _placed(counts: DataFrame, tasks: int, strata: np.ndarray, need: np.ndarray, seed: int) -> DataFrame:
    """``counts`` with the number of their group's split, and ``first`` on one row of each group. ``need`` has the splits' parts of what is left of each of the ``strata``."""
    shared = counts.sparkSession.sparkContext.broadcast((strata, need))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got).combine_chunks().sort_by([("group_id", "ascending"), ("stratum", "ascending")])
        ids, first, group = np.unique(t["group_id"].to_numpy(), return_index=True, return_inverse=True)
        n = t["n"].to_numpy()
        keys, need = shared.value
        pairs, pair = np.unique(t["stratum"].to_numpy(), return_inverse=True)
        need = need[:, np.searchsorted(keys, pairs)]
        rows = np.bincount(pair, n)
        # sets, classes and all rows count as well, so that what pairs are off doesn't add up
        at, target = [pair], [_targets(rows, need, np.random.default_rng([seed % 2**32, TaskContext.get().partitionId()]))]
        for c in ("set", "class"):
            some, k = np.unique(t[c].to_numpy(), return_inverse=True)
            of = np.zeros((len(need), len(some)))
            for split, x in zip(of, need[:, pair], strict=True):
                np.add.at(split, k, x * n)
            at.append(k + sum(x.shape[1] for x in target))
            target.append(of)
        at.append(np.full(len(n), sum(x.shape[1] for x in target)))
        target.append((need * rows).sum(1, keepdims=True))
        split = _dealt(group, np.column_stack(at), n, np.concatenate(target, axis=1))
        flag = np.zeros(len(n), bool)
        flag[first] = True
        yield pa.RecordBatch.from_arrays([t["group_id"].combine_chunks(), t["stratum"].combine_chunks(), pa.array(n), t["size"].combine_chunks(), pa.array(split[group].astype(np.int32)), pa.array(flag)], names=["group_id", "stratum", "n", "size", "split", "first"])

    dealt = counts.repartitionByRange(tasks, "main", "group_id") if tasks > 1 else counts.repartition(1)
    return dealt.select("group_id", "stratum", "set", "class", "n", "size").mapInArrow(run, "group_id bigint, stratum bigint, n bigint, size bigint, split int, first boolean")


def p3_split(data: DataFrame, proportions: Mapping[str, float] | None = None, seed: int = 0, per_task: int = COUNTS_PER_TASK) -> DataFrame:
    """row_id, group_id, split of every row with a row_id; a group is never parted.

    Every group is assigned greedily by its counts in each stratum, a pair of
    training_set and seg_class, the largest groups first. Groups come in tiers
    by size, those within one stratum after the others. A tier is dealt out to tasks in ranges of the stratum that most of
    a group's rows are in; each task divides its rows of a stratum as the splits
    then lack rows of that stratum, so smaller groups make up for what larger
    ones are off, in their strata, sets and classes. The driver
    holds what each split has of each stratum, and no groups.
    """
    proportions = dict(proportions or {"train": 0.8, "validation": 0.1, "test": 0.1})
    names, shares = list(proportions), np.array(list(proportions.values()), float)
    shares = shares / shares.sum()
    kind = {"set": F.xxhash64(F.coalesce("training_set", F.lit(-1))), "class": F.xxhash64(F.upper(F.trim(F.coalesce("seg_class", F.lit("")))))}
    g = materialize(grouped(data, **{f"_{k}": c for k, c in kind.items()}), "p3-groups")
    counts = g.groupBy("group_id", F.col("_set").alias("set"), F.col("_class").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumns({"size": F.sum("n").over(Window.partitionBy("group_id")), "stratum": F.xxhash64("set", "class")})
    # the stratum of most of the group's rows
    counts = counts.withColumn("main", F.max(F.struct("n", "stratum")).over(Window.partitionBy("group_id"))["stratum"])
    total = g.count()
    floors = [total * TIER]
    while floors[-1] >= 1:
        floors.append(floors[-1] * TIER)
    tier = sum((F.col("size") <= f).cast("int") for f in floors[:-1]) if len(floors) > 1 else F.lit(0)
    # groups within one stratum come after the others of their size: they make up for these exactly
    single = (F.count(F.lit(1)).over(Window.partitionBy("group_id")) == 1).cast("int")
    counts = materialize(counts.withColumn("tier", 2 * tier + single), "p3-counts")
    tasks = {r.tier: -(-r.n // per_task) for r in counts.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()}
    all_rows = counts.groupBy("stratum", "set", "class").agg(F.sum("n").alias("n")).toPandas().sort_values("stratum")
    strata = all_rows["stratum"].to_numpy(np.int64)
    of = [np.unique(all_rows[c], return_inverse=True)[1] for c in ("set", "class")]
    lack = shares[:, None] * all_rows["n"].to_numpy(float)[None, :]
    done = []
    for k in sorted(tasks):
        done.append(materialize(_placed(counts.where(F.col("tier") == k), tasks[k], strata, _raked(lack, of, shares), seed + k), f"p3-tier-{k}"))
        held = done[-1].groupBy("stratum", "split").agg(F.sum("n").alias("n")).toPandas()
        lack[held["split"].to_numpy(np.int64), np.searchsorted(strata, held["stratum"].to_numpy(np.int64))] -= held["n"].to_numpy(float)
    rows = g.select("row_id", "group_id")
    if not done:
        return rows.withColumn("split", F.lit(None).cast("string"))
    of = reduce(DataFrame.unionByName, done).where("first").select("group_id", F.element_at(F.array(*map(F.lit, names)), F.col("split") + 1).alias("split"), F.col("size").alias("_n"))
    return lookup_join(rows, of, ["group_id"], F.col("row_id"), count="_n").select("row_id", "group_id", "split")


def p3_found(data: DataFrame) -> DataFrame:
    """row_id, group_id of each row in a group of two or more. An empty table gives no rows."""
    return grouped(data).where("tied").select("row_id", "group_id")


def p3_checks(data: DataFrame, proportions: Mapping[str, float] | None = None) -> DataFrame:
    """One row about a split: rows, groups, parted (groups in two splits or more), even (whether each split's share of all rows is within 1 % of its proportion, or within the largest group if that is more)."""
    proportions = dict(proportions or {"train": 0.8, "validation": 0.1, "test": 0.1})
    whole = sum(proportions.values())
    of = materialize(p3_split(data, proportions).groupBy("group_id", "split").agg(F.count(F.lit(1)).alias("n")), "p3-checked")
    held = {f"_{i}": F.coalesce(F.sum(F.when(F.col("split") == k, F.col("n"))), F.lit(0)) for i, k in enumerate(proportions)}
    groups = of.groupBy("group_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("splits"), *(v.alias(k) for k, v in held.items()))
    one = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("splits") > 1).alias("parted"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), *(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in held))
    off = F.greatest(*(F.abs(F.col(k) - F.col("rows") * F.lit(p / whole)) for k, p in zip(held, proportions.values(), strict=True)), F.lit(0.0))
    return one.select("rows", "groups", "parted", (off <= F.greatest(F.col("rows") * F.lit(0.01), F.col("largest"))).alias("even"))
