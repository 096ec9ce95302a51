"""Percentiles of very large numeric columns by mergeable q-digests (problem 1).

Values are quantized to a bounded ordered universe of 2**BITS levels, evenly on
a log scale. A digest of a group is a set of nodes of the dyadic tree over that
universe with counts: node 1 is the root, node n has the children 2n and 2n+1,
level v is the leaf 2**BITS + v. Compression moves counts of light siblings to
their parent while node + sibling + parent hold no more than n / k. A node's
count then stands for values somewhere below it, and a rank read off the digest
is wrong by at most BITS * n / k (Shrivastava et al. 2004), whatever the data.
Digests of other partitions or days merge by adding the counts of equal nodes
and compressing again. A digest is one row: its group, its nodes and their
counts, and how many values it has at the ends of the universe, where values
beyond it count as well and are bounded in rank only; many digests are
compressed and read at a time in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.plans.latest import latest_rows
from tilewright.plans.skew import broadcast_if_small
from tilewright.plans.stage import materialize

#: The universe has 2**BITS levels over LOW .. HIGH in powers of two: 0.55 % a level.
BITS, LOW, HIGH = 12, -10.0, 22.0
#: Compression: a rank is wrong by BITS / K at most, 0.5 % of the values. A digest has no more than 3 * K nodes.
K = 2400
#: Nodes handled at a time.
CHUNK_NODES = 400_000


def quantized(v: Column) -> Column:
    """Level of a positive, finite value, null for others; values beyond the universe go to its ends."""
    at = F.floor((F.log2(v) - F.lit(LOW)) * F.lit(2**BITS / (HIGH - LOW)))
    return F.when((v > 0) & (v < float("inf")), F.least(F.greatest(at, F.lit(0)), F.lit(2**BITS - 1)).cast("int"))


def value_of(level: np.ndarray) -> np.ndarray:
    """Middle of a level."""
    return 2.0 ** (LOW + (np.asarray(level) + 0.5) * (HIGH - LOW) / 2**BITS)


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if len(key) == 0:
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first)


def compressed(group: np.ndarray, node: np.ndarray, count: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, node, count) of the digests of groups 0, 1, ... after compression, in order; equal nodes are added first."""
    key, n = _added(group.astype(np.int64) << (BITS + 1) | node, count.astype(np.int64))
    mask = (1 << (BITS + 1)) - 1
    limit = np.bincount(key >> (BITS + 1), n).astype(np.int64) // k
    # digests below k values stay as they are
    can = limit[key >> (BITS + 1)] > 0
    done = [(key[~can], n[~can])]
    key, n = key[can], n[can]
    for depth in range(BITS, 0, -1):
        here = (key & mask) >= 1 << depth
        low, low_n, key, n = key[here], n[here], key[~here], n[~here]
        if not len(low):
            continue
        parent = (low >> (BITS + 1) << (BITS + 1)) | ((low & mask) >> 1)
        up, both = _added(parent, low_n)
        if len(key):
            i = np.minimum(np.searchsorted(key, up), len(key) - 1)
            own = np.where(key[i] == up, n[i], 0)
        else:
            own = np.zeros(len(up), np.int64)
        light = both + own <= limit[up >> (BITS + 1)]
        stay = ~light[np.searchsorted(up, parent)]
        done.append((low[stay], low_n[stay]))
        key, n = _added(np.concatenate([key, up[light]]), np.concatenate([n, both[light]]))
    key, n = _added(np.concatenate([x for x, _ in done] + [key]), np.concatenate([x for _, x in done] + [n]))
    return key >> (BITS + 1), key & mask, n


def quantiles_of(group: np.ndarray, node: np.ndarray, count: np.ndarray, at: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Values of the groups 0, 1, ... (rows) at the shares ``at`` (columns), and their sizes: nodes are read by their upper ends, smaller ranges first."""
    depth = np.floor(np.log2(node)).astype(np.int64)
    high = ((node.astype(np.int64) + 1) << (BITS - depth)) - 1 - 2**BITS
    order = np.lexsort((-depth, high, group))
    cum = np.cumsum(count[order])
    size = np.bincount(group, count).astype(np.int64)
    before = np.cumsum(size) - size
    want = np.ceil(np.asarray(at)[None, :] * size[:, None]).clip(1) + before[:, None]
    return value_of(high[order][np.searchsorted(cum, want)]), size


def digests(df: DataFrame, by: Sequence[str], value: str, k: int = K) -> DataFrame:
    """One digest (``by``, nodes, counts, ends) of each group's positive, finite values.

    Null, NaN, infinite, zero and negative values don't count, and groups
    without others have no digest; a null in ``by`` is a group of its own.
    """
    return of_nodes(df.select(*by, (quantized(F.col(value).cast("double")) + F.lit(2**BITS)).alias("node")).where(F.col("node").isNotNull()), by, k)


def of_nodes(df: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """Digests of rows (``by``, node). Rows are counted by node in the partial hash aggregate, so a group brings at most 2**BITS rows to the task that compresses it, however many values it has."""
    n = df.groupBy(*by, "node").agg(F.count(F.lit(1)).alias("n"))
    return _compress(n.withColumn("ends", F.when(F.col("node").isin(2**BITS, 2 ** (BITS + 1) - 1), F.col("n")).otherwise(F.lit(0)).cast("bigint")), by, k)


def merged(digest: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """Digests of coarser groups ``by``: counts of equal nodes are added, then compressed. A rank stays wrong by BITS / k at most."""
    flat = digest.select(*by, "ends", F.posexplode(F.arrays_zip("nodes", "counts")).alias("_at", "e"))
    flat = flat.select(*by, F.col("e.nodes").alias("node"), F.col("e.counts").alias("n"), F.when(F.col("_at") == 0, F.col("ends")).otherwise(F.lit(0)).alias("ends"))
    return _compress(flat.groupBy(*by, "node").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")), by, k)


def _compress(nodes: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    by = list(by)
    kinds = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in by)
    # lists of at most 2**(BITS + 1) nodes
    whole = nodes.groupBy(*by).agg(F.collect_list(F.struct(F.col("node").cast("int").alias("node"), "n")).alias("e"), F.sum("ends").alias("ends")).select(*by, "e.node", "e.n", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, group, node, n in _chunks(batches, "node", "n"):
            g, node, n = compressed(group, node, n, k)
            ends = pa.array(np.searchsorted(g, np.arange(b.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(node, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in by), *lists, b.column("ends")], names=[*by, "nodes", "counts", "ends"])

    return whole.mapInArrow(run, f"{kinds}, nodes array<int>, counts array<bigint>, ends bigint")


def _chunks(batches: Iterator[pa.RecordBatch], nodes: str, counts: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with about CHUNK_NODES nodes together: the rows, and of each node its row, node and count."""
    for b in batches:
        total = np.concatenate(([0], np.cumsum(np.diff(b.column(nodes).offsets.to_numpy()))))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK_NODES, "right")) - 1)
            part = b.slice(at, to - at)
            group = np.repeat(np.arange(part.num_rows), np.diff(total[at : to + 1]))
            yield part, group, part.column(nodes).flatten().to_numpy(), part.column(counts).flatten().to_numpy()
            at = to


def percentiles(digest: DataFrame, by: Sequence[str], pcts: Sequence[int]) -> DataFrame:
    """(``by``, pct, value, n, ends) of each digest; n is the number of values in the group, ends how many of them are at the ends of the universe or beyond."""
    by = list(by)
    kinds = ", ".join(f"`{c}` {digest.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, group, node, n in _chunks(batches, "nodes", "counts"):
            v, size = quantiles_of(group, node, n, [p / 100 for p in pcts])
            row = pa.array(np.repeat(np.arange(b.num_rows), len(pcts)))
            cols = [pa.array(np.tile(np.array(pcts, np.int32), b.num_rows)), pa.array(v.ravel()), pa.array(np.repeat(size, len(pcts)))]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in by), *cols, b.column("ends").take(row)], names=[*by, "pct", "value", "n", "ends"])

    return digest.select(*by, "nodes", "counts", "ends").mapInArrow(run, f"{kinds}, pct int, value double, n bigint, ends bigint")


MEASURES = ("height", "crown_area")
_EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def tree_nodes(trees: DataFrame, classes: DataFrame) -> DataFrame:
    """batch_id, tree (the class's id), measure (place in MEASURES), node: from the latest row of each fid, if its class is the label of a tree.

    Labels count without surrounding white space, in lower case. Rows without
    fid are left out. Ties on delivered_at go to the smallest values. Labels
    and values become small integers before the shuffle on fid.
    """
    known = _labels(classes).withColumnRenamed("tree_class", "_label")
    t = trees.select("fid", "batch_id", F.lower(F.regexp_replace("class", _EDGES, "")).alias("_label"), *(quantized(F.col(m).cast("double")).alias(m) for m in MEASURES), "delivered_at")
    t = t.join(broadcast_if_small(known), "_label", "left").drop("_label")
    t = latest_rows(t, "fid", "delivered_at", ["batch_id", "tree", *MEASURES]).where(F.col("tree").isNotNull())
    both = F.explode(F.array(*(F.struct(F.lit(i).alias("measure"), (F.col(m) + F.lit(2**BITS)).alias("node")) for i, m in enumerate(MEASURES)))).alias("m")
    return t.select("batch_id", "tree", both).select("batch_id", "tree", "m.measure", "m.node").where(F.col("node").isNotNull())


def _labels(classes: DataFrame) -> DataFrame:
    return classes.where("is_tree").groupBy(F.lower(F.regexp_replace("label", _EDGES, "")).alias("tree_class")).agg(F.min("id").cast("int").alias("tree"))


def batch_percentiles(trees: DataFrame, classes: DataFrame, pcts: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Percentiles by batch_id, tree and measure, and by tree and measure out of the merged digests of the batches."""
    by = ["batch_id", "tree", "measure"]
    d = materialize(of_nodes(tree_nodes(trees, classes), by), "p1-digests")
    return percentiles(d, by, pcts), percentiles(merged(d, by[1:]), by[1:], pcts)


def _named(df: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    named = F.element_at(F.array(*map(F.lit, MEASURES)), F.col("measure") + 1).alias("measure")
    return df.join(broadcast_if_small(_labels(classes)), "tree").select("batch_id", "tree_class", named, *columns)


def p1_percentiles(trees: DataFrame, classes: DataFrame, pcts: Sequence[int] = (10, 25, 50, 75, 90, 99)) -> DataFrame:
    """All percentiles: batch_id (null: over all batches), tree_class, measure, pct, value, n, ends."""
    own, every = batch_percentiles(trees, classes, pcts)
    return _named(own.unionByName(every.withColumn("batch_id", F.lit(None).cast(own.schema["batch_id"].dataType))), classes, "pct", "value", "n", "ends")


def p1_found(trees: DataFrame, classes: DataFrame, least: int = 100, low: float = 0.6, high: float = 1.7) -> DataFrame:
    """Batches and classes with at least ``least`` values whose percentile 50 or 90 is at most ``low`` or at least ``high`` times the class's over all batches.

    A row without batch_id counts in the class's percentiles but makes no case.
    Empty tables give no rows.
    """
    own, every = batch_percentiles(trees, classes, (50, 90))
    both = own.where((F.col("n") >= least) & F.col("batch_id").isNotNull()).join(every.select("tree", "measure", "pct", F.col("value").alias("whole")), ["tree", "measure", "pct"])
    ratio = F.col("value") / F.col("whole")
    return _named(both.where((ratio <= low) | (ratio >= high)), classes, "pct")


def p1_counts(trees: DataFrame, classes: DataFrame) -> DataFrame:
    """batch_id, tree_class, measure, n, whole: values in each batch's digest and in the class's merged one."""
    own, every = batch_percentiles(trees, classes, (50,))
    both = own.join(every.select("tree", "measure", F.col("n").alias("whole")), ["tree", "measure"])
    return _named(both, classes, "n", "whole")
