"""Training data, classification by random forest, ordered manual edits, accuracy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.spatial import points_in_shapes, shapes_meet
from tilewright.plans.skew import broadcast_if_small
from tilewright.plans.stage import materialize

#: Schemas of the empty layers that the constructors make.
LAYERS = {
    "points": "fid bigint, geom binary, training_set int, seg_class string",
    "polygons": "fid bigint, geom binary, training_set int, seg_class string",
    "class_edits": "fid bigint, geom binary, from_class string, to_class string",
    "canopy_edits": "fid bigint, geom binary, canopy smallint",
}


def empty_layer(spark: SparkSession, name: str, crs: str | int | None = None) -> DataFrame:
    """An empty, typed layer. ``crs`` must be an EPSG code if given."""
    if crs is not None and not str(crs).upper().removeprefix("EPSG:").isdigit():
        raise ValueError(f"Invalid CRS: {crs}")
    return spark.createDataFrame([], LAYERS[name])


def prefixed(df: DataFrame, sets: Sequence[str]) -> list[str]:
    """Columns that start with <set>_."""
    return [c for c in df.columns if any(c.startswith(f"{s}_") for s in sets)]


def extracted(points: DataFrame, polygons: DataFrame, segments: DataFrame, fields: Sequence[str], done: DataFrame | None = None) -> DataFrame:
    """One row for each segment (fid) that training hits: type, training_set, training_fid, seg_class, fields.

    Polygons (type 2) come before points (type 1), then the smaller
    training_fid: the first keeps the segment. A point takes the first segment
    by fid at its place, a polygon all it meets; both closed. Training
    features in ``done`` (type, training_fid) are skipped. Segments and
    polygons are rectangles, or polygons if they have vertices.
    """
    skip = lambda df, t: df.join(done.where(F.col("type") == t).select(F.col("training_fid").alias("fid")), "fid", "left_anti") if done is not None else df
    named = [F.col("fid").alias("training_fid"), "training_set", "seg_class"]
    shape = lambda df: [c for c in ("minx", "miny", "maxx", "maxy", "xs", "ys", "ends") if c in df.columns]
    seg = segments.select(F.col("fid").alias("_seg"), *shape(segments), *fields)
    pts = points_in_shapes(skip(points, 1).select(*named, "x", "y"), seg, "training_fid")
    pts = pts.groupBy("training_fid", "training_set", "seg_class").agg(F.min_by(F.struct("_seg", *fields), "_seg").alias("s")).select("training_fid", "training_set", "seg_class", "s.*", F.lit(1).alias("type"))
    pol = shapes_meet(skip(polygons, 2).select(*named, *shape(polygons)), seg)
    pol = pol.select("training_fid", "training_set", "seg_class", F.col("_seg_b").alias("_seg"), *(F.col(f"{f}_b").alias(f) for f in fields), F.lit(2).alias("type"))
    both = pol.unionByName(pts)
    cols = ["type", "training_set", "training_fid", "seg_class", *fields]
    first = both.groupBy("_seg").agg(F.min_by(F.struct(*cols), F.struct(-F.col("type"), "training_fid", "training_set", "seg_class")).alias("r"))
    return first.select(F.col("_seg").alias("fid"), "r.*")


def hit_nothing(training: DataFrame, data: DataFrame, kind: int) -> DataFrame:
    """training_fid of the features of a type that have no row in the data."""
    return training.select(F.col("fid").alias("training_fid")).join(data.where(F.col("type") == kind).select("training_fid"), "training_fid", "left_anti")


def require_whole(data: DataFrame, fields: Sequence[str]) -> None:
    """An error if any attribute is null."""
    if data.where(F.exists(F.array(*(F.col(f).isNull() for f in fields)), lambda x: x)).limit(1).count():
        raise ValueError("Extracted attributes contain NA values")


def forest(data: DataFrame, predictors: Sequence[str], label: str = "seg_class", trees: int = 1000, seed: int = 1, depth: int = 10) -> PipelineModel:
    """A random forest on the rows without nulls. ``model.save`` and ``PipelineModel.load`` keep it."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc"),
            VectorAssembler(inputCols=list(predictors), outputCol="_x", handleInvalid="skip"),
            RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, seed=seed, maxDepth=depth, probabilityCol="_p", predictionCol="_k", rawPredictionCol="_raw"),
        ]
    ).fit(data.na.drop("any", subset=[label, *predictors]))


def training_rows(data: DataFrame, sets: Sequence[int], drop: Sequence[str] = ("type", "fid", "training_set", "training_fid")) -> DataFrame:
    """Class and attributes of the rows of the chosen training sets, without those that have a null."""
    rest = [c for c in data.columns if c not in drop]
    return data.where(F.col("training_set").isin(list(sets))).select(*rest).na.drop("any")


def created(data: DataFrame, sets: Sequence[int], predictors: Sequence[str] | None = None, label: str = "seg_class", trees: int = 1000, seed: int = 1, depth: int = 10, held_out: float = 0.1) -> tuple[PipelineModel, float | None]:
    """A forest of the chosen training sets on all attributes or the chosen ones, and the error of one that a part of the rows was held out from.

    The library's forests have no out-of-bag error, so a second forest is
    fitted without the ``held_out`` part of the rows; the error is None if no
    row was. Unknown predictors, 'auto', and no row at all are errors.
    """
    if predictors is not None and "auto" in predictors:
        raise ValueError("Predictors aren't chosen automatically; name them or take all")
    rows = training_rows(data, sets)
    lost = [p for p in predictors or () if p not in rows.columns]
    if lost:
        raise ValueError("Predictors that the training data lack: " + ", ".join(lost))
    use = list(predictors) if predictors is not None else [c for c in rows.columns if c != label]
    rows = materialize(rows.select(label, *use), "training")
    if rows.limit(1).count() == 0:
        raise ValueError(f"No training rows in the sets {list(sets)}")
    # equal rows are held out together, so none of them is known to the forest
    out = F.pmod(F.xxhash64(F.lit(seed), label, *use), F.lit(1_000_000)) < int(held_out * 1_000_000)
    error = None
    if held_out > 0 and rows.where(out).limit(1).count() and rows.where(~out).limit(1).count():
        seen = predicted(rows.where(out).withColumnRenamed(label, "_seen"), forest(rows.where(~out), use, label, trees, seed, depth), "_elected")
        error = seen.agg(F.avg(F.when(F.col("_seen") == F.col("_elected"), 0.0).otherwise(1.0))).first()[0]
    return forest(rows, use, label, trees, seed, depth), error


def predictors_of(model: PipelineModel) -> list[str]:
    return model.stages[1].getInputCols()


def predicted(df: DataFrame, model: PipelineModel, out: str = "seg_class") -> DataFrame:
    """The class with the most votes, the first of the alphabet on ties."""
    d = model.stages[2].transform(model.stages[1].transform(df))
    p = vector_to_array("_p")
    d = d.withColumn("_k", (F.array_position(p, F.array_max(p)) - 1).cast("double"))
    return IndexToString(inputCol="_k", outputCol=out, labels=model.stages[0].labels).transform(d).drop("_x", "_raw", "_p", "_k")


def applied_edit(current: Column, from_class: Column, to_class: Column) -> Column:
    """to_class where the current class is among from_class, codes parted by white space; blank or null means any."""
    codes = F.filter(F.split(F.coalesce(from_class, F.lit("")), r"\s+"), lambda c: c != "")
    return F.when((F.size(codes) == 0) | F.array_contains(codes, current), to_class).otherwise(current)


def edited(segments: DataFrame, hits: DataFrame, key: Sequence[str], column: str = "seg_class") -> DataFrame:
    """Segments after the edits that meet them, one after another: an edit sees the class that the earlier ones left.

    ``hits`` is (key, seq, from_class, to_class); a segment's edits meet as one
    array, in order. Segments without edits stay.
    """
    e = hits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "from_class", "to_class"))).alias("_edits"))
    none = F.array().cast(e.schema["_edits"].dataType)
    fold = F.aggregate(F.coalesce("_edits", none), F.col(column).cast("string"), lambda cur, x: applied_edit(cur, x["from_class"], x["to_class"]))
    return segments.join(e, list(key), "left").withColumn(column, fold).drop("_edits")


def edit_hits(edits: DataFrame, segments: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, seq, from_class, to_class) of edits and segments, rectangles or polygons, that meet."""
    return shapes_meet(segments.select(*key, *(c for c in ("minx", "miny", "maxx", "maxy", "xs", "ys", "ends") if c in segments.columns)), edits).select(*key, *(F.col(f"{c}_b").alias(c) for c in ("seq", "from_class", "to_class")))


def class_ids(df: DataFrame, classes: DataFrame, code: str = "seg_class", out: str = "class_id") -> DataFrame:
    """With the class's id; null for codes that the table lacks."""
    return df.join(broadcast_if_small(classes.select(F.col("code").alias(code), F.col("id").alias(out))), code, "left")


def regrouped(c: str | Column, reclass: Mapping[str, Sequence[str]]) -> Column:
    """Codes replaced by the name of the group that lists them; others stay."""
    out = v = F.col(c) if isinstance(c, str) else c
    for name, codes in reclass.items():
        out = F.when(v.isin(list(codes)), F.lit(name)).otherwise(out)
    return out


def training_summary(data: DataFrame, reclass: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows of each class after regrouping."""
    return data.groupBy(regrouped("seg_class", reclass).alias("seg_class")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(pairs: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """pcc, kappa, and the means of sensitivity and specificity over ``classes``, NaN ignored: one row, or one for each value of ``by``. ``pairs`` is (``by``, observed, elected)."""
    return _accuracy(confusion(pairs, by), classes, by)


def _accuracy(k: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    m = _margins(k, classes, by)
    total, chance = F.col("total"), F.col("chance")
    sums = m.groupBy(*by).agg(F.sum("tp_n").alias("right"), F.max("total").alias("total"), F.sum(F.col("obs") * F.col("ele")).alias("chance"), F.avg(F.try_divide("tp_n", "obs")).alias("sensitivity"), F.avg(F.try_divide(total - F.col("obs") - F.col("ele") + F.col("tp_n"), total - F.col("obs"))).alias("specificity"))
    return sums.select(*by, F.try_divide("right", "total").alias("pcc"), F.try_divide(F.try_divide(F.col("right"), total) - F.try_divide(chance, total * total), 1 - F.try_divide(chance, total * total)).alias("kappa"), "sensitivity", "specificity")


def class_accuracy(pairs: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """User's and producer's accuracy of each class, and of each value of ``by``; null where there is nothing to divide by."""
    return _class_accuracy(confusion(pairs, by), classes, by)


def _class_accuracy(k: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return _margins(k, classes, by).select(*by, "seg_class", F.try_divide("tp_n", "ele").alias("users"), F.try_divide("tp_n", "obs").alias("producers"))


def confusion(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*by, "observed", "elected").agg(F.count(F.lit(1)).cast("double").alias("n"))


def _margins(k: DataFrame, classes: Sequence[str], by: Sequence[str]) -> DataFrame:
    by = list(by)
    flat = k.where(F.col("observed").isin(list(classes)) & F.col("elected").isin(list(classes)))
    zero, right = F.lit(0.0), F.when(F.col("observed") == F.col("elected"), F.col("n")).otherwise(0.0)
    sides = F.array(F.struct(F.col("observed").alias("seg_class"), F.col("n").alias("obs"), zero.alias("ele"), right.alias("tp_n")), F.struct(F.col("elected").alias("seg_class"), zero.alias("obs"), F.col("n").alias("ele"), zero.alias("tp_n")))
    s = flat.select(*by, F.explode(sides).alias("e")).select(*by, "e.*").groupBy(*by, "seg_class").agg(*(F.sum(x).alias(x) for x in ("obs", "ele", "tp_n")))
    every = flat.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("total")).withColumn("seg_class", F.explode(F.array(*map(F.lit, classes))))
    # as many rows as classes, for each value of ``by``
    return every.join(s, [*by, "seg_class"], "left").fillna(0.0, ["obs", "ele", "tp_n"])


def monte_carlo(data: DataFrame, predictors: Sequence[str], reclass: Mapping[str, Sequence[str]], iterations: int = 100, held_out: float = 0.1, trees: int = 1000, seed: int = 1, depth: int = 10) -> DataFrame:
    """(iteration, observed, elected, n): confusion counts, of regrouped classes, of refits on random parts of the rows without nulls.

    Rows are held out by a hash of ``row_id`` and the iteration. An iteration
    ends with its counts, classes squared, on the driver; no plan grows with
    the number of iterations.
    """
    codes = [c for v in reclass.values() for c in v]
    d = materialize(data.where(F.col("seg_class").isin(codes)).na.drop("any", subset=["seg_class", *predictors]).select("row_id", "seg_class", *predictors), "monte-carlo")
    rows: list[tuple[int, str, str, float]] = []
    for i in range(iterations):
        at = F.pmod(F.xxhash64(F.lit(seed * 100_003 + i), F.col("row_id")), F.lit(1_000_000)) < int(held_out * 1_000_000)
        m = forest(d.where(~at), predictors, trees=trees, seed=seed + i, depth=depth)
        v = predicted(d.where(at).withColumnRenamed("seg_class", "_seen"), m).select(regrouped("_seen", reclass).alias("observed"), regrouped("seg_class", reclass).alias("elected"))
        rows += [(i, r.observed, r.elected, r.n) for r in confusion(v).collect()]
    return data.sparkSession.createDataFrame(rows, "iteration int, observed string, elected string, n double")


def monte_carlo_accuracy(data: DataFrame, predictors: Sequence[str], reclass: Mapping[str, Sequence[str]], **more) -> DataFrame:
    """(iteration, pcc, kappa, sensitivity, specificity) of :func:`monte_carlo`; average over iterations for the estimate."""
    return _accuracy(monte_carlo(data, predictors, reclass, **more), list(reclass), ["iteration"])


def monte_carlo_classes(data: DataFrame, predictors: Sequence[str], reclass: Mapping[str, Sequence[str]], **more) -> DataFrame:
    """(seg_class, users, producers): means over the iterations in which there is something to divide by."""
    return _class_accuracy(monte_carlo(data, predictors, reclass, **more), list(reclass), ["iteration"]).groupBy("seg_class").agg(F.avg("users").alias("users"), F.avg("producers").alias("producers"))
