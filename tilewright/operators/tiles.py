"""Tile schemes, the registry of what is done, and vector tilesets.

A scheme is one row a tile: ``tile_name``, ``row``, ``col`` and the bounds
``core``, ``buff`` and ``nbuff`` as structs. A registry is long: ``tile_name``,
``attribute``, ``done``. A tileset is a DataFrame of features and its registry;
every change gives a new one, as Spark's tables are values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.plans.stage import materialize, release

BOX = "struct<minx:double,miny:double,maxx:double,maxy:double>"


@dataclass(frozen=True)
class EngineOptions:
    """Settings of a run, passed explicitly."""

    tile_names: tuple[str, ...] | None = None
    overwrite: bool = False
    verbose: bool = True
    crs: str | None = None

    @classmethod
    def load(cls, path: str, base: EngineOptions | None = None, override: bool = True) -> EngineOptions:
        """Out of a JSON object; with ``override`` the file wins over ``base``, else it only fills what base leaves at its default."""
        import json

        with open(path, encoding="utf-8") as f:
            got = {k: tuple(v) if isinstance(v, list) else v for k, v in json.load(f).items() if k in cls.__dataclass_fields__}
        base = base or cls()
        return replace(base, **{k: v for k, v in got.items() if override or getattr(base, k) == getattr(cls(), k)})


def scheme(spark: SparkSession, rows: int, cols: int, width: float, buffer: float = 0.0, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """A grid of tiles R<row>C<col>, row 1 the lowest. ``nbuff`` is the core, stretched into the buffer at the scheme's edges."""
    x0, y0 = map(float, origin)
    t = spark.range(rows * cols).select((F.floor(F.col("id") / cols) + 1).cast("int").alias("row"), (F.col("id") % cols + 1).cast("int").alias("col"))
    edge = lambda c, o, n: (F.lit(o) + (F.col(c) - 1) * float(width), F.lit(o) + F.col(c) * float(width), F.when(F.col(c) == 1, float(buffer)).otherwise(0.0), F.when(F.col(c) == n, float(buffer)).otherwise(0.0))
    (x, x2, lx, hx), (y, y2, ly, hy) = edge("col", x0, cols), edge("row", y0, rows)
    box = lambda a, b, c, d: F.struct(a.alias("minx"), b.alias("miny"), c.alias("maxx"), d.alias("maxy"))
    return t.select(F.format_string("R%dC%d", "row", "col").alias("tile_name"), "row", "col", box(x, y, x2, y2).alias("core"), box(x - buffer, y - buffer, x2 + buffer, y2 + buffer).alias("buff"), box(x - lx, y - ly, x2 + hx, y2 + hy).alias("nbuff"))


def tile_neighbours(tiles: DataFrame, names: Sequence[str] | None = None, case: str = "queen") -> DataFrame:
    """Neighbours of the named tiles and the tiles themselves, each once, in the order of text. ``queen`` has 8, ``rook`` 4 of them."""
    if case not in ("queen", "rook"):
        raise ValueError("case must be 'queen' or 'rook'")
    return neighbour_pairs(tiles if names is None else tiles.where(F.col("tile_name").isin(list(names))), tiles, case).select(F.col("neighbour").alias("tile_name")).distinct().orderBy("tile_name")


def neighbour_pairs(some: DataFrame, tiles: DataFrame, case: str = "queen") -> DataFrame:
    """(tile_name, neighbour): offsets are exploded and met with the scheme by equality of row and col."""
    off = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if case == "queen" or i * j == 0]
    e = some.select("tile_name", "row", "col", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in off))).alias("o"))
    e = e.select("tile_name", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"))
    return e.join(tiles.select("row", "col", F.col("tile_name").alias("neighbour")), ["row", "col"]).select("tile_name", "neighbour")


def check_names(tiles: DataFrame, names: Sequence[str]) -> None:
    """An error that lists the names that aren't tiles."""
    have = {r.tile_name for r in tiles.where(F.col("tile_name").isin(list(names))).select("tile_name").collect()}
    lost = [n for n in names if n not in have]
    if lost:
        raise ValueError("Following tile names do not exist: " + ", ".join(lost))


def tile_queue(tiles: DataFrame, registry: DataFrame, attribute: str, overwrite: bool = False, names: Sequence[str] | None = None) -> DataFrame:
    """Tiles still to do: the selected ones without those done, or all selected with ``overwrite``."""
    if names is not None:
        check_names(tiles, names)
        tiles = tiles.where(F.col("tile_name").isin(list(names)))
    if overwrite:
        return tiles.select("tile_name")
    return tiles.select("tile_name").join(registry.where((F.col("attribute") == attribute) & F.col("done")), "tile_name", "left_anti")


def missing_tiles(tiles: DataFrame, registry: DataFrame, attribute: str, names: Sequence[str] | None = None, buffered: bool = False) -> DataFrame:
    """Selected tiles, with ``buffered`` their neighbours too, that aren't done. Complete means none."""
    some = tiles if names is None else tiles.where(F.col("tile_name").isin(list(names)))
    need = neighbour_pairs(some, tiles).select(F.col("neighbour").alias("tile_name")).distinct() if buffered else some.select("tile_name")
    return need.join(registry.where((F.col("attribute") == attribute) & F.col("done")), "tile_name", "left_anti")


def has_tiles(tiles: DataFrame, registry: DataFrame, attribute: str) -> DataFrame:
    """(tile_name, done) of every tile; an attribute that the registry doesn't know is done nowhere."""
    done = registry.where((F.col("attribute") == attribute) & F.col("done")).select("tile_name", F.lit(True).alias("done")).distinct()
    return tiles.select("tile_name").join(done, "tile_name", "left").select("tile_name", F.coalesce("done", F.lit(False)).alias("done"))


def require_complete(tiles: DataFrame, registry: DataFrame, attribute: str, names: Sequence[str] | None = None, buffered: bool = False) -> None:
    """An error that names up to ten missing tiles."""
    lost = [r.tile_name for r in missing_tiles(tiles, registry, attribute, names, buffered).orderBy("tile_name").limit(10).collect()]
    if lost:
        raise ValueError(f"Input '{attribute}' is incomplete. Missing tiles: " + ", ".join(lost))


def register(registry: DataFrame, names: DataFrame, attribute: str) -> DataFrame:
    """The registry with these tiles done, also tiles without a feature."""
    new = names.select("tile_name").distinct().withColumns({"attribute": F.lit(attribute), "done": F.lit(True)})
    return registry.join(new, ["tile_name", "attribute"], "left_anti").unionByName(new)


def registry_summary(registry: DataFrame) -> DataFrame:
    """Tiles done and not done of each attribute."""
    return registry.groupBy("attribute").agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("missing"))


def row_counts(tiles: DataFrame, features: DataFrame) -> DataFrame:
    """Features of every tile, 0 for the empty ones."""
    n = features.groupBy("tile_name").agg(F.count(F.lit(1)).alias("n"))
    return tiles.select("tile_name").join(n, "tile_name", "left").select("tile_name", F.coalesce("n", F.lit(0)).alias("n"))


def _require_update(data: DataFrame, key: str) -> None:
    if key not in data.columns:
        raise ValueError(f"Update data lack the id column '{key}'")
    if "tile_name" in data.columns:
        raise ValueError("Update data must not have a column 'tile_name'")


def updated(features: DataFrame, data: DataFrame, tile_name: str, key: str = "poly_id") -> DataFrame:
    """The tile's features with the columns of ``data`` in place of theirs by ``key``; those without a match get nulls, other tiles stay.

    New columns are null elsewhere. Only the tile's rows are joined; the others
    are passed on. Data without ``key`` or with a tile_name are an error.
    """
    _require_update(data, key)
    new = [c for c in data.columns if c != key]
    own = features.where(F.col("tile_name") == tile_name)
    kept = [c for c in features.columns if c not in new]
    own = own.select(*kept).join(data, key, "left").select(*features.columns, *(c for c in new if c not in features.columns))
    rest = features.where(~F.col("tile_name").eqNullSafe(F.lit(tile_name)))
    kinds = {c: data.schema[c].dataType for c in new}
    return own.unionByName(rest.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in features.columns)), allowMissingColumns=True)


def require_appendable(registry: DataFrame, data: DataFrame, tile_name: str, key: str, attribute: str = "geom") -> None:
    """Errors of an append: the tile is there already, data lack the id column, ids are repeated."""
    if registry.where((F.col("tile_name") == tile_name) & (F.col("attribute") == attribute) & F.col("done")).limit(1).count():
        raise ValueError(f"Tile '{tile_name}' is there already")
    if key not in data.columns:
        raise ValueError(f"Appended data lack the id column '{key}'")
    twice = data.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"Duplicate '{key}' values: {twice[0][0]}")


def appended(features: DataFrame, registry: DataFrame, data: DataFrame, tile_name: str, key: str = "poly_id", attribute: str = "geom") -> tuple[DataFrame, DataFrame]:
    """Features and registry with one more tile, also an empty one; columns that either side lacks are null. See :func:`require_appendable` for errors."""
    require_appendable(registry, data, tile_name, key, attribute)
    names = data.sparkSession.createDataFrame([(tile_name,)], "tile_name string")
    undone = registry.where(~((F.col("tile_name") == tile_name) & (F.col("attribute") == attribute)))
    return features.unionByName(data.withColumn("tile_name", F.lit(tile_name)), allowMissingColumns=True), register(undone, names, attribute)


def add_field(df: DataFrame, name: str, kind: str) -> DataFrame:
    """With a null column, if it isn't there."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def delete_field(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def add_attribute(registry: DataFrame, tiles: DataFrame, attribute: str) -> DataFrame:
    """With the attribute undone for every tile that doesn't have it."""
    new = tiles.select("tile_name", F.lit(attribute).alias("attribute"), F.lit(False).alias("done"))
    return registry.unionByName(new.join(registry, ["tile_name", "attribute"], "left_anti"))


def delete_attribute(registry: DataFrame, attribute: str) -> DataFrame:
    return registry.where(F.col("attribute") != attribute)


@dataclass
class VectorTileset:
    """Features and registry kept under one folder: ``features`` partitioned by tile, ``registry`` beside it."""

    spark: SparkSession
    path: str
    schema: str = "tile_name string, poly_id int, geom binary"

    def create(self, tiles: DataFrame) -> VectorTileset:
        """Empty, with every tile seeded for the attribute geom."""
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").partitionBy("tile_name").parquet(f"{self.path}/features")
        tiles.select("tile_name", F.lit("geom").alias("attribute"), F.lit(False).alias("done")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/registry")
        return self

    def features(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/features")

    def registry(self) -> DataFrame:
        """The last state of each tile and attribute; writes only append."""
        r = self.spark.read.schema("tile_name string, attribute string, done boolean").parquet(f"{self.path}/registry")
        return r.groupBy("tile_name", "attribute").agg(F.max("done").alias("done"))

    def read_tile(self, tile_name: str, fields: Sequence[str] | None = None) -> DataFrame:
        """One tile's partition, and only these fields of it."""
        return read_tile(self.features(), tile_name, fields)

    def write(self, df: DataFrame, attribute: str = "geom", tiles: DataFrame | None = None) -> None:
        """Replace the partitions of the tiles in ``df``, all in parallel, then register them and those of ``tiles``, the ones that were worked on and may be empty.

        ``df`` is computed once, before anything is replaced, so it may read this tileset.
        """
        df = materialize(df, "tileset")
        names = df.select("tile_name") if tiles is None else df.select("tile_name").unionByName(tiles.select("tile_name"))
        names = materialize(names.distinct(), "tiles")
        self._put(df)
        if tiles is not None:
            self._clear(names.join(df.select("tile_name").distinct(), "tile_name", "left_anti"))
        names.withColumns({"attribute": F.lit(attribute), "done": F.lit(True)}).coalesce(1).write.mode("append").parquet(f"{self.path}/registry")
        release(df)
        release(names)

    def _put(self, df: DataFrame) -> None:
        kinds = {f.name: f.dataType.simpleString() for f in T._parse_datatype_string(self.schema).fields} | {f.name: f.dataType.simpleString() for f in df.schema.fields}
        self.schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile_name").parquet(f"{self.path}/features")

    def _clear(self, names: DataFrame) -> None:
        """Delete the partitions of tiles that turned out empty, where they had rows before."""
        for r in self.features().join(names, "tile_name", "left_semi").select("tile_name").distinct().toLocalIterator():
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/features/tile_name={r.tile_name}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def append(self, data: DataFrame, tile_name: str, key: str = "poly_id") -> None:
        """One more tile, also an empty one. See :func:`require_appendable` for errors."""
        require_appendable(self.registry(), data, tile_name, key)
        names = self.spark.createDataFrame([(tile_name,)], "tile_name string")
        self.write(data.withColumn("tile_name", F.lit(tile_name)), tiles=names)

    def update(self, data: DataFrame, tile_name: str, attribute: str, key: str = "poly_id", overwrite: bool = False) -> None:
        """As :func:`updated`, where only the tile's partition is read and replaced; a tile done for the attribute is an error unless ``overwrite``."""
        if not overwrite and self.registry().where((F.col("tile_name") == tile_name) & (F.col("attribute") == attribute) & F.col("done")).limit(1).count():
            raise ValueError(f"Tile '{tile_name}' is done for '{attribute}' already")
        names = self.spark.createDataFrame([(tile_name,)], "tile_name string")
        own = updated(self.read_tile(tile_name), data, tile_name, key)
        self.write(own, attribute, names)

    def index(self, field: str) -> bool:
        """Sort every tile's rows by a field, once, so that row-group statistics prune reads; whether it was done now."""
        where = f"{self.path}/indexes"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{where}/{field}")
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(hadoop):
            return False
        df = materialize(self.features(), "indexed")
        # ranges of tile and field: a tile of any size is cut into files with narrow ranges
        self._put(df.repartitionByRange("tile_name", field).sortWithinPartitions("tile_name", field))
        release(df)
        files.mkdirs(hadoop)
        return True

    def backup(self, folder: str, tag: str, overwrite: bool = False) -> str:
        """A copy <folder>/<name>_<tag>; an existing one is an error unless ``overwrite``."""
        to = f"{folder}/{self.path.rstrip('/').rsplit('/', 1)[-1]}_{tag}"
        self.features().write.mode("overwrite" if overwrite else "errorifexists").parquet(to)
        return to


def read_tile(features: DataFrame, tile_name: str, fields: Sequence[str] | None = None) -> DataFrame:
    df = features.where(F.col("tile_name") == tile_name)
    return df.select(*fields) if fields is not None else df


def run_tiles(df: DataFrame, worker: Callable, schema: str) -> DataFrame:
    """``worker(pandas) -> pandas`` on each tile in parallel; (tile_name, status, message) and its columns.

    An exception is kept as the tile's row with status error; a worker's
    result has status success. One tile must fit in a task.
    """
    import pandas as pd

    out = T._parse_datatype_string(schema)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["tile_name"].iloc[0]
        try:
            got, status, message = worker(pdf).reset_index(drop=True), "success", None
            if not len(got):
                got = pd.DataFrame({f.name: [None] for f in out.fields})
        except Exception as e:  # noqa: BLE001
            got, status, message = pd.DataFrame({f.name: [None] for f in out.fields}), "error", str(e)
        got.insert(0, "tile_name", name)
        return got.assign(status=status, message=message)[["tile_name", "status", "message", *(f.name for f in out.fields)]]

    return df.groupBy("tile_name").applyInPandas(one, f"tile_name string, status string, message string, {schema}")


def status_summary(status: DataFrame) -> DataFrame:
    """Tiles by status and message: how many, and their names in order."""
    return status.groupBy("status", "message").agg(F.count(F.lit(1)).alias("tiles"), F.concat_ws(",", F.array_sort(F.collect_list("tile_name"))).alias("names"))


def chunk_plan(tiles: DataFrame, size: int, prefix: str) -> DataFrame:
    """(tile_name, chunk, archive): tiles by name in chunks of ``size``, archives <prefix><i>of<n>.zip. The scheme is small, so one ranking task does."""
    n = F.row_number().over(Window.orderBy("tile_name"))
    total = F.ceil(F.count(F.lit(1)).over(Window.partitionBy()) / size)
    c = tiles.select("tile_name", F.ceil(n / size).cast("int").alias("chunk"), total.cast("int").alias("of"))
    return c.select("tile_name", "chunk", F.format_string(prefix + "%dof%d.zip", "chunk", "of").alias("archive"))
