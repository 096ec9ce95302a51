"""Tiles processed as they land: a stream of files, an operator, a tileset and its registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tilewright.sources.formats import write_tiles


def process_landing(spark: SparkSession, landing: str, schema: str, operator: Callable[[DataFrame], DataFrame], out: str, registry: str, attribute: str, checkpoint: str, overwrite: bool = False) -> StreamingQuery:
    """Run ``operator`` on the tiles of every batch of Parquet files that lands, unless they are done.

    Results replace their tiles' partitions, then the tiles are registered; a
    batch that is run again after a failure finds its tiles done or writes the
    same partitions once more. With ``overwrite`` done tiles are computed again.
    The query ends when everything that is there has been read.
    """
    stream = spark.readStream.schema(schema).parquet(landing)

    def batch(df: DataFrame, number: int) -> None:
        todo = df
        if not overwrite:
            todo = df.join(done_tiles(spark, registry, attribute), "tile_name", "left_anti")
        if todo.isEmpty():
            return
        write_tiles(operator(todo), out)
        names = todo.select("tile_name").distinct().withColumns({"attribute": F.lit(attribute), "done": F.lit(True), "batch": F.lit(number)})
        names.coalesce(1).write.mode("append").parquet(registry)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def done_tiles(spark: SparkSession, registry: str, attribute: str) -> DataFrame:
    """tile_name of the tiles registered as done; none if there is no registry yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(registry)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "tile_name string")
    r = spark.read.schema("tile_name string, attribute string, done boolean, batch bigint").parquet(registry)
    return r.where((F.col("attribute") == attribute) & F.col("done")).select("tile_name").distinct()


def rolling_counts(events: DataFrame, at: str, by: str, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Rows by window and value of ``by``; on a stream, rows later than ``late`` are left out and windows close."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
