"""Stages written to the folder that all executors share, to cut lineage and to be read more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, as in tests, a folder of our own is set, if all executors are on this machine; else that is an error."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="tilewright-")
        atexit.register(shutil.rmtree, own, True)
    return own


_scopes: list[list[DataFrame]] = []
#: Stages that are still there, with the session that wrote them.
_there: dict[str, SparkSession] = {}


def _delete(path: str, spark: SparkSession) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_exit() -> None:
    """Stages don't outlive the program: nothing can read them any more."""
    for path, spark in list(_there.items()):
        try:
            _delete(path, spark)
        except Exception:  # noqa: BLE001
            # the session's machine has gone already, and what it kept with it
            return


@contextmanager
def stages() -> Iterator[None]:
    """Deletes at its end all stages that were written inside: read or write results inside as well."""
    mine: list[DataFrame] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        for df in mine:
            release(df)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Unlike a checkpoint of rows the written table is compressed, columnar and
    has sizes the planner can use. The lost executor's part is read again from
    the shared folder.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    _there[path] = df.sparkSession
    if _scopes:
        _scopes[-1].append(out)
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a materialized DataFrame that nothing will read any more."""
    path = getattr(df, "_stage_path", None)
    if path and _there.pop(path, None):
        _delete(path, df.sparkSession)
