"""Sessions with the settings the operators are written for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Only settings that matter at any scale; sizes (executors, shuffle partitions) belong to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "tilewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS and ``conf``; ``master`` only where the environment names none."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, unless the folder it is in is on their path already: in PYTHONPATH or the working folder."""
    root = Path(__file__).resolve().parent.parent
    known = [Path.cwd(), *(Path(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)]
    context = spark.sparkContext
    if any(p.resolve() == root for p in known) or getattr(context, "_tilewright_shipped", False):
        return
    file = Path(tempfile.mkdtemp(prefix="tilewright-")) / "tilewright.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted((root / "tilewright").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(file))
    context._tilewright_shipped = True
