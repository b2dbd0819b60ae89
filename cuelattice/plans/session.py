"""Sessions, and this package's code on their executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that hold on any cluster; sizes of partitions are left to the adaptive planner.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "cuelattice", **more: str) -> SparkSession:
    """A session with SETTINGS and ``more`` (underscores for dots)."""
    builder = SparkSession.builder.appName(name)
    for k, v in {**SETTINGS, **{k.replace("_", "."): v for k, v in more.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, so that Python functions find it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_cuelattice_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp()).resolve() / "cuelattice_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._cuelattice_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate data, from spark.checkpoint.dir; only a local master may do without the setting."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cuelattice"))
    return context.getCheckpointDir()


def written(df, tasks: int = 0):
    """``df`` written to spark.checkpoint.dir: lineage ends there, and a lost executor costs a read.

    Under SETTINGS the files go once nothing refers to them. Where ``df`` is shuffled, it is so to ``tasks`` partitions at
    least, however few the session asks for; the adaptive planner still merges small ones.
    """
    conf, key = df.sparkSession.conf, "spark.sql.shuffle.partitions"
    checkpoint_dir(df.sparkSession)
    usual = conf.get(key)
    if int(usual) >= tasks:
        return df.checkpoint(eager=True)
    conf.set(key, str(tasks))
    try:
        return df.select("*").checkpoint(eager=True)  # planned anew: a frame keeps its first plan
    finally:
        conf.set(key, usual)
