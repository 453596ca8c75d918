"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "barloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution coalesces small shuffle partitions and splits skewed
    ones, so the shuffle partition count is an upper bound, not a tuning knob.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        # (security, day) keys hardly ever repeat, so a small first-level map only
        # costs a second probe per row.
        "spark.sql.codegen.aggregate.map.twolevel.enabled": "false",
    }
    settings.update({key: str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    A machine-local folder is used only by a local master with nothing set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"barloom-{application_id}-")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path inside the shared folder."""
    return f"{shared_folder(spark)}/barloom/{label}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it is stored; one that does not exist is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def replace_folder(spark: SparkSession, fresh: str, path: str) -> None:
    """Move a folder to ``path``, in the place of what lies there.

    The old folder is moved aside first, next to ``fresh``, so that its files are never lost; it goes
    when the new one is in place.
    """
    old = f"{fresh.rstrip('/')}-old"
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, path, old)]
    new, place, aside = paths
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place.getParent())
    if files.exists(place) and not files.rename(place, aside):
        raise OSError(f"could not move {path} aside to {old}")
    if not files.rename(new, place):
        raise OSError(f"could not move {fresh} to {path}; what lay there is in {old}")
    files.delete(aside, True)


def materialize(rows: DataFrame, label: str = "table") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    For a costly frame that several branches of a plan read: it is computed once,
    its lineage is cut, and each branch reads only its own columns.
    """
    path = new_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
