"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_folders: list[str] = []


def local_session(app: str = "tallyrank", cores: int | str = "*") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Only a local session without that setting gets a folder of its own, since its driver
    and executors are one process.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    configured = configured or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="tallyrank-shared-")
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str = "cut") -> str:
    """A new path in the shared folder; `discard` or the end of the program removes it."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append(path)
    return path


def discard(path: str) -> None:
    """Delete a scratch path through the file system that Spark itself uses."""
    if path in _folders:
        _folders.remove(path)
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jvm is not None:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


#: Spark deletes the shuffle files of a query when it ends, in place of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_cut(df: DataFrame, path: str) -> DataFrame:
    """Write `df` as Parquet at `path` and read it back: later plans read only the columns
    they use, and no lost executor makes them start again from the source. What was shuffled
    to write it is of no more use and goes at once."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)
    return owner_of(df.sparkSession.read.schema(df.schema).parquet(path), path)


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    return write_cut(df, scratch_path(df.sparkSession, name))


def owner_of(df: DataFrame, *paths: str) -> DataFrame:
    """`df`, marked as what `release` takes to free `paths`."""
    df._scratch = paths
    return df


def scratch_of(*frames: DataFrame) -> list[str]:
    return [path for df in frames for path in getattr(df, "_scratch", ())]


def release(*frames: DataFrame) -> None:
    """Delete the files behind tables that `materialize` gave; nothing may read them any more."""
    for path in scratch_of(*frames):
        discard(path)


@contextlib.contextmanager
def scratch_scope(kept: list[str]):
    """Deletes at its end what was written to scratch inside, except the paths put into `kept`."""
    before = set(_folders)
    try:
        yield
    finally:
        for path in [p for p in _folders if p not in before and p not in kept]:
            discard(path)


@atexit.register
def _discard_all() -> None:
    for path in list(_folders):
        try:
            discard(path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return
