"""Session construction for tests and the bench, and the shared folder for checkpoints and written tables."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "qualitas") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("QUALITAS_DRIVER_MEMORY", "16g"))
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shared_folder(spark: SparkSession, configured: str | None = None, master: str | None = None) -> str:
    """The folder that the driver and all executors share, as the session names it in ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a fresh temporary folder; any other master is refused,
    since its executors would each write to a disk of their own.  ``configured`` and ``master`` stand in for
    the session's own values in tests.
    """
    sc = spark.sparkContext
    configured = configured or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = master or sc.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir is not set on {master}: name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="qualitas-shared-")
    sc.setCheckpointDir(path)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Point ``checkpoint()`` at the shared folder; None without a SparkContext (remote session)."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (remote session: no checkpointing from the client)
        return None
    folder = shared_folder(spark)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables and files that one call writes."""
    return f"{shared_folder(spark)}/qualitas-work/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back: cuts the lineage, and lets later joins split skewed sides."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder that :func:`work_folder` named, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
