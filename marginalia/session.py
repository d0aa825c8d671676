"""Settings of a Spark session and the folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_WRITTEN: list[str] = []


def local_session(name: str = "marginalia", cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxPlanStringLength", "100000")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names, else one of our own on a local master."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="marginalia-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there: a lost executor loses nothing.

    Spark removes what was written when nothing refers to it, if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read back: a plan that knows nothing of how they were made.

    Joins with it are sorted: the size of its files says little about that of the columns that are read, or of what is exploded from them.
    It stays until `forget_written`, at the latest the end of the driver's process.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(forget_written, df.sparkSession)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def remove(spark: SparkSession, name: str) -> None:
    """Remove a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget_written(spark: SparkSession) -> None:
    """Remove the tables of `written`; no relation made from them may be used any more."""
    while _WRITTEN:
        name = _WRITTEN.pop()
        try:
            remove(spark, name)
        except Exception:  # the JVM may be gone at the end of the process
            return


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application, unless a local session finds it by PYTHONPATH."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if context.applicationId in _SHIPPED or context.master.startswith("local") and str(root) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    archive = Path(tempfile.mkdtemp(prefix="marginalia-")) / "marginalia.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted((root / "marginalia").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
