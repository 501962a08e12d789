"""Session level helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_made: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="veldra-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the JVM ends."""
    path = f"{shared_dir(spark)}/veldra-{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = target.getFileSystem(spark._jsc.hadoopConfiguration())
    folder.mkdirs(target)  # only what exists can be marked
    folder.deleteOnExit(target)
    _made.add(path)
    return path


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage is cut, and later plans prune columns.

    The files survive the loss of executors and are removed when the JVM ends. The shuffle files of the plan that was written have
    served; a collection on the driver lets Spark's cleaner free their disk before the next stage needs it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and no later plan reads; other frames are left alone."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            _delete(table.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete every scratch table of the session: for long sessions, once the results that read them have been written."""
    while _made:
        _delete(spark, _made.pop())


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _made.discard(path)


def broadcast_checked(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Broadcast hint only when a bounded count proves that ``df`` is small; else ``df`` as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
