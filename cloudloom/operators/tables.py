"""Tables written to the shared folder, where lineage ends."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder in the warehouse. A machine's own folder is an error on a cluster."""
    sc = spark.sparkContext
    held = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if held:
        return held.rstrip("/")
    own = qualified(spark, spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch")
    if own.startswith("file:") and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}/{name}"
    atexit.register(remove, spark, path.rpartition("/")[0])
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system: the session's default one where it names none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = str(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString())
    return "file:///" + whole.removeprefix("file:").lstrip("/") if whole.startswith("file:") else whole


def remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: the folder stays for the cluster's own cleaning
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at_ = path
    return out


def free(*tables: DataFrame) -> None:
    """Remove tables of :func:`stored` that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df.stored_at_.rpartition("/")[0])
