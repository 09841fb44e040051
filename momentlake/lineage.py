"""Cuts of lineage: tables written to the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from momentlake.errors import Refused


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of spark.checkpoint.dir.  Where it is unset, a temporary one
    does for a single machine; a cluster has to name one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise Refused("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="momentlake-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/momentlake-{sc.applicationId}"


def cut(df: DataFrame, name: str = "cut", compression: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    The plan above starts from that table: a lost executor costs its own tasks only, and the sizes are known to
    the optimizer.  compression: a codec other than that of the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._momentlake_path = path
    return out


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more.  It does so when the driver's objects are
    collected as garbage, which may otherwise come long after they have filled the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the table behind a cut() that no later plan reads."""
    path = getattr(df, "_momentlake_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
