"""The shared folder that intermediate tables are written to.

On a cluster it is the one named by ``spark.checkpoint.dir``; every executor
can reach it, so what is written there outlives a lost executor. Only a session
that names none gets a folder of its own when it runs on this machine alone,
and an error otherwise.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        own = tempfile.mkdtemp(prefix="cohortlens-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{shared_dir(spark)}/cohortlens/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder; no two calls share one."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote. Tables that still read it break."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of a table that later steps use several times, without
    tying it to the executors that computed it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a *stored* table for broadcast when a count shows it is small.

    The count reads Parquet footers only. A larger table is returned as it is
    and joins by shuffle, where adaptive execution splits hot keys.
    """
    return F.broadcast(stored) if stored.count() <= rows else stored
