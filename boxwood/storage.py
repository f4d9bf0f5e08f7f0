"""Where intermediate tables go."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in
    ``spark.checkpoint.dir``. Where that is unset, a local session, whose executors are its
    driver, gets a folder of its own; on a cluster that is an error."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = tempfile.mkdtemp(prefix="boxwood-")
        spark.conf.set("spark.checkpoint.dir", held)
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one."""
    return f"{shared_dir(spark)}/boxwood-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the application's intermediate tables, once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise_once(spark: SparkSession, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that the application has written under a key, else ``make``'s, written now."""
    path = f"{own_dir(spark)}/once-{hashlib.sha1(key.encode()).hexdigest()}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there, so a lost
    executor costs no recomputation of what came before."""
    path = f"{own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
