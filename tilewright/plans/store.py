"""Tables that cut a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder of the context. Where both are unset a local session (as in tests) gets a temporary
    folder, which goes when Python ends; on a cluster, whose machines could not share it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tilewright-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: columnar, of known size for the planner, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._saved_at = path
    return back


def forget(*dfs: DataFrame) -> None:
    """Delete tables of ``saved`` that no later step reads."""
    for df in dfs:
        if path := getattr(df, "_saved_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
