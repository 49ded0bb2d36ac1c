"""Cutting lineage by reliable checkpoints."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="matchloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the checkpoint folder, which driver and executors share."""
    return f"{_folder(spark)}/{what}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder. Where none is set, a local master gets a temporary one; on a cluster it raises."""
    _folder(df.sparkSession)
    return df.checkpoint()


_STAGED: list[tuple[SparkSession, str]] = []


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder as compressed Parquet, which takes a fraction of a checkpoint's rows, and read again."""
    path = scratch(df.sparkSession, "staged")
    _STAGED.append((df.sparkSession, path))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the context may be gone when the process ends
            return
