"""New paths in the folder that the cluster shares for checkpoints, and their removal."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths given out by this process and not yet released.
_GIVEN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder; a local one is set only where the cluster names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    _GIVEN.append(f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}")
    return _GIVEN[-1]


def release(spark: SparkSession) -> int:
    """Deletes all that was written to paths given out so far, and returns how many there were.

    Frames that read from them cannot be used any more, so results are written or collected before.
    """
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _GIVEN:
        path = jvm.org.apache.hadoop.fs.Path(_GIVEN.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n


def cut(df: DataFrame) -> DataFrame:
    """Writes df there and reads it back, so that what several parts of a plan use is made once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
