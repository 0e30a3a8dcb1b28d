"""Tables written once to the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is set once, but only for a local master: on a cluster the executors would each
    write to a folder of their own, so an unset folder is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strataloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: it survives lost executors and is computed once.

    The table stays until ``released`` is called, or the program ends.
    """
    path = f"{shared_folder(df.sparkSession)}/strataloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _paths.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released() -> int:
    """Deletes every table this process has written so far, once their results have been used; returns their number."""
    gone = 0
    while _paths:
        spark, path = _paths.pop()
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            gone += 1
        except Exception:  # the session has ended; a stopped program leaves its folder to the cluster
            continue
    return gone


atexit.register(released)
