"""Scratch tables in the cluster's shared folder, which cut a plan's lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Scratch tables made in this process, oldest first.
_MADE: list[str] = []


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset, in local mode (tests), a folder of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="voxloom-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
        found = sc.getCheckpointDir()
    p, fs = _hadoop(spark, found)
    return fs.makeQualified(p).toString().rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; the files go with :func:`release` or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voxloom-{tag}-{uuid.uuid4().hex}"
    p, fs = _hadoop(spark, path)
    fs.deleteOnExit(p)
    _MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all tables of :func:`materialize`; results that were not written elsewhere cannot be read any more."""
    while _MADE:
        p, fs = _hadoop(spark, _MADE.pop())
        fs.delete(p, True)
