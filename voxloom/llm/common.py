"""Shared plumbing: scratch tables in the cluster's shared folder, batch limits."""

from __future__ import annotations

import ctypes
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"


#: Scratch paths made in this process, oldest first.
_MADE: list[str] = []


def _hadoop(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, with its scheme.

    Only where it is unset (tests, a notebook) a local folder is made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="voxloom-")
        sc.setCheckpointDir(found)
        import atexit

        atexit.register(shutil.rmtree, found, True)
        found = sc.getCheckpointDir()
    p, fs = _hadoop(spark, found)
    return fs.makeQualified(p).toString().rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder, deleted by :func:`release` or when the driver's JVM exits."""
    path = f"{shared_dir(spark)}/voxloom-{tag}-{uuid.uuid4().hex}"
    p, fs = _hadoop(spark, path)
    fs.deleteOnExit(p)
    _MADE.append(path)
    return path


def release(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the scratch paths made after the first ``since``, but for tables of :func:`materialize` in ``keep``.

    Nothing that reads the others may run afterwards. ``len(made())`` is the number so far.
    """
    held = {getattr(df, "_voxloom_path", None) for df in keep}
    for path in _MADE[since:]:
        if path not in held:
            drop_path(spark, path)
    _MADE[since:] = [p for p in _MADE[since:] if p in held]


def made() -> list[str]:
    return list(_MADE)


def drop_path(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and reread it."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._voxloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more."""
    drop_path(df.sparkSession, df._voxloom_path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that are written and no longer referenced.

    Its cleaner acts on what the driver's garbage collector finds dead, which else may come long after the files are no use.
    """
    spark.sparkContext._jvm.System.gc()


def trim_memory() -> None:
    """Give the system back what this process has freed but its allocators keep.

    A Python worker lives on after its task, and beside others, so what one task's batches once took else stays taken.
    """
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc's only
        trim(0)


def trimmed(batches):
    """``batches``, with :func:`trim_memory` once they are done."""
    try:
        yield from batches
    finally:
        trim_memory()


#: Bytes of an Arrow batch, beyond its last row.
BATCH_BYTES = 1 << 22


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, since one text may be very long, unless the session bounds them lower.

    The same bound serves all operators, as plans read it when they run.
    """
    key, parse = "spark.sql.execution.arrow.maxBytesPerBatch", spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < parse(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
