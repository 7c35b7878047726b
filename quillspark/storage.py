"""Written intermediates in the folder that driver and executors share, and broadcasts of tables whose bytes are counted."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many bytes is broadcast.
SMALL_BYTES = 16 << 20
_written: dict[str, SparkSession] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's own, else one in the warehouse.

    Only a local session, as in tests, gets a temporary folder of this machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local-") and spark.sparkContext.master.startswith("local"):
        at = "file://" + tempfile.mkdtemp(prefix="quill-")
        spark.sparkContext.setCheckpointDir(at)
    return (at or spark.conf.get("spark.sql.warehouse.dir") + "/quill-work").rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/quill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_clear)
    _written[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._quill_path = path
    return back


def discard(df: DataFrame) -> None:
    """Remove what materialize wrote for this very DataFrame, once nothing is computed from it any more."""
    path = getattr(df, "_quill_path", None)
    if path in _written:
        _remove(_written.pop(path), path)


def _clear() -> None:
    for path, spark in list(_written.items()):
        _remove(spark, path)
    _written.clear()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM is gone already
        pass


def small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """df, marked for broadcast if its values, written out, take at most `most` bytes. Counting reads df: give written tables."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16)).first()[0] or 0
    return F.broadcast(df) if size <= most else df
