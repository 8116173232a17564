"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _WRITES = threading.Lock(), []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session. Only where it is unset on one machine (local master) a temporary
    one is set; on a cluster executors would each write to their own disk, so that fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="veritab-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def _cleaning(spark: SparkSession):
    """Shuffle files are given back after each query, while any write of this session goes on: the first one sets that, the last one puts back what was."""
    with _LOCK:
        _WRITES.append(spark.conf.get(CLEANUP, None))
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            if len(_WRITES) > 1:
                _WRITES.pop()
            elif (before := _WRITES.pop()) is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder, with options of Spark's Parquet writer, and read it back.

    Cuts lineage like ``checkpoint()``, in compressed columns; a lost executor
    costs only the tasks that were running. The shuffle files behind the table
    are of no more use once it is written, so they are given back at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def divided(df: DataFrame, column: str) -> DataFrame:
    """``df`` as a table in the shared folder with a folder for each value of ``column``: filters on it read only their folders."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.partitionBy(column).parquet(path)
    columns = [f for f in df.schema.fields if f.name != column] + [f for f in df.schema.fields if f.name == column]
    return spark.read.schema(StructType(columns)).parquet(path)
