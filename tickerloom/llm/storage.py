"""Tables written once and read back, in the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; a temporary folder only in local runs that set none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Spark's setting by which a write removes its own shuffle files at its end. Else they stay until the driver happens to
#: collect its garbage, and the disk holds those of many steps at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, folder: str | None = None, name: str = "table", codec: str = "snappy") -> DataFrame:
    """``df`` as a written table: its lineage ends here, and lost executors cost no more than the reading."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def giving_back(work):
    """``work`` on the table of a group, after which its worker, which may wait for long, keeps no freed memory."""

    def done(table: pa.Table) -> pa.Table:
        out = work(table)
        give_back()
        return out

    return done


def give_back() -> None:
    """Returns freed memory of a Python worker to the system: workers wait for their next task beside others that work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with this C library
        pass
