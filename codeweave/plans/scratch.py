"""Written intermediates in the folder that the cluster shares, for loops and for plans used more than once."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, a local folder, but only if all of Spark runs in this process.

    Executors on other machines would each write to a disk of their own, so there it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="codeweave-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = f"file://{_local[0]}"
    return f"{base.rstrip('/')}/codeweave/{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage is cut, and lost executors cost nothing."""
    path = path or scratch_dir(df.sparkSession)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """As :func:`materialize`, dealt out and sorted by ``keys``, so that joins and aggregations on them shuffle it no more.

    The table's name goes at once; its files are read as long as the result is.
    """
    spark = df.sparkSession
    tasks, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"codeweave_{uuid.uuid4().hex}"
    dealt = df.repartition(tasks, *keys).write.option("path", scratch_dir(spark)).option("compression", "zstd")
    dealt.bucketBy(tasks, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for joins that shuffle it: a table that compresses well looks small, is many times that in memory, and a broadcast goes through the driver."""
    return df.hint("merge")


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a written intermediate that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/codeweave/" in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over.

    It does so when the driver's JVM has collected their plans; a plan goes in the collection after the one
    that finds its last holder.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
