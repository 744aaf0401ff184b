"""Tables that cut lineage: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset and all is one machine (tests), one of our own."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="millrace-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to a table in the shared folder and read it again; its shuffle files go when it is written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with _setting(spark, _FREE_SHUFFLES, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def cut_parts(df: DataFrame, label: str, part: Column, n: int) -> list[DataFrame]:
    """cut() in one pass to n tables, by part, a number from 0 to n - 1 for each row. They can be dropped one by one."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with _setting(spark, _FREE_SHUFFLES, "true"), _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(n)):  # else rows are sorted by part
        df.withColumn("part", part).write.partitionBy("part").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system, tables = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    for k in range(n):
        folder = f"{path}/part={k}"
        system.mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))  # a part without rows
        tables.append(spark.read.schema(df.schema).parquet(folder))
        tables[-1]._millrace_path = folder
    return tables


def drop(*tables: DataFrame | None) -> None:
    """Delete tables made by cut() that no later plan reads."""
    for table in tables:
        path = getattr(table, "_millrace_path", None)
        if path:
            sc = table.sparkSession.sparkContext
            hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)
