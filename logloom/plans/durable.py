"""Cuts in a plan that outlive lost executors, and the spread of small inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all nodes share: spark.checkpoint.dir. One of our own only where that is unset and all tasks run in this process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.getCheckpointDir() and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="logloom-"))
    return named or spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute once into the folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(table: DataFrame) -> DataFrame:
    """A small table, read from files as it is, dealt to all cores: one row group is one task otherwise. Large tables stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before this one in a total order.

    Rows are cut in ranges of the order; sums run within a range, and one number a range says what lies before it.
    """
    ranged = cut(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    sums = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.sum(value).alias("n")).collect())
    before, total = [], 0
    for part, n in sums:
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "_range int, _lead long")
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(offsets), "_range").withColumn(out, F.col(out) + F.col("_lead")).drop("_range", "_lead")


def clear(spark: SparkSession, names: list[str] | None = None) -> None:
    """Removes what the library has left in the shared folder: scratch tables of some names, and without names all that is in the folder, checkpoints too.

    For the end of a job that has a folder of its own: what reads a table or checkpoint there cannot be computed again after.
    """
    folder = shared_dir(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for f in files.listStatus(path) if files.exists(path) else []:
        if names is None or f.getPath().getName().rsplit("-", 1)[0] in names:
            files.delete(f.getPath(), True)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder or file, wherever Spark keeps it: a superseded load, a run's scratch."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
