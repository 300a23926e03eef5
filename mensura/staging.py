"""Tables staged in the folder that driver and executors share, and numbering without one task for all."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_placed: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode a temporary one if none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="mensura-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return _local["dir"]


def reached(spark: SparkSession, root: str):
    """The file system of a path, and the path as it names it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there goes when the application ends, or by
    ``clear``."""
    root = f"{folder(spark)}/mensura-{uuid.uuid4().hex}"
    store, path = reached(spark, root)
    store.deleteOnExit(path)
    _placed.setdefault(spark.sparkContext.applicationId, []).append(root)
    return f"{root}/{name}"


def clear(spark: SparkSession) -> None:
    """Deletes what operators staged in this application so far. DataFrames that they returned before
    can't be read any more, so write or collect these first."""
    for root in _placed.pop(spark.sparkContext.applicationId, []):
        store, path = reached(spark, root)
        store.delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes the table to the shared folder and reads it again: lineage ends there, and a lost
    executor costs nothing that was computed before."""
    spark, path = df.sparkSession, place(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows dealt by a key over as many tasks as give each about so many. A fixed number of tasks, as
    Spark would join small ones, though each row may make many more."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the row number from one in the order of all rows, which ``order`` must tell apart. Rows are
    ranged and numbered within their range; only a row a range is ordered as a whole."""
    ranged = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = ranged.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return own.join(F.broadcast(sizes), F.col("_range") == F.col("_r")).withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_r", "_before")


def running(df: DataFrame, group: list[str], order: list[str], width: str, name: str) -> DataFrame:
    """Adds the sum of ``width`` over the rows before in their group by ``order``, which tells its rows
    apart. Rows are ranged by group and order and summed within their range; ranges add what lies before
    them, of which a group has no more than there are ranges."""
    ranged = stage(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    here = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range", *group).agg(F.sum(width).alias("_w")).withColumn("_before", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    sums = sums.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_r{i}") for i, g in enumerate(group)], "_before")
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_r{i}"))
    own = ranged.withColumn(name, F.coalesce(F.sum(width).over(here), F.lit(0)))
    return own.join(sums, same).withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_r", "_before", *[f"_r{i}" for i in range(len(group))])


BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches for rows that hold whole texts: fewer rows and bytes than Spark's default, unless
    the session asks for fewer still. What a worker holds doesn't grow with the table either way. The
    setting stays, as a plan that the caller runs later needs it."""
    for key, most in zip(BATCHES, (rows, 4 << 20)):
        now = (spark.conf.get(key, None) or "").rstrip("b")
        if not now or now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
