"""Tables that cut a plan: written to the folder that all executors share and read again, so a lost executor costs a retry, not the result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which all executors share; a temporary one only where that is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomcert-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _delete_at_exit(spark, folder)
    return f"{folder.rstrip('/')}/loomcert-{spark.sparkContext.applicationId}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.deleteOnExit(place)


def new_place(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _delete_at_exit(spark, path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again."""
    path = new_place(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    for t in tables:
        system, place = _place(t.sparkSession, t.stored_at)
        system.delete(place, True)


def keys_to_join(keys: DataFrame) -> DataFrame:
    """A stored table, mostly of keys, to be joined with: one that lies over Spark's threshold for a broadcast in memory is to be shuffled. Spark goes
    by the files' size, but keys in order take about a byte a row there: millions of them would be broadcast, and built in the driver's memory."""
    java = keys.sparkSession._jsparkSession.sessionState().conf()
    size = keys.count() * (8 + keys._jdf.schema().defaultSize())
    return keys.hint("merge") if size > java.autoBroadcastJoinThreshold() else keys


def rows_to_join(df: DataFrame) -> DataFrame:
    """keys_to_join for any table: rows are only counted where Spark takes it for small enough for a broadcast, as of columns read from files."""
    java = df.sparkSession._jsparkSession.sessionState().conf()
    told = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if told > java.autoBroadcastJoinThreshold() else keys_to_join(df)


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """df, stored, with `part`: ranges of the order by quantile, numbered in the order. However keys are spread, a part has about as many rows
    as any other; rows that are equal in the order are in one."""
    return stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")


def placed(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """df with each row's place in the order, from 1: its place in its range, after the sizes of the ranges before. The order should be strict."""
    r = in_ranges(df, *order)
    sizes = r.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return r.withColumn("own", own).join(before, "part").withColumn(name, (F.col("own") + F.col("before")).cast("bigint")).drop("part", "own", "before")
