"""Positions of rows in an order, without a task that sorts them all, and paths of work tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Where it is unset, as in tests, in the warehouse, under a local master only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def numbered(rows: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """rows with 0, 1, ... in an order: ranks within ranges of it plus the counts of the ranges before. The ranges are
    written once, so that both uses see the same ones; their counts are few. Ties are numbered in any order."""
    path = shared_path(rows.sparkSession, "ranges")
    rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    kept = rows.sparkSession.read.parquet(path)
    counts = kept.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return kept.join(F.broadcast(before), "__part").withColumn(name, (rank + F.col("__before")).cast("long")).drop("__part", "__before")
