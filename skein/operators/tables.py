"""Packing and cutting of intermediate tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the folder the session names, so that loops do not carry their lineage; a local folder only where driver
    and executors are one process, as in tests."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def check_complete(df: DataFrame, cols: list[str], what: str) -> None:
    """Raises if a value is missing or not a number; one aggregate over the table."""
    bad = df.agg(*[F.sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("long")).alias(c) for c in cols]).first()
    if any(bad):
        raise ValueError(f"{what}: some values are missing or not numbers")


def number(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with `name` from 0 in the order of `by`: counts of range partitions, then places within them; no task sees all rows."""
    s = cut(df.repartitionByRange(*[F.col(c) for c in by]).withColumn("_p", F.spark_partition_id()))
    counts = s.groupBy("_p").count()  # a row for each partition
    counts = counts.withColumn("_before", F.sum("count").over(W.orderBy("_p")) - F.col("count"))
    place = F.row_number().over(W.partitionBy("_p").orderBy(*by)) - 1
    return s.withColumn("_at", place).join(F.broadcast(counts), "_p").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_p", "_at", "_before", "count")
