"""Intermediate tables that every executor can read again, and joins and choices that hot keys do not hold up."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has more than this share of the rows; so there are at most as many hot keys as its inverse.
HOT = 1 / 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where driver and executors are one process, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder; a lost executor takes nothing with it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Named tables of one job as Parquet in the shared folder. A lost executor takes nothing with it; tables that no later step reads are
    dropped, so that a loop holds the tables of one turn only."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """left joined with right, which has one row for each key and, in `count`, how many rows of left have it.

    The few keys with more than HOT of all rows are broadcast, so that no task gets all rows of one.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = right.where(F.col(count) > total * HOT).drop(count)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.drop(count), key)
    return left.join(F.broadcast(hot), key).select(rest.columns).unionByName(rest)


def one_of_each(docs: DataFrame, lead: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id is in lead (one column), one for each id: of rows with equal ids, the smallest text. Null ids stay."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    lead = lead.toDF("id")
    first = rows.join(lead, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.struct(F.col("t"), F.xxhash64("row"))).alias("row"))
    return first.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
