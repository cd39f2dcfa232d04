"""What may come in place of rows: vectors, distances, neighbour tables and graphs, each brought to the library's columns and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.knn import check_knn, knn_from_distances
from skein.operators.scaling import numeric_columns
from skein.operators.tables import check_complete, number


def feature_table(df: DataFrame, key: str, cols: list[str] | None = None) -> DataFrame:
    """(id, key, x) from the numeric columns (or those named) of df; ids from 0 in the order of key."""
    cols = cols or numeric_columns(df, (key,))
    check_complete(df, cols, "data")
    return number(df, [key], "id").select("id", F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))


def distance_table(pairs: DataFrame, k: int) -> DataFrame:
    """Neighbours from (i, j, d). Distances of zero are undefined; a table that holds each pair once is read both ways."""
    check_complete(pairs, ["i", "j", "d"], "distances")
    once = not pairs.where("i > j").limit(1).count() or not pairs.where("i < j").limit(1).count()
    return knn_from_distances(pairs, k, triangular=once)


def neighbour_table(df: DataFrame, n: int | None = None) -> DataFrame:
    """Neighbours from elsewhere, as (i, rank, j, d) or with the columns named index and distance."""
    named = {"index": "j", "distance": "d"}
    return check_knn(df.withColumnsRenamed({a: b for a, b in named.items() if a in df.columns}), n)


def graph_table(df: DataFrame) -> DataFrame:
    """A graph from elsewhere: complete (i, j, w), every edge in both directions."""
    check_complete(df, ["i", "j", "w"], "graph")
    back = df.select(F.col("j").alias("i"), F.col("i").alias("j"))
    if df.select("i", "j").join(back, ["i", "j"], "left_anti").limit(1).count():
        raise ValueError("the graph is not symmetric")
    return df
