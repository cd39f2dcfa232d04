"""A graph to search in: each row's diversified neighbours, both ways, as a table, with a bounded sample of rows as entries.

A neighbour stays in the graph if no nearer one that stayed is nearer to it than the row itself; links go both ways, the nearest 2 * degree of
a row stay. A search keeps a beam of the best `ef` rows for each query and moves it by joins: each round the best rows of a beam that were
not opened yet are, their unvisited neighbours are measured where their vectors are, and come back to their query. A query ends when its
beam holds no unopened row that is near enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.metrics import distances, paired
from skein.operators.descent import Descent, descend, vectors_by_bucket
from skein.operators.knn import numbers, ranked
from skein.operators.tables import cut

ENTRIES = 1024
STARTS = 8


@dataclass
class Graph:
    nodes: DataFrame  # (id, x, links)
    entries: DataFrame  # (id, x): ENTRIES rows at most
    metric: str
    n: int

    def save(self, path: str) -> None:
        self.nodes.write.mode("errorifexists").parquet(f"{path}/nodes")
        self.entries.withColumns({"metric": F.lit(self.metric), "n": F.lit(self.n)}).coalesce(1).write.mode("errorifexists").parquet(f"{path}/entries")


def load(spark: SparkSession, path: str) -> Graph:
    entries = spark.read.parquet(f"{path}/entries")
    one = entries.first()
    return Graph(spark.read.parquet(f"{path}/nodes"), entries.select("id", "x"), one["metric"], one["n"])


def diversified(table: DataFrame, rows: DataFrame, places: DataFrame, metric: str) -> DataFrame:
    """(i, j, d): neighbours that no nearer, kept neighbour hides."""
    e = cut(table.where("i <> j").select("i", "j", "d").join(places.withColumnRenamed("id", "i"), "i"))
    held = vectors_by_bucket(e.select("bucket", F.col("j").alias("id")), rows)

    def run(e: pa.Table, r: pa.Table) -> pa.Table:
        ids = np.asarray(r.column("id"))
        order = np.argsort(ids)
        ids = ids[order]
        x = np.asarray(r.column("x").combine_chunks().flatten()).reshape(len(ids), -1)[order]
        i, j, d = (np.asarray(e.column(c)) for c in ("i", "j", "d"))
        by = np.lexsort((j, d, i))
        i, d, at = i[by], d[by], np.searchsorted(ids, j[by])
        keep = np.ones(len(i), bool)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1, [len(i)]])
        for low, high in zip(starts[:-1], starts[1:]):
            between, own = distances(metric, x[at[low:high]], x[at[low:high]]), keep[low:high]
            for p in range(1, high - low):
                own[p] = not (own[:p] & (between[p, :p] < d[low + p])).any()
        return pa.table({"i": i[keep], "j": ids[at[keep]], "d": d[keep]})

    return e.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(run, "i long, j long, d double")


def built(df: DataFrame, metric: str = "euclidean", degree: int = 16, build: int = 200, seed: int = 42, sample: int = 16_384, found: Descent | None = None, **args) -> Graph:
    """A graph over df's rows (id, x): from the neighbours of a descent with at most 2 * degree + 1 of each row and `build` candidates."""
    rows = numbers(df)
    n = rows.count()
    found = found or descend(df, min(n, 2 * degree + 1), metric, max_candidates=max(10, min(60, build // 4)), seed=seed, sample=sample, **args)
    kept = cut(diversified(found.table, rows, found.places, metric))
    both = kept.union(kept.select("j", "i", "d")).distinct()
    links = both.withColumn("at", F.row_number().over(W.partitionBy("i").orderBy("d", "j"))).where(F.col("at") <= 2 * degree)
    links = links.groupBy(F.col("i").alias("id")).agg(F.array_sort(F.collect_list("j")).alias("links"))  # 2 * degree
    nodes = cut(rows.join(links, "id", "left").select("id", "x", F.coalesce("links", F.array().cast("array<long>")).alias("links")))
    entries = cut(nodes.select("id", "x").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(ENTRIES))
    return Graph(nodes, entries, metric, n)


STATE = "q long, x array<double>, ids array<long>, ds array<double>, open array<array<long>>, seen array<long>"


def _begin(graph: Graph, query: DataFrame) -> DataFrame:
    """(q, x, j): the STARTS entries that are nearest to each query."""
    held = graph.entries.toPandas()  # ENTRIES rows
    ids, m = held["id"].to_numpy(), np.stack(held["x"].to_numpy())
    known, metric = graph.nodes.sparkSession.sparkContext.broadcast((ids, m)), graph.metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = known.value
        for b in batches:
            if b.num_rows:
                d = distances(metric, np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1), m)
                asks = np.sort(ids[np.argsort(d, axis=1, kind="stable")[:, :STARTS]], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(asks.tolist(), pa.list_(pa.int64()))], names=["q", "x", "asks"])

    return numbers(query).mapInArrow(run, "q long, x array<double>, asks array<long>")


def _measured(asks: DataFrame, graph: Graph) -> DataFrame:
    """(q, j, d, links) for (q, x, j), where the nodes are."""
    metric = graph.metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u, v = (np.asarray(b.column(c).flatten()).reshape(b.num_rows, -1) for c in (2, 3))
                d = np.sqrt(((u - v) ** 2).sum(1)) if metric == "euclidean" else paired(metric, u, v)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d), b.column(4)], names=["q", "j", "d", "links"])

    both = asks.join(graph.nodes.select(F.col("id").alias("j"), F.col("x").alias("xj"), "links"), "j")
    return both.select("q", "j", "x", "xj", "links").mapInArrow(run, "q long, j long, d double, links array<long>")


def _moved(state: dict, j: list[int], d: list[float], links: list[list[int]], k: int, ef: int, width: int, epsilon: float, most: int) -> list[int]:
    """Takes answers into a query's beam and opens its best rows; the neighbours to ask about next."""
    beam = sorted(zip(state["ds"] + d, state["ids"] + j, state["open"] + links), key=lambda e: e[:2])[:ef]
    reach = beam[k - 1][0] * (1 + epsilon) if len(beam) >= k else np.inf
    seen, asks, opened = set(state["seen"]), [], 0
    for at, (far, row, own) in enumerate(beam):
        if own and opened < width and far <= reach and len(seen) < most:
            opened += 1
            fresh = [x for x in own if x not in seen]
            seen.update(fresh)
            asks += fresh
            beam[at] = far, row, []
    state |= {"ds": [b[0] for b in beam], "ids": [b[1] for b in beam], "open": [b[2] for b in beam], "seen": sorted(seen)}
    return sorted(asks)


def search(graph: Graph, query: DataFrame, k: int, ef: int = 100, width: int | None = None, epsilon: float = float("inf"), fraction: float = 1.0) -> DataFrame:
    """(i, rank, j, d): up to k neighbours of query's rows (id, x) among the graph's.

    ef: rows of a beam, k at least. width: rows opened a round (a quarter of ef if None). epsilon: only rows up to 1 + epsilon times the k-th
    distance are opened. fraction: a query ends after visiting this share of all rows.
    """
    ef = max(ef, k)
    width, most = width or max(4, ef // 4), max(ef, int(fraction * graph.n))
    state = _begin(graph, query)
    empty = {"ids": F.array().cast("array<long>"), "ds": F.array().cast("array<double>"), "open": F.array().cast("array<array<long>>")}
    state = cut(state.select("q", "x", *[v.alias(c) for c, v in empty.items()], F.col("asks").alias("seen"), "asks"))
    done = [state.where("false").select("q", "ids", "ds")]

    def run(s: pa.Table, a: pa.Table) -> pa.Table:
        rows = {r["q"]: r for r in s.to_pylist()}
        came = {q: ([], [], []) for q in rows}
        for q, j, d, links in zip(*(a.column(c).to_pylist() for c in ("q", "j", "d", "links"))):
            for part, value in zip(came[q], (j, d, links)):
                part.append(value)
        for q, r in rows.items():
            r["asks"] = _moved(r, *came[q], k, ef, width, epsilon, most)
        return pa.Table.from_pylist(list(rows.values()), schema=s.schema)

    groups = lambda df: df.withColumn("g", F.pmod(F.xxhash64("q"), F.lit(parts))).groupBy("g")
    parts = max(1, -(-state.count() // 1024))
    schema = f"{STATE}, asks array<long>, g long"
    while state.limit(1).count():
        answers = _measured(state.select("q", "x", F.explode("asks").alias("j")), graph)
        state = cut(groups(state).cogroup(groups(answers)).applyInArrow(run, schema).drop("g"))
        done.append(state.where(F.size("asks") == 0).select("q", "ids", "ds"))
        state = state.where(F.size("asks") > 0)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    pairs = out.select(F.col("q").alias("i"), F.explode(F.arrays_zip("ids", "ds")).alias("e")).select("i", F.col("e.ids").alias("j"), F.col("e.ds").alias("d"))
    return cut(ranked(pairs, k, False))
