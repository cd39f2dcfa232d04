"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes shares of hashed words, of word shapes and of repetition; a singular value decomposition of a bounded sample of labelled
rows (`sample`, the smallest hashes of ids) gives the latent space. The sample's vectors are broadcast: sample * dims floats, whatever the
corpus. Every document is multiplied with all of them in blocks, exactly, and its nearest neighbours vote with weights that grow with the
cosine. Factors are rounded to multiples of 1 / FINE, so that the doubles that add up their products lose no bit and a score does not follow
the block in which its row stands. One pass over the documents, no shuffle of texts.

Defined results: null and empty texts have a zero vector and get the mean label; null ids are not held out and are never learned from;
repeated rows get equal scores; of several texts with one id the smallest is learned from, and of several labels their mean; neighbours whose
cosines are equal to six digits go by a hash of their ids; labels that are null are not learned from; without any labels every score is 0.5;
very long texts are read whole; ids may be of any type; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.substring import SPACE, mix, word_hashes

WORDS, SHAPES = 512, 512
REPEATS = 3
BLOCK = 512
FINE = 2**24
U = np.uint64


@dataclass(frozen=True)
class Voting:
    sample: int = 8192  # labelled rows that are learned from
    dims: int = 48
    neighbours: int = 24
    sharpness: float = 12.0
    threshold: float = 0.7
    scales: tuple[float, float, float] = (0.35, 1.0, 1.5)  # of words, shapes and repetition


def _classes() -> np.ndarray:
    kind = np.full(256, 7)  # beyond ASCII
    kind[:128] = 6
    kind[np.arange(97, 123)] = 0
    kind[np.arange(65, 91)] = 1
    kind[np.arange(48, 58)] = 2
    kind[[ord(c) for c in ".,;:"]] = 3
    kind[[ord(c) for c in "!?\"'()-"]] = 4
    kind[[ord(c) for c in "#$%&*|<>"]] = 5
    return kind


KIND = _classes()


def features(texts: list[bytes], scales: tuple[float, float, float]) -> np.ndarray:
    """(texts, WORDS + SHAPES + REPEATS), square roots of shares."""
    n = len(texts)
    h, counts = word_hashes(texts)
    doc = np.repeat(np.arange(n), counts)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.diff(SPACE[buf].astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    ends = ends[len(ends) - len(starts) :]
    size = np.minimum(np.log2(ends - starts + 1).astype(np.int64), 7)
    shape = (KIND[buf[starts]] * 8 + KIND[buf[ends - 1]]) * 8 + size
    table = lambda cell, width: np.bincount(doc * width + cell, minlength=n * width).reshape(n, width)
    total = np.maximum(counts, 1)[:, None]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])

    def repeats(x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Share of x in each document that an earlier place has."""
        _, first = np.unique(mix(x) ^ mix(own.astype(U), 3), return_index=True)
        fresh = np.bincount(own[first], minlength=n)
        return np.bincount(own, minlength=n) - fresh

    three = h[2:] * U(3) + h[1:-1] * U(5) + h[:-2] * U(7) if len(h) > 2 else h[:0]
    own = doc[2:] if len(h) > 2 else doc[:0]
    extra = np.stack([np.bincount(doc, same, n), repeats(h, doc) * 0.25, repeats(three, own)], 1)
    parts = [table((h >> U(55)).astype(np.int64), WORDS), table(shape, SHAPES), extra]
    return np.concatenate([np.sqrt(p / total) * s for p, s in zip(parts, scales)], 1).astype(np.float32)


def _pieces(texts: list[bytes], most: int = 1_000_000) -> Iterator[slice]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most or i - start + 1 >= BLOCK or i == len(texts) - 1:
            yield slice(start, i + 1)
            start, held = i + 1, 0


def _fine(x: np.ndarray) -> np.ndarray:
    return np.rint(x.astype(np.float64) * FINE) / FINE


def _unit(z: np.ndarray) -> np.ndarray:
    return _fine(z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12))


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k largest cosines; those that are equal to six digits go by their place."""
    n = cosine.shape[1]
    order = np.rint(cosine * -1e6).astype(np.int64) * n + np.arange(n)
    return np.argpartition(order, k - 1, axis=1)[:, :k]


def score(docs: DataFrame, labels: DataFrame, learn_from: Column, voting: Voting = Voting(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, score), one row per document. labels: (id_col, label_col); learn_from: which ids may be learned from."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).where(F.col("_y").isNotNull() & F.col("_id").isNotNull())
    known = known.where(F.coalesce(learn_from_column(learn_from, "_id"), F.lit(False))).groupBy("_id").agg(F.avg("_y").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(voting.sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # at most `sample` ids, so their side is broadcast; repeated rows of an id count once
    taken = rows.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.min("t").alias("t"), F.first("_y").alias("y"))
    scales = voting.scales

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode("utf-8") for t in b.column(0).to_pylist()]
            for s in _pieces(texts):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in features(texts[s], scales)], pa.binary()), b.column(1)[s], b.column(2)[s]], names=["x", "y", "place"])

    # at most `sample` rows; in one order whatever the partitions, so that sums and ties come out alike
    learned = taken.select("t", "y", F.xxhash64("_id").alias("place")).mapInArrow(vectors, "x binary, y double, place long").toPandas().sort_values(["place", "x"])
    width = WORDS + SHAPES + REPEATS
    x = np.frombuffer(b"".join(learned["x"]), np.float32).reshape(-1, width)
    y = learned["y"].to_numpy(np.float32)
    prior = float(y.mean()) if len(y) else 0.5
    _, basis = np.linalg.eigh(x.T.astype(np.float64) @ x.astype(np.float64))
    basis = _fine(np.ascontiguousarray(basis[:, ::-1][:, : voting.dims]))
    model = spark.sparkContext.broadcast((basis, _unit(_fine(x) @ basis), y))
    k, sharp = min(voting.neighbours, len(y)), voting.sharpness

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, known, y = model.value
        for b in batches:
            texts = [t.encode("utf-8") for t in b.column(1).to_pylist()]
            for s in _pieces(texts):
                out = np.full(len(texts[s]), prior)
                if k:
                    z = _fine(features(texts[s], scales)) @ basis
                    some = np.linalg.norm(z, axis=1) > 1e-9
                    cosine = _unit(z) @ known.T
                    near = np.sort(nearest(cosine, k), axis=1)
                    weight = np.maximum(np.take_along_axis(cosine, near, 1), 0.0) ** sharp + 1e-12
                    out[some] = ((weight * y[near]).sum(1) / weight.sum(1))[some]
                yield pa.RecordBatch.from_arrays([b.column(0)[s], pa.array(np.clip(out, 0.0, 1.0))], names=["doc_id", "score"])

    return rows.mapInArrow(vote, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def learn_from_column(learn_from, name: str) -> Column:
    """learn_from is a function of the id's column, or a column of its own."""
    return learn_from(F.col(name)) if callable(learn_from) and not isinstance(learn_from, Column) else learn_from


def remainder(key: Column, n: int) -> Column:
    return F.crc32(key.cast("string")) % n


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    voting = Voting()
    out = score(docs, labels, lambda key: remainder(key, 4) != 2, voting)
    return out.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= voting.threshold).cast("int").alias("predicted"),
    )
