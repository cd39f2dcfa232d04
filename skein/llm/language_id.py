"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to `order` bytes, with the bytes that followed each and how often. A text's next byte is coded
in the longest context that the tree holds: a byte seen there has its share of n + t (n occurrences, t different bytes), any other escapes
with the share t to the context one byte shorter, where bytes of the longer one are excluded; below the empty context all bytes left are
alike. Statistics are frozen, so the code length of a byte depends only on itself and the `order` bytes before it: a chunk's different windows
are priced once for each language, and a text's code length is the sum over its windows, in whole 2^-16 bits. The language with the shortest code
is the prediction, and its share of 2^-length among all languages the score.

Trees are fit on a bounded sample of labelled rows: of each language the `rows` different texts of at most `longest` bytes whose hashes are
smallest (fewer of each where there are more than rows_of_all / rows languages). Contexts seen fewer than `least` times are not kept. What
is broadcast is bounded by the sample, whatever the corpus. One pass over the documents, no shuffle of texts.

Defined results: null texts and texts without a letter are `und` with score 0; so is everything if nothing is learned; rows with null id, text
or language are not learned from; equal code lengths go to the language that sorts first; repeated rows get equal results and are learned
once; very long texts are read whole, a piece at a time, with the bytes before the piece as its context; every text starts as if after
`order` bytes of zero; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.llm.knn_quality import remainder

UNIT = 1 << 16
CHUNK = 2 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class Matching:
    order: int = 4
    rows: int = 256
    rows_of_all: int = 16_384
    longest: int = 16_384
    least: int = 2


def windows(pieces: list[bytes], order: int) -> np.ndarray:
    """Of pieces that start with the `order` bytes before them: each byte's window as one number, the byte itself lowest."""
    buf = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    out = np.zeros(max(0, len(buf) - order), np.int64)
    for k in range(order + 1):
        out |= buf[order - k : len(buf) - k] << (8 * k)
    sizes = np.array([len(p) for p in pieces])
    inside = np.ones(len(buf), bool)
    starts = np.cumsum(sizes) - sizes
    inside[(starts[:, None] + np.arange(order)).ravel()] = False
    return out[inside[order:]]


def _log2(x: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(x, 1))


class Tree:
    """One language's contexts, by order: sorted keys, and code lengths in bits."""

    def __init__(self, seen: np.ndarray, order: int, least: int):
        self.order = order
        full, times = np.unique(seen, return_counts=True)
        self.keys, self.pairs, self.hit, self.land, self.escape, self.down_land, self.down_escape = ([] for _ in range(7))
        below = None
        for k in range(order + 1):
            pair, at = np.unique(full & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(at, times, len(pair)).astype(np.int64)
            key, start = np.unique(pair >> 8, return_index=True)
            n = np.add.reduceat(count, start) if len(start) else count
            t = np.diff(np.append(start, len(pair)))
            if k:
                keep = n >= least
                on = np.repeat(keep, t)
                pair, count, key, n, t = pair[on], count[on], key[keep], n[keep], t[keep]
                start = np.cumsum(t) - t
            out = np.where(t < 256, t, 0)  # nothing is left to escape to
            self.keys.append(key), self.pairs.append(pair), self.hit.append(_log2(count))
            self.land.append(_log2(n + out)), self.escape.append(_log2(n + out) - _log2(out))
            if k:  # what is left one byte shorter, without the bytes that this context has
                up_key, up_pair, up_count, up_n, up_t = below
                up = np.searchsorted(up_key, key & ((1 << 8 * (k - 1)) - 1))
                same = up_count[np.searchsorted(up_pair, pair & ((1 << 8 * k) - 1))]
                left = up_n[up] - (np.add.reduceat(same, start) if len(start) else 0)
                out = np.where(up_t[up] < 256, up_t[up] - t, 0)
                self.down_land.append(_log2(left + out)), self.down_escape.append(_log2(left + out) - _log2(out))
            below = key, pair, count, n, t
        self.last = float(np.log2(max(1, 256 - len(self.pairs[0]))))

    def lengths(self, w: np.ndarray) -> np.ndarray:
        """Code lengths of windows, in whole 1 / UNIT bits."""
        cost, on, above = np.zeros(len(w)), np.arange(len(w)), np.full(len(w), -1)
        for k in range(self.order, -1, -1):
            pair = w[on] & ((1 << 8 * (k + 1)) - 1)
            keys, pairs = self.keys[k], self.pairs[k]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, pair >> 8), len(keys) - 1)
            held = keys[at] == pair >> 8
            spot = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            hit = held & (pairs[spot] == pair)
            fresh = above[on] < 0
            if k < self.order and len(self.down_land[k]):
                prev = np.maximum(above[on], 0)
                land, escape = np.where(fresh, self.land[k][at], self.down_land[k][prev]), np.where(fresh, self.escape[k][at], self.down_escape[k][prev])
            else:
                land, escape = self.land[k][at], self.escape[k][at]
            cost[on] += np.where(hit, land - self.hit[k][spot], np.where(held, escape, 0.0))
            above[on] = np.where(held, at, above[on])
            on = on[~hit]
        cost[on] += self.last
        return np.rint(cost * UNIT).astype(np.int64)


@dataclass(frozen=True)
class Model:
    matching: Matching
    trees: dict[str, Tree]  # by language, sorted


def sample(docs: DataFrame, learn: Column, matching: Matching, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, h, t): the rows that are learned from."""
    known = docs.where(F.coalesce(learn, F.lit(False)) & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    count = known.groupBy("lang").count()
    rows = max(1, min(matching.rows, matching.rows_of_all // max(1, count.count())))
    # a language gives some eight times its rows by hash, of which the smallest are taken
    share = count.select("lang", (F.lit(8.0 * rows * 2**32) / F.col("count")).alias("below"))  # a row for each language
    h = F.xxhash64("t")
    some = known.where(F.octet_length("t").between(1, matching.longest)).withColumn("h", h).join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(2**32)) < F.col("below"))
    one = some.groupBy("lang", "h").agg(F.min("t").alias("t"))
    by = W.partitionBy("lang").orderBy(F.pmod("h", F.lit(2**32)), "h")
    return one.withColumn("r", F.row_number().over(by)).where(F.col("r") <= rows).select("lang", "h", "t")


def fit(docs: DataFrame, learn: Column, matching: Matching = Matching(), text_col: str = "text", lang_col: str = "lang") -> Model:
    """A tree for each language in the rows for which `learn` holds."""
    taken = sample(docs, learn, matching, text_col, lang_col).toPandas().sort_values(["lang", "h"])  # rows_of_all rows of `longest` bytes at most
    pad = bytes(matching.order)
    seen = {lang: windows([pad + t.encode("utf-8") for t in own], matching.order) for lang, own in taken.groupby("lang")["t"]}
    return Model(matching, {lang: Tree(seen[lang], matching.order, matching.least) for lang in sorted(seen)})


def _pieces(texts: list[bytes], order: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Chunks of (text numbers, pieces with the bytes before them)."""
    own, held, size = [], [], 0
    for k, t in enumerate(texts):
        padded = bytes(order) + t
        for low in range(0, len(t), CHUNK):
            own.append(k), held.append(padded[low : low + CHUNK + order])
            size += len(held[-1])
            if size >= CHUNK:
                yield own, held
                own, held, size = [], [], 0
    if held:
        yield own, held


def code_lengths(texts: list[bytes], model: Model) -> np.ndarray:
    """(texts, languages) code lengths in whole 1 / UNIT bits."""
    out = np.zeros((len(texts), len(model.trees)), np.int64)
    order = model.matching.order
    for own, held in _pieces(texts, order):
        place, different = pd.factorize(windows(held, order))
        sizes = np.array([len(p) - order for p in held])
        starts = np.cumsum(sizes) - sizes
        for k, tree in enumerate(model.trees.values()):
            np.add.at(out[:, k], own, np.add.reduceat(tree.lengths(different)[place], starts))
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte), one row per document."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), t.alias("t"), t.rlike(r"\p{L}").alias("lettered"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(known.value.trees)
        for b in batches:
            lettered = np.asarray(b.column(2).to_pylist(), bool) if names else np.zeros(b.num_rows, bool)
            texts = [t.encode("utf-8") if on else b"" for t, on in zip(b.column(1).to_pylist(), lettered)]
            lang, score, rate = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
            if lettered.any():
                bits = code_lengths(texts, known.value)
                best, least = bits.argmin(1), bits.min(1)
                share = 1 / np.exp2(np.maximum((least[:, None] - bits) / UNIT, -1000.0)).sum(1)
                score[lettered] = share[lettered]
                rate = least / UNIT / np.maximum(1, [len(t) for t in texts])
                lang = [names[k] if on else UNKNOWN for k, on in zip(best, lettered)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, bits_per_byte double")


def digest(docs: DataFrame, matching: Matching = Matching()) -> DataFrame:
    """The contract's columns."""
    kept = remainder(F.col("doc_id"), 4)
    out = predict(docs, fit(docs, kept != 2, matching))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
