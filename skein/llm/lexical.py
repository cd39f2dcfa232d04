"""Ranked lexical search with integer scores, by the threshold algorithm over impact-sorted lists.

Documents are read once into a forward index that holds only the terms that items ask for. Its partitions are cut into shards of bounded size,
within the task that reads them. In a shard, every term has a list of its documents by falling impact; an item's lists are read in turns,
each new document is looked up in the forward index for its whole score, and reading ends once the sum of the impacts at the reading
positions falls strictly below the k-th best score. (Turns are taken by growing steps, so a few more entries are read than by single ones; a
task's later shards start with the k-th score of its earlier ones.) The best k of each shard merge to the best k of all. Documents are
never shuffled; items whose terms outgrow `terms` are searched in blocks, a pass over the documents each.

Defined results: null and empty texts have no terms and are not found; an item without terms finds nothing; items that share an id are one
item with all their terms, and a null id is an id; rows of documents are documents each, so repeated rows are found each; equal scores go by
ascending doc_id, nulls last; very long texts are read whole, a piece at a time; other columns are not read; empty tables give empty tables.
A score's steps stay in 64 bits as long as 90 * (terms of a document) * (number of documents) does.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.tables import cut

PIECE = 1 << 20


@dataclass(frozen=True)
class Ranking:
    k: int = 10
    rows: int = 65_536  # documents of a shard at most
    postings: int = 4_000_000  # and entries, one document more
    terms: int = 500_000  # (item, term) pairs of a block of items, about


def _folded() -> bytes:
    """A space for every byte that no term has; capitals of ASCII lower-cased."""
    term = lambda b: b >= 128 or chr(b).isalnum()
    return bytes((b + 32 if 65 <= b <= 90 else b) if term(b) else 32 for b in range(256))


FOLDED = _folded()


def term_pieces(text: str | None) -> Iterator[list[bytes]]:
    """The text's terms, in lists of about PIECE bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(FOLDED)
    low = 0
    while low < len(raw):
        high = raw.find(b" ", low + PIECE)
        high = len(raw) if high < 0 else high
        yield raw[low:high].split()
        low = high


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term), once each."""
    kind = dict(items.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(b.column(1).to_pylist()):
                terms = sorted(set().union(*term_pieces(text)))
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k]] * len(terms), b.column(0).type), pa.array(terms, pa.binary())], names=["item", "term"])

    return items.select(F.col(id_col).alias("item"), F.col(text_col).alias("t")).mapInArrow(run, f"item {kind}, term binary").distinct()


def forward_index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): of every document with a term its number of terms, and the vocabulary's terms in it by number."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(known.value)}.get
        for b in batches:
            n, terms, tfs = [], [], []
            for text in b.column(1):
                held: Counter = Counter()
                for piece in term_pieces(text.as_py()):
                    held.update(map(number, piece))
                n.append(held.total())
                held.pop(None, None)
                terms.append(sorted(held))
                tfs.append([held[t] for t in terms[-1]])
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pc.greater(out.column(1), 0))

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def statistics(forward: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, their terms with repeats, documents of each term), over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            docs, length = docs + b.num_rows, length + (pc.sum(b.column(0)).as_py() or 0)
            df += np.bincount(np.asarray(b.column(1).flatten()), minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], held])), pa.array(np.concatenate([[docs, length], df[held]]))], names=["term", "n"])

    got = dict(forward.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # the block's terms
    return got.get(-2, 0), got.get(-1, 0), np.array([got.get(t, 0) for t in range(n_terms)], np.int64)


class Shard:
    """A few documents' forward index and impact-sorted lists. Documents are numbered by ascending id."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, docs: int, length: int):
        self.rows = len(n)
        doc = np.repeat(np.arange(self.rows), sizes)
        m = 10 + 90 * n * docs // max(length, 1)
        self.term, self.impact = terms, weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[doc]))
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        order = np.lexsort((doc, -self.impact, terms))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.lists = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.seen = np.zeros(self.rows, bool)
        self.asked = np.zeros(len(weights), bool)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores, from the forward index, for the terms marked as asked."""
        low, size = self.start[docs], self.start[docs + 1] - self.start[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(low - ends + size, size)
        return np.add.reduceat(np.where(self.asked[self.term[at]], self.impact[at], 0), ends - size)

    def best(self, terms: np.ndarray, k: int, floor: int, step: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, entries read) of the best k, highest first; those below floor may be missing. Scores are above 0."""
        low, high = self.lists[terms], self.lists[terms + 1]
        low, high = low[high > low], high[high > low]
        top_doc, top = np.zeros(0, np.int64), np.zeros(0, np.int64)
        touched, read = [], 0
        self.asked[terms] = True
        while len(low):
            upto = np.minimum(low + step, high)
            size = upto - low
            ends = np.cumsum(size)
            read += int(ends[-1])
            found = np.unique(self.list_doc[np.arange(ends[-1]) + np.repeat(low - ends + size, size)])
            found = found[~self.seen[found]]
            if len(found):
                self.seen[found] = True
                touched.append(found)
                top_doc, top = np.concatenate([top_doc, found]), np.concatenate([top, self.scores(found)])
                rank = np.lexsort((top_doc, -top))[:k]
                top_doc, top = top_doc[rank], top[rank]
            bound = self.list_impact[upto - 1][upto < high].sum()
            if bound < max(floor, top[-1] if len(top) == k else 0, 1):
                break
            low, high, step = upto[upto < high], high[upto < high], 2 * step
        self.asked[terms] = False
        for t in touched:
            self.seen[t] = False
        keep = (top >= floor) & (top > 0)
        return top_doc[keep], top[keep], read


def _shards(batches: Iterator[pa.RecordBatch], ranking: Ranking) -> Iterator[pa.Table]:
    held, rows, postings = [], 0, 0
    for b in batches:
        sizes = np.cumsum(np.diff(np.asarray(b.column(2).offsets)))
        low = 0
        while low < b.num_rows:
            before = sizes[low - 1] if low else 0
            high = min(low + ranking.rows - rows, int(np.searchsorted(sizes, before + ranking.postings - postings)) + 1, b.num_rows)
            held.append(b.slice(low, high - low))
            rows, postings = rows + high - low, postings + int(sizes[high - 1] - before)
            if rows >= ranking.rows or postings >= ranking.postings:
                yield pa.Table.from_batches(held)
                held, rows, postings = [], 0, 0
            low = high
    if held:
        yield pa.Table.from_batches(held)


def _ranked(forward: DataFrame, items: list[np.ndarray], n_terms: int, ranking: Ranking) -> DataFrame:
    """(item_no, doc_id, score): the best k of each shard."""
    docs, length, df = statistics(forward, n_terms)
    weights = np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)
    known = forward.sparkSession.sparkContext.broadcast((items, weights))
    k, kind = ranking.k, dict(forward.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = known.value
        best = np.zeros((len(items), k), np.int64)  # of the task so far, falling
        for t in _shards(batches, ranking):
            t = t.take(pc.sort_indices(t.select(["doc_id"]), [("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
            n, terms, tfs = (t.column(c).combine_chunks() for c in ("n", "terms", "tfs"))
            shard = Shard(np.asarray(n), np.diff(np.asarray(terms.offsets)), np.asarray(terms.flatten()), np.asarray(tfs.flatten()).astype(np.int64), weights, docs, length)
            no, doc, score = [], [], []
            for q, asked in enumerate(items):
                d, s, _ = shard.best(asked, k, int(best[q, -1]))
                no.append(np.full(len(d), q)), doc.append(d), score.append(s)
                best[q] = -np.sort(-np.concatenate([best[q], s]))[:k]
            ids = t.column("doc_id").combine_chunks()
            no, doc, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (no, doc, score))
            yield pa.RecordBatch.from_arrays([pa.array(no), ids.take(pa.array(doc)), pa.array(score)], names=["item_no", "doc_id", "score"])

    return forward.mapInArrow(run, f"item_no long, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, ranking: Ranking = Ranking(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents."""
    spark = docs.sparkSession
    asked = cut(item_terms(items, item_col, item_text))
    blocks = max(1, -(-asked.count() // ranking.terms))
    kinds = dict(asked.dtypes)["item"], dict(docs.dtypes)[id_col]
    parts = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # about `terms` rows
        names = sorted({r["item"] for r in own}, key=lambda x: (x is None, x))
        vocabulary = sorted({bytes(r["term"]) for r in own})
        number, terms = {t: k for k, t in enumerate(vocabulary)}, {x: [] for x in names}
        for r in own:
            terms[r["item"]].append(number[bytes(r["term"])])
        forward = cut(forward_index(docs, vocabulary, id_col, text_col))
        found = _ranked(forward, [np.array(sorted(terms[x]), np.int64) for x in names], len(vocabulary), ranking)
        by = W.partitionBy("item_no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= ranking.k)
        named = spark.createDataFrame(list(enumerate(names)), f"item_no long, item_id {kinds[0]}")  # the block's items
        parts.append(found.join(F.broadcast(named), "item_no").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.union, parts)
