"""Substring dedup: windows of words that an earlier document has go, found with a count-min prefilter.

Documents are taken in buckets, pieces of partitions. A bucket hashes its windows and sends the cells that they fall into, for each row of a
count-min sketch, up a tree of ranges (exchange.py); merged over all buckets, it answers each cell with whether its estimate is two or more.
Estimates never fall short, so a window found in two documents always passes. In the second pass only passing windows travel, with 96 bits of
hash and the bucket's smallest id; the tree groups them exactly and answers whether a smaller id has the window.

The sketch's width follows the corpus and is held in ranges, so it neither saturates nor outgrows a task; answers are bits, and nothing is
broadcast or collected but the corpus's length. A window that a third of all documents share is one entry a bucket. Words are told apart by 64
bits of hash, windows by 96. Buckets are shuffled packed, once for each pass.

Defined results: null text has no words; a document with a null id keeps all its words and takes none from others; rows with equal ids
take nothing from each other; ids that are no whole numbers are a TypeError; texts under a window keep all words; a very long text is a bucket
of its own; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from skein.llm import exchange as X

BUCKET_BYTES = 8_000_000
PIECE_BYTES = 2_000_000
DEPTH = 2
LONG_WORD = 256
#: Odd multipliers of the polynomial hashes.
BYTE_BASE, WINDOW_BASES = 0x9E3779B97F4A7C15, (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x + U(0x9E3779B97F4A7C15 * (salt + 1) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BYTE_BASE to the powers 0..n-1 and -0..-(n-1), modulo 2**64."""
    out = []
    for base in (BYTE_BASE, pow(BYTE_BASE, -1, 2**64)):
        x = np.full(n, base, U)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, words of each text)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACE[buf]
    edge = np.diff(space.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    if len(ends) > len(starts):
        ends = ends[1:]
    up, down = powers(1 << (len(buf) - 1).bit_length())
    total = np.concatenate([np.zeros(1, U), np.cumsum(buf * up[: len(buf)])])
    h = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U)
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        import xxhash

        h[k] = xxhash.xxh64_intdigest(buf[starts[k] : ends[k]].tobytes(), 1)
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return mix(h), np.diff(np.searchsorted(starts, stops), prepend=0)


class Bucket:
    """The windows of a list of texts: hash, document (a place in the list) and first word (among all words)."""

    def __init__(self, texts: list[bytes], size: int):
        words, counts, piece, held = [], [], [], 0
        for t in [*texts, None]:
            if t is None or held + len(t) > PIECE_BYTES and piece:
                if piece:
                    w, c = word_hashes(piece)
                    words.append(w)
                    counts.append(c)
                piece, held = [], 0
            if t is not None:
                piece.append(t)
                held += len(t)
        w = np.concatenate([*words, np.empty(0, U)])
        self.n_words = np.concatenate([*counts, np.empty(0, np.int64)]).astype(np.int64)
        self.first_word = np.cumsum(self.n_words) - self.n_words
        doc = np.repeat(np.arange(len(texts)), self.n_words)
        n = max(0, len(w) - size + 1)
        whole = doc[:n] == doc[size - 1 :] if n else np.zeros(0, bool)
        self.word = np.flatnonzero(whole)
        self.doc = doc[self.word]
        both = []
        for base in WINDOW_BASES:
            acc = np.zeros(n, U)
            for k in range(size):
                acc = acc * U(base) + w[k : k + n]
            both.append(mix(acc[self.word]))
        self.h, self.more = both[0], (both[1] >> U(32)).astype(np.uint32)

    def keep(self, mask: np.ndarray) -> None:
        self.word, self.doc, self.h, self.more = self.word[mask], self.doc[mask], self.h[mask], self.more[mask]


def cells(h: np.ndarray, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct cells of a sketch row in order, the cell number of each window among them)."""
    return np.unique(mix(h, row + 1) >> U(64 - bits), return_inverse=True)


class Cells(X.Scheme):
    """Cells of a sketch row with the documents that fell into each, up to two; the answer is whether all buckets together have two."""

    values = (np.uint8,)
    answers = (np.uint8,)

    def __init__(self, bits: int):
        self.bits = bits

    def merge(self, values, heads):
        return [np.minimum(np.add.reduceat(values[0].astype(np.int64), heads), 2).astype(np.uint8)]

    def top(self, keys, values):
        return [(values[0] > 1).astype(np.uint8)]


class Windows(X.Scheme):
    """96 bits of windows' hashes with the smallest id that has each; the answer is whether a smaller one has it."""

    more = (np.uint32,)
    values = (np.int64,)
    answers = (np.uint8,)

    def merge(self, values, heads):
        return [np.minimum.reduceat(values[0], heads)]

    def top(self, keys, values):
        return [np.zeros(len(keys[0]), np.uint8)]

    def child(self, answers, own, merged):
        return [answers[0] | (own[0] > merged[0])]


def remove_repeats(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept holds the words that stay, joined by a space. Ids are whole numbers."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"ids must be whole numbers, as the smallest one keeps a window; {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    parts = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("t")).alias("n"))
    sized = parts.agg(F.sum("n").alias("octets"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_BYTES))).alias("buckets")).first()
    octets, buckets = sized["octets"] or 1, int(sized["buckets"] or 1)
    cell_bits = max(12, ceil(log2(buckets)), ceil(log2(octets)))  # several cells for each window
    sketched, exact = X.Tree(buckets, [Cells(cell_bits)] * DEPTH), X.Tree(buckets, [Windows()])

    def load(blob: bytes) -> tuple[Bucket, np.ndarray, pa.Table]:
        """Windows of documents with an id, which are in the order of ids."""
        left = X.thaw(blob)
        ids = left.column("doc_id")
        b = Bucket(left.column("t").cast(pa.binary()).to_pylist(), size)
        named = np.asarray(ids.is_valid())
        b.keep(named[b.doc])
        return b, np.asarray(ids.fill_null(0)), left

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell counts documents, one or more; windows of one document count once."""
        for bucket, left in X.bucketed(batches, "t", BUCKET_BYTES):
            blob = X.freeze(left.sort_by("doc_id"))
            b, ids, _ = load(blob)
            key = _once(b.h, ids[b.doc])
            out = [sketched.keep(bucket, [blob])]
            for row in range(DEPTH):
                cell, inverse = cells(key, row, cell_bits)
                out += sketched.send(bucket, row, [cell], [np.minimum(np.bincount(inverse, minlength=len(cell)), 2).astype(np.uint8)])
            yield from X.table(out, X.UP).to_batches()

    def send(left: pa.Table, said: pa.Table) -> pa.Table:
        """Windows whose estimate is two or more in every row."""
        if not said.num_rows:  # a node
            return X.table([], X.UP)
        ((blob,),), bucket = X.kept(left), left.column("child")[0].as_py()
        b, ids, _ = load(blob)
        mask = np.ones(len(b.h), bool)
        for row in range(DEPTH):
            (twice,), _ = sketched.read(said, row)
            if len(b.h):
                mask &= twice[cells(b.h, row, cell_bits)[1]] > 0
        b.keep(mask)
        first = _firsts(b.h, b.more)  # in order of ids: the first has the smallest
        return X.table([exact.keep(bucket, [blob, X.pack_bits(mask)]), *exact.send(bucket, 0, [b.h[first], b.more[first]], [ids[b.doc[first]]])], X.UP)

    def apply(left: pa.Table, said: pa.Table) -> pa.Table:
        if not said.num_rows:
            return X.table([], out_schema)
        ((blob, mask),) = X.kept(left)
        b, ids, left = load(blob)
        b.keep(X.unpack_bits(mask))
        first = _firsts(b.h, b.more)
        (elsewhere,), _ = exact.read(said, 0)
        entry = _entry(b.h, b.more, first)
        gone = (elsewhere[entry] > 0) | (ids[b.doc] > ids[b.doc[first]][entry]) if len(first) else np.zeros(0, bool)
        marks = np.zeros(int(b.n_words.sum()) + size + 1, np.int32)
        marks += np.bincount(b.word[gone], minlength=len(marks)).astype(np.int32)
        marks -= np.bincount(b.word[gone] + size, minlength=len(marks)).astype(np.int32)
        stays = np.cumsum(marks) == 0
        out = []
        for i, (name, t) in enumerate(zip(left.column("doc_id").to_pylist(), left.column("t").cast(pa.binary()).to_pylist())):
            own = stays[b.first_word[i] : b.first_word[i] + b.n_words[i]]
            words, n = t.split(), int(own.sum())
            out.append((name, len(words), len(words) - n, b" ".join(words if n == len(words) else compress(words, own)).decode("utf-8")))
        return X.table(out, out_schema)

    out_schema = "doc_id long, n_words long, n_removed long, kept string"
    sent = rows.mapInArrow(sketch, X.UP)
    passed = sent.groupBy("to").cogroup(X.of_buckets(sketched.totals(sent)).groupBy("to")).applyInArrow(send, X.UP)
    return passed.groupBy("to").cogroup(X.of_buckets(exact.totals(passed)).groupBy("to")).applyInArrow(apply, out_schema)


def _once(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """h without repeats in one document; documents are in order."""
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    return h[np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])] if len(h) else h


def _firsts(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Places of the first window of each kind, in order of (h, more)."""
    order = np.lexsort((more, h))  # stable
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (more[order][1:] != more[order][:-1])]) if len(h) else np.zeros(0, bool)
    return order[new]


def _entry(h: np.ndarray, more: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The number of each window's kind among `first`."""
    order = np.lexsort((more, h))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (more[order][1:] != more[order][:-1])]) if len(h) else np.zeros(0, bool)
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
