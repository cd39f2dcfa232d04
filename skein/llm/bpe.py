"""Byte-level BPE, encoding and decoding, by contiguous rank arrays.

Words of one length form a matrix: a row holds the ids between a word's part boundaries and, beside it, the merge rank of each adjacent
pair. Each round scans every row for its minimum (the leftmost on ties), replaces the pair by its merge, deletes the boundary and
refreshes the two neighbouring ranks. Words longer than SHORT bytes use the same rule with a heap. Each worker keeps a bounded table of
words that it has merged. One pass over the rows, no shuffle; a batch is handled in pieces of bounded size.

Defined results: null text encodes as empty (no ids); null ids stay null; repeated rows get equal results, one each; other columns are
not read; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 48
KEEP = 300_000  # words in a worker's table
PIECE = 4_000_000  # characters handled at once
NONE = np.int32(2**31 - 1)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Merges:
    """A vocabulary's tables, and the words merged so far."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        byte = {c: b for b, c in letter.items()}
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = {i: bytes(byte[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.of_byte = np.array([vocab[letter[b]] for b in range(256)], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        self.pair = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        key = np.array([a << 32 | b for a, b in self.pair], np.int64)
        order = np.argsort(key)
        self.key, value = key[order], np.array(list(self.pair.values()), np.int32)[order]
        self.rank, self.merged = value[:, 0], value[:, 1]
        self.words: dict[str, tuple[int, ...]] = {}
        self.findall = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.rank[at], NONE)

    def merge_short(self, rows: np.ndarray) -> list[tuple[int, ...]]:
        """rows: (words, n) bytes."""
        ids, done = self.of_byte[rows], [()] * len(rows)
        rank, own = self.ranks(ids[:, :-1], ids[:, 1:]), np.arange(len(rows))
        while len(own):
            n = ids.shape[1]
            if n > 1:
                at = rank.argmin(1)
                go = rank[np.arange(len(own)), at] < NONE
            else:
                at, go = np.zeros(len(own), int), np.zeros(len(own), bool)
            for k, x in zip(own[~go].tolist(), ids[~go].tolist()):
                done[k] = tuple(x)
            own, ids, rank, at = own[go], ids[go], rank[go], at[go]
            if not len(own):
                break
            row = np.arange(len(own))
            pair = ids[row, at].astype(np.int64) << 32 | ids[row, at + 1]
            ids[row, at] = self.merged[np.searchsorted(self.key, pair)]
            cols = np.arange(n - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            if n == 2:
                rank = rank[:, :0]
                continue
            cols = np.arange(n - 2)
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), 1)
            left = at > 0
            rank[row[left], at[left] - 1] = self.ranks(ids[row[left], at[left] - 1], ids[row[left], at[left]])
            right = at < n - 2
            rank[row[right], at[right]] = self.ranks(ids[row[right], at[right]], ids[row[right], at[right] + 1])
        return done

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.pair[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pair]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else len(ids)
            if j >= len(ids) or (ids[i], ids[j]) != p:
                continue
            ids[i], ids[j], after[i] = self.pair[p][1], None, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (q := (ids[a], ids[b])) in self.pair:
                    heapq.heappush(heap, (self.pair[q][0], a, q))
        return tuple(x for x in ids if x is not None)

    def learn(self, new: set[str]) -> None:
        if len(self.words) + len(new) > KEEP:
            self.words.clear()
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            b = w.encode("utf-8")
            by_size.setdefault(len(b), []).append((w, b))
        for n, group in by_size.items():
            for k in range(0, len(group), 50_000):
                some = group[k : k + 50_000]
                found = [self.merge_long(b) for _, b in some] if n > SHORT else self.merge_short(np.frombuffer(b"".join(b for _, b in some), np.uint8).reshape(-1, n))
                self.words.update(zip((w for w, _ in some), found))

    def pieces(self, text: str) -> list[str]:
        if not any(x in text for x in self.special):
            return self.findall(text)
        return [w for x in self.split(text) if x for w in ([x] if x in self.special else self.findall(x))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pieces(t) for t in texts]
        new = set(chain.from_iterable(split))
        special = {w: (self.special[w],) for w in self.special}
        self.learn({w for w in new if w not in special} if len(self.words) + len(new) > KEEP else {w for w in new if w not in self.words and w not in special})
        self.words.update(special)
        return [np.fromiter(chain.from_iterable(map(self.words.__getitem__, s)), np.int32) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    """Once a worker."""
    return Merges(path)


def _batches(columns: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in columns:
        texts, start, size = batch.column(1).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= PIECE or i == len(texts) - 1:
                yield batch.column(0).slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>), one row per input row; with `decoded` also the text that the ids decode to.

    path: a tokenizer file that executors can read at the same place.
    """
    path = path or vocabulary_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(path)
        for keys, texts in _batches(batches):
            ids = m.encode(texts)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            out = [keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))]
            names = ["doc_id", "ids"]
            if decoded:
                out.append(pa.array([m.decode(x) for x in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns."""
    return encode(docs, path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
