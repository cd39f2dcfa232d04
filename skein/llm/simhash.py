"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints come from whole texts. Distinct ones only are searched. Two that differ in at most `reach` of 64 bits agree on two of
`reach + 2` blocks of bits, so each is sent to one group per pair of blocks, with those blocks' bits in front. A group is sorted by Gray
rank, in which patterns with common leading bits stand together: a node of the index is a run with one leading pattern, and its children
have longer ones. Pairs of nodes are followed from the root down, and whole pairs of subtrees go as soon as their leading patterns differ
in more bits than `reach`, or all of both is known to be one component. What is left at the leaves is exact.

A group gives a spanning forest, never all its pairs. Components follow by alternating large and small stars over those links, each round
checkpointed. Nothing of the corpus passes through the driver.

Defined results: null text counts as empty; texts without words have fingerprint zero and are linked like any other; null ids get a row
and never name a component unless all its ids are null; ids may be of any type with an order; repeated rows share a component; very long
texts are read whole; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.tables import Scratch, cut, join_hot, one_of_each

PAIRS_AT_ONCE = 1_000_000
SHARD_ROWS = 20_000


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """Of the XXH64 values of all shingles, the bits that are set in over half."""
    import xxhash

    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts, (ends[-n:] - 1).tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        ones += np.unpackbits(h[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints of many sets at once: of each run of n hashes (n: one number a set), the bits that are set in over half."""
    some = np.flatnonzero(n)
    pieces = -(-n[some] // 255)  # of so many hashes, whose bits are counted in bytes
    first = np.cumsum(pieces) - pieces
    start = np.repeat(np.cumsum(n[some]) - n[some], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    ones = np.zeros((len(some), 64), np.int64)
    for k in range(8 if len(some) else 0):
        count = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), start)
        ones[:, k::8] = np.add.reduceat(count.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first)
    out = np.zeros(len(n), np.uint64)
    out[some] = np.packbits(ones * 2 > n[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long), one row per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def gray_rank(p: np.ndarray) -> np.ndarray:
    """The place of each pattern in Gray order."""
    p = p.copy()
    for k in (1, 2, 4, 8, 16, 32):
        p ^= p >> np.uint64(k)
    return p


class Forest:
    """Components of places 0..n-1, of which neighbouring ones may be linked at the start."""

    def __init__(self, linked: np.ndarray):
        self.run = np.concatenate([[0], np.cumsum(~linked)]).astype(np.int64)
        self.root = np.arange(self.run[-1] + 1)
        self._index()

    def _index(self) -> None:
        while (self.root != self.root[self.root]).any():
            self.root = self.root[self.root]
        self.changes = np.concatenate([[0], np.cumsum(self.root[1:] != self.root[:-1])])

    def link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs joined two components."""
        a, b = self.root[self.run[i]], self.root[self.run[j]]
        _, first = np.unique(np.minimum(a, b) * len(self.root) + np.maximum(a, b), return_index=True)
        used, up = [], self.root.tolist() if len(first) > 64 else self.root
        for k in first[a[first] != b[first]].tolist():
            x, y = a[k], b[k]
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                used.append(k)
        if used:
            self.root = np.asarray(up)
            self._index()
        return np.array(used, np.int64)

    def together(self, u: np.ndarray, u_end: np.ndarray, v: np.ndarray, v_end: np.ndarray) -> np.ndarray:
        """Whether all of u..u_end and v..v_end is one component."""
        one = lambda s, e: self.changes[self.run[s]] == self.changes[self.run[e - 1]]
        return one(u, u_end) & one(v, v_end) & (self.root[self.run[u]] == self.root[self.run[v]])


def forest_links(p: np.ndarray, key_bits: int, reach: int, step: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of p (distinct patterns, their group in the first key_bits) that span the components within each group."""
    p = p[np.argsort(gray_rank(p))]
    if len(p) < 2:
        return p[:0], p[:0]
    lengths = [*range(key_bits, 64, step), 64]
    heads = [p >> np.uint64(64 - n) for n in lengths]
    starts = [np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) for h in heads]
    ends = [np.append(s[1:], len(p)) for s in starts]
    near = (np.bitwise_count(p[1:] ^ p[:-1]) <= reach) & (heads[0][1:] == heads[0][:-1])
    forest = Forest(near)
    out = [(np.flatnonzero(near), np.flatnonzero(near) + 1)]
    groups = np.flatnonzero(ends[0] - starts[0] > 1)
    stack = [(0, groups, groups)]
    while stack:
        level, u, v = stack.pop()
        if level == len(lengths) - 1:
            i, j = starts[level][u], starts[level][v]
            k = forest.link(i, j)
            out.append((i[k], j[k]))
            continue
        s, e = starts[level], ends[level]
        open_ = ~forest.together(s[u], e[u], s[v], e[v])
        u, v = u[open_], v[open_]
        if not len(u):
            continue
        first = lambda x: np.searchsorted(starts[level + 1], s[x])
        last = lambda x: np.searchsorted(starts[level + 1], e[x] - 1, "right")
        u0, v0, v1 = first(u), first(v), last(v)
        n_u, n_v = last(u) - u0, v1 - v0
        total = np.cumsum(n_u * n_v)
        if total[-1] > PAIRS_AT_ONCE and len(u) > 1:
            cut_at = max(1, int(np.searchsorted(total, total[-1] // 2)))
            stack += [(level, u[cut_at:], v[cut_at:]), (level, u[:cut_at], v[:cut_at])]
            continue
        rows = np.repeat(np.arange(len(u)), n_u)
        child = np.arange(len(rows)) - np.repeat(np.cumsum(n_u) - n_u, n_u) + u0[rows]  # children of u, one row each
        per = max(1, PAIRS_AT_ONCE // max(1, int(n_v.max())))
        for k in range(0, len(rows), per):
            r, c = rows[k : k + per], child[k : k + per]
            width = n_v[r]
            left = np.repeat(c, width)
            right = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(v0[r], width)
            ok = np.repeat(u[r] != v[r], width) | (left < right) | ((left == right) & (ends[level + 1][left] - starts[level + 1][left] > 1))
            left, right = left[ok], right[ok]
            h = heads[level + 1]
            ok = np.bitwise_count(h[starts[level + 1][left]] ^ h[starts[level + 1][right]]) <= reach
            if ok.any():
                stack.append((level + 1, left[ok], right[ok]))
    i, j = (np.concatenate(x) for x in zip(*out))
    return p[i], p[j]


def fold(fp: np.ndarray, blocks: list[tuple[int, int]], chosen: tuple[int, ...]) -> np.ndarray:
    """fp with the chosen blocks' bits in front; blocks: (shift, bits)."""
    out = np.zeros_like(fp)
    for k in (*chosen, *(k for k in range(len(blocks)) if k not in chosen)):
        shift, n = blocks[k]
        out = (out << np.uint64(n)) | ((fp >> np.uint64(shift)) & np.uint64((1 << n) - 1))
    return out


def unfold(p: np.ndarray, blocks: list[tuple[int, int]], chosen: tuple[int, ...]) -> np.ndarray:
    out = np.zeros_like(p)
    for k in reversed((*chosen, *(k for k in range(len(blocks)) if k not in chosen))):
        shift, n = blocks[k]
        out |= (p & np.uint64((1 << n) - 1)) << np.uint64(shift)
        p = p >> np.uint64(n)
    return out


def links(distinct: DataFrame, reach: int = 4) -> DataFrame:
    """(a, b): links that span the components of the distinct fingerprints in column fp."""
    n = reach + 2
    sizes = [64 // n + (k < 64 % n) for k in range(n)]
    blocks = [(sum(sizes[:k]), s) for k, s in enumerate(sizes)]
    choices = list(combinations(range(n), 2))
    # groups are dealt to shards by a hash of the chosen blocks' bits
    key = lambda c: F.struct(*[F.shiftrightunsigned("fp", blocks[k][0]).bitwiseAND((1 << blocks[k][1]) - 1) for k in c])
    sent = F.array(*[F.struct(F.lit(i).alias("choice"), F.xxhash64(F.lit(i), key(c)).alias("group")) for i, c in enumerate(choices)])
    shards = max(64, distinct.count() * len(choices) // SHARD_ROWS)
    sent = distinct.select("fp", F.explode(sent).alias("x")).select("fp", "x.choice", F.pmod(F.col("x.group"), F.lit(shards)).alias("shard"))

    def run(table: pa.Table) -> pa.Table:
        choice, fp = table.column("choice").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        out = [(np.empty(0, np.uint64), np.empty(0, np.uint64))]
        for c in np.unique(choice):
            bits = sum(blocks[k][1] for k in choices[c])
            p = fold(fp[choice == c], blocks, choices[c])
            out.append(tuple(unfold(x, blocks, choices[c]) for x in forest_links(p, bits, reach)))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
        return pa.table({"a": a, "b": b})

    return sent.groupBy("shard").applyInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root: the smallest node of the component."""
    ordered = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    scratch = Scratch(edges.sparkSession)
    edges = scratch.put("0", ordered(edges))
    before = state(edges)
    for k in range(rounds):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ordered(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = scratch.put(f"{k + 1}", ordered(small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))))
        scratch.drop(f"{k}")
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())


def near_duplicates(docs: DataFrame, reach: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), one row per input row."""
    fps = cut(fingerprints(docs, width, id_col, text_col))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    # fingerprints are named after their smallest document, those without any last, so that a component's root names it
    named = lambda end: distinct.select(F.col("fp").alias(end), F.struct(F.col("low").isNull().alias("without"), "low", "fp").alias(f"{end}_named"))
    edges = links(distinct.select("fp"), reach).join(named("a"), "a").join(named("b"), "b").select(F.col("a_named").alias("a"), F.col("b_named").alias("b"))
    found = components(edges).select(F.col("node.fp").alias("fp"), F.col("root.low").alias("component_id"))
    ids = cut(distinct.join(found, "fp", "left").select("fp", "n", F.coalesce("component_id", "low").alias("component_id")))
    return join_hot(fps, ids, "fp", "n").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, reach: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row per component: the one whose id names it. Rows with null ids stay; of rows with one id the smallest text stays."""
    lead = near_duplicates(docs, reach, width, id_col, text_col).where("doc_id = component_id").select("doc_id").distinct()
    return one_of_each(docs, lead, id_col, text_col)
