"""Near copies: documents whose sets of word shingles have a Jaccard similarity of `like` or more, by SimHash and an exact completion.

Every set has a SimHash fingerprint of its shingles. Those that differ in at most `reach` bits are found by the hierarchical index in Gray
order (simhash.links), and the pairs that it gives are held against the whole sets: those at or above `like` are the first links. Of sets at
0.8 the fingerprints differ in about ten of 64 bits, and no index within some bits finds all of them, so what the fingerprints leave apart is
completed exactly, by a prefix filter, among sets that are not in one component yet.

All shingles have one global order: seldom ones first, by a sketch of their counts, then by hash. Two sets can have similarity `like` only
if their first `n - ceil(like * n) + 1` shingles in that order have one in common (prefix filter), so those are sent, packed, to shards.
At the first that two sets have in common, what is left in both must make up the overlap (positional filter).
The sketch only decides the order: results are the same under any. The sets that share a shingle are a group, in the order of their names,
which are hashes. While many pairs are in different components, its first set, the hub, is compared with all others outside its component;
then the next few, four times as many each turn, with all behind them; what is then left in several components is compared pair by pair.
No pair is compared twice in a group. Every comparison counts the whole sets, so each pair at or above `like` ends in one component, and no
pair below it is a link. Sets are of 64-bit hashes.

Defined results: texts are lower-cased (A-Z) and split at ASCII spaces; one of fewer words than a shingle is one shingle; null text counts
as empty, and texts without words are copies of each other; rows with null ids are left alone; rows of one id are linked by their own texts;
very long texts are whole sets like others; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.exchange import bucketed, freeze, pack, thaw, unpack
from skein.llm.simhash import components, links, majority
from skein.llm.substring import WINDOW_BASES, mix, word_hashes
from skein.llm.tables import Scratch, cut, join_hot, one_of_each

U = np.uint64
CELL_BITS, RANGES, FAN_IN = 21, 32, 32
PIECE = 2_000_000  # bytes hashed at once
HELD = 1_000_000  # places sent at once
SHARD_BYTES = 24_000_000
DEALT_BYTES, TEXT_BYTES, WORD_BYTES = 32_000_000, 48_000_000, 8  # of a partition dealt at once; of a shard of texts; of a word, about
PAIRS_AT_ONCE = 1_000_000
PAIRS_A_ROW, MORE_HUBS = 1, 4
BITS = 26  # 8 MB at most


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, lower-cased texts) of up to PIECE bytes."""
    first, held, size = 0, [], 0
    for i, t in enumerate(column):
        held.append((t.as_py() or "").encode("utf-8").lower())
        size += len(held[-1])
        if size >= PIECE or i == len(column) - 1:
            yield first, held
            first, held, size = i + 1, [], 0


def shingles(texts: list[bytes], width: int, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts, shingles of each text); if distinct, sorted within a text."""
    w, n = word_hashes(texts)
    n = n.astype(np.int64)
    many = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), many)
    start = np.arange(len(doc)) + np.repeat((np.cumsum(n) - n) - (np.cumsum(many) - many), many)
    size, h = n[doc], np.zeros(len(doc), U)
    w = np.concatenate([w, np.zeros(width, U)])
    for k in range(width):
        h = np.where(k < size, h * U(WINDOW_BASES[0]) + w[start + k], h)
    h = mix(h)
    if distinct:
        put = np.lexsort((h, doc))
        h, doc = h[put], doc[put]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(texts))


def _nodes(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A name for each set; equal sets have equal names."""
    import xxhash

    ends = np.cumsum(n)
    return np.array([xxhash.xxh64_intdigest(h[e - k : e].tobytes()) for e, k in zip(ends.tolist(), n.tolist())], U).view(np.int64)


def commonness(texts: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """(half octaves of the shingles' counts by cell of a sketch, shingles in all). texts: one column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for b in batches:
            for _, t in _pieces(b.column(0)):
                cells += np.bincount((shingles(t, width, False)[0] >> U(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
        if cells.any():
            part = TaskContext.get().partitionId() // FAN_IN
            yield _batch([(r, part, pack(x)) for r, x in enumerate(cells.reshape(RANGES, -1))])

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack(x.as_py(), np.int64) for x in table.column("a"))
        return pa.Table.from_batches([_batch([(table.column("r")[0].as_py(), 0, pack(total))])])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        r, part, a = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(part, pa.int32()), pa.array(a, pa.binary())], names=["r", "part", "a"])

    kind = "r int, part int, a binary"
    out, total = np.zeros((RANGES, (1 << CELL_BITS) // RANGES), np.int64), 0
    for row in texts.mapInArrow(count, kind).groupBy("r", "part").applyInArrow(add, kind).groupBy("r").applyInArrow(add, kind).collect():  # a row a range
        out[row["r"]] = unpack(row["a"], np.int64)
    total = int(out.sum())
    return (2 * np.log2(out.ravel() + 1.0)).astype(np.uint8), total


def _names(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, node, fp, text): the name and the fingerprint of the set of each row of rows (doc_id, t), and a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in _pieces(b.column(1)):
                h, n = shingles(texts, width)
                columns = [b.column(0).slice(first, len(n)), pa.array(_nodes(h, n)), pa.array(majority(h, n).view(np.int64)), b.column(2).slice(first, len(n))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "fp", "text"])

    return rows.withColumn("text", F.xxhash64("t")).mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, node long, fp long, text long")


def fingerprint_pairs(named: DataFrame, reach: int) -> DataFrame:
    """(a, b): pairs of sets, of named (node, fp), that span the components of fingerprints which differ in at most `reach` bits."""
    heads = cut(named.groupBy("fp").agg(F.min("node").alias("head")))
    of = lambda end: heads.select(F.col("fp").alias(f"fp_{end}"), F.col("head").alias(end))
    near = links(heads.select("fp"), reach).withColumnsRenamed({"a": "fp_a", "b": "fp_b"}).join(of("a"), "fp_a").join(of("b"), "fp_b").select("a", "b")
    same = named.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return near.union(same)


def _sets(rows: DataFrame, wanted: DataFrame, width: int, shards: int) -> DataFrame:
    """(node, h): the sets of wanted (node, text), each from one of the rows (t) with that hash of the text."""
    shard = lambda c: F.pmod(F.col(c), F.lit(shards)).cast("int").alias("shard")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as packed pieces, one for each shard that some of them go to; equal ones of a piece of a partition once."""
        for _, t in bucketed(batches, "t", DEALT_BYTES):
            t = t.take(np.unique(t.column("text").to_numpy(), return_index=True)[1])
            to = t.column("shard").to_numpy()
            order = np.argsort(to, kind="stable")
            t, to = t.drop_columns(["shard"]).take(order), to[order]
            edges = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
            for a, b in zip(edges[:-1], edges[1:]):
                yield pa.RecordBatch.from_arrays([pa.array(to[a : a + 1]), pa.array([freeze(t.slice(a, b - a))], pa.binary())], names=["shard", "rows"])

    def build(pieces: pa.Table, wanted: pa.Table) -> pa.Table:
        want, found, nodes, parts = wanted.column("text").to_numpy(), set(), [], []
        for p in pieces.column("rows") if len(want) else []:
            t = thaw(p.as_py())
            hashes = t.column("text").to_numpy()
            new = np.flatnonzero(np.isin(hashes, want) & ~np.isin(hashes, np.fromiter(found, np.int64, len(found))))
            found.update(hashes[new].tolist())
            for _, texts in _pieces(t.column("t").take(new).combine_chunks()):
                h, n = shingles(texts, width)
                nodes.append(_nodes(h, n))
                parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64))))
        node = np.concatenate([*nodes, np.empty(0, np.int64)])
        return pa.table({"node": node, "h": pa.chunked_array(parts, pa.list_(pa.int64()))})

    dealt = rows.select("t", F.xxhash64("t").alias("text")).select("t", "text", shard("text")).mapInArrow(deal, "shard int, rows binary")
    return dealt.groupBy("shard").cogroup(wanted.select("node", "text", shard("text")).groupBy("shard")).applyInArrow(build, "node long, h array<long>")


def _those_of(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets whose bit of a map of BITS is that of an end of pairs (a, b): all that the pairs need, and few others."""
    bit = F.pmod(F.col("node"), F.lit(1 << BITS)) + 1
    at = pairs.select(F.explode(F.array("a", "b")).alias("node")).select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("spot"))
    maps = at.groupBy("bucket").agg(F.bitmap_construct_agg("spot").alias("map"))
    octet = F.conv(F.hex(F.expr("substring(map, cast(spot div 8 as int) + 1, 1)")), 16, 10).cast("int")
    named = sets.select("*", F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("spot"))
    return named.join(F.broadcast(maps), "bucket").where(octet.bitwiseAND(F.expr("shiftleft(1, cast(spot % 8 as int))")) != 0).select(*sets.columns)


def _prefixes(texts: DataFrame, width: int, like: float, common: np.ndarray, shard_bits: int) -> DataFrame:
    """(shard, h, node, n, place): the shingles of prefixes, packed, with their sets' names and sizes. texts: one column."""
    known = texts.sparkSession.sparkContext.broadcast(common)
    names = ["shard", "h", "node", "n", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            put = np.argsort(columns[0])
            columns = [x[put] for x in columns]
            e = np.searchsorted((columns[0] >> U(64 - shard_bits)).astype(np.int64), np.arange((1 << shard_bits) + 1))
            some = np.flatnonzero(e[1:] > e[:-1])
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array([pack(x[e[s] : e[s + 1]]) for s in some], pa.binary()) for x in columns]], names=names)

        for b in batches:
            for _, t in _pieces(b.column(0)):
                h, n = shingles(t, width)
                node, doc = _nodes(h, n), np.repeat(np.arange(len(n)), n)
                put = np.argsort(doc << 8 | known.value[(h >> U(64 - CELL_BITS)).astype(np.int64)], kind="stable")  # hashes are in order
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                front = place < (n - np.ceil(like * n - 1e-9).astype(np.int64) + 1)[doc]
                held.append((h[put][front], node[doc[front]], n[doc[front]].astype(np.uint32), place[front].astype(np.uint32)))
                if sum(len(x[0]) for x in held) > HELD:
                    yield flush()
        if sum(len(x[0]) for x in held):
            yield flush()

    return texts.mapInArrow(run, "shard int, h binary, node binary, n binary, place binary")


def _groups(table: pa.Table, like: float) -> pa.Table:
    """(shard, sig, node, n, cap, place) of one shard: the sets that share a shingle of their prefixes, and their places in the order of names.
    cap: the largest set that can be similar if this shingle is the first in common."""
    join = lambda c, kind: np.concatenate([unpack(x.as_py(), kind) for x in table.column(c)])
    h, node, n, place = join("h", U), join("node", np.int64), join("n", np.uint32).astype(np.int64), join("place", np.uint32).astype(np.int64)
    put = np.lexsort((node, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[put][1:] != h[put][:-1]) | (node[put][1:] != node[put][:-1])
    h, node, n, place = (x[put][new] for x in (h, node, n, place))
    cap = np.floor((n - place) * (1 + like) / like + 1e-6).astype(np.int64) - n
    for _ in range(2):  # first those without any partner go, then those without one of a fitting size
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        fits = lambda x, f: np.repeat(f.reduceat(x, first), size)
        some = np.repeat(size > 1, size)
        if len(h):
            some &= (fits(n, np.minimum) <= cap) & (fits(cap, np.maximum) >= n)
        h, node, n, cap = (x[some] for x in (h, node, n, cap))
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))[: len(h)]
    size = np.diff(np.append(first, len(h)))
    some, hub = np.repeat(size > 1, size), np.repeat(first, size)
    pair = np.repeat(size == 2, size)
    both = _fit(n, cap, n[hub], cap[hub]) | (hub == np.arange(len(h)))
    if len(h):
        some &= ~pair | np.repeat(np.minimum.reduceat(both, first), size)
    out = {"sig": h.view(np.int64), "node": node, "n": n, "cap": cap, "place": np.arange(len(h)) - hub}
    return pa.table({"shard": np.full(some.sum(), table.column("shard")[0].as_py(), np.int32)} | {k: x[some] for k, x in out.items()})


def _fit(n: np.ndarray, cap: np.ndarray, other_n: np.ndarray, other_cap: np.ndarray) -> np.ndarray:
    return (other_n <= cap) & (n <= other_cap)


def _across(low: int, high: float):
    """A function of a shard: pairs (a, b) of one group but not of one component, a at a place from low up to high and b behind it."""

    def run(table: pa.Table) -> pa.Table:
        sig, place, node, n, cap, root = (table.column(c).to_numpy() for c in ("sig", "place", "node", "n", "cap", "root"))
        put = np.lexsort((place, sig))
        sig, place, node, n, cap, root = (x[put] for x in (sig, place, node, n, cap, root))
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))[: len(sig)]
        last = np.append(first[1:], len(sig))[: len(first)]
        end = np.repeat(last, last - first)
        follow = np.where((place >= low) & (place < high), end - np.arange(len(sig)) - 1, 0)
        ends = np.cumsum(follow)
        found, held, size, at = [np.empty((0, 2), np.int64)], [], 0, 0
        while at < len(sig):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            f = follow[at:to]
            i = np.repeat(np.arange(at, to), f)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(f) - f, f)
            ok = (root[i] != root[j]) & _fit(n[i], cap[i], n[j], cap[j])
            held.append(np.stack([node[i[ok]], node[j[ok]]], 1))
            size += len(held[-1])
            if size > PAIRS_AT_ONCE:
                found, held, size = [np.unique(np.concatenate([*found, *held]), axis=0)], [], 0
            at = to
        pairs = np.unique(np.concatenate([*found, *held]), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def near_copies(docs: DataFrame, like: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", reach: int = 4) -> DataFrame:
    """(doc_id, component_id), one row per input row with an id. reach: bits in which fingerprints may differ to be a candidate."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    kind = dict(rows.dtypes)["doc_id"]
    common, total = commonness(rows.select("t"), width)
    shard_bits = max(4, ceil(np.log2(max(1.0, total * (1 - like) * 16 / SHARD_BYTES))))
    names = cut(_names(rows, width))
    # sets are named after their smallest document in the end, so that a component's root names it
    lows = cut(names.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.min("fp").alias("fp"), F.min("text").alias("text")))
    prefixes = _prefixes(rows.select("t"), width, like, common, shard_bits)
    shared = cut(prefixes.groupBy("shard").applyInArrow(lambda t: _groups(t, like), "shard int, sig long, node long, n long, cap long, place long"))

    # the sets of those that share a shingle of their prefixes: no others can be alike
    wanted = lows.join(shared.select("node").distinct(), "node", "left_semi")
    sets = cut(_sets(rows, wanted, width, max(16, ceil(total * WORD_BYTES / TEXT_BYTES))))

    scratch = Scratch(docs.sparkSession)

    def alike(name: str, pairs: DataFrame) -> DataFrame:
        pairs = scratch.put(f"pairs-{name}", pairs)
        some = _those_of(sets, pairs)
        both = pairs.join(some.select(F.col("node").alias("a"), F.col("h").alias("h_a")), "a").join(some.select(F.col("node").alias("b"), F.col("h").alias("h_b")), "b")
        both = both.select("a", "b", F.size(F.array_intersect("h_a", "h_b")).alias("n"), (F.size("h_a") + F.size("h_b")).alias("total"))
        return both.where(F.col("n") >= F.lit(like) * (F.col("total") - F.col("n")) - 1e-9).select("a", "b")

    def across(rooted: DataFrame, low: int, high: float) -> DataFrame:
        return alike(f"{low}", rooted.where(F.col("place") >= low).groupBy("shard").applyInArrow(_across(low, high), "a long, b long").distinct())

    # links from each set to its component's root stand for all that earlier turns found; the first turn is the fingerprints'
    turn, low, high, rows_ = 0, 0, 1, shared.count()
    more, stars = alike("fp", fingerprint_pairs(lows.select("node", "fp"), reach)), None
    while True:
        found = scratch.put(f"stars-{turn}", components(stars.union(more) if turn else more))
        stars = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
        rooted = shared.join(found.withColumnRenamed("root", "_root"), "node", "left").select("shard", "sig", "node", "n", "cap", "place", F.coalesce("_root", "node").alias("root"))
        rooted = scratch.put(f"rooted-{turn}", rooted)
        if turn:
            scratch.drop(f"stars-{turn - 1}", f"rooted-{turn - 1}")
        # pairs that are not compared yet and not in one component; while they are many, more hubs bring components together
        own = rooted.where(F.col("place") >= low).groupBy("sig", "root").count()
        own = own.groupBy("sig").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("inner"))
        apart = own.agg(F.sum((F.col("n") * F.col("n") - F.col("inner")) / 2)).first()[0]
        if not apart or apart <= PAIRS_A_ROW * rows_:
            break
        more = across(rooted, low, high)
        turn, low, high = turn + 1, high, high * MORE_HUBS
    more = across(rooted, low, float("inf"))
    named = lambda end: lows.select(F.col("node").alias(end), F.struct("low", "node").alias(f"{end}_named"))
    edges = stars.union(more).join(named("a"), "a").join(named("b"), "b").select(F.col("a_named").alias("a"), F.col("b_named").alias("b"))
    found = components(edges).select(F.col("node.node").alias("node"), F.col("root.low").alias("component_id"))
    ids = cut(lows.join(found, "node", "left").select("node", "n", F.coalesce("component_id", "low").alias("component_id")))
    return join_hot(names, ids, "node", "n").select(F.col("doc_id").cast(kind).alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, like: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row per component: the one whose id names it. Rows with null ids stay; of rows with one id the smallest text stays."""
    lead = near_copies(docs, like, width, id_col, text_col).select("component_id").distinct()
    return one_of_each(docs, lead, id_col, text_col)
