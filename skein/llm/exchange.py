"""Totals of keys over all buckets of documents, exactly, by a tree of ranges.

A bucket is a piece of a partition with so many bytes of text. It sends its distinct keys, in order and cut into a fixed number of ranges, to
as many nodes; a node merges one range of as many buckets, and sends the merged keys on, cut into finer ranges, until one node has what all
buckets hold of its range. The answers come back the same way. A bucket and a node send `2 ** FAN_BITS` messages at most, so messages grow as
the number of buckets times the levels, and a node holds about as much as a bucket. A key that every bucket has is one entry of each message.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
FAN_BITS = 8
PASS = 3
UP = "to long, child long, at int, keys binary, values array<binary>"
DOWN = "child long, kind int, at int, values array<binary>"


def pack(x: np.ndarray) -> bytes:
    """Bytes by significance, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpack(b: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(b[8:], n * width, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, U), dtype=U)


def pack_bits(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + np.packbits(x).tobytes()


def unpack_bits(b: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b[8:], np.uint8), count=int.from_bytes(b[:8], "little")).astype(bool)


def freeze(table: pa.Table) -> bytes:
    """A table as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def thaw(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<binary>": pa.list_(pa.binary())}
    spec = [x.split() for x in names.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(spec)})


def bucketed(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[tuple[int, pa.Table]]:
    """(bucket, rows) of a partition: rows until the texts pass `most` bytes. Buckets are numbered by partition and place in it."""
    first = TaskContext.get().partitionId() << 32
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text)).cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = min(b.num_rows, max(at + 1, int(np.searchsorted(ends, before + most - size, "right"))))
            held.append(b.slice(at, to - at))
            size += int(ends[to - 1] - before)
            at = to
            if size >= most or at < b.num_rows:
                yield first, pa.Table.from_batches(held)
                first, held, size = first + 1, [], 0
    if held:
        yield first, pa.Table.from_batches(held)


class Scheme:
    """What travels: sorted keys of `bits` bits (a second key column may tell apart what the first does not) with values."""

    bits = 64
    more: tuple = ()  # dtypes of further key columns
    values: tuple = (np.int64,)
    answers: tuple = (np.int64,)

    def merge(self, values: list[np.ndarray], heads: np.ndarray) -> list[np.ndarray]:
        """Values of equal keys, which follow each other from each head on, as one."""
        return [np.add.reduceat(v, heads) for v in values]

    def top(self, keys: list[np.ndarray], values: list[np.ndarray]) -> list[np.ndarray]:
        """The answer to each key, from the values of all buckets."""
        return values

    def child(self, answers: list[np.ndarray], own: list[np.ndarray], merged: list[np.ndarray]) -> list[np.ndarray]:
        """The answer for a child's keys, from the merged ones' and from both values."""
        return answers

    def lengths(self, keys: list[np.ndarray]) -> np.ndarray | None:
        """If the last answer has several numbers for each key: how many."""
        return None

    def sums(self, keys: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
        """Numbers that are summed over all keys of all buckets, for everyone."""
        return np.zeros(0, np.int64)

    def _packed(self, keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[bytes, list[bytes]]:
        return pack_sorted(keys[0]), [pack(x) for x in (*keys[1:], *values)]

    def _unpacked(self, keys: bytes, values: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        rest = [unpack(b, k) for b, k in zip(values, (*self.more, *self.values))]
        return [unpack_sorted(keys), *rest[: len(self.more)]], rest[len(self.more) :]


class Tree:
    """Several schemes at once. Rows of UP are grouped by `to`: a node's number and the scheme's place, or PASS for what is not read here."""

    def __init__(self, buckets: int, schemes: list[Scheme], fan_bits: int | None = None):
        bits = ceil(log2(max(1, buckets)))
        levels = max(1, ceil(bits / (fan_bits or FAN_BITS)))
        self.widths = [bits // levels + (k < bits % levels) for k in range(levels)]
        self.schemes = schemes

    def number(self, bucket: int) -> int:
        """Buckets are dealt to the first level by a hash."""
        return (bucket * 0x9E3779B97F4A7C15 % 2**64) >> 20 & ((1 << sum(self.widths)) - 1)

    def _messages(self, level: int, node: int, child: int, kind: int, keys: list[np.ndarray], values: list[np.ndarray]) -> list[tuple]:
        """Rows to the nodes of the next level, one for each of its ranges even if it is empty."""
        scheme, had, width = self.schemes[kind], sum(self.widths[:level]), self.widths[level]
        have = had + width
        group = node >> have << have
        low = (node & ((1 << had) - 1)) << width if level else 0
        at = (keys[0] >> U(scheme.bits - have)).astype(np.int64) if have else np.zeros(len(keys[0]), np.int64)
        edges = np.searchsorted(at, np.arange(low, low + (1 << width) + 1))
        cut = [(k, slice(edges[k], edges[k + 1])) for k in range(1 << width)]
        return [((group | low | k) << 2 | kind, child, k, *scheme._packed([x[s] for x in keys], [x[s] for x in values])) for k, s in cut]

    def send(self, bucket: int, kind: int, keys: list[np.ndarray], values: list[np.ndarray]) -> list[tuple]:
        """Rows of UP with a bucket's keys."""
        return self._messages(0, self.number(bucket), bucket, kind, keys, values)

    def keep(self, group: int, values: list[bytes], at: int = 0) -> tuple:
        """A row of UP that is not for a node, but stays with its group."""
        return group << 2 | PASS, group, at, None, values

    def _meet(self, scheme: Scheme, rows: list[dict]):
        """(children's values, merged keys and values, for each child the places of its keys among the merged ones)."""
        parts = [scheme._unpacked(r["keys"], r["values"]) for r in rows]
        keys = [np.concatenate(x) for x in zip(*(k for k, _ in parts))]
        values = [np.concatenate(x) for x in zip(*(v for _, v in parts))]
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        merged = scheme.merge([v[order] for v in values], heads) if len(order) else values
        ends = np.cumsum([0, *(len(k[0]) for k, _ in parts)])
        return [v for _, v in parts], [k[order][heads] for k in keys], merged, [place[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def _reply(self, kind: int, rows: list[dict], answers: list[np.ndarray], sums: np.ndarray, met) -> pa.Table:
        scheme, (own, keys, merged, places) = self.schemes[kind], met
        many = scheme.lengths(keys)
        first = None if many is None else np.cumsum(many) - many
        out = []
        for r, mine, at in zip(rows, own, places):
            said = [x[at] for x in (answers if many is None else answers[:-1])]
            if many is not None:
                n = many[at]
                said.append(answers[-1][np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            said = scheme.child(said, mine, [v[at] for v in merged])
            out.append((r["child"], kind, r["at"], [*(pack(x) for x in said), pack(sums)]))
        return table(out, DOWN)

    def totals(self, sent: DataFrame) -> DataFrame:
        """The answers to rows of UP, as rows of DOWN; read() puts a bucket's together. All steps group `sent` by `to`: one shuffle of it."""

        def rise(level: int):
            def run(t: pa.Table) -> pa.Table:
                to = t.column("to")[0].as_py()
                if to & 3 == PASS:
                    return table([], UP)
                _, keys, merged, _ = self._meet(self.schemes[to & 3], t.to_pylist())
                return table(self._messages(level, to >> 2, to, to & 3, keys, merged), UP)

            return run

        def top(t: pa.Table) -> pa.Table:
            rows = t.to_pylist()
            kind = rows[0]["to"] & 3
            if kind == PASS:
                return table([], DOWN)
            met, scheme = self._meet(self.schemes[kind], rows), self.schemes[kind]
            return self._reply(kind, rows, scheme.top(met[1], met[2]), scheme.sums(met[1], met[2]), met)

        def fall(t: pa.Table, said: pa.Table) -> pa.Table:
            rows = t.to_pylist()
            kind = rows[0]["to"] & 3 if rows else PASS
            if kind == PASS:
                return table([], DOWN)
            return self._reply(kind, rows, *self.read(said, kind), self._meet(self.schemes[kind], rows))

        up = [sent]
        for level in range(1, len(self.widths)):
            up.append(up[-1].groupBy("to").applyInArrow(rise(level), UP))
        down = up[-1].groupBy("to").applyInArrow(top, DOWN)
        for level in reversed(range(len(self.widths) - 1)):
            down = up[level].groupBy("to").cogroup(down.groupBy("child")).applyInArrow(fall, DOWN)
        return down

    def read(self, said: pa.Table, kind: int) -> tuple[list[np.ndarray], np.ndarray]:
        """(a scheme's answers in the order of the keys that were sent, sums)."""
        rows = sorted(said.filter(pc.equal(said.column("kind"), kind)).to_pylist(), key=lambda r: r["at"])
        kinds = self.schemes[kind].answers
        answers = [np.concatenate([*(unpack(r["values"][i], k) for r in rows), np.empty(0, k)]) for i, k in enumerate(kinds)]
        sums = [unpack(r["values"][len(kinds)], np.int64) for r in rows]
        return answers, np.sum(sums, axis=0) if sums else np.zeros(0, np.int64)


def kept(rows: pa.Table, at: int = 0) -> list[list[bytes]]:
    """What keep() left in a group."""
    return [] if not rows.num_rows or rows.column("to")[0].as_py() & 3 != PASS else [r["values"] for r in rows.to_pylist() if r["at"] == at]


def of_buckets(down: DataFrame) -> DataFrame:
    """Rows of DOWN with `to`, by which they meet what keep() left of their buckets."""
    return down.withColumn("to", F.shiftleft("child", 2).bitwiseOR(F.lit(PASS)))
