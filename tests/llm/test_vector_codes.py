import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, row int, x int, cell int"


def brute(rows, parts, entries, rounds, scale):
    """Plain loops: {place: (code, error)} and the codebooks."""
    ints = [[int(np.floor(scale * v)) for v in x] for x in rows]
    width = len(ints[0]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[list(cut(x, p)) for x in ints[:entries]] for p in range(parts)]

    def nearest(v, book):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in book]
        return min(range(len(d)), key=lambda e: (d[e], e)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(cut(x, p), books[p])[0] for x in ints]
            for e in range(len(books[p])):
                held = [cut(x, p) for x, o in zip(ints, own) if o == e]
                if held:
                    books[p][e] = [sum(c) // len(held) for c in zip(*held)]
    found = [[nearest(cut(x, p), books[p]) for p in range(parts)] for x in ints]
    return [("".join(f"{e:02x}" for e, _ in f), sum(d for _, d in f)) for f in found], books


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(3)
    good = [[float(v) for v in np.round(rng.normal(size=32), 2)] for _ in range(150)]
    good[90:120] = [good[5]] * 30  # repeated rows
    good[120] = [0.0] * 32
    good[121] = [-0.001] * 32  # floors go down
    rows = [(1000 + k, x, None if k % 3 == 0 else k % 2) for k, x in enumerate(good)]
    bad = [(1, None, 1), (2, [], 1), (3, [None] + [0.5] * 31, 1), (4, [float("nan")] * 32, 1), (5, [float("inf")] + [0.5] * 31, 1), (6, [float("-inf")] * 32, None)]
    return rows, bad


def test_equal_to_plain_loops(spark, odd):
    rows, bad = odd
    coding = V.Coding(entries=20, block=6)
    df = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows + bad], SCHEMA)
    want, books = brute([np.float32(x).astype(float) for _, x, _ in rows], 16, 20, 2, 256)
    for parts in (1, 7):
        got = {r.vec_id: r for r in V.digest(df.repartition(parts), coding).collect()}
        assert len(got) == len(rows)
        assert {i: (r.code, r.error) for i, r in got.items()} == {r[0]: w for r, w in zip(rows, want)}
        assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()}
        total = {}
        for (_, _, label), (_, e) in zip(rows, want):
            total[label] = total.get(label, 0) + e
        assert all(got[i].label_error == total[label] for i, _, label in rows)


def test_partial_distances_are_exact():
    rng = np.random.default_rng(1)
    for width in (1, 2, 4, 9):
        for spread in (2, 50):
            book, x = rng.integers(-spread, spread, (37, width)), rng.integers(-spread, spread, (500, width))
            book[20:25] = book[3]  # ties
            d = ((x[:, None] - book[None]) ** 2).sum(2)
            for block in (1, 5, 64):
                entry, best = V.nearest(x, book, block)
                assert (best == d.min(1)).all() and (entry == d.argmin(1)).all()


def test_edges(spark, odd):
    rows, bad = odd
    few = spark.createDataFrame([(7, [1.0] * 16, 1), (None, [2.0] * 16, None), (7, [0.5] * 16, 1), (7, [1.0] * 16, 1)], "vec_id long, embedding array<double>, label int")
    out = sorted((r.vec_id or -1, r.code, r.error, r.label_error) for r in V.digest(few).collect())
    assert [r[2] for r in out] == [0, 0, 0, 0] and [r[0] for r in out] == [-1, 7, 7, 7]
    # of rows with one id the smaller components come first, null ids last, equal entries to the lower one
    assert {r[1] for r in out if r[0] == 7} == {"00" * 16, "01" * 16} and out[0][1] == "03" * 16
    empty = spark.createDataFrame([(*r, "c", 1, 2, 3) for r in bad], SCHEMA)
    assert V.digest(empty).count() == 0 and V.digest(empty.where("false")).columns == V.digest(few).columns
    for x in ([1.0] * 15, [1e9] * 16):
        with pytest.raises(ValueError):
            V.fit(spark.createDataFrame([(1, x)], "vec_id long, embedding array<double>"))
    x = np.array([r[1] for r in rows])
    books = V.fit(spark.createDataFrame([(i, e) for i, e, _ in rows], "vec_id long, embedding array<double>"))
    code, error = books.assign(V.integers(x, 256))
    assert (((books.decode(code) - V.integers(x, 256)) ** 2).sum(1) == error.sum(1)).all()
    assert V.encode(few.withColumn("embedding", F.array_repeat(F.lit(0.25), 32)), books).count() == 4
