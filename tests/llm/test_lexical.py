import math
import re

import numpy as np
from pyspark.sql import functions as F

from skein.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """{item: [(doc_id, score)]} from plain counts."""
    held = [(i, terms(t)) for i, t in docs]
    n_docs, length = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df, asked = {}, {}
    for _, w in held:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = {}
    for item, q in asked.items():
        scored = []
        for i, w in held:
            m, s = 10 + (90 * len(w) * n_docs) // max(length, 1), 0
            for x in q:
                if tf := w.count(x):
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out[item] = [(None if null else i, -s) for s, null, i in sorted(scored)[:k]]
    return out


def found(out):
    got = {}
    for r in out.orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(got[r.item_id])
    return got


def test_equal_to_brute_force(docs, none, spark, sf):
    few = docs.where("length(text) < 3000 or text is null")  # counting by hand is slow
    rows = [(r.doc_id, r.text) for r in few.select("doc_id", "text").collect()]
    items = [(1, "one two THREE four five"), (2, None), (3, ""), (4, "no such terms xyzzy"), (5, "Ünïcode wörter license 10 0"), (None, "a b c"), (6, "a"), (6, "license"), (7, " ".join(t for _, t in rows[:40] if t))]
    items += [(100 + r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(12).collect()]
    table = spark.createDataFrame([(*i, 0, "x", 1.0, 2) for i in items], "item_id long, text string, rank int, term string, score double, doc_id long")
    want = {k: v for k, v in brute(rows, items).items() if v}
    assert found(X.search(few, table)) == want
    # tiny shards and several blocks give the same
    small = X.Ranking(rows=7, postings=60, terms=40)
    assert found(X.search(few.repartition(5), table, small)) == want
    assert found(X.search(few, table, X.Ranking(k=1))) == {k: v[:1] for k, v in want.items()}
    assert X.search(none, table).count() == 0 and X.search(few, table.where("false")).count() == 0


def test_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(k % 20, f"same words here {'x' * (k % 2)}") for k in range(200)] + [(None, "same words here x")] * 3 + [(50, None), (51, "?! ...")], "doc_id long, text string")
    items = [(1, "same words"), (2, "x")]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert found(X.search(docs.repartition(6), table)) == brute([(r.doc_id, r.text) for r in docs.collect()], items)
    named = X.search(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), table)
    assert [r.doc_id for r in named.where("item_id = 2").orderBy("rank").collect()] == ["d1"] * 10


def test_very_long_texts_are_read_whole(spark):
    long = "word " * 600_000 + "needle" + "y" * 2_000_000 + " Needle"
    docs = spark.createDataFrame([(1, long), (2, "needle in here"), (3, "hay")], "doc_id long, text string")
    table = spark.createDataFrame([(1, "NEEDLE word")], "item_id long, text string")
    n, total = 600_002, 600_006
    w = [math.floor(1000 * math.log(8 / 5)), math.floor(1000 * math.log(8 / 3))]
    score = lambda tf, n, w: w * ((1_000_000_000 * tf) // (1000 * tf + 8 * (10 + 90 * n * 3 // total)))
    want = {1: sorted([(1, score(1, n, w[0]) + score(600_000, n, w[1])), (2, score(1, 3, w[0]))], key=lambda x: -x[1])}
    assert found(X.search(docs, table)) == want


def test_reading_stops_early():
    """The threshold ends reading before the lists do, and never too early."""
    rng = np.random.default_rng(5)
    n, vocabulary = 3000, 40
    tf = rng.geometric(0.5, (n, vocabulary)) * (rng.random((n, vocabulary)) < 0.3)
    tf[:12, :5] = 60
    sizes = (tf > 0).sum(1)
    weights = rng.integers(100, 4000, vocabulary)
    length = tf.sum(1)
    shard = X.Shard(length, sizes, np.nonzero(tf)[1], tf[tf > 0], weights, n, int(length.sum()))
    m = 10 + 90 * length * n // length.sum()
    impact = weights * (1_000_000_000 * tf // (1000 * tf + 8 * m[:, None]))
    early = 0
    for _ in range(30):
        asked = np.sort(rng.choice(vocabulary, rng.integers(1, 8), replace=False))
        s = impact[:, asked].sum(1)
        order = np.lexsort((np.arange(n), -s))[:10]
        doc, score, read = shard.best(asked, 10, 0)
        assert doc.tolist() == order.tolist() and score.tolist() == s[order].tolist()
        early += read < (impact[:, asked] > 0).sum()
        floor = int(s[order[4]])
        assert shard.best(asked, 10, floor)[0].tolist() == [d for d in order if s[d] >= floor]
    assert early > 5 and not shard.seen.any() and not shard.asked.any()
