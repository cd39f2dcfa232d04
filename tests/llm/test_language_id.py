import math

import numpy as np
from pyspark.sql import functions as F

from skein.llm import language_id as L


def brute(train, text, order, least):
    """Bits of text by dictionaries: contexts from the longest kept one down, with exclusion, escapes by the number of different bytes."""
    seen = {}
    for t in train:
        b = bytes(order) + t
        for p in range(order, len(b)):
            for k in range(order + 1):
                own = seen.setdefault(b[p - k : p], {})
                own[b[p]] = own.get(b[p], 0) + 1
    seen = {c: s for c, s in seen.items() if not c or sum(s.values()) >= least}
    bits, b = 0.0, bytes(order) + text
    for p in range(order, len(b)):
        out, cost = set(), 0.0
        for k in range(order, -1, -1):
            own = seen.get(b[p - k : p])
            if own is None:
                continue
            left = {s: n for s, n in own.items() if s not in out}
            t = len(left) if len(own) < 256 else 0
            total = sum(left.values()) + t
            if b[p] in left:
                cost += math.log2(total) - math.log2(left[b[p]])
                break
            if left:
                cost += math.log2(total) - math.log2(t)
            out |= set(own)
        else:
            cost += math.log2(256 - len(seen.get(b"", {})))
        bits += round(cost * L.UNIT) / L.UNIT
    return bits


def test_code_lengths_equal_plain_trees():
    rng = np.random.default_rng(0)
    texts = {"aa": [b"abracadabra " * 9, b"the cat sat on the mat", "ünïcode wörter".encode()], "bb": [bytes(range(256)) * 3, b"xyzzy"], "cc": [b"z"]}
    asked = [b"abracadabra", b"the dog sat", b"", b"q", bytes(rng.integers(0, 256, 300).tolist()), "wörter und ünïcode".encode() * 3, b"\0\0\0abra"]
    for order, least in ((4, 2), (2, 1), (1, 3), (0, 1), (5, 2)):
        pad = bytes(order)
        model = L.Model(L.Matching(order=order, least=least), {k: L.Tree(L.windows([pad + t for t in v], order), order, least) for k, v in texts.items()})
        got = L.code_lengths(asked, model) / L.UNIT
        for i, t in enumerate(asked):
            for k, lang in enumerate(texts):
                assert abs(got[i, k] - brute(texts[lang], t, order, least)) < 1e-3, (order, least, t, lang)


def test_shares_of_all_bytes_sum_to_one():
    tree = L.Tree(L.windows([bytes(3) + b"how much wood would a woodchuck chuck if a woodchuck could"], 3), 3, 2)
    for context in (b"woo", b"chu", b"zzz", b"a w", b"\xff\x00u"):
        w = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)])
        assert abs(np.exp2(-tree.lengths(w) / L.UNIT).sum() - 1) < 1e-3


def test_pieces_of_a_long_text_add_up(monkeypatch):
    model = L.Model(L.Matching(), {"a": L.Tree(L.windows([bytes(4) + b"some words, and some more words. " * 5], 4), 4, 2)})
    texts = [b"some more words, and others " * 50, b"", b"short"]
    whole = L.code_lengths(texts, model)
    monkeypatch.setattr(L, "CHUNK", 37)
    assert (L.code_lengths(texts, model) == whole).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.digest(docs)
    both = out.join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.98
    assert both.score.between(0, 1).all()
    again = L.digest(docs.select("lang", "text", "doc_id", F.lit("x").alias("source")).repartition(5)).toPandas()
    cols = ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"]
    a, b = (x.sort_values("doc_id")[cols].reset_index(drop=True) for x in (out.toPandas(), again))
    assert a.equals(b)


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.createDataFrame([(k, "aaaa bbbb aaaa bbbb" if k % 2 else "cccc dddd cccc dddd", "x" if k % 2 else "y") for k in range(40)], "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    changed = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    assert L.digest(changed).sort("doc_id").collect() == L.digest(docs).sort("doc_id").collect()
    assert {r.lang_pred for r in L.digest(changed).collect()} == {"x", "y"}


def test_edges(docs, none, spark):
    out = {r.doc_id: r for r in L.digest(docs).collect()}
    assert L.digest(docs).count() == docs.count() and L.digest(none).count() == 0
    assert all(out[k].lang_pred == L.UNKNOWN and out[k].score == 0 for k in (1, 2, 3))
    assert out[10].lang_pred != L.UNKNOWN and not out[None].held_out
    assert {r.lang_pred for r in L.digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {L.UNKNOWN}
    assert {r.lang_pred for r in L.digest(docs.withColumn("text", F.lit("12 34 !"))).collect()} == {L.UNKNOWN}
    same = docs.withColumn("text", F.lit("one text for all languages")).withColumn("lang", F.coalesce("lang", F.lit("en")))
    tied = L.digest(same).select("lang_pred", "score").distinct().collect()
    first = min(r.lang for r in same.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).select("lang").distinct().collect())
    assert [r.lang_pred for r in tied] == [first] and 0 < tied[0].score < 1
    # more languages than the sample has room for: one row each
    many = spark.createDataFrame([(k, f"text number {k} in its own tongue " + chr(97 + k % 26) * 9, f"l{k:03d}") for k in range(60)], "doc_id long, text string, lang string")
    assert L.sample(many, F.lit(True), L.Matching(rows_of_all=30)).count() == 60
