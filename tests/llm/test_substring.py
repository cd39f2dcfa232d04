"""Substring dedup against brute force."""

from collections import Counter

import pytest

from skein.llm import exchange, substring


def brute(rows, size=13):
    low = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - size + 1):
                x = tuple(w[k : k + size])
                low[x] = min(low.get(x, i), i)
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - size + 1):
                if low[tuple(w[k : k + size])] < i:
                    gone.update(range(k, k + size))
        yield i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()


def test_against_brute_force(docs, none, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET_BYTES", 100_000)
    expected = Counter(brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    got = Counter(tuple(r) for r in substring.remove_repeats(docs).collect())
    assert got == expected and any(r[2] for r in got)
    assert substring.digest(none).count() == 0


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="whole numbers"):
        substring.remove_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_levels_of_the_tree_agree(docs, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET_BYTES", 20_000)
    flat = Counter(tuple(r) for r in substring.digest(docs).collect())
    monkeypatch.setattr(exchange, "FAN_BITS", 1)
    assert Counter(tuple(r) for r in substring.digest(docs).collect()) == flat
