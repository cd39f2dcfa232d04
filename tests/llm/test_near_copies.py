"""The near-duplicates stage against brute-force Jaccard."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from skein.llm import near_copies, simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def groups(texts):
    """{id: smallest id of its component}, by all pairs; texts: (id, text)."""
    s = [(i, shingles(t)) for i, t in texts]
    up = {i: i for i, _ in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in combinations(s, 2):
        if 5 * len(a & b) >= 4 * len(a | b) and top(i) != top(j):
            up[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in up}


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def made():
    """Copies with few and many edits around the bound, under a passage that all documents share."""
    rng = random.Random(5)
    passage = [f"common{k}" for k in range(60)]
    out = []
    for family in range(12):
        base = passage + [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 140, 300]))]
        out += [edited(rng, base, n) for n in (0, 0, 1, 2, 3, 4, 5, 7, 9)]
    out += [None, "", "a b", "A  b", "a b c", "one two three four five"]
    return list(enumerate(out, 1))


@pytest.mark.parametrize("pairs", [1, 0])  # 0: always more hubs
def test_components_are_those_of_all_pairs(spark, monkeypatch, pairs):
    monkeypatch.setattr(near_copies, "PAIRS_A_ROW", pairs)
    rows = made()
    expected = groups(rows)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == expected
    s = {i: shingles(t) for i, t in rows}
    fp = {i: simhash.fingerprint(t or "") for i, t in rows}
    assert any(0.8 <= jaccard(s[i], s[j]) < 0.95 and (fp[i] ^ fp[j]).bit_count() > 4 for i, j in combinations(s, 2))
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_whole_table(spark, docs, none):
    raw = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(raw).collect()}
    assert got == groups([(r.doc_id, r.text) for r in raw.select("doc_id", "text").collect()])
    assert near_copies.keep_one(docs).where("doc_id is null").count() == 1
    assert near_copies.keep_one(none).count() == 0


def test_fingerprints_come_first(spark, monkeypatch):
    """SimHash proposes: its pairs span the fingerprints' components; the exact completion then changes no result."""
    rows, reach = made(), 4
    h, n = near_copies.shingles([(t or "").lower().encode() for _, t in rows], 5)
    node, ends = near_copies._nodes(h, n).tolist(), np.cumsum(n)
    fp = {}
    for k, name in enumerate(node):
        own = h[ends[k] - n[k] : ends[k]].tolist()
        fp[name] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own))
    assert simhash.majority(h, n).tolist() == [fp[x] for x in node]
    many = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert simhash.majority(many, np.array([0, 1000, 0]))[1] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in many.tolist()) > 1000)

    def spanned(pairs):
        up = {x: x for x in fp}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[max(top(a), top(b))] = min(top(a), top(b))
        return {x: top(x) for x in fp}

    table = spark.createDataFrame([(x, int(np.uint64(f).astype(np.int64))) for x, f in fp.items()], "node long, fp long")
    found = [(r.a, r.b) for r in near_copies.fingerprint_pairs(table, reach).collect()]
    assert spanned(found) == spanned((a, b) for a, b in combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= reach) and len(found) < len(fp)

    asked, whole = [], near_copies.fingerprint_pairs
    monkeypatch.setattr(near_copies, "fingerprint_pairs", lambda *a: asked.append(a) or whole(*a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == groups(rows) and len(asked) == 1
