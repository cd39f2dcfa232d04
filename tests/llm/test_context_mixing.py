import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace
from math import exp, isclose, log, log10, log1p

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import context_mixing as cm
from skein.llm import exchange


def test_base_and_held_out_bits(docs, none, monkeypatch):
    monkeypatch.setattr(cm, "BUCKET_BYTES", 60_000)
    monkeypatch.setattr(exchange, "FAN_BITS", 2)
    rows = [(r.doc_id, re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in docs.select("doc_id", "text").collect()]
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", t), None]
    c = Counter(x for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for x in token(t))
    n, v = sum(c.values()), len(c)
    expected = {(i, t): (len(token(t)), sum(c[x] > 0 for x in token(t)), sum(log10((c[x] + 1) / (n + v + 1)) for x in token(t))) for i, t in rows}
    by_id = {}
    for (i, t), e in expected.items():
        by_id.setdefault(i, e)
    out = cm.digest(docs).toPandas().astype({"doc_id": object})
    assert len(out) == len(rows) and set(out.train_tokens) == {n}
    for r in out.itertuples():
        e = by_id[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert (r.n_tokens, r.n_known) == e[:2] and isclose(r.base_score, e[2], rel_tol=1e-9)
    assert out[out.held_out & (out.n_tokens > 50)].bits_per_byte.median() < 3
    assert cm.digest(none).count() == 0


class Brute:
    """The model, choice by choice, over plain dictionaries of counts."""

    def __init__(self, texts, weights, model):
        seen = np.zeros(256, np.int64)
        for t in texts:
            seen += np.bincount(np.frombuffer(t + b"\xff", np.uint8), minlength=256)
        self.code, self.w, self.model, self.n = cm.prefix_code(seen), weights, model, defaultdict(Counter)
        for t in texts:
            for p in range(len(t) + 1):
                for o in range(len(model.orders)):
                    self.n[self.context(t, p, o)][(t + b"\xff")[p]] += 1

    def context(self, t, p, o):
        k = self.model.orders[o]
        if k:
            return o, t[max(0, p - k) : p]
        at = max((t.rfind(bytes([c]), 0, p) for c in b" \t\n\v\f\r"), default=-1) + 1
        piece = (p - at) // cm.WORD
        return o, piece > 0, t[at + piece * cm.WORD : p]

    def choices(self, t, p):
        """(gate, odds of each order for the choice that was made) along the byte's path."""
        byte = (t + b"\xff")[p]
        place = self.code.place
        for depth in range(int(self.code.length[byte])):
            gate, x = None, []
            for o in range(len(self.model.orders)):
                c = self.n[self.context(t, p, o)]
                same = sum(n for b, n in c.items() if b == byte or self.code.shared[place[b], place[byte]] >= depth + 1)
                both = sum(n for b, n in c.items() if b == byte or self.code.shared[place[b], place[byte]] >= depth)
                same, other = self.coded(same), self.coded(both - same)
                x.append(log((same + self.model.prior) / (other + self.model.prior)))
                gate = min(depth, cm.DEPTHS) * (len(cm.SEEN) + 1) + sum(same + other >= s for s in cm.SEEN)
            yield gate, x

    def coded(self, n):
        return float(cm.COUNT_OF[cm.to_code(np.array([n]))][0])

    def bits(self, t):
        total, drift, read = 0.0, np.zeros(len(self.model.orders)), 0
        block = cm.edges(len(t) + 1, self.model)
        for low, high in zip(block[:-1], block[1:]):
            slope = np.zeros(len(drift))
            for p in range(low, high):
                for gate, x in self.choices(t, p):
                    x = np.array([*x[:-1], x[-1] * self.w[gate][-1]])
                    z = float(np.array([*self.w[gate][:-1], 1.0]) @ x + drift @ x)
                    total += log1p(exp(-z))
                    slope += x / (1 + exp(z))
            read += high - low
            drift += self.model.rate / np.sqrt(read) * slope
        return total / log(2)


def vectorised(train, texts, weights, model):
    seen = np.zeros(256, np.int64)
    for t in train:
        seen += np.bincount(np.frombuffer(t + b"\xff", np.uint8), minlength=256)
    code = cm.prefix_code(seen)
    s = cm.Stream([*train, *texts], code, model, 56)
    use = np.repeat(np.arange(len(s.size)) < len(train), s.size)
    keys, n, place = s.together(use)
    c = cm.Contexts(code, 56)
    return cm.costs(s, cm.Odds(s, place, c.lengths([keys]), c.top([keys], [n])[0], model), weights, model)[len(train) :]


def corpus():
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 105, int(n), np.uint8)) for n in rng.integers(1, 9, 60)] + ["ünï".encode(), b"x" * 70]
    return [b" ".join(words[k] for k in rng.zipf(1.4, int(n)) % len(words)) for n in rng.integers(0, 90, 25)]


@pytest.mark.parametrize("block", [16, 64])
def test_scores_equal_the_choices_one_by_one(block):
    rng = np.random.default_rng(5)
    texts, model = corpus(), replace(cm.Model(), first_block=block, rate=0.2, together=3)
    weights = rng.uniform(0.1, 0.8, (cm.GATES, 3))
    brute = Brute(texts[:15], weights, model)
    got = vectorised(texts[:15], texts[15:], weights, model)
    assert np.allclose(got, [brute.bits(t) for t in texts[15:]], rtol=1e-4)


def test_a_table_scores_as_the_choices_one_by_one(spark, monkeypatch):
    """From rows through buckets, both levels of the tree and back; only the starting weights are given."""
    texts, weights = corpus(), np.random.default_rng(8).uniform(0.1, 0.8, (cm.GATES, 3))

    def given(cell, n, orders):
        return weights

    monkeypatch.setattr(cm, "BUCKET_BYTES", 300)
    monkeypatch.setattr(exchange, "FAN_BITS", 2)
    monkeypatch.setattr(cm, "fit", given)
    rows = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.bits for r in cm.score(rows, lambda key: key < 15).collect()}
    brute = Brute(texts[:15], weights, cm.Model())
    assert len(got) == len(texts) and all(isclose(got[i], brute.bits(t), rel_tol=1e-4) for i, t in enumerate(texts))


def test_scores_do_not_follow_partitions(docs, monkeypatch):
    monkeypatch.setattr(cm, "BUCKET_BYTES", 60_000)
    rows = docs.dropDuplicates(["doc_id", "text"])
    scores = [sorted(cm.digest(rows.repartition(n)).select(F.xxhash64("doc_id", "n_tokens"), "base_score", "score").collect()) for n in (1, 2, 24, 100)]
    assert len(scores[0]) == rows.count()
    for other in scores[1:]:
        assert all(a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-9) for a, b in zip(scores[0], other))


def test_a_row_counts_as_often_as_it_stands(spark, monkeypatch):
    monkeypatch.setattr(cm, "BUCKET_BYTES", 1_000)
    rows = spark.range(2_000).select(F.lit(1).alias("doc_id"), F.lit("one more time").alias("text"))
    out = cm.score(rows, lambda key: key > 0).groupBy("score", "n_known", "train_tokens").count().collect()
    assert [(r.n_known, r.train_tokens, r["count"]) for r in out] == [(4, 8_000, 2_000)]


def test_chances_of_all_that_may_follow_sum_to_one():
    texts, model = corpus(), cm.Model()
    weights = np.random.default_rng(6).uniform(0.1, 0.8, (cm.GATES, 3))
    brute = Brute(texts, weights, model)
    drift = np.array([0.05, -0.1, 0.2])
    for stem in (b"", b"ab", texts[3][:20], b"never seen "):
        chance = lambda t: exp(-sum(log1p(exp(-float((weights[g] + drift) @ np.array(x)))) for g, x in brute.choices(t, len(stem))))
        assert isclose(sum(chance(stem + f) for f in [*(bytes([k]) for k in range(255)), b""]), 1.0, rel_tol=1e-6)


def test_starting_weights_code_the_counted_choices_best():
    rng = np.random.default_rng(7)
    true = np.array([0.3, 0.9, 0.5])
    cell = rng.integers(0, cm.LEVELS**3, 20_000)
    digits = np.stack([cell // cm.LEVELS % cm.LEVELS, cell % cm.LEVELS, cell // cm.LEVELS**2], 1)
    chance = 1 / (1 + np.exp(-cm.PREDICTIONS[digits] @ true))
    # a choice is seen as made or, with its signs turned, as not made
    turned = ((cm.LEVELS - 1 - digits) * np.array([cm.LEVELS, 1, cm.LEVELS**2])).sum(1)
    n = np.concatenate([chance, 1 - chance]) * 1000
    w = cm.fit(np.concatenate([cell, turned]), n, 3)
    assert np.allclose(w[0], true, atol=1e-3) and np.allclose(w[1], 1 / 3)


def test_equal_texts_score_equally_in_any_company():
    texts, model = corpus(), replace(cm.Model(), together=4)
    weights = np.full((cm.GATES, 3), 0.4)
    long = b" ".join(texts * 20)
    together = vectorised(texts[:5], [*texts, long], weights, model)
    assert all(isclose(vectorised(texts[:5], [t], weights, model)[0], c, rel_tol=1e-6) for t, c in zip([*texts, long], together))


def test_messages_follow_the_buckets():
    """A bucket sends so many messages whatever the corpus; levels are added as it grows."""
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 5_000).astype(np.uint64))
    tree = {n: exchange.Tree(n, [cm.Tokens()]) for n in (40, 2_500, 10_000_000)}
    assert [sum(1 << w for w in t.widths) for t in tree.values()] == [64, 128, 768]
    assert len(tree[2_500].send(1, 0, [keys], [np.ones(5_000, np.int64)])) == 64


def test_work_follows_the_kinds_of_bytes_not_the_bytes(monkeypatch):
    """Bytes that agree in all orders are worked out once; every byte finds its own keys again, across pieces of texts and of words."""
    monkeypatch.setattr(cm, "PIECES_AT_ONCE", 7)
    model = cm.Model()
    texts = [*corpus(), b"", b"\0\0ab \0ab", b"ab ab", b"x" * 31 + b" " + b"y" * 32 + b" " + b"x" * 65 + b"\n", b"yx " * 9]
    code = cm.prefix_code(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
    for orders in ((2, 4, 0), (7, 0), (3, 1)):
        own = replace(model, orders=orders)
        s, again = cm.Stream(texts, code, own, 56), cm.Stream(texts * 20, code, own, 56)
        assert len(again.many) == len(s.many) and [len(k) for k in again.keys] == [len(k) for k in s.keys]
        context = Brute([], None, own).context
        place = {}
        for o in range(len(orders)):
            assert len(set(s.keys[o].tolist())) == len(s.keys[o])
            key = s.keys[o][s.entry[o][s.kinds()]].tolist()
            at = iter(key)
            for t in texts:
                for p in range(len(t) + 1):
                    # bytes 0 stand for what is in front of a text
                    c = context(t, p, o)
                    c = (*c[:-1], c[-1].rjust(orders[o], b"\0")) if orders[o] else c
                    assert place.setdefault((c, (t + b"\xff")[p]), k := next(at)) == k
            assert len({k for (c, _), k in place.items() if c[0] == o}) == sum(c[0] == o for c, _ in place)
        use = np.repeat(np.arange(len(texts)) % 3 > 0, s.size)
        keys, n, _ = s.together(use)
        told = Counter(k for o in range(len(orders)) for k in s.keys[o][s.entry[o][s.kinds()[use]]].tolist())
        assert Counter(dict(zip(keys.tolist(), n.tolist()))) - Counter() == told


def test_distinct_keys_come_in_their_order():
    rng = np.random.default_rng(11)
    for key in (rng.integers(0, 50, 1_000), rng.integers(0, 2**62, 1_000), np.zeros(0), np.array([5, 5])):
        own, which = cm.find(key.astype(np.uint64))
        assert own.tolist() == [*dict.fromkeys(key.astype(np.uint64).tolist())] and (own[which] == key.astype(np.uint64)).all()


def test_distinct_keys_whose_hashes_differ_in_the_lowest_bits_alone(monkeypatch):
    monkeypatch.setattr(cm, "mix", lambda x, salt=0: x)
    key = np.array([3, 1, 3, 2, 1, 900], np.uint64)
    own, which = cm.find(key)
    assert own.tolist() == [3, 1, 2, 900] and (own[which] == key).all()
