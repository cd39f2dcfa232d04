"""BPE, mixing and SimHash against libraries and brute force."""

from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import bpe, mixing, simhash


def test_bpe_equals_the_library(docs, none):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    t = Tokenizer.from_file(bpe.vocabulary_path())
    expected = Counter((i, tuple(t.encode(x, add_special_tokens=False).ids), x) for i, x in rows)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode(docs, decoded=True).collect()) == expected
    assert bpe.digest(none).count() == 0


def test_bpe_odd_texts():
    m = bpe.Merges(bpe.vocabulary_path())
    t = Tokenizer.from_file(bpe.vocabulary_path())
    odd = ["<|endoftext|>", "x<|endoftext|> y<|endo", "  \n\n a  b\t\tc  ", "abc" * 500, "é" * 999, "I'll don't 12345 中文 🙂", " " * 99]
    assert [x.tolist() for x in m.encode(odd)] == [x.ids for x in t.encode_batch(odd, add_special_tokens=False)]


def test_mixing_budgets(spark):
    rows = [(f"{d}{lang}{i}", "w " * 10, lang, f"s{d}") for d in range(2) for lang in ("en", "fr") for i in range(40 if lang == "en" else 5)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    plan = mixing.Mix(budget_share=0.5, max_epochs=2, temperature=1.0, targets={("domain0",): 1.0, ("domain1",): 3.0})
    out = mixing.mix(df, plan).groupBy("domain").agg(F.sum("n_tokens").alias("n"), F.max("epoch").alias("e"))
    got = {r["domain"]: r["n"] for r in out.collect()}
    assert abs(got["domain0"] - 112.5) <= 20 and abs(got["domain1"] - 337.5) <= 20
    full = mixing.mixed(df, mixing.Mix(budget_share=5.0, max_epochs=2)).groupBy("doc_id").count()
    assert full.where("count <> 2").count() == 0 and full.count() == len(rows)


def test_mixing_targets_on_all_levels(spark):
    rows = [(f"{d}{lang}{i}{s}", "w " * 10, lang, f"{d}{s}") for d in ("web", "books") for lang in ("en", "fr") for s in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    targets = {("web",): 0.75, (mixing.ANY, "en"): 0.8, ("web", "en", "weba"): 0.9, ("books", "fr"): 0.5}
    plan = mixing.Mix(budget_share=0.4, max_epochs=9, targets=targets)
    out = mixing.mix(df, plan, domain=F.regexp_extract("source", "web|books", 0)).groupBy("domain", "row.lang", "row.source").agg(F.sum("n_tokens").alias("n"))
    got = {(r.domain, r.lang, r.source): r.n for r in out.collect()}
    total = 0.4 * 4000
    expected = {("web", "en", "weba"): 0.75 * 0.8 * 0.9, ("web", "en", "webb"): 0.75 * 0.8 * 0.1, ("web", "fr", "weba"): 0.75 * 0.2 * 0.5, ("books", "fr", "booksb"): 0.25 * 0.5 / (0.5 + 0.8) * 0.5}
    assert all(abs(got[k] - x * total) <= 10 for k, x in expected.items())


def test_mixing_edges(docs, none):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() > 0 and out.where("rest <> 'rest' or domain <> 'domain'").count() == 0
    assert mixing.digest(none).count() == 0


def brute_components(fp):
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fp))]


def test_simhash(docs, none):
    rows = [(r.doc_id, simhash.fingerprint(r.text or "")) for r in docs.select("doc_id", "text").collect()]
    root = brute_components([f for _, f in rows])
    low = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    expected = Counter((i, f"{f:016x}", low.get(r)) for (i, f), r in zip(rows, root))
    assert Counter(tuple(r) for r in simhash.digest(docs).collect()) == expected
    assert simhash.digest(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(low.values())) + 1


def test_xxh64_is_sparks(spark):
    import xxhash

    s = "the quick brown fox"
    h = spark.range(1).select(F.xxhash64(F.lit(s))).first()[0]
    assert h % 2**64 == xxhash.xxh64_intdigest(s.encode(), 42)
