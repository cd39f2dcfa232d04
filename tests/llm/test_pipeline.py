"""The pipeline's stages on the smallest tables, each against its own input."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import bpe, mixing, pii, quality_rules, simhash
from tests.llm import test_native, test_near_copies


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    kept = corpus_pipeline.quality(spark, docs, sf).cache()
    verdict = {r.doc_id: r for r in quality_rules.line_first(docs).collect()}
    assert kept.columns == cols
    assert {r.doc_id: r.text for r in kept.collect()} == {i: r.clean_text for i, r in verdict.items() if r.kept}

    single = corpus_pipeline.near_duplicates(spark, kept, sf).cache()
    fp = {r.doc_id: simhash.fingerprint(r.text) for r in kept.collect()}
    left = sorted(r.doc_id for r in single.collect())
    assert single.columns == cols and all((fp[a] ^ fp[b]).bit_count() > 4 for a in left for b in left if a < b)

    clean = corpus_pipeline.personal_data(spark, single, sf).cache()
    assert clean.columns == cols and clean.count() == single.count()
    assert pii.digest(clean).where("n_email + n_ip + n_card + n_phone > 0").count() == 0

    mixed = corpus_pipeline.mix(spark, clean, sf).cache()
    share = mixed.selectExpr(f"sum(size(split(text, ' ')))").first()[0] / clean.selectExpr("sum(size(split(text, ' ')))").first()[0]
    assert mixed.columns == cols and mixed.count() == mixed.select("doc_id").distinct().count() and 0.7 < share <= 1

    m = bpe.Merges(bpe.vocabulary_path())
    text = {r.doc_id: r.text for r in mixed.collect()}
    out = corpus_pipeline.encode(spark, mixed, sf).collect()
    assert {r.doc_id: m.decode(__import__("numpy").array(r.ids)) for r in out} == text


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 50 and out.columns == ["doc_id", "n_tokens", "ids"]
    assert len(corpus_pipeline.STAGES) == 5 and mixing.Mix().seed == corpus_pipeline.MIX.seed


def plainly(rows, docs):
    """What run() should give, {doc_id: text}: rules as tested, all pairs for near copies, spans put in by hand, and no budget that binds."""
    kept = [(r.doc_id, r.clean_text) for r in quality_rules.line_first(docs).collect() if r.kept]
    groups = test_near_copies.groups(sorted({(i, t) for i, t in kept if i is not None}))
    kept = {(i, t) for i, t in kept if i is None or groups[i] == i}
    spans = {(r.doc_id, r.t): [(s, e, "id") for s, e in r.id] for r in pii.extract(rows).join(rows.selectExpr("doc_id as d", "text as t"), F.expr("doc_id <=> d")).collect()}
    return {(i, test_native.redacted(t, [(s, e, k) for k, v in test_native.base(t).items() for s, e in v] + spans.get((i, t), []))) for i, t in kept}


def test_run_on_odd_rows_equals_plain_code(spark, docs, tmp_path, monkeypatch):
    nameless = docs.where("doc_id = 4").withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("Nobody gave this text an id, and still it is long enough to be kept, with a mail a.b@c.example.org in it.")})
    docs.union(nameless).drop("n").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "MIX", mixing.Mix(budget_share=2.0, max_epochs=1))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    m = bpe.Merges(bpe.vocabulary_path())
    got = Counter((r.doc_id, m.decode(np.array(r.ids))) for r in out)
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(spark, table, ""), "")
    assert before.columns == table.columns
    assert got == Counter(dict.fromkeys(plainly(before.select("doc_id", "text"), table), 1))
    texts = "".join(t for _, t in got)
    assert "Column<" not in texts and None in {i for i, _ in got}


def test_run_on_an_empty_table(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
