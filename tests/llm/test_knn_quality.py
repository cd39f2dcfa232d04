import numpy as np
from pyspark.sql import functions as F

from skein.llm import knn_quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = knn_quality.digest(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    r = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = r.score[r.quality == 1].to_numpy(), r.score[r.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.9
    assert (r.predicted == r.quality).mean() > 0.85


def test_votes_are_exact_and_edges_defined(docs, none, spark):
    raw = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    same = spark.createDataFrame([(900 + k, "one text that many labelled rows share, word for word.") for k in range(60)], "doc_id long, text string")
    df = raw.unionByName(same).repartition(7)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    y = {i: float(i % 3 == 0) for i in texts if i % 2 == 0 or i >= 900}
    labels = spark.createDataFrame([(i, int(v)) for i, v in y.items()], "doc_id long, quality int")
    every = lambda key: F.lit(True)
    got = {r.doc_id: r.score for r in knn_quality.score(df, labels, every).collect()}
    v, ids = knn_quality.Voting(), sorted(texts)
    place = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    learned = sorted(y, key=place.get)
    x = {i: knn_quality.features([texts[i].encode()], v.scales)[0].astype(float) for i in ids}
    train = np.stack([x[i] for i in learned])
    basis = np.linalg.eigh(train.T @ train)[1][:, ::-1][:, : v.dims]
    unit = lambda z: z / max(np.linalg.norm(z), 1e-12)
    known = np.stack([unit(x[i] @ basis) for i in learned])
    near_ties = 0
    for i in ids:
        q = x[i] @ basis
        if np.linalg.norm(q) <= 1e-9:
            assert abs(got[i] - np.mean(list(y.values()))) < 1e-6
            continue
        c = known @ unit(q)
        order = sorted(range(len(c)), key=lambda k: (-round(c[k], 6), k))
        if abs(c[order[v.neighbours - 1]] - c[order[v.neighbours]]) < 3e-6 and i < 900:
            near_ties += 1  # rounding may tell these apart otherwise
            continue
        own = order[: v.neighbours]
        w = np.maximum(c[own], 0) ** v.sharpness + 1e-12
        assert abs(got[i] - (w * np.array([y[learned[k]] for k in own])).sum() / w.sum()) < 2e-3
    assert near_ties < len(ids) / 10
    again = {r.doc_id: r.score for r in knn_quality.score(df.repartition(3), labels, every).collect()}
    assert again == got
    assert knn_quality.score(docs, labels, every).count() == docs.count()
    assert knn_quality.score(none, labels, every).count() == 0
    assert {r.score for r in knn_quality.score(docs, labels.where("false"), every).collect()} == {0.5}


def test_scores_do_not_follow_blocks(docs):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    labels = rows.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"))
    scores = [dict(map(tuple, knn_quality.score(rows.repartition(n), labels, lambda key: F.lit(True)).collect())) for n in (1, 3, 40)]
    assert len(scores[0]) == rows.count() and scores[1] == scores[0] and scores[2] == scores[0]


def test_products_lose_no_bit():
    rng = np.random.default_rng(2)
    x, basis = knn_quality._fine(rng.random((9, 1027)) / 20), knn_quality._fine(np.linalg.qr(rng.normal(size=(1027, 48)))[0])
    exact = [[sum(int(a * knn_quality.FINE) * int(b * knn_quality.FINE) for a, b in zip(u, v)) for v in basis.T] for u in x]
    assert (x @ basis * float(knn_quality.FINE) ** 2 == np.array(exact, float)).all()
