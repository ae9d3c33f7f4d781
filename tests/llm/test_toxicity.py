import numpy as np

from cadenza.llm import toxicity

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").selectExpr("doc_id", "1 - quality as junk", "toxic")
    found = toxicity.score_documents(docs, labels.where("doc_id % 4 <> 0"), ("junk", "toxic")).join(
        labels.where("doc_id % 4 = 0").withColumnRenamed("toxic", "gold"), "doc_id"
    )
    rows = found.collect()
    assert np.mean([r["flagged"] == bool(r["gold"]) for r in rows]) >= 0.85
    assert np.mean([(r["p_junk"] >= 0.5) == bool(r["junk"]) for r in rows]) >= 0.9


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(6, 1, 0), (9, None, 1), (77, 1, 1), (None, 0, 0), (9, None, 1)], "doc_id long, junk int, toxic int")
    found = toxicity.score_documents(edge, labels, ("junk", "toxic"))
    assert found.count() == edge.count() and found.where("p_toxic is null").count() == 0
    assert toxicity.score_documents(empty, labels, ("junk", "toxic")).collect() == []
    assert toxicity.score_documents(edge, labels.limit(0), ("junk", "toxic")).where("flagged").count() == 0


def test_large_ids_and_labels_that_clash(spark):
    big = 2**60
    rows = [(big + 1, "a bad word"), (None, "x"), (big + 3, "a good word")] + [(k, "bad " * k if k % 2 else "good " * k) for k in range(1, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = [(k, k % 2) for k in range(1, 40)] + [(5, 0), (8, 0), (5, 0)]
    first, again = (
        sorted(map(repr, toxicity.score_documents(df, spark.createDataFrame(x, "doc_id long, toxic int"), ("toxic",)).collect()))
        for x in (labels, labels[::-1])
    )
    assert first == again and sum(str(big + 1) in r or str(big + 3) in r for r in first) == 2 and len(first) == len(rows)


def test_chain_uses_earlier_categories():
    """The second label is the first one, which the features show only in part: out-of-fold probabilities carry over."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    first = (x[:, 0] > 0).astype(float)
    y = np.stack([first, first], 1)
    models = toxicity.fit_chain(x, y, np.arange(400) % 4)
    assert len(models[1]) == len(models[0]) + 1 and models[1][3] > 0
    assert ((toxicity.run_chain(x, models)[:, 1] >= 0.5) == first).mean() > 0.97


def test_one_class():
    w = toxicity.fit_logistic(np.ones((4, 2)), np.zeros(4))
    assert (toxicity.predict(np.ones((2, 2)), w) < 0.01).all()
