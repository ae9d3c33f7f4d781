import numpy as np

from cadenza.llm import embeddings


def plain(rows, cosine=0.98):
    good = {}
    for key, e, label in rows:
        x = np.array([np.nan if v is None else v for v in e] if e is not None else [np.nan], float)
        if label is not None and np.isfinite(x).all() and (x != 0).any():
            good.setdefault((label, len(x)), []).append((key, x / np.linalg.norm(x)))
    links, least = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    for own in good.values():
        v = np.stack([x for _, x in own])
        close = v @ v.T >= cosine
        for i, (key, _) in enumerate(own):
            links[key] = int(close[i].sum()) - 1
        part = np.array([k for k, _ in own])
        while True:
            low = np.where(close, part[None, :], part.max()).min(1)
            if (low == part).all():
                break
            part = low
        least.update({k: int(p) for (k, _), p in zip(own, part, strict=True)})
    return {k: (links[k], least[k], least[k] == k) for k in links}


def found(df):
    return {r[0]: (r[1], r[2], r[3]) for r in embeddings.near_vectors(df).collect()}


def test_recall(spark):
    """Clusters whose members are near the threshold: what is found is right, and at least 0.99 of all links are."""
    rng = np.random.default_rng(0)
    rows = []
    for k in range(60):
        centre = rng.normal(size=32)
        for _ in range(rng.integers(1, 40)):
            x = centre / np.linalg.norm(centre) + rng.normal(size=32) * 0.14 / np.sqrt(32)
            rows.append((len(rows), [float(np.float32(v)) for v in x], int(k % 3)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    want, got = plain(rows), found(df)
    total = sum(v[0] for v in want.values())
    assert total > 1000 and sum(v[0] for v in got.values()) >= 0.99 * total
    assert all(got[k][0] <= want[k][0] for k in want)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert found(df) == plain([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 2.0, 3.0]]
    rows = [(k, e, 1) for k, e in enumerate(odd)] + [(20, [1.0, 1.0], None), (21, [1.0, 1.0], None), (22, [3.0, 0.0], 2)]
    rows += [(30 + k, [1.0, 0.001 * k], 1) for k in range(60)] + [(100 + k, [1.0, 1.0], 1) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = plain(rows)
    assert found(df.withColumn("n", df["vec_id"])) == want and want[100][0] == 29
    assert found(df.limit(0)) == {}
    assert found(df.where("vec_id = 1")) == {1: (0, 1, True)}
