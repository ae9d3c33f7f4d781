import re

import numpy as np
import pytest

from cadenza.llm import mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    total = sum(sizes.values())
    while True:
        rest = total - sum(target[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        for s in names:
            if s not in full:
                target[s] = rest * weight[s] / share
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        for s in over:
            target[s] = 3.0 * sizes[s]
        full |= over


def check(df, near):
    rows = mixing.mix(df.select("doc_id", "text", "source")).collect()
    sizes = {}
    texts = [(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["source"]) for r in df.collect()]
    for _, n, s in texts:
        sizes[s] = sizes.get(s, 0) + n
    assert sorted(map(repr, texts)) == sorted(repr((r["doc_id"], r["size"], r["source"])) for r in rows)
    want = plain_targets(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        taken = sum(r["size"] * r["copies"] for r in own)
        assert all(r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s] for r in own)
        assert all(0 <= r["copies"] <= 3 for r in own)
        # Within near of the target; a source of a few texts, one of which outweighs the others, within half of that.
        some = [r["size"] for r in own if r["size"]]
        assert abs(taken - want[s]) <= max(near * want[s], 0.5 * (max(some) if 2 * max(some) > sum(some) or len(some) < 10 else min(some)) + 1e-6 if some else 0)
    again = mixing.mix(df.select("doc_id", "text", "source").repartition(3)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_documents(spark, docs):
    check(docs, 0.05)
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 0.01)


def test_large_ids_beside_a_null(spark):
    big = 2**60
    rows = [(big + 1, "a b c", "x"), (None, "a b", "x"), (big + 3, "a", "x"), (None, "a b", "x"), (0, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    assert sorted(repr(r["doc_id"]) for r in mixing.mix(df).collect()) == sorted(repr(k) for k, *_ in rows)


def test_edges(edge, empty):
    check(edge.drop("size", "n", "component"), 0.02)
    assert mixing.mix(edge).count() == edge.count()
    assert mixing.mix(empty).collect() == []


def test_limit(spark):
    rows = [(1, "a " * 10, "s0"), (2, "b " * 10, "s1"), (3, "c " * 1000, "s2"), (4, "d", None)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), 0.01)


def test_tree(spark):
    """Many small groups, so that residuals climb several levels."""
    rng = np.random.default_rng(1)
    rows = [(i, "a " * int(rng.integers(1, 60)), "hot" if i % 3 else f"s{i % 5}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    old = mixing.GROUP, mixing.FAN_IN
    sizes = df.selectExpr("source", "doc_id as key", "false as nokey", "cast(length(text) / 2 as long) as size", "0.37D as p", "1000L as n")
    try:
        mixing.FAN_IN = 4
        got = mixing.round_copies(sizes, group=16).toPandas()
    finally:
        mixing.GROUP, mixing.FAN_IN = old
    assert len(got) == 1500 and set(got["copies"]) <= {0, 1}
    words = got.assign(t=got["size"] * got["copies"]).groupby("source")[["size", "t"]].sum()
    assert (abs(words["t"] - 0.37 * words["size"]) <= 20).all()


def test_pivot_keeps_the_mean():
    sizes, p = np.array([5.0, 3.0, 9.0, 1.0]), np.array([0.2, 0.9, 0.5, 0.4])
    runs = np.array([mixing.pivot(sizes, p, np.random.default_rng(k)) for k in range(4000)])
    assert np.allclose(runs @ sizes, sizes @ p)
    assert np.allclose(runs.mean(0), p, atol=0.03)
