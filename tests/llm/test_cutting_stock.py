"""Cutting-stock packing: pieces against the tokenizer, places without gaps, the program against bounds."""

import itertools
import zlib

import numpy as np
from tokenizers import Tokenizer

from cadenza.llm import cutting_stock, packing

SIZES = cutting_stock.length_classes(2048)


def check(df, capacity=2048):
    """Number of sequences and the least there could be."""
    rows = cutting_stock.pack_documents(df, capacity=capacity).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = {}
    for r in df.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want.setdefault((r["doc_id"], ids), 0)
        want[r["doc_id"], ids] += 1
    total, by = 0, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
        total += r["length"]
    # Each key's parts, put together by their starts, are its texts.
    for (key, n), parts in by.items():
        texts = [ids for (k, ids), times in want.items() if k == key and len(ids) == 4 * n for _ in range(times)]
        assert sum(len(x) for _, x in parts) == sum(map(len, texts))
        for start, ids in parts:
            assert any(x[4 * start : 4 * start + len(ids)] == ids for x in texts)
        if len(texts) == 1:
            assert b"".join(x for _, x in sorted(parts)) == texts[0]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in map(sorted, sequences.values()):
        assert [x for x, _ in parts] == [0, *itertools.accumulate(n for _, n in parts[:-1])]
        assert sum(n for _, n in parts) <= capacity
    return len(sequences), -(-total // capacity)


def test_documents(spark, docs):
    n, least = check(docs.repartition(9))
    assert n <= 1.03 * least + 1
    n, least = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    assert n <= 1.015 * least + 1


def test_edges(spark, edge, empty):
    check(edge)
    assert cutting_stock.pack_documents(empty).collect() == []
    big = 2**60
    rows = [(None, "a b"), (big + 1, "c " * 3000), (big + 3, None), (big + 3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    check(df)
    assert {r["doc_id"] for r in cutting_stock.pack_documents(df).collect()} == {k for k, _ in rows}


def test_many_of_one_length(spark):
    """Two texts of 1,101 tokens do not fit into one sequence, so some are cut to fill up others."""
    df = spark.range(900).selectExpr("id as doc_id", "repeat('a ', 1100) as text", "1 as row", "2 as start").repartition(5)
    n, least = check(df)
    assert n <= 1.02 * least + 1


def lengths_of(kind):
    rng = np.random.default_rng(5)
    return {
        "even": rng.integers(1, 2048, 20_000),
        "long": rng.integers(1025, 1400, 8000),
        "one": np.full(5000, 1100),
        "tiny": rng.integers(1, 40, 20_000),
        "few": np.array([2047, 3, 1500, 548, 1]),
        "none": np.zeros(0, np.int64),
    }[kind]


def test_plan():
    for kind in ("even", "long", "one", "tiny", "few", "none"):
        counts = np.bincount(np.searchsorted(SIZES, lengths_of(kind)), minlength=len(SIZES)).astype(np.int64)
        patterns, cuts = cutting_stock.plan(counts, SIZES, 2048)
        want, got = counts.copy(), np.zeros_like(counts)
        for u, a, b, n in cuts:
            assert SIZES[a] < (SIZES[u - 1] + 1 if u else 1) and SIZES[u] - SIZES[a] <= SIZES[b]
            want[u] -= n
            want[a] += n
            want[b] += n
        for pattern, times in patterns:
            assert sum(SIZES[u] * n for u, n in pattern.items()) <= 2048
            for u, n in pattern.items():
                got[u] += n * times
        assert (got == want).all() and (counts >= 0).all()
        n, least = sum(t for _, t in patterns), (counts @ SIZES) / 2048
        assert n <= 1.03 * least + 2, kind


def test_pricing_is_exact():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 5, 7, 11])
    for _ in range(20):
        values = rng.random(4)
        most, patterns = cutting_stock.price(values, sizes, 20)
        every = [sum(n * v for n, v in zip(ns, values)) for ns in itertools.product(range(7), repeat=4) if np.dot(ns, sizes) <= 20]
        assert abs(most - max(every)) < 1e-9
        assert all(sum(sizes[u] * n for u, n in p.items()) <= 20 for p in patterns)


def test_program_finds_the_optimum():
    """Of 10 of 6 and 20 of 3 in sequences of 9, ten are enough; of 6 alone, cuts cost little and save a third."""
    sizes, counts = np.arange(1, 10), np.zeros(9, np.int64)
    counts[[5, 2]] = 300, 300
    assert abs(sum(t for _, t in cutting_stock.solve(counts, sizes, 9)) - 300) < 1
    counts[2] = 0
    found = cutting_stock.solve(counts, sizes, 9)
    cost = sum(t * (1.0 if min(col.values()) > 0 else cutting_stock.CUT_COST) for col, t in found)
    assert abs(cost - (200 + 100 * cutting_stock.CUT_COST)) < 1


def test_a_hot_length_is_ranked_in_buckets(docs, monkeypatch):
    monkeypatch.setattr(cutting_stock, "BUCKET", 10)
    n, least = check(docs)
    assert n <= 1.03 * least + 1
