import zlib

import numpy as np
from tokenizers import Tokenizer

from cadenza.llm import packing


def check(df, capacity=4096):
    rows = packing.pack(packing.token_pieces(df, capacity=capacity), capacity=capacity).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for r in df.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((r["doc_id"], k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted(want) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(w[3] for w in want) // capacity)


def test_documents(docs):
    n, least = check(docs.repartition(40))
    assert n <= 1.02 * least + 1
    n, least = check(docs.repartition(7), capacity=300)
    assert n <= 1.02 * least + 1


def test_all_underfull_bins_are_handed_on(spark, monkeypatch):
    """Pairs of 1,500 leave room for 1,000, which only other partitions have."""
    for partitions, group in ((3, packing.GROUP), (3, 5000), (40, 5000)):
        monkeypatch.setattr(packing, "GROUP", group)
        pieces = spark.range(0, 45_000, 1, partitions).selectExpr("id", "if(id < 30000, 1500L, 1000L) as length")
        rows = packing.pack(pieces).collect()
        assert sorted((r["id"], r["length"]) for r in rows) == [(k, 1500 if k < 30_000 else 1000) for k in range(45_000)]
        sequences = {}
        for r in rows:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in map(sorted, sequences.values()):
            assert [x for x, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
            assert sum(n for _, n in parts) <= 4096
        assert len(sequences) <= 1.02 * 15_000


def test_edges(edge, empty):
    check(edge)
    assert packing.pack(packing.token_pieces(empty)).collect() == []


def test_large_ids_beside_a_null(spark):
    big = 2**60
    rows = [(big + 1, "a"), (None, "b"), (big + 3, "c")]
    got = packing.pack(packing.token_pieces(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))).collect()
    assert {r["doc_id"] for r in got} == {k for k, _ in rows}


def test_best_fit():
    bins, offsets, fills = packing.best_fit(np.array([6, 5, 5, 4]), 10)
    assert fills.tolist() == [10, 10] and bins[0] == bins[3] and bins[1] == bins[2] and offsets[3] == 6


def test_ids(docs):
    r = packing.token_pieces(docs.where("doc_id = 1"), with_ids=True).first()
    assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]


def test_pieces_of_two_partitions(spark):
    """Two of 1,990 in one partition must not shut out those of 2,100 in another."""
    pieces = spark.range(0, 40_000, 1, 2).selectExpr("id", "if(id < 20000, 2100L, 1990L) as length")
    assert packing.pack(pieces).select("sequence_id").distinct().count() == 20_000


def test_clashing_names(spark):
    pieces = spark.range(0, 50, 1, 3).selectExpr("id", "100L as length", "'x' as offset", "1 as sequence_id", "2 as up", "3 as bin", "4 as fill")
    rows = packing.pack(pieces).collect()
    assert len(rows) == 50 and {(r["up"], r["bin"], r["fill"]) for r in rows} == {(2, 3, 4)}
    assert sorted(r["offset"] % 100 for r in rows) == [0] * 50


def test_words_and_texts_have_equal_ids():
    """The table of words against the tokenizer itself, on texts where they could differ."""
    path = packing.default_tokenizer()
    texts = ["Don't THE. Ab,c .. , A.", "cafÉ İx “x”. Kelvin é", "Foo <|EndOfText|> bar", "a <|endoftext|> B", "...a., 12.5 x1  y z", "", None]
    raw = [None if x is None else x.encode() for x in texts]
    assert packing.splits_words(path)
    assert packing.WordIds(path).encode(raw) == packing.TextIds(path).encode(raw)


def test_another_tokenizer(docs):
    """A file that is not split at white space is encoded text by text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing.splits_words(path)
    tokenizer = Tokenizer.from_file(path)
    for r in packing.token_pieces(docs.limit(20), tokenizer=path, capacity=10**9).collect():
        text = docs.where(f"doc_id = {r['doc_id']}").first()["text"] or ""
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())


def test_the_table_of_words_is_bounded(docs, monkeypatch):
    """A table that overflows, and a batch with more words than it may hold, give the same ids."""
    monkeypatch.setattr(packing, "CACHE", 1 << 10)
    path = packing.default_tokenizer()
    raw = [(r["text"] or "").encode() for r in docs.select("text").limit(60).collect()]
    words = packing.WordIds(path)
    want = packing.TextIds(path).encode(raw)
    assert words.encode(raw) == want and [words.encode([x])[0] for x in raw] == want
