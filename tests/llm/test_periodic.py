"""Runs of words against a plain version, work that grows with the length, and the query's digests."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import periodic


def plain(w, least=12):
    """Stretches of matches at each distance, of which the smallest period is kept."""
    found, n = {}, len(w)
    for p in range(1, n // 2 + 1):
        at = 0
        while at + p < n:
            to = at
            while to + p < n and w[to] == w[to + p]:
                to += 1
            if to + p - at >= max(least, 2 * p):
                found.setdefault((at, to + p - at), p)
            at = to + 1
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 4), st.integers(2, 12))
def test_runs(words, times, least):
    assert periodic.runs_of(words * times, least) == plain(words * times, least)


def strings(n):
    fib, low = [1], [0]
    while len(fib) < n:
        fib, low = fib + low, fib
    square = [0]
    while len(square) < n:
        square = square + square + [max(square) + 1]
    rng = random.Random(3)
    two = [rng.randint(0, 1) for _ in range(n)]
    block = [rng.randint(0, 3) for _ in range(n // 7)]
    yield from (fib[:n], [bin(k).count("1") % 2 for k in range(n)], [0] * n, [0, 1] * (n // 2), square[:n], square[:n][::-1], two, block * 7, list(range(n)))
    yield [int(k % 97 == 0) for k in range(n)]
    yield [k & -k for k in range(1, n)]


class Counted(int):
    """A number that counts how often it is compared."""

    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


def test_work_grows_with_the_length():
    for k, (small, large) in enumerate(zip(strings(2000), strings(16000), strict=True)):
        assert periodic.runs_of(small) == plain(small)
        for words in (small, large):
            Counted.seen = 0
            top = max(words)
            for order in (words, [top - x for x in words]):
                periodic.lyndon_array([Counted(x) for x in [*order, -1]], len(words))
            assert Counted.seen <= 10 * len(words), k


def test_numbers():
    words = "a b a ab abcdefgh abcdefghi abcdefgh a\x00 a\x00\x00 é éé abcdefghijklmnopqrstuvwx abcdefghijklmnopqrstuvwy abcdefghi".encode().split(b" ")
    data = b" ".join(words)
    import numpy as np

    starts, ends, _ = periodic.split_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    got = periodic.numbered(np.frombuffer(data, np.uint8), starts, ends).tolist()
    assert [[x == y for x in words] for y in words] == [[x == y for x in got] for y in got]


def whole(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain(w)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (len(runs), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None)
    return (key, *head, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark, docs):
    got = periodic.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    short = {r["doc_id"]: r["text"] for r in docs.collect() if len(r["text"] or "") < 8000}
    assert len(got) == docs.count() and len(short) > 150
    assert sorted(tuple(r) for r in got if r["doc_id"] in short) == sorted(whole(k, x) for k, x in short.items())
    assert sum(r["n_runs"] > 0 for r in got) > 10


def test_edges(spark, edge, empty):
    assert periodic.find_runs(empty).collect() == []
    got = periodic.find_runs(edge.where("doc_id <> 8 and doc_id <> 9")).collect()
    assert sorted(repr((r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "").strip())) for r in edge.where("doc_id not in (8, 9)").collect()) == sorted(
        repr((r["doc_id"], r["collapsed"])) for r in got
    )
    long = {r["doc_id"]: r for r in periodic.find_runs(edge).collect()}
    assert [tuple(x) for x in long[8]["runs"]] == [(0, 30000, 1)] and long[8]["collapsed"] == "word" and long[9]["runs"] == []
    big = 2**60
    rows = [(big + 1, "x y " * 6), (None, "a " * 12), (big + 3, "x y z " * 3 + "x y z"), (5, "q " * 11), (5, "q " * 11), (6, "a a a b a a a b a a a b   c")]
    got = periodic.find_runs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert [(r["doc_id"], r["n_words"]) for r in got] == [(k, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in rows]
    assert [[tuple(x) for x in r["runs"]] for r in got] == [plain(re.findall(r"[^\x20\x09-\x0D]+", x)) for _, x in rows]
