import random
import re

from pyspark.sql import functions as F

from cadenza.llm import lines


def edit(a, b):
    """Whether two lists of words are within one edit, by the definition."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain(rows, min_words=5, near_words=10):
    """Lines removed: {(doc, line number): near}."""
    every = []
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((text or "").split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", line)
            if len(w) >= min_words:
                every.append((doc, k, line, w))
    first, gone, near = {}, {}, set()
    for doc, k, line, w in every:
        first.setdefault(line, (doc, k, w))
    distinct = list(first.items())
    for j, (line, (_, _, w)) in enumerate(distinct):
        if len(w) >= near_words:
            for _, (_, _, v) in distinct[:j]:
                if len(v) >= near_words and edit(w, v):
                    near.add(line)
                    break
    for doc, k, line, _ in every:
        if line in near:
            gone[doc, k] = True
        elif first[line][:2] != (doc, k):
            gone[doc, k] = False
    return gone


def found(df):
    return {(r[0], r[1]): r[2] for r in lines.duplicate_lines(df).collect()}


def test_documents(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = plain(rows)
    assert found(docs) == want and want
    out = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    for doc, text in rows:
        kept = [x for k, x in enumerate(text.split("\n")) if (doc, k) not in want]
        assert out[doc]["text"] == "\n".join(kept)
        assert out[doc]["n_exact"] + out[doc]["n_near"] == len(text.split("\n")) - len(kept)


def test_edits(spark):
    """Chains of edits, insertions at both ends, and a group that agrees but for one word."""
    rng = random.Random(5)
    rows = []
    for base in range(5):
        w = [f"w{rng.randrange(50)}" for _ in range(rng.randint(9, 14))]
        for _ in range(30):
            v = list(w)
            kind = rng.randrange(4)
            at = rng.randrange(len(v))
            if kind == 0:
                v[at] = f"x{rng.randrange(9)}"
            elif kind == 1:
                v.insert(rng.choice((0, at, len(v))), "new")
            elif kind == 2:
                del v[rng.choice((0, at, len(v) - 1))]
            if rng.random() < 0.3:
                w = v
            rows.append((rng.randrange(10**6), " ".join(v) + "\nshort line\n" + f"page {base} of the one same book number {rng.randrange(4)} here it is"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == plain(rows)


def test_edges(edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert found(edge) == plain(rows)
    out = lines.dedup_lines(edge)
    assert out.count() == edge.count() and out.where("doc_id = 1").first()["text"] is None
    assert found(empty) == {}
    nulls = edge.where("doc_id = 6").limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    assert found(nulls.union(edge.where("doc_id = 6"))) == {(6, 0): False}


def test_white_space_and_long_lines(spark):
    """Words count, not what stands between them; a long line is compared as a short one."""
    w = [f"w{k}" for k in range(3000)]
    other = [*w[:1700], "changed", *w[1701:]]
    rows = [
        (1, "one two three four five six seven eight nine ten eleven"), (2, " one two  three four\tfive six seven eight nine ten eleven\x0b"),
        (3, "one two three four five six seven eight nine ten"), (4, "\r\n  \n" + " ".join(w)), (5, " ".join(other)), (6, " ".join(w[1:])),
        (2**40, "one two three four five six seven eight nine ten eleven"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows)
    assert found(df) == want and {d for d, _ in want} == {2, 3, 5, 6, 2**40}


def test_variants_of_shared_halves_only(spark):
    """A word is left out where an edit can be: outside of the half that another line shares."""
    w = [f"w{k}" for k in range(40)]
    rows = [(1, w, True, False), (2, w[:39], False, True), (3, w, True, True)]
    df = spark.createDataFrame(rows, "at long, w array<string>, head boolean, tail boolean")
    places = {at: sorted(r["i"] for r in lines.variants(df).where(F.col("at") == at).collect()) for at in (1, 2, 3)}
    assert places == {1: list(range(19, 40)), 2: list(range(20)), 3: list(range(40))}


def test_edits_at_every_place(spark):
    """Pairs of 10 to 13 words, one of them changed, left out or added, at each place."""
    rows = []
    for n in range(10, 14):
        for at in range(n + 1):
            w = [f"n{n}p{at}w{k}" for k in range(n)]
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join([*w[:at], "other", *w[at + 1 :]])), (len(rows) + 2, " ".join(w[:at] + w[at + 1 :])), (len(rows) + 3, " ".join([*w[:at], "added", *w[at:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows)
    assert found(df) == want and len(want) > 100
