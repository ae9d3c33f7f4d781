import random
import re

from cadenza.llm import ngram_join


def plain(rows):
    """Components by comparing every pair."""
    sets, out = {}, {}
    for key, text in rows:
        w = [x.encode().lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for k in keys:
        out[k] = (len(sets[k]), root(k))
    return out


def found(df):
    return {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_components(df).collect()}


def test_documents(spark, docs):
    assert found(docs) == plain(docs.select("doc_id", "text").collect())


def test_edges(edge, empty):
    want = plain([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert found(edge) == want and want[6] == want[7] == (2, 6)
    assert ngram_join.jaccard_components(edge).count() == edge.count()
    assert ngram_join.jaccard_components(empty).collect() == []


def test_chains_and_shared_passages(spark):
    """Near copies around the threshold, chains of them, and a passage that many short documents share."""
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=14))
    rows = []
    for base in range(6):
        text = rng.choices(vocabulary, k=rng.randint(20, 60))
        for _ in range(25):
            text = list(text)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    for _ in range(60):
        rows.append((2000 + len(rows), passage + " " + " ".join(rng.choices(vocabulary, k=rng.randint(0, 6)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == plain(rows)


def test_null_key(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert found(df) == {None: (2, None), 2: (2, 2)}


def test_broadcasts_stay_small(spark):
    """The driver holds what it sends; ids or wide rows beyond a few MB are joined by hash."""
    sent = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert sent(ngram_join._small(spark.range(1_000))) and not sent(ngram_join._small(spark.range(300_000)))
    assert not sent(ngram_join._small(spark.range(50_000), ngram_join.WIDE))
