"""States that merge, votes by threshold, batches that fill up, and a table function, against plain Python."""

import math
import random
from collections import Counter

import numpy as np

from cadenza.functions import tables
from cadenza.operators import corpus as C
from cadenza.operators import merging
from cadenza.operators import metrics as M


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(0)
    x = np.append(rng.exponential(3, 1000), [np.nan, np.nan])
    m = merging.Moments()
    for cuts in ([1002], [1, 1, 1000], [500, 502], [0, 1002]):
        parts = [m.start(p) for p in np.split(x, np.cumsum(cuts)[:-1])]
        n, mean, sd, skew = m.finish(m.merge([m.merge(parts[::-1]), m.start(x[:0])]))
        y = x[:1000]
        assert n == 1000 and math.isclose(mean, y.mean()) and math.isclose(sd, y.std())
        assert math.isclose(skew, ((y - y.mean()) ** 3).mean() / y.std() ** 3)
    assert m.finish(m.merge([])) == (0, None, None, None) and m.finish(m.start(np.full(5, 2.0)))[3] is None


def test_states_meet_in_a_tree(spark):
    df = spark.range(0, 3000, 1, 40).selectExpr("if(id < 2000, 'hot', concat('g', id % 3)) as g", "if(id % 50 = 0, null, cast(id as double)) as v")
    got = {r["g"]: r for r in merging.merged_states(df, ["g"], "v", fan_in=3).collect()}
    want = {r["g"]: r for r in df.groupBy("g").agg({"v": "avg", "*": "count"}).collect()}
    exact = {r["g"]: r["n"] for r in df.groupBy("g").agg({"v": "count"}).withColumnRenamed("count(v)", "n").collect()}
    assert set(got) == set(want)
    for g, r in got.items():
        assert r["n"] == exact[g] and math.isclose(r["mean"], want[g]["avg(v)"])
    assert merging.merged_states(df.limit(0), ["g"], "v").collect() == []


def test_votes_by_threshold(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 9), rng.randint(0, 2), float(rng.randint(0, 30))) for k in range(300)]
    rows = [(k, f, f % 3, p, s if f else 1.0) for k, f, p, s in rows]
    df = spark.createDataFrame(rows, "k long, f int, gold int, p int, s double")
    got = {r["threshold"]: tuple(r)[1:] for r in M.voted_sweep(df, "f", "gold", "p", "s", "k", (0, 10, 25, 99)).collect()}
    for t in (0, 10, 25, 99):
        kept = [r for r in rows if r[4] >= t]
        files = {f: Counter(r[3] for r in kept if r[1] == f).most_common(1)[0][0] for f in {r[1] for r in kept}}
        ok = sum(p == f % 3 for f, p in files.items())
        assert got[t] == (len(kept), len(files), ok / max(len(files), 1), ok / len({r[1] for r in rows}))


def test_batches_fill_up(spark):
    rows = [("x", "human", k) for k in range(3)] + [("x", "table", k) for k in range(10, 12)] + [("x", "latest", k) for k in range(20, 30)]
    rows += [("y", "human", 40), ("y", "latest", 41), (None, "human", 50), ("z", "latest", 60)]
    df = spark.createDataFrame([(*r, 16) for r in rows], "g string, role string, id long, size long")
    made = C.mixed_with_backfill(df, ["g"], "role", "id", "size", {"human": (1, 2), "table!": (1, 4)}, "latest").collect()
    n = Counter((r["g"], r["role"]) for r in made)
    # Half from humans again and again; two of four from the table, the other two from the latest besides its own four.
    assert n == {("x", "human"): 8, ("x", "table"): 2, ("x", "latest"): 6, ("y", "human"): 8, ("y", "latest"): 8, (None, "human"): 8, ("z", "latest"): 8}
    for g, role in n:
        own = sorted((r["slot"], r["id"]) for r in made if (r["g"], r["role"]) == (g, role))
        assert [s for s, _ in own] == list(range(n[g, role]))
        times = Counter(k for _, k in own).values()
        assert max(times) - min(times) <= 1


def test_windows_of_songs(spark):
    rng = random.Random(8)
    songs = {s: [rng.choice((0, 0, 0, 1, 5)) for _ in range(rng.choice((0, 3, 16, 17, 18, 40)))] for s in range(25)}
    df = spark.createDataFrame([(s, b, n) for s, own in songs.items() for b, n in enumerate(own)], "song long, bar int, n int").repartition(3)
    tables.register(spark)
    got = spark.sql("select * from song_windows(table(select * from {df}) partition by song order by (bar), 6, 4, 6)", df=df).collect()
    want = []
    for s, own in songs.items():
        for f in range(0, len(own) - 16, 6):
            if sum(own[f + 6 : f + 10]):
                want.append((s, f, sum(own[f : f + 6]), sum(own[f + 6 : f + 10]), sum(own[f + 10 : f + 16])))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 5
