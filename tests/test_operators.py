"""Hand-made cases for the operators, and streams against batches."""

from pyspark.sql import functions as F

from cadenza.functions import scalars as X
from cadenza.functions import vocab
from cadenza.operators import corpus as C
from cadenza.operators import metrics as M
from cadenza.operators import notes as N
from cadenza.operators import sequences as S
from cadenza.plans.telemetry import alerts
from cadenza.streaming import telemetry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_vocabulary(spark):
    v = vocab.vocabulary(spark)
    assert v.count() == 694 and v.agg(F.countDistinct("token_id")).first()[0] == 694
    assert v.where("token_id = 209").first()["kind"] == "pitch"


def test_tokens_round_trip(spark):
    rows = [("a", 0, 3, 60, 10), ("a", 0, 3, 64, 10), ("a", 2, 95, 0, 1), ("a", 5, 0, 126, 287)]
    notes = spark.createDataFrame(rows, "song string, measure int, shift int, pitch int, dur int")
    seq = N.notes_to_tokens(notes, ["song"])
    back = N.tokens_to_notes(seq, ["song"]).collect()
    # The parser counts bars from the first bar token, so bars 0 and 1 are one to it.
    assert sorted(tuple(r) for r in back) == sorted((a, max(m - 1, 0), *r) for a, m, *r in rows)
    assert seq.first()["tokens"][-1] == vocab.TE


def test_bars_are_common_to_parts(spark):
    """Bar 0 has no bar token; each bar line passed gives one, bars without notes a blank."""
    rows = [("a", 0, 0, 60, 5), ("b", 1, 0, 60, 5), ("c", 3, 0, 60, 5)]
    seq = N.notes_to_tokens(spark.createDataFrame(rows, "song string, measure int, shift int, pitch int, dur int"), ["song"])
    note = [51, 269, 342, 627]
    assert {r["song"]: r["tokens"] for r in seq.collect()} == {"a": note, "b": [49, *note], "c": [49, 50, 49, 50, 49, *note]}


def test_half_open_pitch(spark):
    seq = spark.createDataFrame([("a", [49, 51, 336, 340, 51, 209, 340, 340])], "song string, tokens array<int>")
    assert [tuple(r) for r in N.tokens_to_notes(seq, ["song"]).collect()] == [("a", 0, 0, 0, 3)]


def test_budget_takes_the_crossing_row(spark):
    m = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "song long, tokens long")
    got = C.budget_prefixes(m, [7, 1000]).orderBy("cum").collect()
    assert [r["budget"] for r in got] == [7, 7, 1000] and [r["cum"] for r in got] == [5, 10, 15]


def test_running_total_is_exact(spark):
    rows = spark.range(3000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 7).alias("n"))
    got = {r["id"]: r["cum"] for r in C.running_total(rows, "h", "id", "n").collect()}
    total = 0
    for r in sorted(rows.collect(), key=lambda r: (r["h"], r["id"])):
        total += r["n"]
        assert got[r["id"]] == total


def test_allocation(spark):
    g = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "name string, w double")
    assert [r["alloc"] for r in C.largest_remainder(g, 10, "w", "name").orderBy("name").collect()] == [4, 3, 3]


def test_durations_and_keys(spark):
    assert one(spark, X.clamp_duration(F.lit(0), F.lit(400))) == 287 and one(spark, X.clamp_duration(F.lit(5), F.lit(5))) == 1
    key = lambda t, m: (F.lit(t), F.lit(m))
    c = key(0, False)
    pairs = ((0, False, 1.0), (7, False, 0.5), (9, True, 0.3), (0, True, 0.2), (2, False, 0.0))
    assert [one(spark, X.mirex(*c, *key(t, m))) for t, m, _ in pairs] == [s for *_, s in pairs]
    assert [one(spark, X.fold_pitch(F.lit(p))) for p in (-1, 0, 127, 128, 141)] == [11, 0, 127, 116, 117]


def test_md5_mod_equals_python(spark):
    import hashlib

    for text in ("0", "abc", "ñ"):
        assert one(spark, X.md5_mod(F.lit(text), 1000)) == int(hashlib.md5(text.encode()).hexdigest(), 16) % 1000


def test_labels_and_smoothing(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    cases = ((("PAST", "FUTURE", "CONST"), "infill"), (("CONST",), "uncond"), (("PAST", "META"), "analysis"), (("FUTURE", "CONST"), "anticipation"))
    assert [one(spark, S.direction(arr(*b))) for b, _ in cases] == [x for _, x in cases]
    assert one(spark, S.smoothed(arr("A", "B", "C"), arr(2, 1, 2), 2)) == ["A", "C", "C"]
    assert one(spark, S.smoothed(arr("A", "B"), arr(2, 1), 2)) == ["A", "A"]


def test_metrics(spark):
    h = spark.createDataFrame([(k, p) for k, p in enumerate([0.5, 0.5, 0.0, 0.0])], "bin int, p double")
    o = spark.createDataFrame([(k, p) for k, p in enumerate([0.0, 0.0, 0.5, 0.5])], "bin int, p double")
    assert abs(M.js_divergence(h, h, []).first()["js"]) < 1e-9 and abs(M.js_divergence(h, o, []).first()["js"] - 1) < 1e-6
    w = spark.createDataFrame([("g", 0, 0), ("g", 3, 1)], "g string, v int, side int")
    assert M.wasserstein(w, ["g"], "v", "side").first()["w1"] == 3
    same = spark.createDataFrame([("g", 0.5, k % 2) for k in range(6)], "g string, s double, y int")
    assert M.auc(same, ["g"], "s", "y").first()["auc"] == 0.5


def test_windows_need_one_bar_more(spark):
    bars = lambda n: spark.range(n).selectExpr("'a' as song", "cast(id as int) as bar", "1 as n")
    assert N.windows(bars(12), ["song"], 4, 4, 4).count() == 0
    assert N.windows(bars(13), ["song"], 4, 4, 4).count() == 12


def test_alert_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    stream = telemetry.alert_stream(telemetry.event_stream(spark, f"{tmp_path}/in", events.schema, 100), late="30 days")
    q = stream.writeStream.format("memory").queryName("alerts").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in alerts(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").collect()}
    assert {tuple(r) for r in spark.table("alerts").collect()} == want


def test_replay_pool_keeps_the_smallest(spark, tmp_path):
    items = spark.range(60).selectExpr("if(id % 2 = 0, 'a', 'b') as source", "concat('s', id) as seq", "abs(hash(id)) % 1000 * 100 + id as rank")
    items.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = telemetry.replay_pool(telemetry.event_stream(spark, f"{tmp_path}/in", items.schema), 5)
    q = stream.writeStream.format("memory").queryName("pool").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("pool").collect()
    for source in ("a", "b"):
        own = [r for r in rows if r["source"] == source]
        last = max(r["seen"] for r in own)
        want = sorted(r["rank"] for r in items.where(F.col("source") == source).collect())[:5]
        assert last == 30 and sorted(r["rank"] for r in own if r["seen"] == last) == want


def test_forgetting_pool(spark, tmp_path):
    """Rounds of 40 new items a source: 20 at first, then a quarter goes and as many as there is room for come."""
    schema = "source string, seq string"
    for k in range(3):
        rows = [("a" if i % 2 else "b", f"{k}-{i}") for i in range(80)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = telemetry.forgetting_pool(telemetry.event_stream(spark, f"{tmp_path}/in", schema), 20)
    q = stream.writeStream.format("memory").queryName("rounds").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    pools: dict = {}
    for r in spark.table("rounds").collect():
        pools.setdefault((r["source"], r["round"]), set()).add(r["seq"])
    for source in ("a", "b"):
        first, second, third = (pools[source, k] for k in range(3))
        assert len(first) == 20 and len(second & first) == 15 and len(second) == 20 and len(third & second) == 15 and len(third) == 20


def test_direction_labels(spark):
    """One order for each label, and those in which music stands before META."""
    cases = {
        "PAST,META,CONST": "analysis", "CONST,META": "analysis", "META,PAST": "no_target", "META": "no_target", "PAST,CONST,FUTURE": "continuation",
        "PAST,FUTURE,CONST": "infill", "FUTURE,CONST": "anticipation", "META,CONST": "meta_gen", "CONST": "uncond", "PAST": "no_target", "META,PAST,CONST": "continuation",
    }
    df = spark.createDataFrame([(k, k.split(",")) for k in cases], "k string, b array<string>")
    assert {r["k"]: r["x"] for r in df.select("k", S.direction(F.col("b")).alias("x")).collect()} == cases


def test_smoothing_of_single_runs(spark):
    df = spark.createDataFrame([(1, ["A"], [1]), (2, ["A", "B", "C"], [2, 1, 2]), (3, ["A", "B"], [2, 1]), (4, [], [])], "k int, r array<string>, n array<int>")
    got = {r["k"]: r["x"] for r in df.select("k", S.smoothed(F.col("r"), F.col("n"), 2).alias("x")).collect()}
    assert got == {1: [None], 2: ["A", "C", "C"], 3: ["A", "A"], 4: []}


def test_pairing_is_first_in_first_out(spark):
    """Against a queue, with ends that find nothing open and notes that nothing ends."""
    import random

    rng = random.Random(1)
    rows = [(u, t, t, rng.choice(("on", "off", "off", "other"))) for u in range(8) for t in range(60)]
    df = spark.createDataFrame(rows, "u int, event_id long, s long, kind string").selectExpr("u", "event_id", "kind", "timestamp_seconds(s) as ts")
    want = []
    for u in range(8):
        open_, k = [], 0
        for _, _, t, kind in (r for r in rows if r[0] == u):
            if kind == "on":
                k += 1
                open_.append((k, t))
            elif kind == "off" and open_:
                n, start = open_.pop(0)
                want.append((u, n, start, max(t, start + 1)))
        want += [(u, n, start, max(59, start + 1)) for n, start in open_]
    got = N.paired(df, ["u"], "on", "off").selectExpr("u", "k", "unix_timestamp(start) as a", "unix_timestamp(stop) as b").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_groove(spark):
    def song(name, times):
        return [(name, k, t // 96, t % 96) for k, t in enumerate(times)]

    rows = song("even", [0, 12, 24, 36]) + song("swing", [0, 16, 24, 40, 48]) + song("few", [0, 12]) + song("far", [0, 90, 180])
    df = spark.createDataFrame(rows, "song string, event_id long, measure int, shift int")
    assert {r["song"]: r["groove"] for r in M.groove(df, ["song"]).collect()} == {"even": "even", "swing": "swing", "few": "undetermined", "far": "undetermined"}


def test_rank_and_similarity_rewards(spark):
    r = lambda rank, n: one(spark, X.rank_reward(F.lit(rank).cast("int"), F.lit(n), 1.0, 0.5))
    assert [r(1, 24), r(2, 24), r(24, 24), r(None, 24), r(3, 3), r(1, 2), r(2, 2), r(5, 4)] == [1.0, 0.0, -0.5, -0.5, -0.5, 1.0, 0.0, -0.5]
    s = lambda x: one(spark, X.similarity_reward(F.lit(x)))
    assert s(0.3) == 0 and s(0.5) == 0 and abs(s(1.0) + 0.5) < 1e-12 and abs(s(0.75) + 0.25) < 1e-12
    assert one(spark, X.discriminator_reward(F.lit(4.0))) == 0 and one(spark, X.discriminator_reward(F.lit(-9.0))) == 1


def test_law_is_found():
    import numpy as np

    x, y = (v.ravel() for v in np.meshgrid(np.log([1, 4, 16, 64, 256.0]), np.log([1, 3, 9, 27.0])))
    target = np.log(1.5 * np.exp(-0.6 * x) + 0.7 * np.exp(-0.3 * y) + 1.1)
    a, b, e, al, be = S.fit_law(x, y, target)
    assert np.allclose([np.exp(a), np.exp(b), np.exp(e), al, be], [1.5, 0.7, 1.1, 0.6, 0.3], atol=0.05)


def test_smoothing_against_a_loop(spark):
    """Runs of all lengths, one after the other, each seeing what its left neighbour has become."""
    import random

    rng = random.Random(6)
    rows = [(k, [rng.choice("ABC") for _ in range(n)], [rng.randint(1, 3) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 3] * 10 + [20] * 10)]
    want = {}
    for k, labels, lengths in rows:
        out = list(labels)
        for i, n in enumerate(lengths):
            if n < 2:
                out[i] = labels[i + 1] if i + 1 < len(labels) else out[i - 1] if i else None
        want[k] = out
    df = spark.createDataFrame(rows, "k int, r array<string>, n array<int>")
    assert {r["k"]: r["x"] for r in df.select("k", S.smoothed(F.col("r"), F.col("n"), 2).alias("x")).collect()} == want


def test_tokens_of_ones_own(spark):
    kinds = (vocab.TokenKind("loud", 4, lambda: F.col("v")), vocab.TokenKind("mark", 1, lambda: F.when(F.col("dur") > 5, 0)))
    rows = [("a", 0, 0, 60, 9, 3), ("a", 0, 4, 60, 1, 7), ("a", 1, 0, 60, 1, None)]
    notes = spark.createDataFrame(rows, "song string, measure int, shift int, pitch int, dur int, v int")
    seq = N.notes_to_tokens(notes, ["song"], kinds)
    assert seq.first()["tokens"] == [51, 269, 346, 697, 698, 55, 269, 338, 49, 51, 269, 338, 627]
    assert N.tokens_to_notes(seq, ["song"]).count() == 3
    assert vocab.vocabulary(spark, kinds).count() == 699 and vocab.vocabulary(spark).agg(F.max("token_id")).first()[0] == 693
