"""Queries over marker-delimited sequences, runs, windows of scores, and rule-based rewards."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import sequences as S
from ..sources.tables import SQL_MOD, SQL_NOTES, notes, table
from .registry import query

#: A conversation stands for a sequence of blocks: system META, user PAST or FUTURE by turn, assistant CONST.
SQL_BLOCKS = """blocks as (select conv_id, turn, case role when 'system' then 'META' when 'assistant' then 'CONST' else case when turn % 3 = 2 then 'FUTURE' else 'PAST' end end as block,
 len(string_split(text, ' ')) as words from conversations)"""
SQL_ORDER = f"{SQL_BLOCKS}, o as (select conv_id, list(block order by turn) as b from blocks group by 1)"
def _sql_before(x, y):
    return f"coalesce(nullif(list_position(b,'{x}'),0) < nullif(list_position(b,'{y}'),0), false)"


SQL_LABEL = f"""case when {_sql_before('PAST','META')} or {_sql_before('CONST','META')} or {_sql_before('FUTURE','META')} then 'analysis'
 when {_sql_before('PAST','CONST')} and {_sql_before('FUTURE','CONST')} then 'infill' when {_sql_before('FUTURE','CONST')} then 'anticipation' when {_sql_before('PAST','CONST')} then 'continuation'
 when {_sql_before('META','CONST')} then 'meta_gen' when list_contains(b,'CONST') then 'uncond' else 'no_target' end"""


def blocks(spark, sf_dir):
    role = F.col("role")
    block = F.when(role == "system", "META").when(role == "assistant", "CONST").when(F.col("turn") % 3 == 2, "FUTURE").otherwise("PAST")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", block.alias("block"), F.size(F.split("text", " ")).alias("words"))


def orders(spark, sf_dir):
    sorted_ = F.array_sort(F.collect_list(F.struct("turn", "block")))
    return blocks(spark, sf_dir).groupBy("conv_id").agg(F.transform(sorted_, lambda x: x["block"]).alias("b"))


@query(f"with {SQL_ORDER} select array_to_string(b, '>') as pattern, count(*) as n from o group by 1")
def pattern_histogram(spark, sf_dir):
    return orders(spark, sf_dir).groupBy(F.array_join("b", ">").alias("pattern")).agg(F.count("*").alias("n"))


@query(f"with {SQL_ORDER} select round(avg(case when list_contains(b,'META') then 1e0 else 0e0 end), 6) as meta, round(avg(case when b[1]='META' then 1e0 else 0e0 end), 6) as meta_first, round(avg(case when len(list_distinct(b))=1 and b[1]='CONST' then 1e0 else 0e0 end), 6) as only_const from o")
def block_ratios(spark, sf_dir):
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    b = F.col("b")
    return orders(spark, sf_dir).agg(
        rate(F.array_contains(b, "META")).alias("meta"), rate(F.get(b, 0) == "META").alias("meta_first"),
        rate((F.size(F.array_distinct(b)) == 1) & (F.get(b, 0) == "CONST")).alias("only_const"),
    )


@query(f"with {SQL_ORDER} select conv_id, {SQL_LABEL} as label from o")
def direction_label(spark, sf_dir):
    return orders(spark, sf_dir).select("conv_id", S.direction(F.col("b")).alias("label"))


@query(f"""with {SQL_BLOCKS}, w as (select conv_id, words - case when row_number() over v = 1 then 1 else 0 end as words, block, coalesce(list_distinct(list(block) over (v rows between unbounded preceding and 1 preceding)), []) as f from blocks window v as (partition by conv_id order by turn)),
k as (select *, case when block='META' and (list_contains(f,'PAST') or list_contains(f,'CONST') or list_contains(f,'FUTURE')) then 'analysis' when block='CONST' and list_contains(f,'PAST') and list_contains(f,'FUTURE') then 'infill'
 when block='CONST' and list_contains(f,'PAST') then 'continuation' when block='CONST' and list_contains(f,'FUTURE') then 'anticipation' when block='CONST' and len(f)=1 and f[1]='META' then 'meta_gen' when block='CONST' and len(f)=0 then 'uncond' end as bucket from w)
select bucket, count(*) as spans, cast(sum(words) as bigint) as weight from k where bucket is not null group by 1""")
def direction_buckets(spark, sf_dir):
    """Tokens to predict, by what their block and the blocks before it say; blocks that are context count nowhere. The first
    token of a sequence is not predicted."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    b = blocks(spark, sf_dir).withColumn("f", F.collect_set("block").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    b = b.withColumn("words", F.col("words") - (F.row_number().over(w) == 1).cast("int"))
    has = lambda *x: F.arrays_overlap("f", F.array(*map(F.lit, x)))
    const = F.col("block") == "CONST"
    bucket = (
        F.when((F.col("block") == "META") & has("PAST", "CONST", "FUTURE"), "analysis").when(const & has("PAST") & has("FUTURE"), "infill")
        .when(const & has("PAST"), "continuation").when(const & has("FUTURE"), "anticipation")
        .when(const & (F.size("f") == 1) & has("META"), "meta_gen").when(const & (F.size("f") == 0), "uncond")
    )
    kept = b.withColumn("bucket", bucket).where("bucket is not null")
    return kept.groupBy("bucket").agg(F.count("*").alias("spans"), F.sum("words").alias("weight"))


@query(f"""with {SQL_BLOCKS}, w as (select *, max(case when block='CONST' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as seen, max(case when block='CONST' then 1 else 0 end) over (partition by conv_id) as any_ from blocks)
select conv_id, turn, cast(case when any_=0 then 1 else seen end as integer) as mask from w""")
def loss_mask(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    hit = (F.col("block") == "CONST").cast("int")
    seen, some = F.max(hit).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)), F.max(hit).over(w)
    return blocks(spark, sf_dir).select("conv_id", "turn", F.when(some == 0, 1).otherwise(seen).cast("int").alias("mask"))


@query(f"""with {SQL_BLOCKS}, c as (select *, coalesce(sum(case when block='CONST' then 1 else 0 end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as cell from blocks),
s as (select conv_id, cell, min(case when block='PAST' then turn end) as a, max(case when block='CONST' then turn end) as b from c group by 1,2) select conv_id, a as span_start, b as span_end from s where a < b""")
def tagged_spans(spark, sf_dir):
    return S.spans(blocks(spark, sf_dir), ["conv_id"], "turn", "block", "PAST", "CONST")


@query(f"with {SQL_BLOCKS} select conv_id, block, string_agg(cast(words as varchar), ',' order by turn) as lengths from blocks group by 1,2")
def block_map(spark, sf_dir):
    """The blocks of each kind of a sequence, in order: a map, as rows."""
    one = F.array_sort(F.collect_list(F.struct("turn", "words")))
    m = blocks(spark, sf_dir).groupBy("conv_id", "block").agg(F.array_join(F.transform(one, lambda x: x["words"].cast("string")), ",").alias("lengths"))
    return m


@query(f"with {SQL_ORDER} select conv_id, array_to_string(case when list_contains(b,'CONST') then list_slice(b, list_position(b,'CONST'), len(b)) else [] end, '>') as gold, len(b) as n from o")
def sample_parse(spark, sf_dir):
    at = F.array_position("b", F.lit("CONST"))
    gold = F.when(at > 0, F.slice("b", at.cast("int"), F.size("b"))).otherwise(F.array().cast("array<string>"))
    return orders(spark, sf_dir).select("conv_id", F.array_join(gold, ">").alias("gold"), F.size("b").cast("long").alias("n"))


@query(f"with {SQL_NOTES}, b as (select song, program, array_to_string(list_concat(['3'], list_transform(list(pitch+209 order by event_id), lambda x: cast(x as varchar)), ['626','2']), ' ') as block from notes group by 1,2) select song, program, block from b")
def block_build(spark, sf_dir):
    own = F.array_sort(F.collect_list(F.struct("event_id", (F.col("pitch") + 209).cast("string").alias("t"))))
    body = F.transform(own, lambda x: x["t"])
    whole = F.concat(F.array(F.lit("3")), body, F.array(F.lit("626"), F.lit("2")))
    return notes(spark, sf_dir).groupBy("song", "program").agg(F.array_join(whole, " ").alias("block"))


SQL_RUNS = """r0 as (select user_id as song, event_id, ts, event_type, case when lag(event_type) over w = event_type then 0 else 1 end as new_ from events window w as (partition by user_id order by ts, event_id)),
r1 as (select *, sum(new_) over (partition by song order by ts, event_id) as run from r0), runs as (select song, run, min(event_type) as event_type, min(ts) as first_at, count(*) as length from r1 group by 1,2)"""


def _runs(spark, sf_dir):
    return S.runs(table(spark, sf_dir, "events").withColumnRenamed("user_id", "song"), ["song"], ["ts", "event_id"], "event_type")


@query(f"with {SQL_RUNS} select song, cast(run as bigint) as run, event_type, first_at, length from runs")
def run_length_segments(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(f"with {SQL_RUNS}, t as (select song, event_type, cast(sum(length) as bigint) as total from runs group by 1,2) select song, event_type, total from (select *, row_number() over (partition by song order by total desc, event_type) as rn from t) x where rn=1")
def duration_mode(spark, sf_dir):
    t = _runs(spark, sf_dir).groupBy("song", "event_type").agg(F.sum("length").alias("total"))
    w = Window.partitionBy("song").orderBy(F.desc("total"), "event_type")
    return t.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


@query(f"""with {SQL_RUNS}, n as (select *, lead(event_type) over w as r, lag(event_type) over w as l, lag(length) over w as ll from runs window w as (partition by song order by run)),
s as (select *, case when length >= 2 then event_type when r is not null then r when ll < 2 then event_type else l end as label from n)
select song, string_agg(event_type, '>' order by run) as before, coalesce(string_agg(label, '>' order by run), '') as after from s group by 1""")
def key_smoothing(spark, sf_dir):
    """Runs shorter than two smoothed from left to right."""
    in_order = F.array_sort(F.collect_list(F.struct("run", "event_type", "length")))
    r = _runs(spark, sf_dir).groupBy("song").agg(in_order.alias("r"))
    labels, lengths = F.transform("r", lambda x: x["event_type"]), F.transform("r", lambda x: x["length"])
    return r.select("song", F.array_join(labels, ">").alias("before"), F.array_join(S.smoothed(labels, lengths, 2), ">").alias("after"))


SQL_WIN = f"""{SQL_NOTES}, m as (select song, max(measure)+1 as bars from notes group by 1), w0 as (select song, bars, unnest(range(0, bars, 2)) as a from m), w1 as (select song, a, least(a+4, bars) as b, bars from w0),
wins as (select song, a, b from w1 where a = 0 or a - 2 + 4 < bars)"""


def _key_windows(spark, sf_dir, size=4, step=2):
    """Windows of `size` bars every `step`; the last is clipped, and none starts after one that reached the end."""
    m = notes(spark, sf_dir).groupBy("song").agg((F.max("measure") + 1).alias("bars"))
    w = m.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("bars") - 1, F.lit(step))))
    return w.where((F.col("a") == 0) | (F.col("a") - step + size < F.col("bars"))).select("song", "a", F.least(F.col("a") + size, F.col("bars")).alias("b"))


@query(f"with {SQL_WIN} select song, a, b from wins")
def key_windows(spark, sf_dir):
    return _key_windows(spark, sf_dir)


SQL_VOTES = f"""{SQL_WIN}, n as (select song, measure, program, count(*) as c, row_number() over (partition by song, measure order by count(*) desc, program) as r from notes group by 1,2,3),
v as (select w.song, w.a, w.b, arg_max(n.program, cast(n.c as hugeint)*1000000000000000000 - n.r*cast(1000000000 as hugeint) - n.measure) as vote, least(3, max(n.c)) as weight from wins w join n on n.song=w.song and n.measure>=w.a and n.measure<w.b group by 1,2,3),
bars as (select song, a, unnest(range(a, b)) as bar, vote, weight from v), s as (select song, bar, vote, sum(weight) as weight, min(a) as f from bars group by 1,2,3)"""


@query(f"with {SQL_VOTES} select song, bar, vote as winner, cast(weight as bigint) as best, n as candidates from (select *, count(*) over (partition by song, bar) as n, row_number() over (partition by song, bar order by weight desc, f, vote) as rn from s) t where rn = 1")
def bar_vote(spark, sf_dir):
    """Winner of each bar by the weighted votes of the windows over it; ties go to the vote that came first."""
    counts = notes(spark, sf_dir).groupBy("song", "measure", "program").agg(F.count("*").alias("c"))
    r = counts.withColumn("r", F.row_number().over(Window.partitionBy("song", "measure").orderBy(F.desc("c"), "program")))
    spread = _key_windows(spark, sf_dir).withColumn("measure", F.explode(F.sequence(F.col("a"), F.col("b") - 1)))
    v = spread.join(r, ["song", "measure"]).groupBy("song", "a", "b").agg(
        F.max_by("program", F.struct("c", -F.col("r"), -F.col("measure"))).alias("vote"), F.least(F.lit(3), F.max("c")).alias("weight")
    )
    bars = v.withColumn("bar", F.explode(F.sequence(F.col("a"), F.col("b") - 1))).withColumn("bar", F.col("bar").cast("long"))
    s = bars.groupBy("song", "bar", "vote").agg(F.sum("weight").alias("weight"), F.min("a").alias("f"))
    w = Window.partitionBy("song", "bar")
    ranked = s.withColumn("candidates", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("weight"), "f", "vote")))
    return ranked.where("rn = 1").select("song", "bar", F.col("vote").alias("winner"), F.col("weight").cast("long").alias("best"), "candidates")


SQL_STEPS = "s as (select user_id as run, value as loss, cast(json_extract_string(props,'$.k') as integer) as k, row_number() over (partition by user_id order by ts, event_id) as step from events)"


def _steps(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("value").alias("loss"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.row_number().over(w).cast("long").alias("step"))


@query(f"with {SQL_STEPS} select run, step, round(avg(loss) over (partition by run order by step rows between 999 preceding and current row), 6) as mean from s")
def running_mean(spark, sf_dir):
    w = Window.partitionBy("run").orderBy("step").rowsBetween(-999, 0)
    return _steps(spark, sf_dir).select("run", "step", F.round(F.avg("loss").over(w), 6).alias("mean"))


@query(f"""with {SQL_STEPS}, m as (select run, step, avg(loss) over w as kl, avg(k) over w as disc, count(*) over w as n from s window w as (partition by run order by step rows between 19 preceding and current row)),
c as (select run, step, case when kl > 260e0 and disc > 50e0 then 'hacking' when kl < 220e0 then 'achieved' end as reason from m where n = 20)
select run, min(step) as stop_at, arg_min(reason, step) as reason from c where reason is not null group by run""")
def moving_average_stop(spark, sf_dir):
    """The first step at which two averages over 20 steps are both too high, or one has reached its goal."""
    w = Window.partitionBy("run").orderBy("step").rowsBetween(-19, 0)
    m = _steps(spark, sf_dir).withColumns({"kl": F.avg("loss").over(w), "disc": F.avg("k").over(w), "n": F.count("*").over(w)})
    reason = F.when((F.col("kl") > 260.0) & (F.col("disc") > 50.0), "hacking").when(F.col("kl") < 220.0, "achieved")
    c = m.where("n = 20").withColumn("reason", reason).where("reason is not null")
    return c.groupBy("run").agg(F.min("step").alias("stop_at"), F.min_by("reason", "step").alias("reason"))


@query(f"""with {SQL_STEPS}, m as (select run, step, regr_slope(loss, step) over w as slope, count(*) over w as n from s window w as (partition by run order by step rows between 9 preceding and current row)),
f as (select run, step, case when slope < -0.01e0 then 0 else 1 end as up, sum(case when slope < -0.01e0 then 0 else 1 end) over (partition by run order by step) as island from m where n = 10),
k as (select run, step, row_number() over (partition by run, island order by step) - case when island = 0 then 0 else 1 end as stale, up from f)
select run, min(step) as stop_at from k where up = 0 and stale >= 3 and step >= 20 group by run""")
def slope_stop(spark, sf_dir):
    """The first step, from the 20th on, with the slope of ten values too low for the third time in a row."""
    run = Window.partitionBy("run").orderBy("step")
    w = run.rowsBetween(-9, 0)
    x, y = F.col("step").cast("double"), F.col("loss")
    m = _steps(spark, sf_dir).withColumns({"near": F.regr_slope(y, x).over(w), "last": F.collect_list(F.struct(x.alias("x"), y.alias("y"))).over(w)}).where("step >= 10")
    # Next to the limit, the last bits tell on which side a slope is.
    slope = F.when(F.abs(F.col("near") + 0.01) < 1e-6, S.slope(F.col("last"))).otherwise(F.col("near"))
    m = m.withColumn("up", F.when(slope < -0.01, 0).otherwise(1)).drop("near", "last")
    island = m.withColumn("island", F.sum("up").over(run))
    counted = island.withColumn("stale", F.sum(1 - F.col("up")).over(Window.partitionBy("run", "island").orderBy("step")))
    return counted.where("up = 0 and stale >= 3 and step >= 20").groupBy("run").agg(F.min("step").alias("stop_at"))


@query("with g as (select l_orderkey, l_linenumber, l_quantity as r, avg(l_quantity) over (partition by l_orderkey) as m, stddev_samp(l_quantity) over (partition by l_orderkey) as sd from lineitem) select l_orderkey, l_linenumber, round((r-m)/(sd+1e-4), 5) as advantage from g where sd is not null")
def group_advantage(spark, sf_dir):
    w = Window.partitionBy("l_orderkey")
    t = table(spark, sf_dir, "lineitem")
    sd = F.when(F.count("*").over(w) > 1, F.stddev_samp("l_quantity").over(w))
    g = t.withColumn("sd", sd).withColumn("m", F.avg("l_quantity").over(w)).where("sd is not null")
    return g.select("l_orderkey", "l_linenumber", F.round((F.col("l_quantity") - F.col("m")) / (F.col("sd") + 1e-4), 5).alias("advantage"))


@query("""with p as (select user_id, event_type, sum(value) as v from events group by 1,2), q as (select *, v/sum(v) over (partition by user_id) as p from p), c as (select *, sum(p) over (partition by user_id order by p desc, event_type rows unbounded preceding) - p as before from q)
select user_id, event_type, round(p/sum(p) over (partition by user_id), 6) as p from c where before <= 0.6e0""")
def nucleus_filter(spark, sf_dir):
    user = Window.partitionBy("user_id")
    # Summed as decimals, which no order of the rows changes; values that are none leave their users with sums of doubles.
    exact = F.col("value").try_cast("decimal(28,12)")
    p = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.sum("value").alias("double"), F.sum(exact).alias("exact"), (F.count("value") == F.count(exact)).alias("whole")
    )
    whole = F.min("whole").over(user)
    v, total = F.when(whole, F.col("exact").cast("double")).otherwise(F.col("double")), F.when(whole, F.sum("exact").over(user).cast("double")).otherwise(F.sum("double").over(user))
    q = p.withColumn("p", F.try_divide(v, total))
    w = user.orderBy(F.desc("p"), F.asc_nulls_last("event_type")).rowsBetween(Window.unboundedPreceding, 0)
    kept = q.withColumn("before", F.sum("p").over(w) - F.col("p")).where("before <= 0.6D")
    share = F.try_divide("p", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return kept.select("user_id", "event_type", (F.round(share * 1e6) / 1e6).alias("p"))


@query("""with a as (select event_id, cast(event_id % 10 as integer)+1 as want, case when event_id % 9 = 0 then null else cast((event_id*3) % 10 as integer)+1 end as got, value/500e0 as sim, value/25e0-10e0 as z, case when event_id % 7 = 0 then null else cast(event_id % 24 as integer)+1 end as rank, case when event_id % 5 = 0 then 3 else 24 end as n from events),
b as (select *, least(1e0, coalesce(abs(want-got)/9e0, 1e0)) as d, 1/(1+exp(-12e0*(least(1e0, sim)-0.75e0))) as s, 1/(1+exp(3e0)) as s0, 1/(1+exp(-3e0)) as s1, greatest(0e0, least(1e0, (sim-0.2e0)/0.6e0)) as t from a)
select event_id, round(1-1.5e0*d, 6) as attribute, round(case when sim <= 0.5e0 then 0e0 else -0.5e0*(s-s0)/(s1-s0) end, 6) as penalty, round(t*t*(3-2*t), 6) as smooth, round(greatest(0e0, least(1e0, 0.5e0 - z/8e0)), 6) as discriminator,
 round(case when rank is null or rank > n then -0.5e0 when rank = 1 then 1e0 when rank = 2 then 0e0 when n <= 3 then -0.5e0 else -0.5e0*(rank-2)/cast(n-2 as double) end, 6) as key_rank from b""")
def reward_components(spark, sf_dir):
    e = F.col("event_id")
    got = F.when(e % 9 == 0, F.lit(None)).otherwise((e * 3) % 10 + 1)
    d = X.ordinal_distance((e % 10 + 1).cast("double"), got.cast("double"), 9)
    sim, rank = F.col("value") / 500.0, F.when(e % 7 != 0, e % 24 + 1)
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(X.attribute_score(d, 1.0, 0.5), 6).alias("attribute"), F.round(X.similarity_reward(sim), 6).alias("penalty"),
        F.round(X.smoothstep(sim, 0.2, 0.8), 6).alias("smooth"), F.round(X.discriminator_reward(F.col("value") / 25.0 - 10.0), 6).alias("discriminator"),
        F.round(X.rank_reward(rank, F.when(e % 5 == 0, 3).otherwise(24), 1.0, 0.5), 6).alias("key_rank"),
    )


@query()
def bootstrap_ci(spark, sf_dir, reps: int = 10_000):
    """Mean and percentile interval of resamples by event type. The draws are Poisson(1) weights, one generator for each
    thousand rows and hundred resamples; the state of a task is a sum and a count a resample."""
    values = table(spark, sf_dir, "events").select("event_type", F.expr("event_id div 1000").alias("block"), "event_id", "value")

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        own = pdf.sort_values("event_id")["value"].to_numpy()
        seed = [int(pdf["block"].iloc[0]) % 2**32, *pdf["event_type"].iloc[0].encode()]
        parts = []
        for k in range(0, reps, 100):
            w = np.random.default_rng([k, *seed]).poisson(1.0, (100, len(own)))
            parts.append(np.stack([w @ own, w.sum(1)], 1))
        both = np.concatenate(parts)
        return pd.DataFrame({"event_type": pdf["event_type"].iloc[0], "rep": np.arange(len(both)), "s": both[:, 0], "n": both[:, 1]})

    each = values.groupBy("event_type", "block").applyInPandas(sums, "event_type string, rep int, s double, n double")
    means = each.groupBy("event_type", "rep").agg((F.sum("s") / F.sum("n")).alias("m"))
    ci = means.groupBy("event_type").agg(*[F.round(F.percentile("m", F.lit(p)), 3).alias(x) for x, p in (("low", 0.025), ("high", 0.975))])
    mean = values.groupBy("event_type").agg(F.round(F.avg("value"), 3).alias("mean"))
    return mean.join(ci, "event_type")


@query()
def scaling_fit(spark, sf_dir, reps: int = 200):
    """log loss = log(A / N^a + B / D^b + E) by Huber loss on logarithms, with the interval of resamples of the points.

    N and D are the numbers of documents and of words in nested samples of each source and language; the loss is the
    share of words that are new in a sample (types by tokens). Samples are powers of two by a hash of the document."""
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).where("w <> ''")
    level = F.lit(7) - F.least(F.floor(F.log2(X.md5_mod(F.col("doc_id").cast("string"), 128) + 1)), F.lit(7))
    # A word of level k stands in the samples 0 to k; whole numbers of documents come from their own rows.
    words = d.withColumn("level", level.cast("int")).groupBy("source", "lang", "w").agg(*[F.count_if(F.col("level") == k).alias(str(k)) for k in range(8)])
    known = [sum((F.col(str(j)) for j in range(k, 8)), F.lit(0)) for k in range(8)]
    counts = words.groupBy("source", "lang").agg(*[F.struct(F.count_if(n > 0).alias("types"), F.sum(n).alias("tokens")).alias(f"s{k}") for k, n in enumerate(known)])
    docs = table(spark, sf_dir, "documents").withColumn("level", level.cast("int")).groupBy("source", "lang").agg(*[F.count_if(F.col("level") >= k).alias(f"d{k}") for k in range(8)])
    each = counts.join(docs, counts["source"].eqNullSafe(docs["source"]) & counts["lang"].eqNullSafe(docs["lang"]))
    points = each.select(F.inline(F.array(*[F.struct(F.col(f"d{k}").alias("n"), F.col(f"s{k}.tokens").alias("d"), F.col(f"s{k}.types").alias("t")) for k in range(8)])))
    kept = points.where("n > 0 and d > 0 and t > 0").select(F.log("n").alias("x"), F.log("d").alias("y"), F.log(F.col("t") / F.col("d")).alias("l"))
    return S.scaling_law(kept, reps)


SQL_REPLAY_CAP = 150


def _sql_replay(rounds: int = 4) -> str:
    key = lambda salt: f"md5('{salt}-'||cast(doc_id as varchar))"
    sql = f"h as (select doc_id, {SQL_MOD.format(x='cast(doc_id as varchar)', n=rounds)} as r from documents), t0 as (select doc_id, cast(0 as bigint) as entered from h where r = 0 order by {key('t0')} limit {SQL_REPLAY_CAP})"
    for k in range(1, rounds):
        size = f"(select count(*) from t{k - 1})"
        stay = f"({size} - {size} // 4)"
        take = f"least((select count(*) from h where r = {k}) // 4, {SQL_REPLAY_CAP} - {stay})"
        sql += f", k{k} as (select doc_id, entered from (select *, row_number() over (order by {key(f'k{k}')}) as rn from t{k - 1}) z where rn <= {stay}), t{k} as (select * from k{k} union all select doc_id, {k} from (select *, row_number() over (order by {key(f't{k}')}) as rn from h where r = {k}) z where rn <= {take})"
    return f"with {sql} select doc_id, entered as round_ from t{rounds - 1}"


@query(_sql_replay())
def replay_rounds(spark, sf_dir, rounds: int = 4, cap: int = SQL_REPLAY_CAP):
    """The replay pool after its rounds: the first fills it up to its cap; each later one forgets a quarter of it and takes
    a quarter of the new items, as far as there is room. Who stays is the order of a hash; only counts reach the driver,
    and a round takes cap rows at most."""
    d = table(spark, sf_dir, "documents").select("doc_id", X.md5_mod(F.col("doc_id").cast("string"), rounds).alias("r"))
    counts = {x["r"]: x["count"] for x in d.groupBy("r").count().collect()}
    key = lambda salt: F.md5(F.concat(F.lit(f"{salt}-"), F.col("doc_id").cast("string")))
    new = lambda k: d.where(F.col("r") == k).select("doc_id", F.lit(k).cast("long").alias("round_"))
    pool, size = new(0).orderBy(key("t0")).limit(cap), min(counts.get(0, 0), cap)
    for k in range(1, rounds):
        stay = size - size // 4
        take = min(counts.get(k, 0) // 4, cap - stay)
        pool = pool.orderBy(key(f"k{k}")).limit(stay).union(new(k).orderBy(key(f"t{k}")).limit(take))
        size = stay + take
    return pool
