"""Queries over rolls: cells, overlaps, notes out of rolls with dropouts, the roll of one layer a program."""

from pyspark.sql import functions as F

from ..operators import rolls as R
from ..sources.tables import SQL_NOTES, notes
from .registry import query

SQL_ROLL = f"""{SQL_NOTES}, c as (select song, program, pitch, measure*96+shift as s, unnest(range(measure*96+shift, measure*96+shift+dur)) as step from notes),
r as (select song, program, step, pitch, max(case when step = s then 1 else 0 end) as onset from c group by 1,2,3,4)"""


@query(f"with {SQL_ROLL} select song, program, count(*) as cells, cast(sum(onset) as bigint) as onsets, cast(max(step) as bigint) as last_step from r group by 1,2")
def sparse_roll(spark, sf_dir):
    """Cells, onsets and the last step of each part's roll, from the spans in which its pitches sound."""
    spans, onsets = R.roll_spans(notes(spark, sf_dir), ["song", "program"])
    cells = spans.groupBy("song", "program").agg(F.sum(F.col("stop") - F.col("start")).alias("cells"), (F.max("stop") - 1).alias("last_step"))
    return cells.join(onsets.groupBy("song", "program").agg(F.count("*").alias("onsets")), ["song", "program"])


@query(f"""with {SQL_ROLL}, k as (select song, step, pitch, max(case when program='view' then 1 else 0 end) as a, max(case when program='click' then 1 else 0 end) as b from r group by 1,2,3),
l as (select song, least(max(case when a=1 then step end), max(case when b=1 then step end)) as last_ from k group by 1 having max(a) = 1 and max(b) = 1)
select song, cast(sum(a*b) as bigint) as both_, round(sum(a*b)/cast(sum(greatest(a,b)) as double), 6) as iou from k join l using (song) where greatest(a,b) = 1 and step <= last_ group by song""")
def roll_iou(spark, sf_dir):
    """Overlap of two parts' rolls, both cut to the shorter one: lengths of the spans that one or both cover."""
    pair = notes(spark, sf_dir).where("program in ('view', 'click')")
    spans, _ = R.roll_spans(pair, ["song", "program"])
    end = lambda p: F.max(F.when(F.col("program") == p, F.col("stop")))
    last = spans.groupBy("song").agg(end("view").alias("a"), end("click").alias("b")).where("a is not null and b is not null").select("song", F.least("a", "b").alias("last"))
    cut = spans.join(last, "song").withColumn("stop", F.least("stop", "last"))
    length = F.col("stop") - F.col("start")
    both = F.sum(F.when(F.col("value") == 2, length).otherwise(0))
    found = R.steps_of(cut, ["song", "pitch"]).groupBy("song").agg(both.alias("both_"), F.sum(length).alias("n"))
    return found.select("song", "both_", F.round(F.col("both_") / F.col("n"), 6).alias("iou"))


SQL_DROPS = f"""{SQL_NOTES}, n as (select song, program, pitch, event_id, measure*96+shift as s, measure*96+shift+dur as e from notes), d as (select *, (s // 24 + 1) * 24 as g, event_id % 12 as k from n),
cells as (select distinct song, program, pitch, t from (select *, unnest(range(s, e)) as t from d) where t = s or t < g - k or t >= g), onsets as (select distinct song, program, pitch, s as t from d)"""


@query(f"""with {SQL_DROPS}, every as (select song, program, pitch, t, max(on_) as on_, max(o) as o from (select *, 1 as on_, 0 as o from cells union all select *, 0, 1 from onsets) group by 1,2,3,4),
seg as (select *, max(case when o = 1 then t end) over (partition by song, program, pitch order by t) as start from every),
i as (select *, t - row_number() over (partition by song, program, pitch, start order by t) as island from seg where start is not null),
r as (select song, program, pitch, start, min(t) as a, max(t) + 1 as b from i group by song, program, pitch, start, island),
x as (select *, a - lag(b) over (partition by song, program, pitch, start order by a) as gap from r),
y as (select *, sum(case when gap is null or gap <= 3 or (gap <= 24 and a % 24 = 0 and b - a >= 6) then 0 else 1 end) over (partition by song, program, pitch, start order by a) as ended from x)
select song, program, cast(pitch as integer) as pitch, cast(start as bigint) as start, cast(max(b) as bigint) as stop from y where ended = 0 group by 1,2,3,4""")
def chunk_sustains(spark, sf_dir):
    """Notes back out of rolls whose cells drop out before a chunk's end: 0 to 11 steps of each note."""
    by = ["song", "program", "pitch"]
    start = (F.col("measure") * 96 + F.col("shift")).cast("long")
    n = notes(spark, sf_dir).select(*by, start.alias("s"), (start + F.col("dur")).alias("e"), (F.col("event_id") % 12).alias("k"))
    edge = (F.expr("s div 24") + 1) * 24
    before = F.struct(F.col("s").alias("start"), F.least(F.col("e"), F.greatest(F.col("s") + 1, edge - F.col("k"))).alias("stop"))
    after = F.struct(edge.alias("start"), F.col("e").alias("stop"))
    spans = n.select(*by, F.inline(F.array(before, after)))
    return R.sustained_notes(spans, n.select(*by, F.col("s").alias("step")), by)


SQL_LAYERS = f"""{SQL_NOTES}, n as (select song, program, event_id % 3 as instrument, pitch, pitch as velocity, (measure*96+shift)*2e0/96e0 as a, (measure*96+shift+dur)*2e0/96e0 as b, measure from notes),
l as (select song, max(b) as len, max(measure) + 1 as measures from n group by 1), t as (select n.*, cast(floor(a*(measures*96/len)) as bigint) as s, least(cast(floor(b*(measures*96/len)) as bigint), measures*96) as e from n join l using (song)),
c as (select song, program, instrument, pitch, unnest(range(s, e)) as step, velocity from t), i as (select song, program, instrument, pitch, step, sum(velocity) as v from c group by 1,2,3,4,5), m as (select song, program, pitch, step, max(v) as v from i group by 1,2,3,4)"""


def _layers(spark, sf_dir):
    at = F.col("measure") * 96 + F.col("shift")
    n = notes(spark, sf_dir).select("song", "program", (F.col("event_id") % 3).alias("instrument"), "pitch", F.col("pitch").cast("long").alias("velocity"), (at * 2.0 / 96.0).alias("start"), ((at + F.col("dur")) * 2.0 / 96.0).alias("stop"), "measure")
    songs = n.groupBy("song").agg((F.max("measure") + 1).alias("measures"))
    return R.velocity_roll(n.drop("measure"), songs, ["song"], 96)


@query(f"with {SQL_LAYERS} select song, program, count(*) as cells, cast(sum(v) as bigint) as loudness, cast(sum((step % 1000) * v) as bigint) as weight from m group by 1,2")
def layered_roll(spark, sf_dir):
    """The roll of one layer a program, summed up: cells, loudness, and loudness by place."""
    a, b = F.col("start"), F.col("stop")
    # Sums of step % 1000 from 0 up to a step.
    upto = lambda x: F.expr(f"{x} div 1000") * 499500 + (F.col(x) % 1000) * (F.col(x) % 1000 - 1) / 2
    r = _layers(spark, sf_dir)
    return r.groupBy("song", "program").agg(F.sum(b - a).alias("cells"), F.sum((b - a) * F.col("velocity")).alias("loudness"), F.sum((upto("stop") - upto("start")).cast("long") * F.col("velocity")).alias("weight"))


@query(f"""with {SQL_LAYERS}, g as (select *, step - row_number() over (partition by song, program, pitch order by step) as island from m)
select song, program, cast(pitch as integer) as pitch, cast(min(step) as bigint) as start, cast(max(step) + 1 as bigint) as stop, cast(greatest(1, floor(cast(arg_min(v, step)/127e0 as float) * cast(127 as float))) as bigint) as velocity from g group by song, program, pitch, island""")
def layered_roll_notes(spark, sf_dir):
    """The roll of one layer a program, taken back to notes."""
    return R.notes_of_roll(_layers(spark, sf_dir), ["song", "program", "pitch"])
