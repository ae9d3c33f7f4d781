"""Queries over notes, tokens and time."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import notes as N
from ..sources.tables import SQL_NOTES, notes, sequences, table
from .registry import query

SQL_BARS = f"""{SQL_NOTES}, b0 as (select song, program, measure, string_agg(cast(shift+51 as varchar)||' '||cast(pitch+209 as varchar)||' '||cast(dur+337 as varchar), ' ' order by shift, pitch, dur) as t
 from notes group by 1,2,3), b1 as (select *, measure - coalesce(lag(measure) over (partition by song, program order by measure), 0) as passed from b0),
seqs as (select song, program, string_agg(repeat('49 50 ', cast(greatest(passed-1, 0) as integer))||case when passed > 0 then '49 ' else '' end||t, ' ' order by measure)||' 627' as tokens from b1 group by 1,2)"""


@query(f"with {SQL_BARS} select song, program, tokens from seqs")
def notes_to_tokens(spark, sf_dir):
    return sequences(spark, sf_dir).select("song", "program", F.array_join("tokens", " ").alias("tokens"))


@query(f"with {SQL_NOTES} select song, program, cast(greatest(measure-1, 0) as integer) as measure, shift, pitch, dur from notes where dur < 288")
def tokens_to_notes(spark, sf_dir):
    return N.tokens_to_notes(sequences(spark, sf_dir), ["song", "program"])


@query(f"with {SQL_BARS} select song, program, len(string_split(tokens, ' ')) as n, len(list_filter(string_split(tokens, ' '), lambda x: x = '49')) as bars, len(list_filter(string_split(tokens, ' '), lambda x: x = '50')) as blanks from seqs")
def token_counts(spark, sf_dir):
    count = lambda t: F.size(F.filter("tokens", lambda x: x == t)).cast("long")
    return sequences(spark, sf_dir).select("song", "program", F.size("tokens").cast("long").alias("n"), count(V.SME).alias("bars"), count(V.BLANK).alias("blanks"))


@query(f"with {SQL_NOTES}, b as (select song, program, measure, count(*) as n, case when program='view' then 24 else 45 end as most from notes group by 1,2,3) select song, program, case when max(n) > max(most) then null else cast(greatest(1, least(10, ceil(round(sum(n)/cast(max(measure)+1 as double)/max(most)*10, 9)))) as integer) end as density from b group by 1,2")
def density_bucket(spark, sf_dir):
    """One program stands for an instrument of one voice (24 notes a bar at most), the others play chords (45)."""
    return N.bar_density(notes(spark, sf_dir), ["song", "program"], F.when(F.col("program") == "view", 24).otherwise(45))


@query(f"with {SQL_NOTES} select song, program, max(c) = 1 as mono from (select song, program, measure, shift, count(*) as c from notes group by 1,2,3,4) t group by 1,2")
def monophony_check(spark, sf_dir):
    onsets = notes(spark, sf_dir).groupBy("song", "program", "measure", "shift").agg(F.count("*").alias("c"))
    return onsets.groupBy("song", "program").agg((F.max("c") == 1).alias("mono"))


@query(f"""with {SQL_NOTES}, o as (select song, measure, shift, lag(shift) over (partition by song, measure order by event_id) as before from notes)
select song, cast(sum(case when before > shift then 1 else 0 end) as bigint) as reversals from o group by song""")
def grammar_reversals(spark, sf_dir):
    w = Window.partitionBy("song", "measure").orderBy("event_id")
    o = notes(spark, sf_dir).withColumn("before", F.lag("shift").over(w))
    return o.groupBy("song").agg(F.count_if(F.col("before") > F.col("shift")).alias("reversals"))


@query(f"with {SQL_NOTES} select song, measure // 4 as part, count(*) as n, min(pitch) as low, max(pitch) as high from notes group by 1,2")
def bars_by_four(spark, sf_dir):
    return notes(spark, sf_dir).groupBy("song", F.expr("measure div 4").alias("part")).agg(F.count("*").alias("n"), F.min("pitch").alias("low"), F.max("pitch").alias("high"))


@query(f"""with {SQL_NOTES}, s as (select *, unnest(range(-5, 7)) as moved from notes), m as (select song, moved, program, pitch + case when program='error' then 0 else moved end as p from s)
select song, cast(moved as integer) as moved, count(*) as n, cast(sum(case when program='error' then p when p > 127 then p-12 when p < 0 then p+12 else p end) as bigint) as pitches from m group by 1,2""")
def transpose_expand(spark, sf_dir):
    t = N.transposed(notes(spark, sf_dir), drums="program = 'error'")
    return t.groupBy("song", "moved").agg(F.count("*").alias("n"), F.sum("pitch").alias("pitches"))


@query(f"with {SQL_NOTES}, c as (select song, program, count(*) as n from notes group by 1,2), r as (select *, row_number() over (partition by song order by n desc, program) as slot from c) select song, program, n, cast(slot as integer) as slot from r where slot <= 3")
def lane_select(spark, sf_dir):
    return N.lanes(notes(spark, sf_dir), ["song"], "program", 3)


@query("""with e as (select user_id as song, event_id, cast(floor(epoch(ts)) as bigint) as start, cast(floor(epoch(ts)) as bigint) + cast(floor(value) as bigint)*600 as stop,
 cast(json_extract_string(props,'$.k') as integer) % 12 as pitch, event_type from events),
p as (select song, start as on_, least(start + 40000, lead(start) over (partition by song order by start, event_id)) as off_, start + 40000 as far from e where event_type = 'view'),
q as (select song, on_, coalesce(off_, far) as off_ from p),
n as (select song, event_id, start, stop, pitch from e where event_type = 'click'),
j as (select n.*, (select max(q.off_) from q where q.song = n.song and q.on_ <= n.stop and q.off_ > n.stop) as off_,
 lead(start) over (partition by song, pitch order by start, stop) as nxt from n),
h as (select *, greatest(stop, coalesce(off_, stop)) as held from j)
select song, event_id, case when nxt is not null and held > nxt then greatest(stop, nxt) else held end as sustained_end from h""")
def sustain_extension(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("song"), "event_id", "event_type", F.unix_timestamp("ts").alias("start"),
        (F.unix_timestamp("ts") + F.floor("value") * 600).alias("end"), (F.get_json_object("props", "$.k").cast("int") % 12).alias("pitch"),
    )
    following = F.lead("start").over(Window.partitionBy("song").orderBy("start", "event_id"))
    pedal = e.where("event_type = 'view'").select("song", F.col("start").alias("on"), F.least(F.col("start") + 40000, following).alias("off"))
    played = e.where("event_type = 'click'").drop("event_type")
    return N.sustained(played, pedal.where("off > on"), ["song"]).select("song", "event_id", "sustained_end")


@query("select l_orderkey, l_linenumber, cast(round_even(l_extendedprice/7e0, 0) as bigint) as a, greatest(cast(round_even(l_extendedprice/7e0, 0) as bigint)+1, cast(round_even((l_extendedprice+l_quantity)/7e0, 0) as bigint)) as b from lineitem")
def tick_quantize(spark, sf_dir):
    tick = lambda c: F.rint(c / 7.0).cast("long")
    t = table(spark, sf_dir, "lineitem")
    a = tick(F.col("l_extendedprice"))
    return t.select("l_orderkey", "l_linenumber", a.alias("a"), F.greatest(a + 1, tick(F.col("l_extendedprice") + F.col("l_quantity"))).alias("b"))


@query("""with c as (select user_id, ts, max(event_id) as chord from events where event_type='purchase' group by 1,2)
select e.event_id, c.chord from (select * from events where event_type='error') e asof left join c on e.user_id=c.user_id and e.ts >= c.ts""")
def asof_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    chords = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("chord"))
    return N.as_of(e.where("event_type = 'error'"), chords, ["user_id"], "ts", "chord").select("event_id", "chord")


@query("""with s as (select user_id, ts as a, lead(ts) over (partition by user_id order by ts, event_id) as b, event_id as seg from events where event_type='signup'),
e as (select * from events where event_type='click')
select e.event_id, coalesce(max(case when e.ts >= s.a and (e.ts < s.b or s.b is null) then s.seg end), max(f.last_seg)) as seg from e left join s on e.user_id=s.user_id
 left join (select user_id, arg_max(seg, a) as last_seg from s group by 1) f on f.user_id = e.user_id group by e.event_id""")
def interval_lookup(spark, sf_dir):
    """The segment that holds an event's time; before the first segment, the last one of its key."""
    e = table(spark, sf_dir, "events")
    seg = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("seg"))
    last = seg.groupBy("user_id").agg(F.max_by("seg", "ts").alias("last_seg"))
    found = N.as_of(e.where("event_type = 'click'"), seg, ["user_id"], "ts", "seg")
    return found.join(last, "user_id", "left").select("event_id", F.coalesce("seg", "last_seg").alias("seg"))


@query("""with e as (select user_id, event_type, ts, event_id, sum(case event_type when 'view' then 1 when 'click' then -1 else 0 end) over w as o, max(ts) over (partition by user_id) as last_ from events window w as (partition by user_id order by ts, event_id)),
m as (select *, least(0, coalesce(min(o) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)) as low from e),
k as (select *, sum(case when event_type='view' then 1 else 0 end) over w as on_, sum(case when event_type='click' and o >= low then 1 else 0 end) over w as off_ from m window w as (partition by user_id order by ts, event_id))
select a.user_id, cast(a.on_ as bigint) as k, a.ts as start, greatest(coalesce(b.ts, a.last_), a.ts + interval 1 second) as stop from (select * from k where event_type='view') a left join (select * from k where event_type='click' and o >= low) b on a.user_id=b.user_id and a.on_=b.off_""")
def note_pairing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("kind"))
    return N.paired(e, ["user_id"], "view", "click").select("user_id", F.col("k").cast("long").alias("k"), "start", "stop")


SQL_BAR_INDEX = f"""{SQL_NOTES}, raw as (select song, measure as bar, count(*) as n from notes group by 1,2), lim as (select song, max(bar)+1 as bars from raw group by 1),
g as (select song, unnest(range(0, bars)) as bar, bars from lim), bars as (select g.song, g.bar, g.bars, coalesce(r.n, 0) as n from g left join raw r on r.song=g.song and r.bar=g.bar)"""


def _bars(spark, sf_dir):
    raw = notes(spark, sf_dir).groupBy("song", F.col("measure").alias("bar")).agg(F.count("*").alias("n"))
    every = raw.groupBy("song").agg(F.max("bar").alias("m")).select("song", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("bar"))
    return every.join(raw, ["song", "bar"], "left").fillna(0, ["n"])


@query(f"""with {SQL_BAR_INDEX}, w as (select *, unnest(range(0, 3)) as back from bars), x as (select *, bar // 4 - back as win from w), y as (select *, bar - win*4 as pos from x)
select song, cast(win as bigint) as win, case when pos < 4 then 'past' when pos < 8 then 'const' else 'future' end as role, cast(sum(n) as bigint) as notes
from y where win >= 0 and pos < 12 and win*4+12 < bars group by 1,2,3""")
def sliding_windows(spark, sf_dir):
    w = N.windows(_bars(spark, sf_dir), ["song"], 4, 4, 4)
    return w.groupBy("song", F.col("window").alias("win"), "role").agg(F.sum("n").alias("notes"))


@query(f"with {SQL_BAR_INDEX} select song, bar // 24 as win, (bar % 24) // 8 as segment, count(*) as bars_in, cast(sum(n) as bigint) as notes from bars group by 1,2,3")
def greedy_windows(spark, sf_dir):
    b = _bars(spark, sf_dir)
    return b.groupBy("song", F.expr("cast(bar div 24 as bigint)").alias("win"), F.expr("cast((bar % 24) div 8 as bigint)").alias("segment")).agg(F.count("*").alias("bars_in"), F.sum("n").alias("notes"))


@query(f"""with {SQL_BAR_INDEX}
select song, bar // 8 as part, round(avg(case when n = 0 then 1e0 else 0e0 end), 6) as blank from bars group by 1,2 having avg(case when n = 0 then 1e0 else 0e0 end) < 0.5e0""")
def blank_ratio_filter(spark, sf_dir):
    ratio = F.avg((F.col("n") == 0).cast("double"))
    r = _bars(spark, sf_dir).groupBy("song", F.expr("cast(bar div 8 as bigint)").alias("part")).agg(ratio.alias("blank"))
    return r.where("blank < 0.5").withColumn("blank", F.round("blank", 6))
