"""Queries that filter and project token sequences, look rows up, sample, and cut songs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.scalars import md5_mod
from ..operators import corpus as C
from ..operators import notes as N
from ..operators import rolls as R
from ..operators import samples as B
from ..sources.tables import SQL_MANIFEST, SQL_MOD, SQL_NOTES, SQL_PREDS, manifest, notes, predictions, sequences, table
from .notes import SQL_BARS
from .registry import query
from .samples import SQL_PARTS, parts, samples, text

SQL_TOK = f"{SQL_BARS}, tk as (select song, program, list_transform(string_split(tokens, ' '), lambda x: cast(x as integer)) as t from seqs)"


def _in(x, *ranges):
    out = F.lit(False)
    for first, size in ranges:
        out = out | x.between(first, first + size - 1)
    return out


@query(f"with {SQL_TOK} select song, program, len(t) as n from tk where len(t) between 40 and 120")
def inclusive_length(spark, sf_dir):
    return sequences(spark, sf_dir).select("song", "program", F.size("tokens").cast("long").alias("n")).where("n between 40 and 120")


@query(f"with {SQL_TOK} select song, program, len(t) as n, len(list_filter(t, lambda x: x = 50)) as blanks from tk where len(t) > 40 and len(t) < 150 and len(list_filter(t, lambda x: x = 50)) < 16")
def class_filter(spark, sf_dir):
    """Longer than one length, shorter than another, and with few tokens of one kind."""
    s = sequences(spark, sf_dir).select("song", "program", F.size("tokens").cast("long").alias("n"), F.size(F.filter("tokens", lambda x: x == V.BLANK)).cast("long").alias("blanks"))
    return s.where("n > 40 and n < 150 and blanks < 16")


@query(f"with {SQL_TOK} select song, program, array_to_string(list_filter(t, lambda x: x between 51 and 147 or x between 209 and 336), ' ') as kept from tk")
def range_mask(spark, sf_dir):
    return sequences(spark, sf_dir).select("song", "program", text(F.filter("tokens", lambda x: _in(x, (V.SHIFT, 97), (V.PITCH, 128))), "kept"))


@query(f"with {SQL_TOK} select song, program, len(list_filter(t, lambda x: x >= 51 and x < 147)) > 0 as has_notes, len(list_filter(t, lambda x: x >= 209 and x < 229)) > 0 as has_low from tk")
def has_notes(spark, sf_dir):
    return sequences(spark, sf_dir).select("song", "program", F.exists("tokens", lambda x: _in(x, (V.SHIFT, 96))).alias("has_notes"), F.exists("tokens", lambda x: _in(x, (V.PITCH, 20))).alias("has_low"))


@query(f"""with {SQL_NOTES}, m as (select song, program, max(c) = 1 as mono from (select song, program, measure, shift, count(*) as c from notes group by 1,2,3,4) t group by 1,2), r as (select * from (values ('view', false), ('click', true), ('signup', false)) v(program, poly))
select m.song, m.program, case when r.program is null then 'undefined' when r.poly or m.mono then 'pass' else 'fail' end as verdict from m left join r on r.program=m.program""")
def instrument_constraint(spark, sf_dir):
    """Instruments of one voice must be monophonic; those without a rule are reported."""
    rules = spark.createDataFrame([("view", False), ("click", True), ("signup", False)], "program string, poly boolean")
    m = notes(spark, sf_dir).groupBy("song", "program", "measure", "shift").count().groupBy("song", "program").agg((F.max("count") == 1).alias("mono"))
    v = F.when(F.col("poly").isNull(), "undefined").when(F.col("poly") | F.col("mono"), "pass").otherwise("fail")
    return m.join(F.broadcast(rules), "program", "left").select("song", "program", v.alias("verdict"))


@query("""with m as (select user_id as song, cast(json_extract_string(props,'$.k') as integer) % 8 as meter from events where event_type='signup')
select u.song, coalesce(bool_and(m.meter <> 3), true) as four from (select distinct user_id as song from events) u left join m on m.song=u.song group by u.song having coalesce(bool_and(m.meter <> 3), true)""")
def meter_filter(spark, sf_dir):
    """Songs all of whose time signatures are 4/4; none counts as 4/4."""
    e = table(spark, sf_dir, "events")
    other = e.where((F.col("event_type") == "signup") & (F.get_json_object("props", "$.k").cast("int") % 8 == 3)).select(F.col("user_id").alias("song"))
    return e.select(F.col("user_id").alias("song")).distinct().join(other, "song", "left_anti").withColumn("four", F.lit(True))


@query(f"with {SQL_TOK}, z as (select song, program, list_transform(t, lambda x: case when x = 625 then 0 else x end) as t from tk) select song, program, len(t) as n from z where not list_contains(t, 0)")
def pad_rejection(spark, sf_dir):
    """Sequences with a padding token inside are errors; the longest duration stands for one."""
    z = sequences(spark, sf_dir).withColumn("t", F.transform("tokens", lambda x: F.when(x == 625, 0).otherwise(x)))
    return z.where(~F.array_contains("t", 0)).select("song", "program", F.size("t").cast("long").alias("n"))


SQL_CHORD = f"{SQL_NOTES}, ch as (select song, measure, shift, event_id, 148+pitch%20 as r, 168+pitch%19 as q, 187+pitch%22 as b from notes where program='purchase')"


def _chords(spark, sf_dir):
    c = notes(spark, sf_dir).where("program = 'purchase'")
    p = F.col("pitch")
    return c.select("song", "measure", "shift", "event_id", (p % 20 + 148).alias("r"), (p % 19 + 168).alias("q"), (p % 22 + 187).alias("b"))


@query(f"""with {SQL_CHORD}, b0 as (select song, measure, string_agg((shift+51)||' '||r||' '||q||' '||b, ' ' order by shift, event_id) as t from ch group by 1,2), b1 as (select *, measure - coalesce(lag(measure) over (partition by song order by measure), 0) as passed from b0)
select song, string_agg(repeat('49 50 ', cast(greatest(passed-1, 0) as integer))||case when passed > 0 then '49 ' else '' end||t, ' ' order by measure)||' 627' as tokens from b1 group by 1""")
def chord_timeline(spark, sf_dir):
    """Chords alone as tokens: bar lines as for notes, then place, root, quality and bass of each."""
    one = F.array_sort(F.collect_list(F.struct("shift", "event_id", "r", "q", "b")))
    told = F.flatten(F.transform(one, lambda x: F.array((x["shift"] + V.SHIFT).cast("int"), x["r"].cast("int"), x["q"].cast("int"), x["b"].cast("int"))))
    bars = _chords(spark, sf_dir).groupBy("song", "measure").agg(told.alias("t"))
    passed = F.col("measure") - F.coalesce(F.lag("measure").over(Window.partitionBy("song").orderBy("measure")), F.lit(0))
    bars = bars.withColumn("passed", passed)
    empty = F.flatten(F.array_repeat(B.tokens(V.SME, V.BLANK), F.greatest(F.col("passed") - 1, F.lit(0)).cast("int")))
    each = bars.withColumn("t", F.concat(empty, F.when(F.col("passed") > 0, B.tokens(V.SME)).otherwise(B.none()), "t"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("measure", "t"))), lambda x: x["t"]))
    return each.groupBy("song").agg(text(F.concat(whole, B.tokens(V.TE)), "tokens"))


SQL_CALLED = f"""{SQL_CHORD}, n as (select *, measure*96+shift as pos_ from notes where program='view'), c as (select song, measure*96+shift as pos_, max(event_id) as chord from ch group by 1,2),
a as (select n.song, n.event_id, n.pos_, n.measure, n.shift, n.pitch, n.dur, c.chord from n asof left join c on n.song=c.song and n.pos_ >= c.pos_), k as (select *, chord is not null and row_number() over (partition by song, chord order by pos_, pitch, dur, event_id) = 1 as called from a)"""


def _called(spark, sf_dir):
    """The notes of a part with the chord that sounds, and whether they are the first in it."""
    at = (F.col("measure") * 96 + F.col("shift")).alias("at")
    n = notes(spark, sf_dir).where("program = 'view'").select("song", "event_id", at, "measure", "shift", "pitch", "dur")
    c = _chords(spark, sf_dir).select("song", at, "event_id").groupBy("song", "at").agg(F.max("event_id").alias("chord"))
    w = Window.partitionBy("song", "chord").orderBy("at", "pitch", "dur", "event_id")
    return N.as_of(n, c, ["song"], "at", "chord").withColumn("called", F.col("chord").isNotNull() & (F.row_number().over(w) == 1))


@query(f"with {SQL_CALLED} select song, event_id, chord from k where called")
def chord_emit_once(spark, sf_dir):
    return _called(spark, sf_dir).where("called").select("song", "event_id", "chord")


@query(f"""with {SQL_CALLED}, x as (select k.song, k.measure, k.shift, k.pitch, k.dur, k.event_id, case when called then (select ch.r||' '||ch.q||' '||ch.b||' ' from ch where ch.event_id=k.chord) else '' end||(k.shift+51)||' '||(k.pitch+209)||' '||(k.dur+337) as t from k)
select song, cast(measure as integer) as measure, string_agg(t, ' ' order by shift, pitch, dur, event_id) as tokens from x group by 1,2""")
def notes_with_chords(spark, sf_dir):
    """Bars of notes with a chord's tokens before the first note in it."""
    c = _chords(spark, sf_dir).select(F.col("event_id").alias("chord"), "r", "q", "b")
    k = _called(spark, sf_dir).join(c, "chord", "left")
    chord = F.when(F.col("called"), F.array(*[F.col(x).cast("int") for x in ("r", "q", "b")])).otherwise(B.none())
    t = F.concat(chord, F.array((F.col("shift") + V.SHIFT).cast("int"), (F.col("pitch") + V.PITCH).cast("int"), (F.col("dur") + V.DUR).cast("int")))
    own = F.array_sort(F.collect_list(F.struct("shift", "pitch", "dur", "event_id", t.alias("t"))))
    return k.groupBy("song", "measure").agg(text(F.flatten(F.transform(own, lambda x: x["t"])), "tokens"))


@query(f"""with {SQL_CALLED}, m as (select song, measure, string_agg((shift+51)||' '||(pitch+209)||' '||(dur+337), ' ' order by shift, pitch, dur) as melody from n group by 1,2), c2 as (select song, measure, string_agg((shift+51)||' '||r||' '||q||' '||b, ' ' order by shift, event_id) as chords from ch group by 1,2)
select coalesce(m.song, c2.song) as song, cast(coalesce(m.measure, c2.measure) as integer) as measure, '49 '||coalesce(melody, '50') as melody, '49 '||coalesce(chords, '50') as chords from m full join c2 on m.song=c2.song and m.measure=c2.measure""")
def melody_and_chords(spark, sf_dir):
    """Two streams bar by bar, each with a blank where only the other has something."""
    n = notes(spark, sf_dir).where("program = 'view'")
    note = F.array_sort(F.collect_list(F.struct("shift", "pitch", "dur")))
    melody = n.groupBy("song", "measure").agg(F.flatten(F.transform(note, lambda x: F.array(x["shift"] + V.SHIFT, x["pitch"] + V.PITCH, x["dur"] + V.DUR))).alias("a"))
    one = F.array_sort(F.collect_list(F.struct("shift", "event_id", "r", "q", "b")))
    chords = _chords(spark, sf_dir).groupBy("song", "measure").agg(F.flatten(F.transform(one, lambda x: F.array(x["shift"] + V.SHIFT, x["r"], x["q"], x["b"]))).alias("b"))
    bar = lambda c: text(F.concat(B.tokens(V.SME), F.coalesce(F.col(c).cast("array<int>"), B.tokens(V.BLANK))))
    return melody.join(chords, ["song", "measure"], "full").select("song", "measure", bar("a").alias("melody"), bar("b").alias("chords"))


@query(f"with {SQL_TOK} select song, program, array_to_string(list_filter(t, lambda x: x = 49 or x between 51 and 147 or x between 209 and 625), ' ') as melody from tk")
def melody_projection(spark, sf_dir):
    return sequences(spark, sf_dir).select("song", "program", text(F.filter("tokens", lambda x: (x == V.SME) | _in(x, (V.SHIFT, 97), (V.PITCH, 417))), "melody"))


@query(f"with {SQL_PARTS} select song, cast(win as bigint) as win, array_to_string(list_filter(string_split(meta, ' '), lambda x: cast(x as integer) not between 629 and 636), ' ') as meta from s")
def strip_measure_count(spark, sf_dir):
    return samples(spark, sf_dir).select("song", "win", text(F.filter("meta", lambda x: ~_in(x, (V.GMC, 8))), "meta"))


@query(f"with {SQL_PARTS} select song, cast(win as bigint) as win, case when body='' then '627' else body||' 627' end as answer from s")
def strip_reasoning(spark, sf_dir):
    """Answers that begin with a system block (every other one) lose it; others stay."""
    s = samples(spark, sf_dir)
    given = F.when(F.col("h") % 2 == 0, F.concat("meta", "body", B.tokens(V.TE))).otherwise(F.concat("body", B.tokens(V.TE)))
    s = s.withColumn("a", given)
    return s.select("song", "win", text(F.when(F.get("a", F.lit(0)) == B.SYSTEM, B.cut_at(F.col("a"), V.TAG_END)).otherwise(F.col("a")), "answer"))


@query(f"with {SQL_NOTES} select song, cast((max(measure)+1)*96 as integer) as steps from notes group by 1 having (max(measure)+1)*96 <= 2784")
def oversize_guard(spark, sf_dir):
    return notes(spark, sf_dir).groupBy("song").agg(((F.max("measure") + 1) * 96).cast("int").alias("steps")).where("steps <= 2784")


@query(f"""with {SQL_PARTS}, b as (select song, win, program, role, n, bars from parts), r as (select song, program, cast(floor(bar/4) as integer) as q, avg(case when n=0 then 1e0 else 0e0 end) as blank from bars group by 1,2,3)
select t.song, t.program, cast(t.q as bigint) as win from r t join r q on q.song=t.song and q.program=t.program and q.q=t.q-1 where t.blank < 0.9e0 and q.blank < 0.8e0""")
def blank_target_and_query(spark, sf_dir):
    """Four bars are a target if they are not nearly empty, and the four before them a query; two limits."""
    n = notes(spark, sf_dir).where("program in ('view', 'click')")
    bars = B.bar_tokens(n, ["song", "program"])
    r = bars.groupBy("song", "program", F.expr("bar div 4").alias("win")).agg(F.avg((F.col("n") == 0).cast("double")).alias("blank"))
    q = r.select("song", "program", (F.col("win") + 1).alias("win"), F.col("blank").alias("before"))
    return r.join(q, ["song", "program", "win"]).where("blank < 0.9D and before < 0.8D").select("song", "program", "win")


# Lookups


@query(f"""with {SQL_MANIFEST}, v as (select *, song % 12 - 5 as shift, ({SQL_MOD.format(x='cast(song as varchar)', n=1000)}) as b from manifest) select song, cast(shift as bigint) as shift from v where b >= 900 and shift = 0""")
def heldout_originals(spark, sf_dir):
    """Held-out songs in their own key only."""
    m = manifest(spark, sf_dir).withColumn("shift", F.col("song") % 12 - 5)
    held = m.where(md5_mod(F.col("song").cast("string"), 1000) >= 900).select("song")
    return m.where("shift = 0").join(held, "song", "left_semi").select("song", "shift")


@query(f"""with {SQL_MANIFEST}, l as (select doc_id, quality from labels where toxic = 0) select m.song, m.dataset, m.label, l.quality from manifest m join l on l.doc_id=m.song""")
def pool_lookup(spark, sf_dir):
    """Labels of the documents of a pool: rows without one go."""
    l = table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("song"), "quality")  # noqa: E741
    return manifest(spark, sf_dir).join(l, "song").select("song", "dataset", "label", "quality")


@query("""with t as (select user_id, ts, max(value) as tempo from events where event_type='signup' group by 1,2) select e.event_id, coalesce(t.tempo, 0) as tempo from (select * from events where event_type='view') e asof left join t on e.user_id=t.user_id and e.ts >= t.ts""")
def tempo_at_note(spark, sf_dir):
    """The last tempo at or before each note; 0 before the first."""
    e = table(spark, sf_dir, "events")
    t = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("value").alias("tempo"))
    return N.as_of(e.where("event_type = 'view'"), t, ["user_id"], "ts", "tempo").select("event_id", F.coalesce("tempo", F.lit(0.0)).alias("tempo"))


@query("""with a as (select doc_id, quality as gold, row_number() over (order by doc_id) as k from labels), b as (select doc_id, n_chars, row_number() over (order by doc_id) as k from documents) select a.k as ordinal, a.gold, b.n_chars, (select count(*) from a) - (select count(*) from b) as mismatch from a join b on a.k=b.k""")
def positional_zip(spark, sf_dir):
    """Two tables put side by side by their place in the order of a key; mismatch is by how much the first one is longer."""
    a = C.numbered(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("gold")), "doc_id")
    b = C.numbered(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").drop("doc_id")
    n = a.agg(F.count("*").alias("na")).crossJoin(b.agg(F.count("*").alias("nb")))
    return a.join(b, "ordinal").crossJoin(F.broadcast(n)).select("ordinal", "gold", "n_chars", (F.col("na") - F.col("nb")).alias("mismatch"))


@query(f"with {SQL_NOTES}, g as (select song, program, count(*) as n, round(avg(pitch), 6) as pitch from notes group by 1,2) select a.song, a.n as generated, b.n as context, c.n as reference, round(a.pitch - c.pitch, 6) as gap from g a join g b on a.song=b.song and b.program='click' join g c on a.song=c.song and c.program='purchase' where a.program='view'")
def paired_parts(spark, sf_dir):
    """What was generated, what it followed and what it stands against, side by side."""
    g = notes(spark, sf_dir).groupBy("song").pivot("program", ["view", "click", "purchase"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pitch"), 6).alias("p"))
    full = g.where("view_n is not null and click_n is not null and purchase_n is not null")
    return full.select("song", F.col("view_n").alias("generated"), F.col("click_n").alias("context"), F.col("purchase_n").alias("reference"), F.round(F.col("view_p") - F.col("purchase_p"), 6).alias("gap"))


_SQL_KINDS = " ".join(f"when tok between {a} and {a + n - 1} then '{k}'" for k, a, n in V.RANGES)


@query(f"with {SQL_TOK}, e as (select unnest(t) + case when program='error' then 100 else 0 end as tok from tk) select case {_SQL_KINDS} end as kind, count(*) as n from e group by 1")
def token_kinds(spark, sf_dir):
    """Tokens by kind; ids beyond the vocabulary have none."""
    tok = F.col("tok") + F.when(F.col("program") == "error", 100).otherwise(0)
    e = sequences(spark, sf_dir).select("program", F.explode("tokens").alias("tok")).select(tok.alias("token_id"))
    return e.join(F.broadcast(V.vocabulary(spark)), "token_id", "left").groupBy("kind").agg(F.count("*").alias("n"))


# Samples of rows


@query(f"""with {SQL_MANIFEST}, g as (select dataset, sum(tokens) as t, md5('g'||dataset) as h from manifest group by 1), c as (select *, sum(t) over (order by h) as cum from g) select m.song, m.dataset from manifest m join c on c.dataset=m.dataset where c.cum - c.t < 1000000""")
def group_budget(spark, sf_dir, most: int = 1_000_000):
    """Whole groups in hash order until a budget is reached; the group that crosses it is still in."""
    m = manifest(spark, sf_dir)
    g = m.groupBy("dataset").agg(F.sum("tokens").alias("t")).withColumn("h", C.hashed("g", "dataset"))
    kept = C.running_total(g, "h", "dataset", "t").where(F.col("cum") - F.col("t") < most)
    return m.join(kept.select("dataset"), "dataset", "left_semi").select("song", "dataset")


@query(f"""with {SQL_MANIFEST}, r as (select song, row_number() over (order by md5('r'||cast(song as varchar)), song) as rn, count(*) over () as n from manifest) select song, case when rn <= floor(n*0.95e0) then 'train' else 'val' end as side from r""")
def ratio_split(spark, sf_dir):
    r = C.ranked(manifest(spark, sf_dir).withColumn("all", F.lit(1)), ["all"], "song", "r")
    return r.select("song", F.when(F.col("rn") <= F.floor(F.col("n") * 0.95), "train").otherwise("val").alias("side"))


@query("""select doc_id from (select doc_id, row_number() over (order by md5('d'||cast(doc_id as varchar)), doc_id) as rn from (select doc_id from documents except select doc_id from labels) x) y where rn <= 100""")
def difference_subset(spark, sf_dir):
    """A fixed number of the songs of one set that are not in another."""
    left = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").distinct()
    return left.orderBy(C.hashed("d", "doc_id"), "doc_id").limit(100)


@query(f"""with {SQL_MANIFEST} select song from (select song, row_number() over (order by md5('u'||cast(song as varchar)), song) as rn from manifest) x where rn <= 50""")
def uniform_sample(spark, sf_dir):
    return manifest(spark, sf_dir).select("song").orderBy(C.hashed("u", "song"), "song").limit(50)


@query(f"""with {SQL_MANIFEST}, s as (select tokens from (select tokens, row_number() over (order by md5('e'||cast(song as varchar)), song) as rn from manifest) x where rn <= 400) select round(avg(tokens), 6) as per_file, cast(round(avg(tokens)*(select count(*) from manifest)/8e0) as bigint) as steps from s""")
def sampled_estimate(spark, sf_dir):
    """Steps of an epoch, from the mean of 400 files and the number of all."""
    m = manifest(spark, sf_dir)
    s = m.select("song", "tokens").orderBy(C.hashed("e", "song"), "song").limit(400).agg(F.avg("tokens").alias("a"))
    return s.crossJoin(m.agg(F.count("*").alias("n"))).select(F.round("a", 6).alias("per_file"), F.round(F.col("a") * F.col("n") / 8.0).cast("long").alias("steps"))


@query(f"""with {SQL_MANIFEST}, t as (select *, sum(tokens) over (order by md5('b'||cast(song as varchar)), song rows unbounded preceding) as cum from manifest), b as (select *, unnest([200000, 800000, 3200000]) as budget from t) select cast(budget as bigint) as budget, label as arm, count(*) as sequences, count(distinct song % 500) as songs, round(count(*)/cast(count(distinct song % 500) as double), 6) as per_song from b where cum - tokens < budget group by 1,2""")
def songs_per_budget(spark, sf_dir):
    """Sequences, songs and sequences a song in each nested budget, arm by arm."""
    budgets = [200_000, 800_000, 3_200_000]
    t = C.running_total(manifest(spark, sf_dir).withColumn("_h", C.hashed("b", "song")), "_h", "song", "tokens")
    b = t.withColumn("budget", F.explode(F.array(*[F.lit(x).cast("long") for x in budgets]))).where(F.col("cum") - F.col("tokens") < F.col("budget"))
    songs = F.countDistinct(F.col("song") % 500)
    return b.groupBy("budget", F.col("label").alias("arm")).agg(F.count("*").alias("sequences"), songs.alias("songs"), F.round(F.count("*") / songs, 6).alias("per_song"))


@query("""select size, data, lr, size||'-'||data||'-'||lr as run from (values (20),(60),(160)) a(size), (values ('a1'),('a2')) b(data), (values (1),(2),(4)) c(lr) where size||'-'||data||'-'||lr not in ('20-a1-1','60-a2-4')""")
def open_runs(spark, sf_dir):
    """The grid of sizes, data and rates without the runs that are done."""
    one = lambda values, s: spark.createDataFrame([(v,) for v in values], s)
    grid = one((20, 60, 160), "size int").crossJoin(one(("a1", "a2"), "data string")).crossJoin(one((1, 2, 4), "lr int")).withColumn("run", F.concat_ws("-", "size", "data", "lr"))
    return grid.join(F.broadcast(one(("20-a1-1", "60-a2-4"), "run string")), "run", "left_anti").select("size", "data", "lr", "run")


# Time and space


@query("""with e as (select user_id, ts, event_id, cast(json_extract_string(props,'$.k') as integer) >= 50 as down from events where event_type='view'), c as (select *, coalesce(lag(down) over (partition by user_id order by ts, event_id), false) as before from e),
s as (select user_id, ts, event_id, down from c where down <> before), p as (select user_id, ts as on_, lead(ts) over (partition by user_id order by ts, event_id) as off_, down from s) select user_id, on_, off_ from p where down and off_ is not null""")
def pedal_spans(spark, sf_dir):
    """Spans in which a controller is at half or more; one that is never released is none."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").where("event_type = 'view'").withColumn("down", F.get_json_object("props", "$.k").cast("int") >= 50)
    s = e.withColumn("before", F.coalesce(F.lag("down").over(w), F.lit(False))).where("down <> before")
    return s.select("user_id", F.col("ts").alias("on_"), F.lead("ts").over(w).alias("off_"), "down").where("down and off_ is not null").drop("down")


@query(f"with {SQL_NOTES}, s as (select *, unnest([-7, 5, 30]) as moved from notes) select song, cast(moved as integer) as moved, count(*) as n, cast(sum(case when program='error' then pitch else pitch+moved end) as bigint) as pitches from s where program='error' or pitch+moved between 0 and 127 group by 1,2")
def roll_shift(spark, sf_dir):
    """A roll moved up or down: what leaves it is lost; drums stay."""
    s = notes(spark, sf_dir).withColumn("moved", F.explode(F.array(*[F.lit(x) for x in (-7, 5, 30)])))
    p = F.when(F.col("program") == "error", F.col("pitch")).otherwise(F.col("pitch") + F.col("moved"))
    return s.withColumn("p", p).where("p between 0 and 127").groupBy("song", "moved").agg(F.count("*").alias("n"), F.sum("p").alias("pitches"))


@query("select event_id, cast(floor(value/(60e0/120e0*4e0/96e0)) as bigint) as tick, round(floor(value/(60e0/120e0*4e0/96e0))*(60e0/120e0*4e0/96e0), 9) as seconds from events")
def seconds_to_ticks(spark, sf_dir, tempo: float = 120.0):
    step = 60.0 / tempo * 4.0 / 96.0
    tick = F.floor(F.col("value") / F.lit(step))
    return table(spark, sf_dir, "events").select("event_id", tick.alias("tick"), F.round(tick * F.lit(step), 9).alias("seconds"))


@query("""with t as (select user_id, ts, event_id, cast(floor(epoch(ts)) as bigint) as q, 60 + cast(json_extract_string(props,'$.k') as integer) as tempo from events where event_type='signup'),
m as (select *, lag(q) over w as q0, lag(tempo) over w as t0 from t window w as (partition by user_id order by ts, event_id)) select user_id, event_id, round(sum(coalesce((q-q0)*60e0/t0, 0)) over (partition by user_id order by ts, event_id rows unbounded preceding), 6) as seconds from m""")
def tempo_map(spark, sf_dir):
    """Seconds at each tempo change: beats between changes at the tempo before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    q, tempo = F.unix_timestamp("ts"), 60 + F.get_json_object("props", "$.k").cast("int")
    t = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", "ts", "event_id", q.alias("q"), tempo.alias("tempo"))
    step = F.coalesce((F.col("q") - F.lag("q").over(w)) * 60.0 / F.lag("tempo").over(w), F.lit(0.0))
    return t.withColumn("step", step).select("user_id", "event_id", F.round(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("seconds"))


@query(f"with {SQL_NOTES} select song, program, cast(greatest(measure-1, 0) as integer) as measure, pitch, round(greatest(measure-1, 0)*2e0 + shift*2e0/96e0, 6) as start, round(greatest(measure-1, 0)*2e0 + (shift+dur)*2e0/96e0, 6) as stop from notes where dur < 288")
def tokens_to_seconds(spark, sf_dir, tempo: float = 120.0):
    """Notes of a token sequence in seconds at one tempo."""
    bar = 60.0 / tempo * 4.0
    n = N.tokens_to_notes(sequences(spark, sf_dir), ["song", "program"])
    at = F.col("measure") * F.lit(bar)
    tick = lambda c: F.round(at + c * F.lit(bar) / 96.0, 6)
    return n.select("song", "program", "measure", "pitch", tick(F.col("shift")).alias("start"), tick(F.col("shift") + F.col("dur")).alias("stop"))


@query(f"with {SQL_NOTES}, c as (select song, program, measure, shift//12 as chunk, shift%12 as step, pitch from notes) select song, program, cast(measure as integer) as measure, cast(chunk as integer) as chunk, count(*) as cells, cast(min(measure*96+chunk*12+step) as integer) as first_step from c group by 1,2,3,4")
def bar_chunks(spark, sf_dir):
    """A bar in eight chunks of twelve steps, and the step of the song that a chunk's first cell had."""
    s = F.col("shift")
    n = notes(spark, sf_dir).select("song", "program", "measure", F.expr("cast(shift div 12 as int)").alias("chunk"), (s % 12).alias("step"))
    return n.groupBy("song", "program", "measure", "chunk").agg(F.count("*").alias("cells"), F.min(F.col("measure") * 96 + F.col("chunk") * 12 + F.col("step")).cast("int").alias("first_step"))


@query(f"with {SQL_NOTES}, m as (select song, max(measure)+1 as bars from notes group by 1), w as (select song, bars, unnest(range(0, greatest(bars-8, 0)+1, 4)) as a from m) select song, cast(a as integer) as a, cast(least(a+8, bars) as integer) as b from w")
def token_windows(spark, sf_dir, size: int = 8, step: int = 4):
    """Windows of bars by start; a song shorter than a window has one."""
    m = notes(spark, sf_dir).groupBy("song").agg((F.max("measure") + 1).alias("bars"))
    w = m.withColumn("a", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bars") - size, F.lit(0)), F.lit(step))))
    return w.select("song", "a", F.least(F.col("a") + size, F.col("bars")).cast("int").alias("b"))


@query(f"""with {SQL_NOTES}, c as (select distinct song, pitch, unnest(range(measure*96+shift, measure*96+shift+dur)) as step from notes where program='view'), g as (select *, step - lag(step) over (partition by song, pitch order by step) as gap from c),
i as (select *, sum(case when gap is null or gap > 4 then 1 else 0 end) over (partition by song, pitch order by step rows unbounded preceding) as island from g) select song, pitch, min(step) as start, max(step)+1 as stop, count(*) as cells from i group by song, pitch, island""")
def bridged_sustains(spark, sf_dir, bridge: int = 3):
    """Cells of a pitch as notes again: gaps of up to three steps are bridged."""
    spans, _ = R.roll_spans(notes(spark, sf_dir).where("program = 'view'"), ["song"])
    w = Window.partitionBy("song", "pitch").orderBy("start")
    gap = F.col("start") - F.lag("stop").over(w)
    i = spans.withColumn("new", F.when(gap.isNull() | (gap > bridge), 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    return i.groupBy("song", "pitch", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum(F.col("stop") - F.col("start")).alias("cells")).drop("island")
