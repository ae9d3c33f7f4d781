"""Queries for names, rewards, and the evaluation of what a model made."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as A
from ..functions import sql
from ..functions import scalars as X
from ..functions import vocab as V
from ..operators import metrics as M
from ..sources.tables import SQL_MOD, SQL_NOTES, SQL_PREDS, manifest, notes, predictions, table
from .metrics import _sql_shares
from .registry import query
from .samples import SQL_PARTS, foundation_samples, parts
from .sequences import SQL_BLOCKS, blocks

_LIST = lambda xs: "[" + ",".join(f"'{x}'" for x in xs) + "]"
_PICK = lambda xs, k: f"{_LIST(xs)}[cast({k} as integer)+1]"
_QUAL = (*A.QUALITIES[1:12], "xyz", "")
_MAP = lambda d: "map {" + ",".join(f"'{k}': " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in d.items()) + "}"


def _pick(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))


@query(f"""with c as (select event_id, {_PICK(A.ROOTS, 'event_id%20')}||{_PICK(_QUAL, 'event_id%13')}||case when event_id%3=0 then '/'||{_PICK(A.ROOTS, 'event_id%17')} else '' end as chord from events),
d as (select *, split_part(chord, '/', 1) as core, case when contains(chord, '/') then '/'||split_part(chord, '/', 2) else 'None' end as bass from c), r as (select *, case when substr(core, 1, 2) in ({", ".join(f"'{x}'" for x in A.ROOTS if len(x) == 2)}) then substr(core, 1, 2) else substr(core, 1, 1) end as root from d)
select event_id, chord, root, case when list_contains({_LIST(A.QUALITIES)}, substr(core, len(root)+1)) then substr(core, len(root)+1) else 'None' end as quality, bass from r""")
def chord_names(spark, sf_dir):
    """Chord names into root, quality and bass."""
    e = F.col("event_id")
    chord = F.concat(_pick(A.ROOTS, e % 20), _pick(_QUAL, e % 13), F.when(e % 3 == 0, F.concat(F.lit("/"), _pick(A.ROOTS, e % 17))).otherwise(""))
    c = table(spark, sf_dir, "events").select("event_id", chord.alias("chord"))
    root, quality, bass = A.chord_parts(F.col("chord"))
    return c.select("event_id", "chord", root.alias("root"), quality.alias("quality"), bass.alias("bass"))


_TONICS = (*A.SHARPS, "D-", "E-", "F-", "B-", "Cb", "H")
_TOKEN = f"case when list_contains({_LIST(A.MAJOR_KEYS)}, t) then t||m when list_contains({_LIST(A.MAJOR_KEYS)}, o) then o||m else 'Unknown' end"


@query(f"""with k as (select event_id, replace({_PICK(_TONICS, f'event_id%{len(_TONICS)}')}, '-', 'b') as t, case when event_id%2=0 then 'M' else 'm' end as m, event_id%11-5 as shift from events), o as (select *, coalesce({_MAP(A.FLATS | {v: k for k, v in A.FLATS.items()})}[t], '?') as o, {_MAP(A.CLASSES)}[t] as pc from k)
select event_id, {_TOKEN} as token, coalesce({_LIST(A.SHARPS)}[cast((pc+shift+12)%12 as integer)+1]||m, 'Unknown') as moved, coalesce({_MAP(A.FLATS)}[t], t)||m as flat from o""")
def key_names(spark, sf_dir):
    """Key names of the vocabulary, of transpositions, and with flats only."""
    e = F.col("event_id")
    mode = F.when(e % 2 == 0, "major").otherwise("minor")
    k = table(spark, sf_dir, "events").select("event_id", _pick(_TONICS, e % len(_TONICS)).alias("tonic"), mode.alias("mode"), (e % 11 - 5).alias("shift"))
    t = F.regexp_replace("tonic", "-", "b")
    m = F.when(F.col("mode") == "major", "M").otherwise("m")
    return k.select(
        "event_id", A.key_token(F.col("tonic"), F.col("mode")).alias("token"), A.transposed_key(t, F.col("shift"), F.col("mode")).alias("moved"),
        A.in_flats(F.concat(t, m)).alias("flat"),
    )


@query(r"""with n as (select doc_id, 'song'||(doc_id//12)||case when doc_id%12=5 then '' else '_shift_'||(doc_id%12-5) end||case when doc_id%7=0 then '.midi.npz' else '.mid.npz' end as name from documents)
select doc_id, regexp_replace(name, '\.mid.*', '') as stem, regexp_extract(name, '^(.*?)(?:_shift_-?\d+)?\.mid', 1) as song, case when regexp_matches(name, '_shift_(-?\d+)\.mid\.') then cast(regexp_extract(name, '_shift_(-?\d+)\.mid\.', 1) as integer) else 0 end as shift from n""")
def file_names(spark, sf_dir):
    """Song, transposition and stem from a file's name; without a readable shift it is 0."""
    d = F.col("doc_id")
    shift = F.when(d % 12 == 5, "").otherwise(F.concat(F.lit("_shift_"), (d % 12 - 5).cast("string")))
    name = F.concat(F.lit("song"), F.expr("doc_id div 12").cast("string"), shift, F.when(d % 7 == 0, ".midi.npz").otherwise(".mid.npz"))
    n = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    found = F.regexp_extract("name", r"_shift_(-?\d+)\.mid\.", 1)
    return n.select("doc_id", F.regexp_replace("name", r"\.mid.*", "").alias("stem"), F.regexp_extract("name", r"^(.*?)(?:_shift_-?\d+)?\.mid", 1).alias("song"), F.when(found != "", found.cast("int")).otherwise(0).alias("shift"))


_GENRES = ("rock", "jazz", "pop", "folk", "blues")


@query(f"""with g as (select source, list(distinct lang||(doc_id%7)) as tags from documents group by 1), x as (select source, list_filter(list_transform(list_sort(tags), lambda t: list_position({_LIST([f'{a}{k}' for a in ('en', 'fr', 'de') for k in range(7)])}, t)), lambda p: p is not null and p > 0) as ids from g)
select source, array_to_string(list_sort(list_transform(ids, lambda p: 646+p)), ' ') as genres from x""")
def genre_ids(spark, sf_dir):
    """Names of genres as tokens; unknown names are dropped."""
    known = {f"{a}{k}": V.GENRE + i for i, (a, k) in enumerate((a, k) for a in ("en", "fr", "de") for k in range(7))}
    d = table(spark, sf_dir, "documents").select("source", F.concat("lang", (F.col("doc_id") % 7).cast("string")).alias("tag"))
    ids = F.filter(F.transform(F.collect_set("tag"), lambda t: A.mapped(t, known)), lambda x: x.isNotNull())
    return d.groupBy("source").agg(F.array_join(F.array_sort(ids), " ").alias("genres"))


@query("""select o_orderkey, case when (o_orderkey*1237.3e0+0.37e0) >= 1e9 then printf('%.2fB', (o_orderkey*1237.3e0+0.37e0)/1e9) when (o_orderkey*1237.3e0+0.37e0) >= 1e6 then printf('%.2fM', (o_orderkey*1237.3e0+0.37e0)/1e6) when (o_orderkey*1237.3e0+0.37e0) >= 1e3 then printf('%.2fK', (o_orderkey*1237.3e0+0.37e0)/1e3) else cast((o_orderkey*1237.3e0+0.37e0) as varchar) end as size,
 round(power(512e0, -0.5e0)*least(power(cast(greatest(o_orderkey, 1) as double), -0.5e0), greatest(o_orderkey, 1)*power(4000e0, -1.5e0)), 12) as noam, round(case when o_orderkey < 100 then 0.001e0*o_orderkey/100e0 else 0.00001e0+0.00099e0*0.5e0*(1+cos(3.141592653589793e0*least(1e0, (o_orderkey-100)/9900e0))) end, 12) as cosine from orders""")
def rates_and_sizes(spark, sf_dir):
    """Learning rates by step, and numbers as people write them."""
    k = F.col("o_orderkey")
    size = A.human_count(k * F.lit(1237.3) + F.lit(0.37))
    return table(spark, sf_dir, "orders").select("o_orderkey", size.alias("size"), F.round(A.noam_rate(k, 512, 4000), 12).alias("noam"), F.round(A.cosine_rate(k, 100, 10000, 0.001, 0.00001), 12).alias("cosine"))


@query("select event_id, case when k between 65 and 68 then 'SAX' when k between 0 and 7 then 'PIANO' when k between 32 and 39 then 'BASS' else 'OTHER' end as program from (select event_id, cast(json_extract_string(props,'$.k') as integer) as k from events) t")
def program_groups(spark, sf_dir):
    """Program numbers by groups of instruments."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.when(k.between(65, 68), "SAX").when(k.between(0, 7), "PIANO").when(k.between(32, 39), "BASS").otherwise("OTHER").alias("program"))


# Rewards

SQL_GEN = f"""{SQL_PARTS}, want as (select song, win, list(inst order by inst) filter (n > 0) as inst, max(density) filter (inst=9) as sax, max(density) filter (inst=10) as piano, 4 as bars from dens group by 1,2),
got as (select song, win-1 as win, list(inst order by inst) filter (n > 0) as inst, max(density) filter (inst=9) as sax, max(density) filter (inst=10) as piano, 3+song%3 as bars from dens group by 1,2),
wg as (select w.song, w.win, coalesce(w.inst, []) as wi, coalesce(g.inst, []) as gi, w.sax as ws, g.sax as gs, w.piano as wp, g.piano as gp, w.bars as wb, g.bars as gb from want w join got g on g.song=w.song and g.win=w.win)"""


def _made(spark, sf_dir):
    """What a window asks for, and what the next one of the song holds, which stands for what was made."""
    p = parts(spark, sf_dir).where("role = 'const'").withColumn("win", F.col("window").cast("long"))
    most = F.when(F.col("program") == "view", 24.0).otherwise(45.0)
    d = F.when(F.col("n") > 0, F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(F.round(F.col("n") / F.col("bars") / most * 10, 9)).cast("int"))))
    g = p.withColumn("d", d).groupBy("song", "win").agg(
        F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.col("inst")))).alias("i"), F.max(F.when(F.col("inst") == 9, F.col("d"))).alias("s"), F.max(F.when(F.col("inst") == 10, F.col("d"))).alias("p")
    )
    want = g.select("song", "win", F.col("i").alias("wi"), F.col("s").alias("ws"), F.col("p").alias("wp"), F.lit(4).alias("wb"))
    got = g.select("song", (F.col("win") - 1).alias("win"), F.col("i").alias("gi"), F.col("s").alias("gs"), F.col("p").alias("gp"), (F.col("song") % 3 + 3).alias("gb"))
    return want.join(got, ["song", "win"])


_SQL_JAC = "case when len(wi)=0 and len(gi)=0 then 0e0 else 1-len(list_intersect(wi, gi))/cast(len(list_distinct(list_concat(wi, gi))) as double) end"
_SQL_DENS = "(case when ws is null then 0e0 else coalesce(least(1e0, abs(gs-ws)/9e0), 1e0) end + case when wp is null then 0e0 else coalesce(least(1e0, abs(gp-wp)/9e0), 1e0) end)/nullif(len(wi), 0)"


_SQL_GENRES = "list_distinct([song % 42, case when song % 3 = 0 then (song * 7) % 42 else song % 42 end]) as wg_, list_distinct([(song + win % 2) % 42]) as gg"


@query(f"""with {SQL_GEN}, d as (select *, {_SQL_DENS} as dd, {_SQL_JAC} as di, {_SQL_GENRES} from wg), e as (select *, 1 - len(list_intersect(wg_, gg))/cast(len(list_distinct(list_concat(wg_, gg))) as double) as dg from d)
select song, cast(win as bigint) as win, round(coalesce(1-dd, 1), 6) as density, round(1-dg, 6) as genre, round(1-di, 6) as inst, round(1-least(1e0, abs(gb-wb)/cast(wb as double)), 6) as measures, round(case when len(wi)=0 then 0e0 else 0.25e0-0.5e0*dd end + 0.25e0-0.5e0*dg + case when len(wi)=0 then 0e0 else 0.25e0-0.5e0*di end, 6) as reward from e""")
def meta_match_reward(spark, sf_dir):
    """Distance of what was made to what was asked for: densities instrument by instrument, genres and instruments as sets;
    the number of bars is observed only."""
    each = lambda w, g: F.when(F.col(w).isNull(), 0.0).otherwise(X.ordinal_distance(F.col(g), F.col(w), 9))
    n, song = F.size("wi"), F.col("song")
    dd = (each("ws", "gs") + each("wp", "gp")) / F.nullif(n, F.lit(0))
    di = X.jaccard_distance(F.col("wi"), F.col("gi"))
    asked = F.array_distinct(F.array(song % 42, F.when(song % 3 == 0, song * 7 % 42).otherwise(song % 42)))
    dg = X.jaccard_distance(asked, F.array((song + F.col("win") % 2) % 42))
    score = F.when(n == 0, 0.0).otherwise(X.attribute_score(dd, 0.25, 0.25) + X.attribute_score(di, 0.25, 0.25)) + X.attribute_score(dg, 0.25, 0.25)
    bars = F.least(F.lit(1.0), F.abs(F.col("gb") - F.col("wb")) / F.col("wb"))
    return _made(spark, sf_dir).select(
        "song", "win", F.round(F.coalesce(1 - dd, F.lit(1.0)), 6).alias("density"), F.round(1 - dg, 6).alias("genre"), F.round(1 - di, 6).alias("inst"),
        F.round(1 - bars, 6).alias("measures"), F.round(score, 6).alias("reward"),
    )


@query(f"with {SQL_GEN} select song, cast(win as bigint) as win, round(greatest(0e0, 1-abs(gb-wb)/cast(wb as double)), 6) as measure, round(case when len(wi)=0 then 1e0 else 1-{_SQL_JAC} end, 6) as inst, round((greatest(0e0, 1-abs(gb-wb)/cast(wb as double))+case when len(wi)=0 then 1e0 else 1-{_SQL_JAC} end)/2, 6) as reward from wg")
def structural_reward(spark, sf_dir):
    """Bars and instruments, measured on what was made: half each."""
    m = F.greatest(F.lit(0.0), 1 - F.abs(F.col("gb") - F.col("wb")) / F.col("wb"))
    i = F.when(F.size("wi") == 0, 1.0).otherwise(1 - X.jaccard_distance(F.col("wi"), F.col("gi")))
    return _made(spark, sf_dir).select("song", "win", F.round(m, 6).alias("measure"), F.round(i, 6).alias("inst"), F.round((m + i) / 2, 6).alias("reward"))


@query(f"with {SQL_GEN}, v as (select song, win, list_filter([case when ws is not null and gs is not null then greatest(0e0, least(1e0, (abs(gs-ws)-1)/8e0)) end, case when wp is not null and gp is not null then greatest(0e0, least(1e0, (abs(gp-wp)-1)/8e0)) end], lambda x: x is not null) as v, coalesce(abs(gs-ws), 0) <= 1 and coalesce(abs(gp-wp), 0) <= 1 as ok from wg) select song, cast(win as bigint) as win, round(coalesce(list_avg(v), 0), 6) as violation, case when len(v) > 0 then ok end as ok from v")
def density_violation(spark, sf_dir, tolerance: int = 1):
    """By how much densities miss, beyond a tolerance; instruments that are missing are not counted here."""
    one = lambda w, g: X.clamp((F.abs(F.col(g) - F.col(w)) - tolerance) / (9.0 - tolerance), 0.0, 1.0)
    has = lambda w, g: F.col(w).isNotNull() & F.col(g).isNotNull()
    v = F.filter(F.array(F.when(has("ws", "gs"), one("ws", "gs")), F.when(has("wp", "gp"), one("wp", "gp"))), lambda x: x.isNotNull())
    near = lambda w, g: F.coalesce(F.abs(F.col(g) - F.col(w)), F.lit(0)) <= tolerance
    d = _made(spark, sf_dir).withColumn("v", v)
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("v"), F.lit(0))
    return d.select("song", "win", F.round(F.coalesce(mean, F.lit(0.0)), 6).alias("violation"), F.when(F.size("v") > 0, near("ws", "gs") & near("wp", "gp")).alias("ok"))


SQL_OUT = f"""{SQL_NOTES}, k as (select *, song%12 as tonic, song%2=1 as minor from notes where program in ('view','click')), o as (select song, program, avg(case when (not minor and (pitch-tonic+144)%12 in (0,2,4,5,7,9,11)) or (minor and (pitch-tonic+144)%12 in (0,2,3,5,7,8,10,11)) then 0e0 else 1e0 end) as out_ from k group by 1,2)"""


def _out_of_key(spark, sf_dir):
    n = notes(spark, sf_dir).where("program in ('view', 'click')")
    miss = 1.0 - X.in_scale(F.col("pitch"), F.col("song") % 12, F.col("song") % 2 == 1).cast("double")
    return n.groupBy("song", "program").agg(F.avg(miss).alias("out_"))


@query(f"with {SQL_OUT} select song, program, round(out_, 6) as out_ from o")
def out_of_key_ratio(spark, sf_dir):
    return _out_of_key(spark, sf_dir).withColumn("out_", F.round("out_", 6))


@query(f"with {SQL_OUT}, v as (select g.song, g.out_ as g, greatest(0.2e0, coalesce(r.out_, 0)) + 0.1e0 as tau from (select * from o where program='view') g left join (select * from o where program='click') r on r.song=g.song) select song, round(case when tau >= 1 then 0e0 else greatest(0e0, least(1e0, (g-tau)/(1-tau))) end, 6) as violation from v")
def key_violation(spark, sf_dir):
    """Notes out of key beyond what the reference has, itself with a floor and a margin."""
    o = _out_of_key(spark, sf_dir)
    r = o.where("program = 'click'").select("song", F.col("out_").alias("r"))
    tau = F.greatest(F.lit(0.2), F.coalesce("r", F.lit(0.0))) + 0.1
    v = F.when(tau >= 1, 0.0).otherwise(X.clamp((F.col("out_") - tau) / F.nullif(1 - tau, F.lit(0.0)), 0.0, 1.0))
    return o.where("program = 'view'").join(r, "song", "left").select("song", F.round(v, 6).alias("violation"))


SQL_TOTAL = """t as (select event_id, event_type, cast(json_extract_string(props,'$.k') as integer) as k, value from events), r as (select *, k % 10 = 0 as empty, greatest(0e0, least(1e0, 0.5e0-(value/25e0-10e0)/8e0)) as disc, 0.5e0*(k%7)/6e0 as dens, 0.25e0*(k%5)/4e0 as key_, 0.3e0*(k%3)/2e0 as struct_ from t),
z as (select event_id, event_type, empty, case when empty then -1e0 else disc-dens-key_-struct_ end as reward, case when empty then 0e0 else disc end as disc, case when empty then 0e0 else -dens end as dens, case when empty then 0e0 else -key_ end as key_, case when empty then 0e0 else -struct_ end as struct_ from r)"""


def _rewards(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    t = table(spark, sf_dir, "events").select("event_id", "event_type", (k % 10 == 0).alias("empty"), X.discriminator_reward(F.col("value") / 25.0 - 10.0).alias("disc"), (0.5 * (k % 7) / 6.0).alias("dens"), (0.25 * (k % 5) / 4.0).alias("key_"), (0.3 * (k % 3) / 2.0).alias("struct_"))
    part = lambda c: F.when(F.col("empty"), 0.0).otherwise(c)
    reward = F.when(F.col("empty"), -1.0).otherwise(F.col("disc") - F.col("dens") - F.col("key_") - F.col("struct_"))
    return t.select("event_id", "event_type", "empty", reward.alias("reward"), part(F.col("disc")).alias("disc"), *[part(-F.col(c)).alias(c) for c in ("dens", "key_", "struct_")])


@query(f"with {SQL_TOTAL} select event_id, round(reward, 6) as reward from z")
def total_reward(spark, sf_dir):
    """What drives, less what violates; a fixed value for empty outputs."""
    return _rewards(spark, sf_dir).select("event_id", F.round("reward", 6).alias("reward"))


@query(f"with {SQL_TOTAL} select event_type, round(avg(disc), 6) as disc, round(avg(dens), 6) as dens, round(avg(key_), 6) as key_, round(avg(struct_), 6) as struct_, round(avg(case when empty then 1e0 else 0e0 end), 6) as empty_rate from z group by 1")
def reward_means(spark, sf_dir):
    m = lambda c: F.round(F.avg(c), 6).alias(c)
    return _rewards(spark, sf_dir).groupBy("event_type").agg(*map(m, ("disc", "dens", "key_", "struct_")), F.round(F.avg(F.col("empty").cast("double")), 6).alias("empty_rate"))


# Distributions

_SQL_JS = "select {by}, round(sum((p*log2(p/((p+q)/2)) + q*log2(q/((p+q)/2)))/2), 6) as {name} from (select {by}, p/sum(p) over (partition by {by}) as p, q/sum(q) over (partition by {by}) as q from (select a.{by}, a.p+1e-12 as p, b.p+1e-12 as q from {h} a join {h} b on a.{by}=b.{by} and a.bin=b.bin and a.program='view' and b.program='click') j) n group by {by}"


def _sides(spark, sf_dir, value, k, name):
    s = M.shares(notes(spark, sf_dir).where("program in ('view', 'click')"), ["song", "program"], value, k)
    a, b = (s.where(F.col("program") == p).drop("program") for p in ("view", "click"))
    return M.js_divergence(a, b, ["song"]).select("song", F.round("js", 6).alias(name))


@query(f"with {SQL_NOTES}, {_sql_shares('h', 'dur', 289, 'song, program')} {_SQL_JS.format(by='song', name='js', h='h')}")
def duration_js(spark, sf_dir):
    return _sides(spark, sf_dir, F.col("dur"), 289, "js")


@query(f"with {SQL_NOTES}, {_sql_shares('h', 'measure*96+shift', 24, 'song, program')} {_SQL_JS.format(by='song', name='js', h='h')}")
def phase_js(spark, sf_dir):
    return _sides(spark, sf_dir, F.col("measure") * 96 + F.col("shift"), 24, "js")


@query(f"""with {SQL_NOTES}, t as (select song, program, unnest([shift+51, pitch+209, dur+337]) as tok from notes where program in ('view','click')), v as (select song, program, tok from t where tok < 147 or tok between 209 and 335 or tok between 337 and 624), c as (select song, tok, sum(case when program='view' then 1 else 0 end) as a, sum(case when program='click' then 1 else 0 end) as b from v group by 1,2),
s as (select song, a/cast(sum(a) over (partition by song) as double) as a, b/cast(sum(b) over (partition by song) as double) as b, sum(a) over (partition by song) as na, sum(b) over (partition by song) as nb from c), e as (select *, a+1e-12 as p, b+1e-12 as q from s where na > 0 and nb > 0), z as (select song, p/sum(p) over (partition by song) as p, q/sum(q) over (partition by song) as q from e)
select song, round(sum((p*log2(p/((p+q)/2)) + q*log2(q/((p+q)/2)))/2), 6) as js from z group by 1""")
def vocabulary_js(spark, sf_dir):
    """Tokens of places, pitches and durations of what was made against those of its context; without either there is none."""
    t = notes(spark, sf_dir).where("program in ('view', 'click')").select("song", "program", F.explode(F.array(F.col("shift") + V.SHIFT, F.col("pitch") + V.PITCH, F.col("dur") + V.DUR)).alias("tok"))
    v = t.where((F.col("tok") < 147) | F.col("tok").between(209, 335) | F.col("tok").between(337, 624))
    c = v.groupBy("song", "tok").agg(F.count_if(F.col("program") == "view").alias("a"), F.count_if(F.col("program") == "click").alias("b"))
    w = Window.partitionBy("song")
    s = c.withColumns({"na": F.sum("a").over(w), "nb": F.sum("b").over(w)}).where("na > 0 and nb > 0")
    side = lambda x, n: s.select("song", F.col("tok").alias("bin"), (F.col(x) / F.col(n)).alias("p"))
    return M.js_divergence(side("a", "na"), side("b", "nb"), ["song"]).withColumn("js", F.round("js", 6))


@query(f"with {SQL_NOTES}, d as (select song, measure >= 15 as after, count(*)/cast(count(distinct measure) as double) as d from notes group by 1,2) select song, round(abs(coalesce(max(d) filter (after), 0) - coalesce(max(d) filter (not after), 0)), 6) as step from d group by 1")
def density_step(spark, sf_dir):
    """Difference of notes a bar before and after a seam; a side without notes has none a bar."""
    d = notes(spark, sf_dir).groupBy("song", (F.col("measure") >= 15).alias("after")).agg((F.count("*") / F.countDistinct("measure")).alias("d"))
    of = lambda c: F.coalesce(F.max(F.when(c, F.col("d"))), F.lit(0.0))
    return d.groupBy("song").agg(F.round(F.abs(of(F.col("after")) - of(~F.col("after"))), 6).alias("step"))


@query(f"with {SQL_NOTES}, {_sql_shares('h', 'pitch', 12, 'song')} select cast(bin as integer) as bin, round(avg(p), 6) as p from h group by bin")
def mean_pitch_class(spark, sf_dir):
    """Mean over files of each one's pitch class histogram."""
    return M.shares(notes(spark, sf_dir), ["song"], F.col("pitch"), 12).groupBy("bin").agg(F.round(F.avg("p"), 6).alias("p"))


@query(f"with {SQL_PREDS}, v as (select source, lang, gold, pred, count(*) as c, min(doc_id) as f from p group by 1,2,3,4), m as (select source, lang, gold, pred, row_number() over (partition by source, lang, gold order by c desc, f) as rn from v) select gold, round(avg(case when pred=gold then 1e0 else 0e0 end), 6) as accuracy, count(*) as files from m where rn = 1 group by 1")
def per_class_accuracy(spark, sf_dir):
    """Accuracy by class over files: each file (source, language and class) votes first."""
    m = M.majority(predictions(spark, sf_dir), ["source", "lang", "gold"], "pred", "doc_id")
    return m.groupBy("gold").agg(F.round(F.avg((F.col("pred") == F.col("gold")).cast("double")), 6).alias("accuracy"), F.count("*").alias("files"))


@query(f"with {SQL_NOTES} select song % 3 as model, program as task, count(distinct song) as samples, count(*) as notes_, round(count(*)/cast(count(distinct song) as double), 6) as per_sample, round(avg(pitch), 6) as pitch, max(pitch)-min(pitch) as span, round(avg(dur), 6) as dur from notes group by 1,2")
def generation_summary(spark, sf_dir):
    songs = F.countDistinct("song")
    return notes(spark, sf_dir).groupBy((F.col("song") % 3).alias("model"), F.col("program").alias("task")).agg(
        songs.alias("samples"), F.count("*").alias("notes_"), F.round(F.count("*") / songs, 6).alias("per_sample"), F.round(F.avg("pitch"), 6).alias("pitch"),
        (F.max("pitch") - F.min("pitch")).alias("span"), F.round(F.avg("dur"), 6).alias("dur"),
    )


SQL_NLL = "n as (select user_id % 2 as arm, user_id//2 as pair, event_type as bucket, value/100e0 as nll, ts, event_id from events)"


def _nll(spark, sf_dir):
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select((u % 2).alias("arm"), F.floor(u / 2).alias("pair"), F.col("event_type").alias("bucket"), (F.col("value") / 100.0).alias("nll"), "ts", "event_id")


@query(f"with {SQL_NLL}, b as (select pair, bucket, sum(nll) filter (arm=0)/nullif(count(*) filter (arm=0), 0) as a, sum(nll) filter (arm=1)/nullif(count(*) filter (arm=1), 0) as b from n group by 1,2) select bucket, count(*) as pairs, round(avg(a), 6) as first_, round(avg(b), 6) as second_, round(avg(a-b), 6) as gap, round(coalesce(stddev_samp(a-b), 0), 6) as sd from b where a is not null and b is not null group by 1")
def nll_by_bucket(spark, sf_dir):
    """Loss by bucket of two arms, and their differences pair by pair."""
    mean = lambda k: F.avg(F.when(F.col("arm") == k, F.col("nll")))
    b = _nll(spark, sf_dir).groupBy("pair", "bucket").agg(mean(0).alias("a"), mean(1).alias("b")).where("a is not null and b is not null")
    gap = F.col("a") - F.col("b")
    return b.groupBy("bucket").agg(F.count("*").alias("pairs"), F.round(F.avg("a"), 6).alias("first_"), F.round(F.avg("b"), 6).alias("second_"), F.round(F.avg(gap), 6).alias("gap"), F.round(F.coalesce(F.stddev_samp(gap), F.lit(0.0)), 6).alias("sd"))


@query(f"with {SQL_NLL}, r as (select *, row_number() over (partition by arm, pair order by ts, event_id) as a, row_number() over (partition by arm, pair order by ts desc, event_id desc) as b from n), p as (select arm, nll, unnest(list_filter([case when a=1 then 'first1' end, case when a<=3 then 'first3' end, case when a>3 and b>1 then 'interior' end, case when b=1 then 'last1' end], lambda x: x is not null)) as pos from r) select arm, pos, count(*) as n, round(avg(nll), 6) as nll, round(avg(case when nll < 0.5e0 then 1e0 else 0e0 end), 6) as acc1, round(avg(case when nll < 2e0 then 1e0 else 0e0 end), 6) as acc5 from p group by 1,2")
def boundary_nll(spark, sf_dir):
    """Loss and hits at the first, the first three, the inner and the last positions."""
    w = Window.partitionBy("arm", "pair")
    r = _nll(spark, sf_dir).withColumns({"a": F.row_number().over(w.orderBy("ts", "event_id")), "b": F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))})
    a, b = F.col("a"), F.col("b")
    places = F.filter(F.array(F.when(a == 1, "first1"), F.when(a <= 3, "first3"), F.when((a > 3) & (b > 1), "interior"), F.when(b == 1, "last1")), lambda x: x.isNotNull())
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    p = r.select("arm", "nll", F.explode(places).alias("pos"))
    return p.groupBy("arm", "pos").agg(F.count("*").alias("n"), F.round(F.avg("nll"), 6).alias("nll"), rate(F.col("nll") < 0.5).alias("acc1"), rate(F.col("nll") < 2.0).alias("acc5"))


@query(f"with {SQL_NLL}, r as (select arm, bucket, pair % 5 as seed, avg(nll) as m from n group by 1,2,3) select arm, bucket as pos, round(avg(m), 6) as mean, round(coalesce(stddev_samp(m), 0), 6) as sd from r group by 1,2")
def boundary_seeds(spark, sf_dir):
    """Mean and deviation over seeds, by arm and position."""
    r = _nll(spark, sf_dir).groupBy("arm", "bucket", (F.col("pair") % 5).alias("seed")).agg(F.avg("nll").alias("m"))
    return r.groupBy("arm", F.col("bucket").alias("pos")).agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), 6).alias("sd"))


@query(f"with {SQL_PREDS}, t as (select *, unnest([1, 4, 16]) as part, ({SQL_MOD.format(x="'c'||cast(doc_id as varchar)", n=16)}) as h from p) select cast(part as bigint) as part, 'ft'||part as checkpoint, count(*) as n, round(avg(case when gold=pred then 1e0 else 0e0 end), 6) as accuracy from t where h < part group by 1,2")
def learning_curve(spark, sf_dir):
    """Metrics of checkpoints by the part of the data, in sixteenths, that they were tuned on."""
    h = X.md5_mod(F.concat(F.lit("c"), F.col("doc_id").cast("string")), 16)
    t = predictions(spark, sf_dir).withColumn("part", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 4, 16)]))).where(h < F.col("part"))
    return t.groupBy("part", F.concat(F.lit("ft"), F.col("part").cast("string")).alias("checkpoint")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 6).alias("accuracy"))


@query(f"with {SQL_PREDS}, c as (select distinct lang as known from p where source in ('src1','src2')), k as (select * from p where lang in (select known from c) and source not in ('src1','src2')) select count(*) as n, round(avg(case when gold=pred then 1e0 else 0e0 end), 6) as accuracy from k")
def known_class_eval(spark, sf_dir):
    """Accuracy on rows whose class was seen in training."""
    p = predictions(spark, sf_dir)
    seen = F.col("source").isin("src1", "src2")
    k = p.where(~seen).join(p.where(seen).select("lang").distinct(), "lang", "left_semi")
    return k.agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 6).alias("accuracy"))


@query(f"with {SQL_BLOCKS}, f as (select conv_id, min(turn) filter (block='META') as m, min(turn) filter (block<>'META') as b from blocks group by 1) select count(*) as n, round(avg(case when m is not null and (b is null or m < b) then 1e0 else 0e0 end), 6) as rate from f")
def meta_first_rate(spark, sf_dir):
    """Share of outputs in which the system block stands before any music."""
    at = lambda c: F.min(F.when(c, F.col("turn")))
    f = blocks(spark, sf_dir).groupBy("conv_id").agg(at(F.col("block") == "META").alias("m"), at(F.col("block") != "META").alias("b"))
    first = F.col("m").isNotNull() & (F.col("b").isNull() | (F.col("m") < F.col("b")))
    return f.agg(F.count("*").alias("n"), F.round(F.avg(first.cast("double")), 6).alias("rate"))


@query(f"with {SQL_NOTES}, a as (select song, program, measure, shift, pitch, dur, row_number() over (partition by song, program order by measure, shift, pitch, dur, event_id) as k from notes), b as (select song, program, measure, shift, pitch, least(dur + case when event_id%10=0 then 1 when event_id%25=1 then 3 else 0 end, 288) as dur, row_number() over (partition by song, program order by measure, shift, pitch, dur, event_id) as k from notes) select a.song, a.program, count(*) as n, cast(sum(case when a.pitch=b.pitch and a.measure=b.measure and a.shift=b.shift and abs(a.dur-b.dur) <= 1 then 0 else 1 end) as bigint) as mismatch from a join b on a.song=b.song and a.program=b.program and a.k=b.k group by 1,2")
def round_trip(spark, sf_dir):
    """Two versions of a song note by note, in order; durations may differ by one."""
    w = Window.partitionBy("song", "program").orderBy("measure", "shift", "pitch", "dur", "event_id")
    a = notes(spark, sf_dir).withColumn("k", F.row_number().over(w))
    e = F.col("event_id")
    other = F.least(F.col("dur") + F.when(e % 10 == 0, 1).when(e % 25 == 1, 3).otherwise(0), F.lit(288))
    b = a.select("song", "program", "k", *[F.col(c).alias(f"{c}2") for c in ("measure", "shift", "pitch")], other.alias("dur2"))
    same = (F.col("pitch") == F.col("pitch2")) & (F.col("measure") == F.col("measure2")) & (F.col("shift") == F.col("shift2")) & (F.abs(F.col("dur") - F.col("dur2")) <= 1)
    return a.join(b, ["song", "program", "k"]).groupBy("song", "program").agg(F.count("*").alias("n"), F.count_if(~same).alias("mismatch"))


@query("with n as (select doc_id, 'song'||(doc_id//12)||case when doc_id%12=5 then '' else '_shift_'||(doc_id%12-5) end||'.mid.npz' as name from documents), s as (select distinct 'song'||(doc_id//12) as song, doc_id//12 % 10 as h from documents) select n.doc_id, case when s.h < 8 then 'train' when s.h = 8 then 'val' else 'test' end as split from n join s on s.song = replace(n.name, '.mid.npz', '')")
def exact_stem_index(spark, sf_dir):
    """Files by the split of their song, by exact name: transposed variants drop out."""
    d = F.col("doc_id")
    shift = F.when(d % 12 == 5, "").otherwise(F.concat(F.lit("_shift_"), (d % 12 - 5).cast("string")))
    n = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("song"), F.expr("doc_id div 12").cast("string"), shift).alias("song"))
    h = F.expr("(doc_id div 12) % 10")
    s = table(spark, sf_dir, "documents").select(F.concat(F.lit("song"), F.expr("doc_id div 12").cast("string")).alias("song"), h.alias("h")).distinct()
    return n.join(s, "song").select("doc_id", F.when(F.col("h") < 8, "train").when(F.col("h") == 8, "val").otherwise("test").alias("split"))


@query("with recursive c as (select l_returnflag as layer, l_linenumber as step, l_suppkey % 5 as expert, count(*) as n from lineitem group by 1,2,3), e as (select layer, expert, step, n, row_number() over (partition by layer, expert order by step) as k from c), f as (select layer, expert, k, cast(n as double) as m from e where k = 1 union all select e.layer, e.expert, e.k, 0.9e0*f.m + 0.1e0*e.n from f join e on e.layer=f.layer and e.expert=f.expert and e.k=f.k+1) select layer, expert, round(arg_max(m, k), 6) as ema from f group by 1,2")
def expert_averages(spark, sf_dir, decay: float = 0.9):
    """Moving averages of the load of each expert, step by step: a fold over its counts in order."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("layer"), F.col("l_linenumber").alias("step"), (F.col("l_suppkey") % 5).alias("expert")).agg(F.count("*").alias("n"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("step", "n"))), lambda x: x["n"].cast("double"))
    g = c.groupBy("layer", "expert").agg(own.alias("v"))
    ema = F.aggregate(F.slice("v", F.lit(2), F.size("v")), F.get("v", F.lit(0)), lambda a, x: F.lit(decay) * a + F.lit(1.0) * (1 - decay) * x)
    return g.select("layer", "expert", F.round(ema, 6).alias("ema"))


@query(f"""with {SQL_NOTES}, k as (select event_id, cast(event_id%12 as integer) as a, event_id%5=0 as am, cast((event_id*7)%12 as integer) as b, event_id%3=0 as bm from events),
s as (select event_id, case when am=bm and a=b then 1e0 when am=bm and (b-a+12)%12 in (5,7) then 0.5e0 when am<>bm and (b-a+12)%12 = case when am then 3 else 9 end then 0.3e0 when am<>bm and a=b then 0.2e0 else 0e0 end as mirex from k), m as (select song, program, max(c) = 1 as mono from (select song, program, measure, shift, count(*) as c from notes group by 1,2,3,4) t group by 1,2)
select 'mirex' as name, round(sum(mirex), 6) as total from s union all select 'monophonic', cast(sum(case when mono then 1 else 0 end) as double) from m""")
def sql_functions(spark, sf_dir):
    """Registered functions, called from SQL."""
    sql.register(spark)
    e = table(spark, sf_dir, "events")
    n = notes(spark, sf_dir).groupBy("song", "program").agg(F.collect_list(F.struct(F.col("measure").alias("bar"), "shift")).alias("o"))
    mirex = "cadenza_mirex(cast(event_id % 12 as int), event_id % 5 = 0, cast((event_id * 7) % 12 as int), event_id % 3 = 0)"
    a = spark.sql(f"select 'mirex' as name, round(sum({mirex}), 6) as total from {{e}}", e=e)
    return a.union(spark.sql("select 'monophonic', cast(count_if(cadenza_monophonic(o)) as double) from {n}", n=n))


# Published key profiles (fixed values): Krumhansl-Schmuckler, Temperley-Kostka-Payne, Bellman-Budge; major, then minor.
PROFILES = {
    "ks": (X.MAJOR_PROFILE, X.MINOR_PROFILE),
    "tkp": (
        (0.748, 0.060, 0.488, 0.082, 0.670, 0.460, 0.096, 0.715, 0.104, 0.366, 0.057, 0.400),
        (0.712, 0.084, 0.474, 0.618, 0.049, 0.460, 0.105, 0.747, 0.404, 0.067, 0.133, 0.330),
    ),
    "bb": (
        (16.80, 0.86, 12.95, 1.41, 13.49, 11.93, 1.25, 20.28, 1.80, 8.04, 0.62, 10.57),
        (18.16, 0.69, 12.99, 13.34, 1.07, 11.15, 1.38, 21.07, 7.49, 1.53, 0.92, 10.21),
    ),
}
_KEYS = [(p, 2 * t + m, (t + k) % 12, v) for p, both in PROFILES.items() for m, prof in enumerate(both) for t in range(12) for k, v in enumerate(prof)]
SQL_KEYVOTE = f"""{SQL_NOTES}, w as (select song, measure//4 as win, pitch%12 as pc, cast(sum(dur) as double) as c from notes group by 1,2,3), f as (select d.song, d.win, r.pc, coalesce(w.c, 0) as c from (select distinct song, win from w) d cross join range(0,12) r(pc) left join w on w.song=d.song and w.win=d.win and w.pc=r.pc),
r as (select song, win, profile, key, round(corr(c, p), 6) as r from f join (values {",".join(f"('{a}',{b},{c},{d}e0)" for a, b, c, d in _KEYS)}) v(profile, key, pc, p) on v.pc=f.pc group by 1,2,3,4), o as (select *, row_number() over (partition by song, win, profile order by r desc, key) as rn, round(r - lead(r) over (partition by song, win, profile order by r desc, key), 6) as margin from r),
v as (select song, win, profile, key from o where rn = 1 and r >= 0.2e0 and margin >= 0.05e0), c as (select song, win, key, count(*) as n, max(case when profile='ks' then 1 else 0 end) as ks, min(case profile when 'ks' then 0 when 'tkp' then 1 else 2 end) as f from v group by 1,2,3)"""


@query(f"with {SQL_KEYVOTE} select song, cast(win as bigint) as win, cast(key as integer) as key, cast(sum_n as bigint) as weight, n as votes from (select *, sum(n) over (partition by song, win) as sum_n, row_number() over (partition by song, win order by n desc, ks desc, f) as rn from c) t where rn = 1")
def window_key_vote(spark, sf_dir):
    """Key of each four bars by the votes of three profiles, each of which votes only if its best key is good and clear; ties go
    to the first profile. weight: how many voted."""
    pc, known = F.pmod("pitch", F.lit(12)), F.col("song").isNotNull() & F.col("measure").isNotNull()
    sums = [F.coalesce(F.sum(F.when((pc == k) & known, F.col("dur"))), F.lit(0)).cast("double").alias(f"c{k}") for k in range(12)]
    n = notes(spark, sf_dir).groupBy("song", F.expr("cast(measure div 4 as bigint)").alias("win")).agg(*sums)
    return M.key_votes(n, list(PROFILES.values()))
