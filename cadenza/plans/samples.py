"""Queries over training samples: blocks, prompts, tasks, their parsing and their cleaning."""

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.scalars import md5_mod
from ..operators import samples as B
from ..sources.tables import SQL_MOD, SQL_NOTES, notes
from .registry import query

#: Two programs stand for the two instruments of the vocabulary; songs have windows of three times four bars.
SQL_PARTS = f"""{SQL_NOTES}, nn as (select * from notes where program in ('view','click')),
own as (select song, program, measure as bar, string_agg((shift+51)||' '||(pitch+209)||' '||(dur+337), ' ' order by shift, pitch, dur) as t, count(*) as n from nn group by 1,2,3),
ev as (select p.song, p.program, l.last, unnest(range(0, l.last+1)) as bar from (select distinct song, program from nn) p join (select song, max(measure) as last from nn group by 1) l on l.song=p.song),
bars as (select e.song, e.program, e.last, cast(e.bar as integer) as bar, coalesce(o.n, 0) as n, '49 '||coalesce(o.t, '50') as t from ev e left join own o on o.song=e.song and o.program=e.program and o.bar=e.bar),
w as (select *, bar//4 - back as win from (select *, unnest([0,1,2]) as back from bars) s),
parts as (select song, win, case back when 0 then 'past' when 1 then 'const' else 'future' end as role, program, case program when 'view' then 9 else 10 end as inst, sum(n) as n, count(*) as bars, max(n) as most, string_agg(t, ' ' order by bar) as seq
 from w where win >= 0 and win*4+12 <= last group by 1,2,3,4),
blk as (select song, win, role, case role when 'past' then '3' when 'const' then '5' else '6' end as mark, coalesce(string_agg(inst||' '||seq||' 626', ' ' order by program) filter (n > 0), '') as body from parts group by 1,2,3),
block as (select song, win, role, body, mark||case when body='' then '' else ' '||body end||' 2' as block from blk),
dens as (select song, win, program, inst, n, case when n > 0 then cast(greatest(1, least(10, ceil(round(n/cast(bars as double)/(case program when 'view' then 24e0 else 45e0 end)*10, 9)))) as integer) end as density from parts where role='const'),
meta as (select song, win, '8 '||(14+song%34)||' 632'||coalesce(string_agg(' '||inst||' '||(636+density), '' order by program) filter (n > 0), '')||' '||(647+song%42)||' 2' as meta from dens group by 1,2),
s as (select c.song, c.win, p.block as past, c.block as const_, f.block as future, c.body as body, m.meta, ({SQL_MOD.format(x="c.song||'-'||c.win", n=60)}) as h
 from (select * from block where role='const') c join (select * from block where role='past') p on p.song=c.song and p.win=c.win join (select * from block where role='future') f on f.song=c.song and f.win=c.win join meta m on m.song=c.song and m.win=c.win)"""


def parts(spark, sf_dir):
    n = notes(spark, sf_dir).where("program in ('view', 'click')")
    p = B.window_parts(B.bar_tokens(n, ["song", "program"]), "song", "program")
    return p.withColumn("inst", F.when(F.col("program") == "view", 9).otherwise(10))


def samples(spark, sf_dir):
    """(song, win, past, const, future, body, meta, h): the blocks of each window, its system block, and a number from a hash."""
    p = parts(spark, sf_dir)
    b = B.blocks(p, ["song", "window"], "inst", "program").groupBy("song", "window")
    role = lambda x, c: F.max(F.when(F.col("role") == x, F.col(c))).alias("body" if c == "body" else x)
    wide = b.agg(*[role(x, "block") for x in B.MARKS], role("const", "body"))
    most = F.when(F.col("program") == "view", 24.0).otherwise(45.0)
    density = F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(F.round(F.col("n") / F.col("bars") / most * 10, 9)).cast("int")))
    own = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("program", "inst", density.alias("density")))))
    insts = p.where("role = 'const'").groupBy("song", "window").agg(own.alias("insts"))
    full = wide.join(insts, ["song", "window"])
    return full.select(
        "song", F.col("window").cast("long").alias("win"), "past", "const", "future", "body",
        B.system_block(F.col("song") % 34, F.lit(4), F.col("insts"), F.col("song") % 42).alias("meta"),
        md5_mod(F.concat_ws("-", "song", "window"), 60).alias("h"), "insts",
    )


def text(column, name: str | None = None):
    column = F.col(column) if isinstance(column, str) else column
    joined = F.array_join(column, " ")
    return joined.alias(name) if name else joined


@query(f"with {SQL_PARTS} select song, cast(win as bigint) as win, past, const_, future, meta from s")
def window_blocks(spark, sf_dir):
    """The three blocks of a window, instruments in the order of their names, and its system block."""
    return samples(spark, sf_dir).select("song", "win", text("past", "past"), text("const", "const_"), text("future", "future"), text("meta", "meta"))


def _kept(s):
    """Blocks left of past and future, by the hash; where CONST and META go among them."""
    drop = F.col("h") % 4
    rest = F.filter(F.array(F.when(~drop.isin(1, 3), F.col("past")), F.when(~drop.isin(2, 3), F.col("future"))), lambda x: x.isNotNull())
    s = s.withColumn("rest", rest)
    at = F.pmod(F.floor(F.col("h") / 4), F.size("rest") + 1).cast("int")
    s = s.withColumn("music", B.inserted(F.col("rest"), at, F.col("const")))
    mode = F.element_at(F.array(*map(F.lit, ("full", "perm_only", "del_only", "meta_first"))), (F.floor(F.col("h") / 15) + 1).cast("int"))
    return s.withColumn("mode", mode)


_SQL_REST = "list_filter([case when h%4 not in (1,3) then past end, case when h%4 not in (2,3) then future end], lambda x: x is not null)"
_SQL_PUT = "list_concat(list_concat(list_slice({a}, 1, {k}), [{x}]), list_slice({a}, {k}+1, len({a})))"


@query(f"""with {SQL_PARTS}, r as (select *, {_SQL_REST} as rest, ['full','perm_only','del_only','meta_first'][cast(h//15+1 as integer)] as mode from s),
m as (select *, {_SQL_PUT.format(a='rest', k='cast((h//4) % (len(rest)+1) as integer)', x='const_')} as music from r),
o as (select song, win, mode, case mode when 'perm_only' then {_SQL_PUT.format(a='[past, future]', k='cast(h%3 as integer)', x='const_')} when 'del_only' then list_concat(rest, [const_]) else music end as music, meta, h from m)
select song, cast(win as bigint) as win, mode, '1 '||array_to_string(case when mode='meta_first' then list_concat([meta], music) when mode='del_only' then music else {_SQL_PUT.format(a='music', k='cast((h//7) % (len(music)+1) as integer)', x='meta')} end, ' ')||' 627' as sample from o""")
def foundation_samples(spark, sf_dir):
    """Blocks dropped and put in another order, the system block somewhere between them; the modes only reorder, only drop, or
    put the system block first. What is drawn is a hash of song and window."""
    s = _kept(samples(spark, sf_dir))
    both = F.array("past", "future")
    music = (
        F.when(F.col("mode") == "perm_only", B.inserted(both, (F.col("h") % 3).cast("int"), F.col("const")))
        .when(F.col("mode") == "del_only", F.concat("rest", F.array("const"))).otherwise(F.col("music"))
    )
    s = s.withColumn("music", music)
    at = F.pmod(F.floor(F.col("h") / 7), F.size("music") + 1).cast("int")
    whole = F.when(F.col("mode") == "meta_first", F.concat(F.array("meta"), "music")).when(F.col("mode") == "del_only", F.col("music")).otherwise(B.inserted(F.col("music"), at, F.col("meta")))
    return s.select("song", "win", "mode", text(F.concat(B.tokens(B.EOS), F.flatten(whole), B.tokens(V.TE)), "sample"))


#: Tasks of generation and what stands before <MGEN> besides the system block.
TASKS = {"meta": (), "meta_past": ("past",), "meta_future": ("future",), "infill": ("past", "future")}


@query(f"""with {SQL_PARTS}, t as (select s.*, unnest(['meta','meta_past','meta_future','infill']) as task from s),
g as (select song, win, task, meta||case when task in ('meta_past','infill') then ' '||past else '' end||case when task in ('meta_future','infill') then ' '||future else '' end||' 12' as prompt, case when body='' then '627' else body||' 627' end as answer from t
 union all select s.song, s.win, 'inst_comp', s.meta||' 5 '||o.inst||' '||o.seq||' 626 2 12', p.inst||' '||p.seq||' 626 627' from s join parts p on p.song=s.song and p.win=s.win and p.role='const' and p.n > 0 join parts o on o.song=s.song and o.win=s.win and o.role='const' and o.n > 0 and o.inst <> p.inst)
select song, cast(win as bigint) as win, task, prompt, answer from g""")
def generation_tasks(spark, sf_dir):
    """Five tasks of generation for each window; one instrument is added to another in the last."""
    s = samples(spark, sf_dir)
    one = lambda task, roles: s.select(
        "song", "win", F.lit(task).alias("task"), text(F.concat("meta", *roles, B.tokens(B.MGEN)), "prompt"), text(F.concat("body", B.tokens(V.TE)), "answer")
    )
    p = parts(spark, sf_dir).where("role = 'const' and n > 0").select("song", F.col("window").cast("long").alias("win"), "inst", "seq")
    o = p.withColumnsRenamed({"inst": "other", "seq": "known"})
    pairs = s.select("song", "win", "meta").join(p, ["song", "win"]).join(o, ["song", "win"]).where("inst <> other")
    prompt = F.concat("meta", B.tokens(V.CONST), B.framed(F.col("other"), F.col("known")), B.tokens(V.TAG_END, B.MGEN))
    comp = pairs.select("song", "win", F.lit("inst_comp").alias("task"), text(prompt, "prompt"), text(F.concat(B.framed(F.col("inst"), F.col("seq")), B.tokens(V.TE)), "answer"))
    out = comp
    for task, roles in TASKS.items():
        out = one(task, roles).unionByName(out)
    return out


@query(f"with {SQL_PARTS} select song, cast(win as bigint) as win, const_||' 628 '||meta||' 627' as sample from s")
def analysis_samples(spark, sf_dir):
    """Music first, then what is to be said about it."""
    return samples(spark, sf_dir).select("song", "win", text(F.concat("const", B.tokens(V.META), "meta", B.tokens(V.TE)), "sample"))


@query(f"""with {SQL_PARTS} select song, cast(win as bigint) as win, 'music' as kind, '1 '||past||' '||const_||' '||future||' 627' as sample from s union all select song, win, 'meta', '1 '||meta||' '||past||' '||const_||' '||future||' 627' from s""")
def pretraining_pairs(spark, sf_dir):
    s = samples(spark, sf_dir)
    music = F.concat("past", "const", "future", B.tokens(V.TE))
    made = lambda kind, *parts_: s.select("song", "win", F.lit(kind).alias("kind"), text(F.concat(B.tokens(B.EOS), *parts_), "sample"))
    return made("music", music).unionByName(made("meta", "meta", music))


#: Older tasks: what is shown of this instrument and of the other, and what is asked for, by role.
ROLES = {
    "continuation": ("past", "", "const"), "continuation_with_other": ("past", "past const", "const"), "infill": ("past future", "", "const"),
    "infill_with_other": ("past future", "past const future", "const"), "other_to_this": ("", "const", "const"), "opening": ("", "", "past"), "full_infill": ("past", "past future", "const future"),
}


@query(f"""with {SQL_PARTS}, k as (select song, win, inst, max(seq) filter (role='past') as past, max(seq) filter (role='const') as const_, max(seq) filter (role='future') as future from parts group by 1,2,3),
t as (select a.song, a.win, a.inst, v.task, v.own, v.other, v.want, a.past, a.const_, a.future, b.inst as inst2, b.past as past2, b.const_ as const2, b.future as future2 from k a join k b on a.song=b.song and a.win=b.win and a.inst <> b.inst, (values {", ".join(f"('{k}','{a}','{b}','{c}')" for k, (a, b, c) in ROLES.items())}) v(task, own, other, want))
select song, cast(win as bigint) as win, inst, task, trim(case when own <> '' then inst||case when contains(own,'past') then ' '||past else '' end||case when contains(own,'const') then ' '||const_ else '' end||case when contains(own,'future') then ' '||future else '' end||' 626' else '' end
 ||case when other <> '' then ' '||inst2||case when contains(other,'past') then ' '||past2 else '' end||case when contains(other,'const') then ' '||const2 else '' end||case when contains(other,'future') then ' '||future2 else '' end||' 626' else '' end||' 12') as prompt,
 trim(case when contains(want,'past') then ' '||past else '' end||case when contains(want,'const') then ' '||const_ else '' end||case when contains(want,'future') then ' '||future else '' end)||' 627' as answer from t""")
def role_tasks(spark, sf_dir):
    """Continuation, infilling and accompaniment, all by one builder over the roles that are shown and asked for."""
    p = parts(spark, sf_dir).groupBy("song", F.col("window").cast("long").alias("win"), "inst").agg(*[F.max(F.when(F.col("role") == r, F.col("seq"))).alias(r) for r in B.MARKS])
    other = p.withColumnsRenamed({"inst": "inst2", **{r: f"{r}2" for r in B.MARKS}})
    pairs = p.join(other, ["song", "win"]).where("inst <> inst2")
    shown = lambda roles, end="": F.concat(B.none(), *[F.col(r + end) for r in roles.split()])
    out = None
    for task, (own, of_other, want) in ROLES.items():
        prompt = F.concat(
            B.framed(F.col("inst"), shown(own)) if own else B.none(), B.framed(F.col("inst2"), shown(of_other, "2")) if of_other else B.none(), B.tokens(B.MGEN)
        )
        one = pairs.select("song", "win", "inst", F.lit(task).alias("task"), text(prompt, "prompt"), text(F.concat(shown(want), B.tokens(V.TE)), "answer"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {SQL_PARTS} select song, cast(win as bigint) as win, task, '1 '||case task when 'uncond' then '' when 'meta_gen' then meta||' ' when 'continuation' then meta||' '||past||' ' when 'anticipation' then meta||' '||future||' ' when 'infill' then meta||' '||past||' '||future||' ' else const_||' ' end||case when task='analysis' then '628' else '5' end as prompt
from s, (values ('uncond'),('meta_gen'),('continuation'),('anticipation'),('infill'),('analysis')) v(task)""")
def frozen_prompts(spark, sf_dir):
    """Prompts of six tasks up to the marker that the model goes on from."""
    s = samples(spark, sf_dir)
    plan = {"uncond": (), "meta_gen": ("meta",), "continuation": ("meta", "past"), "anticipation": ("meta", "future"), "infill": ("meta", "past", "future"), "analysis": ("const",)}
    out = None
    for task, roles in plan.items():
        end = V.META if task == "analysis" else V.CONST
        one = s.select("song", "win", F.lit(task).alias("task"), text(F.concat(B.tokens(B.EOS), *roles, B.tokens(end)), "prompt"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {SQL_PARTS}, p as (select song, win, role, inst, seq, n from parts where n > 0) select song, cast(win as bigint) as win, role, inst, seq from p""")
def parsed_blocks(spark, sf_dir):
    """Each block taken apart again into instruments and their sequences."""
    s = samples(spark, sf_dir)
    rows = s.select("song", "win", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("block")) for r in B.MARKS])).alias("b"))
    m = rows.select("song", "win", "b.role", F.explode(B.parsed_block(F.col("b.block"))).alias("inst", "seq"))
    return m.select("song", "win", "role", "inst", text("seq", "seq"))


@query(f"""with {SQL_PARTS}, j as (select song, win, inst, string_agg(case when n > 0 then seq end, ' ' order by case role when 'past' then 0 when 'const' then 1 else 2 end) as seq from parts group by 1,2,3),
o as (select song, win, string_agg(inst||' '||seq||' 626', ' ' order by inst) as t from j where seq is not null group by 1,2)
select song, cast(win as bigint) as win, '5 '||t||' 2' as block from o""")
def normalized_const(spark, sf_dir):
    """Past, answer and future of each instrument one after the other, in one block; instruments in order."""
    s = samples(spark, sf_dir)
    maps = s.select("song", "win", *[B.parsed_block(F.col(r)).alias(r) for r in B.MARKS])
    names = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.map_keys(r) for r in B.MARKS]))))
    empty = B.none()
    body = F.flatten(F.transform("names", lambda k: B.framed(k, F.concat(*[F.coalesce(F.try_element_at(r, k), empty) for r in B.MARKS]))))
    return maps.withColumn("names", names).where(F.size("names") > 0).select("song", "win", text(F.concat(B.tokens(V.CONST), body, B.tokens(V.TAG_END)), "block"))


@query(f"with {SQL_PARTS} select song, cast(win as bigint) as win, const_ as music, meta||' 627' as answer from s")
def split_at_meta(spark, sf_dir):
    """Analysis samples cut at <META> into music and answer."""
    s = samples(spark, sf_dir).withColumn("t", F.concat("const", B.tokens(V.META), "meta", B.tokens(V.TE)))
    return s.select("song", "win", text(B.cut_at(F.col("t"), V.META, False), "music"), text(B.cut_at(F.col("t"), V.META), "answer"))


@query(f"""with {SQL_PARTS}, d as (select *, 14+song%34 as key_, 647+song%42 as genre from dens where n > 0)
select s.song, cast(s.win as bigint) as win, cast(14+s.song%34 as integer) as key_, coalesce(string_agg(cast(636+d.density as varchar), ' ' order by d.program), '') as density, cast(647+s.song%42 as varchar) as genre, coalesce(string_agg(cast(d.inst as varchar), ' ' order by d.program), '') as inst, 632 as measures from s left join d on d.song=s.song and d.win=s.win group by 1,2, s.song""")
def parsed_meta(spark, sf_dir):
    """A system block by kinds of tokens; the first key counts."""
    m = F.col("meta")
    kind = lambda a, b: F.filter(m, lambda t: t.between(a, b))
    return samples(spark, sf_dir).select(
        "song", "win", F.get(kind(V.KEY, V.KEY + 33), 0).alias("key_"), text(kind(V.DENSE, V.DENSE + 9), "density"), text(kind(V.GENRE, V.GENRE + 41), "genre"),
        text(kind(9, 10), "inst"), F.element_at(kind(V.GMC, V.GMC + 7), -1).alias("measures"),
    )


@query(f"""with {SQL_PARTS}, q as (select song, win, '1 '||meta||' '||past||' '||const_||' '||future||' 627' as t, len(string_split(meta,' ')) as a, len(string_split(past,' ')) as b, len(string_split(const_,' ')) as c, len(string_split(future,' ')) as d from s)
select song, cast(win as bigint) as win, v.block, case v.block when 'META' then 1 when 'PAST' then 1+a when 'CONST' then 1+a+b else 1+a+b+c end as start_, case v.block when 'META' then 1+a when 'PAST' then 1+a+b when 'CONST' then 1+a+b+c else 2+a+b+c+d end as end_ from q, (values ('META'),('PAST'),('CONST'),('FUTURE')) v(block)""")
def block_spans(spark, sf_dir):
    """Blocks of a sample as (name, start, end): from a marker to the next one, the last to the end."""
    names = {B.SYSTEM: "META", V.PAST: "PAST", V.CONST: "CONST", V.FUTURE: "FUTURE"}
    t = F.concat(B.tokens(B.EOS), "meta", "past", "const", "future", B.tokens(V.TE))
    s = samples(spark, sf_dir).select("song", "win", t.alias("t"))
    marks = F.filter(F.transform("t", lambda x, i: F.when(x.isin(*names), i)), lambda i: i.isNotNull())
    s = s.withColumn("at", marks)
    spans = F.transform("at", lambda i, k: F.struct(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.get("t", i)).alias("block"), i.alias("start_"), F.coalesce(F.get("at", k + 1), F.size("t")).alias("end_")))
    return s.select("song", "win", F.inline(spans))


@query(f"""with {SQL_PARTS}, o as (select song, win, role, string_agg(inst||' '||seq||' 626', ' ' order by program) filter (n > 0 and not (({SQL_MOD.format(x="song||'-'||win||'-'||inst", n=3)}) = 0)) as kept from parts group by 1,2,3)
select song, cast(win as bigint) as win, role, coalesce(kept, '') as kept from o""")
def dropped_instruments(spark, sf_dir):
    """A third of the instruments taken out of every block of a window, by a hash; the rest is put together again."""
    s = samples(spark, sf_dir)
    rows = s.select("song", "win", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("block")) for r in B.MARKS])).alias("b"))
    m = rows.select("song", "win", "b.role", B.parsed_block(F.col("b.block")).alias("m"))
    inst = m.select("song", "win", "role", F.explode_outer("m").alias("inst", "seq"))
    stays = inst.withColumn("stays", md5_mod(F.concat_ws("-", "song", "win", "inst"), 3) != 0)
    own = F.array_sort(F.collect_list(F.when(F.col("stays") & F.col("inst").isNotNull(), F.struct((-F.col("inst")).alias("o"), B.framed(F.col("inst"), F.col("seq")).alias("t")))))
    return stays.groupBy("song", "win", "role").agg(text(F.flatten(F.transform(own, lambda x: x["t"])), "kept"))


@query(f"""with {SQL_PARTS}, l as (select song, win, list_transform(string_split(const_, ' '), lambda x: cast(x as integer)) as t from s) select song, cast(win as bigint) as win, array_to_string(list_slice(list_concat(t, list_transform(range(0, 64), lambda x: 0)), 1, 64), ' ') as padded, least(len(t), 64) as used from l""")
def padded_batch(spark, sf_dir, width: int = 64):
    """Sequences cut or filled with 0 to one width, and how many of their tokens count."""
    c = F.col("const")
    return samples(spark, sf_dir).select("song", "win", text(F.slice(F.concat(c, F.array_repeat(F.lit(0), width)), 1, width), "padded"), F.least(F.size(c), F.lit(width)).cast("long").alias("used"))


@query(f"""with {SQL_PARTS}, l as (select song, win, string_split(const_, ' ') as t from s) select song, cast(win as bigint) as win, cast(i as bigint) as chunk, array_to_string(list_slice(t, i*16+1, i*16+16), ' ') as piece from (select song, win, t, unnest(range(0, len(t)//16)) as i from l) x""")
def fixed_chunks(spark, sf_dir, width: int = 16):
    """Pieces of one width; what is left over goes."""
    s = samples(spark, sf_dir).where(F.size("const") >= width)
    at = s.select("song", "win", "const", F.explode(F.sequence(F.lit(0), F.floor(F.size("const") / width).cast("int") - 1)).alias("chunk"))
    return at.select("song", "win", F.col("chunk").cast("long").alias("chunk"), text(F.slice("const", F.col("chunk") * width + 1, F.lit(width)), "piece"))


@query(f"""with {SQL_PARTS}, l as (select song, win, string_split(seq, ' ') as t, inst from parts where role='const'), i as (select *, unnest(list_filter(range(1, len(t)+1), lambda k: t[k] = '49')) as a from l),
j as (select *, lead(a) over (partition by song, win, inst order by a) as b, row_number() over (partition by song, win, inst order by a) as bar from i)
select song, cast(win as bigint) as win, inst, bar, array_to_string(list_slice(t, a, coalesce(b-1, len(t))), ' ') as piece from j""")
def split_at_value(spark, sf_dir):
    """A sequence cut before every bar token."""
    p = parts(spark, sf_dir).where("role = 'const'").select("song", F.col("window").cast("long").alias("win"), "inst", "seq")
    at = F.filter(F.transform("seq", lambda x, i: F.when(x == V.SME, i)), lambda i: i.isNotNull())
    p = p.withColumn("at", at)
    pieces = F.transform("at", lambda i, k: F.struct((k + 1).cast("long").alias("bar"), F.array_join(F.slice("seq", i + 1, F.coalesce(F.get("at", k + 1), F.size("seq")) - i), " ").alias("piece")))
    return p.select("song", "win", "inst", F.inline(pieces))


@query(f"with {SQL_PARTS} select song, cast(win as bigint) as win, past as slice from s")
def prompt_slice(spark, sf_dir):
    """From the first marker of a prompt to the end of its block."""
    t = F.concat(B.tokens(B.EOS), "meta", "past", "future")
    s = samples(spark, sf_dir).withColumn("t", t).withColumn("a", F.array_position("t", V.PAST).cast("int"))
    tail = s.withColumn("tail", F.slice("t", F.col("a"), F.size("t")))
    return tail.select("song", "win", text(F.slice("tail", F.lit(1), F.array_position("tail", V.TAG_END).cast("int")), "slice"))


@query(f"""with {SQL_PARTS}, l as (select song, win, inst, unnest(string_split(seq, ' ')) as tok, generate_subscripts(string_split(seq, ' '), 1) as i from parts where role='const' and n > 0)
select song, cast(win as bigint) as win, inst, string_agg(case when tok='49' then '<SME>' when tok='50' then '<BLANK>' when cast(tok as integer) between 51 and 147 then 's_'||(cast(tok as integer)-51) when cast(tok as integer) between 209 and 336 then 'p_'||(cast(tok as integer)-209) else 'd_'||(cast(tok as integer)-337) end, ' ' order by i) as symbols from l group by 1,2,3""")
def symbol_text(spark, sf_dir):
    """Tokens by their names."""
    name = lambda x: (
        F.when(x == V.SME, "<SME>").when(x == V.BLANK, "<BLANK>").when(x.between(V.SHIFT, V.SHIFT + 96), F.concat(F.lit("s_"), x - V.SHIFT))
        .when(x.between(V.PITCH, V.PITCH + 127), F.concat(F.lit("p_"), x - V.PITCH)).otherwise(F.concat(F.lit("d_"), x - V.DUR))
    )
    p = parts(spark, sf_dir).where("role = 'const' and n > 0")
    return p.select("song", F.col("window").cast("long").alias("win"), "inst", text(F.transform("seq", name), "symbols"))


@query(f"""with {SQL_PARTS}, d as (select song, win, n, bars, most, program, role from parts where role='const') select song, cast(win as bigint) as win, case when max(n) = 0 then 'no_notes' when max(case when program='view' then most else 0 end) > 2 then 'overflow' else 'built' end as reason from d group by 1,2""")
def window_reasons(spark, sf_dir):
    """Why a window is left out: nothing to play, or an instrument over its limit, which drops the whole window."""
    d = parts(spark, sf_dir).where("role = 'const'")
    over = F.max(F.when(F.col("program") == "view", F.col("most")).otherwise(0)) > 2
    return d.groupBy("song", F.col("window").cast("long").alias("win")).agg(F.when(F.max("n") == 0, "no_notes").when(over, "overflow").otherwise("built").alias("reason"))


@query(f"""with {SQL_PARTS}, d as (select song, win, n, program, most, role from parts where role='const'), r as (select song, win, case when max(n) = 0 then 'no_notes' when max(case when program='view' then most else 0 end) > 2 then 'overflow' else 'built' end as reason from d group by 1,2) select reason, count(*) as n from r group by 1""")
def finish_reasons(spark, sf_dir):
    return window_reasons(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""with {SQL_PARTS}, k as (select song, win, inst, max(n) filter (role='const') as c, count(distinct role) filter (role <> 'const' and n > 0) as ctx, avg(case when role='const' then n/cast(bars as double) end) as d from parts group by 1,2,3)
select song, cast(win as bigint) as win, inst, round(d, 6) as per_bar from k where c > 0 and ctx > 0 and d between 0.25e0 and 1.5e0""")
def density_band(spark, sf_dir):
    """Targets with notes, with notes around them, and with so many a bar."""
    const = F.col("role") == "const"
    k = parts(spark, sf_dir).groupBy("song", F.col("window").cast("long").alias("win"), "inst").agg(
        F.max(F.when(const, F.col("n"))).alias("c"), F.countDistinct(F.when(~const & (F.col("n") > 0), F.col("role"))).alias("ctx"),
        F.avg(F.when(const, F.col("n") / F.col("bars"))).alias("d"),
    )
    return k.where("c > 0 and ctx > 0 and d between 0.25D and 1.5D").select("song", "win", "inst", F.round("d", 6).alias("per_bar"))
