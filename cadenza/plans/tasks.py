"""Queries that build and take apart tasks: generation with a stated plan, prompts, keys of moved songs, filled windows, splits."""

import uuid

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import corpus as C
from ..operators import samples as B
from ..operators.notes import notes_to_tokens
from ..sources.tables import SQL_MANIFEST, SQL_NOTES, manifest, notes, shared_folder, table
from .notes import SQL_BAR_INDEX, _bars
from .registry import ORACLE, query
from .samples import SQL_PARTS, foundation_samples, parts, samples, text

#: Conditions and plan are drawn from bits of the window's hash.
_BITS = {"density": 1, "length": 2, "genre": 4, "key": 8, "thinking": 16}
_SQL_BIT = {k: f"(h // {n}) % 2 = 1" for k, n in _BITS.items()}
_SQL_SYSTEM = f"""'8'||coalesce((select string_agg(' '||d.inst||case when {_SQL_BIT['density']} then ' '||(636+d.density) else '' end, '' order by program) from dens d where d.song=s.song and d.win=s.win and d.n > 0), '')
 ||case when {_SQL_BIT['length']} then ' 632' else '' end||case when {_SQL_BIT['genre']} then ' '||(647+s.song%42) else '' end||case when {_SQL_BIT['key']} then ' '||(14+s.song%34) else '' end||case when {_SQL_BIT['thinking']} then ' 689' else '' end||' 2'"""
SQL_REASONED = f"""{SQL_PARTS}, rt as (select song, win, task, past, const_, future, body, meta, h, {_SQL_SYSTEM} as system_, {_SQL_BIT['thinking']} as thinking from s, (values ('meta_past'),('meta_future'),('infill')) v(task)),
rs as (select *, '1 '||system_||case when task in ('meta_past','infill') then ' '||past else '' end||case when task in ('meta_future','infill') then ' '||future else '' end||' 12' as prompt, case when thinking then meta||' ' else '' end||case when body='' then '' else body||' ' end||'627' as answer from rt)"""


def _reasoned(spark, sf_dir):
    s = samples(spark, sf_dir)
    bit = {k: F.floor(F.col("h") / n) % 2 == 1 for k, n in _BITS.items()}
    system = B.partial_system(F.col("song") % 34, F.lit(4), F.col("insts"), F.col("song") % 42, bit["density"], bit["length"], bit["genre"], bit["key"], bit["thinking"])
    s = s.withColumns({"system": system, "thinking": bit["thinking"]})
    plan = F.when(F.col("thinking"), F.col("meta")).otherwise(B.none())
    asked = {"meta_past": ("past",), "meta_future": ("future",), "infill": ("past", "future")}
    # All tasks of a window are made where it lies.
    tasks = [
        F.struct(F.lit(task).alias("task"), F.concat(B.tokens(B.EOS), "system", *roles, B.tokens(B.MGEN)).alias("prompt"), F.concat(plan, "body", B.tokens(V.TE)).alias("answer"))
        for task, roles in asked.items()
    ]
    return s.select("*", F.inline(F.array(*tasks)))


@query(f"with {SQL_REASONED} select song, cast(win as bigint) as win, task, thinking, prompt, answer from rs")
def reasoned_tasks(spark, sf_dir):
    """Tasks of generation with some of the attributes stated; where a plan is asked for, the whole system block comes
    before the music."""
    return _reasoned(spark, sf_dir).select("song", "win", "task", "thinking", text("prompt", "prompt"), text("answer", "answer"))


@query(f"""with {SQL_REASONED}, pp as (select song, win, role, string_agg(inst||':'||seq, '|' order by inst) as seqs from parts where n > 0 group by 1,2,3)
select rs.song, cast(rs.win as bigint) as win, rs.task, rs.task as found, rs.system_ as condition, rs.body as gold, len(string_split(rs.prompt, ' ')) as prompt_tokens,
 case when rs.task in ('meta_past','infill') then coalesce(p.seqs, '') end as past, case when rs.task in ('meta_future','infill') then coalesce(f.seqs, '') end as future
from rs left join pp p on p.song=rs.song and p.win=rs.win and p.role='past' left join pp f on f.song=rs.song and f.win=rs.win and f.role='future'""")
def parsed_tasks(spark, sf_dir):
    """Samples of generation taken apart again: task, condition, what was shown and what is right."""
    r = _reasoned(spark, sf_dir).withColumn("p", B.parsed_sample(F.concat("prompt", "answer")))
    told = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"], F.array_join(e["value"], " "))), "|")
    return r.select(
        "song", "win", "task", F.col("p.task").alias("found"), text("p.condition", "condition"), text("p.gold", "gold"), F.size("p.prompt").cast("long").alias("prompt_tokens"),
        told(F.col("p.past")).alias("past"), told(F.col("p.future")).alias("future"),
    )


@query(f"""with {SQL_PARTS}, i as (select distinct song, inst from parts) select song, '1 8'||coalesce(string_agg(' '||inst, '' order by inst), '')||case when song % 5 = 0 then '' else ' '||(14 + song % 34) end||' 2 12' as prompt from i group by song""")
def prompt_batch(spark, sf_dir):
    """A prompt for each list of instruments and key, if there is one."""
    p = parts(spark, sf_dir).select("song", "inst").distinct().groupBy("song").agg(F.array_sort(F.collect_list(F.col("inst").cast("int"))).alias("insts"))
    key = F.when(F.col("song") % 5 != 0, F.array((F.col("song") % 34 + V.KEY).cast("int"))).otherwise(B.none())
    return p.select("song", text(F.concat(B.tokens(B.EOS, B.SYSTEM), "insts", key, B.tokens(V.TAG_END, B.MGEN)), "prompt"))


SQL_CHORDED = f"""{SQL_PARTS}, ch as (select song, measure, shift, event_id, 148+pitch%20 as r, 168+pitch%19 as q, 187+pitch%22 as b from notes where program='purchase'), cb as (select song, measure as bar, string_agg((shift+51)||' '||r||' '||q||' '||b, ' ' order by shift, event_id) as t from ch group by 1,2),
ce as (select song, last, unnest(range(0, last+1)) as bar from (select song, max(measure) as last from nn group by 1) x), cw as (select e.song, e.bar // 4 - 1 as win, string_agg('49 '||coalesce(b.t, '50'), ' ' order by e.bar) as chords from ce e left join cb b on b.song=e.song and b.bar=e.bar where e.bar // 4 >= 1 and (e.bar // 4 - 1)*4+12 <= e.last group by 1,2),
g as (select c.song, c.win, c.inst, c.seq, case when p.n > 0 then ' '||p.inst||' '||p.seq||' 626' else '' end as past, case when f.n > 0 then ' '||f.inst||' '||f.seq||' 626' else '' end as future, case when o.n > 0 then ' '||o.inst||' '||o.seq||' 626' else '' end as other, cw.chords, s.meta
 from parts c join parts p on p.song=c.song and p.win=c.win and p.inst=c.inst and p.role='past' join parts f on f.song=c.song and f.win=c.win and f.inst=c.inst and f.role='future' left join parts o on o.song=c.song and o.win=c.win and o.inst<>c.inst and o.role='const' join cw on cw.song=c.song and cw.win=c.win join s on s.song=c.song and s.win=c.win where c.role='const' and c.n > 0)"""


@query(f"""with {SQL_CHORDED} select song, cast(win as bigint) as win, inst, task, '1 '||meta||case when task = 'chords_only' then '' else ' 3'||past||' 2' end||case when task = 'infill_chords' then ' 6'||future||' 2' else '' end||case when task = 'continue_both' then ' 5'||coalesce(other, '')||' 2' else '' end||' 4 '||chords||' 626 2 12' as prompt,
 inst||' '||seq||' 626 627' as answer from g, (values ('continue_chords'),('continue_both'),('infill_chords'),('chords_only')) v(task)""")
def chord_tasks(spark, sf_dir):
    """Melodies to given chords: going on from what came before, with the other part or without, between what comes before
    and after, or from the chords alone."""
    p = parts(spark, sf_dir).select("song", "window", "role", "inst", "n", "seq")
    block = lambda e="": F.when(F.col(f"n{e}") > 0, B.framed(F.col(f"inst{e}"), F.col(f"seq{e}"))).otherwise(B.none())
    of = lambda role, name: p.where(F.col("role") == role).select("song", "window", "inst", block().alias(name))
    target = p.where("role = 'const' and n > 0").drop("role")
    other = of("const", "other").withColumnRenamed("inst", "inst2")
    n = notes(spark, sf_dir)
    pitch = F.col("pitch")
    chords = n.where("program = 'purchase'").select("song", "measure", "shift", "event_id", (pitch % 20 + 148).alias("r"), (pitch % 19 + 168).alias("q"), (pitch % 22 + 187).alias("b"))
    lasts = n.where("program in ('view', 'click')").groupBy("song").agg(F.max("measure").alias("last"))
    meta = samples(spark, sf_dir).select("song", F.col("win").cast("int").alias("window"), "meta")
    key = ["song", "window"]
    both = target.join(of("past", "past"), [*key, "inst"]).join(of("future", "future"), [*key, "inst"]).join(B.chord_windows(chords, lasts), key).join(meta, key)
    paired = both.join(other, key, "left").where("inst2 is null or inst2 <> inst").withColumn("other", F.coalesce("other", B.none()))
    # A part without another one has itself as the only candidate.
    alone = both.join(paired.select(*key, "inst"), [*key, "inst"], "left_anti").withColumn("other", B.none())
    g = paired.drop("inst2").unionByName(alone)
    given = lambda mark, c: F.concat(B.tokens(mark), c, B.tokens(V.TAG_END))
    head, end = F.concat(B.tokens(B.EOS), "meta"), F.concat(B.tokens(B.CHORDS), "chords", B.tokens(V.ESEQ, V.TAG_END, B.MGEN))
    past, future, beside = given(V.PAST, "past"), given(V.FUTURE, "future"), given(V.CONST, "other")
    answer = F.concat(B.framed(F.col("inst"), F.col("seq")), B.tokens(V.TE))
    out = None
    for task, shown in {"continue_chords": (past,), "continue_both": (past, beside), "infill_chords": (past, future), "chords_only": ()}.items():
        one = g.select("song", F.col("window").cast("long").alias("win"), "inst", F.lit(task).alias("task"), text(F.concat(head, *shown, end), "prompt"), text(answer, "answer"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {SQL_REASONED} select song, cast(win as bigint) as win, task, case when task = 'meta_future' then '' else past end as spans, case when task = 'meta_future' or past = '3 2' then '' else substr(past, 3, len(past) - 4) end as inner_ from rs""")
def tagged_sequences(spark, sf_dir):
    """What stands between two tags of a sequence, with them and without."""
    r = _reasoned(spark, sf_dir)
    flat = lambda with_tags: text(F.flatten(B.tagged(F.col("prompt"), V.PAST, V.TAG_END, with_tags)))
    return r.select("song", "win", "task", flat(True).alias("spans"), flat(False).alias("inner_"))


@query("""with s as (select user_id as song, count(*) as n, user_id % 12 as tonic, user_id % 2 = 1 as minor from events group by 1), m as (select *, unnest([-5,-4,-3,-2,-1,1,2,3,4,5,6]) as moved from s)
select song, cast(moved as integer) as moved, n, cast((tonic + moved + 12) % 12 as integer) as tonic, minor, case when minor then (tonic + moved + 9 + 12) % 12 else (tonic + moved + 12) % 12 end % 2 = 0 as even from m""")
def moved_keys(spark, sf_dir):
    """Songs in eleven other keys: the key's name moves with the notes, its mode stays."""
    s = notes(spark, sf_dir).groupBy("song").agg(F.count("*").alias("n"))
    m = s.withColumn("moved", F.explode(F.array(*[F.lit(x) for x in range(-5, 7) if x])))
    tonic, minor = F.pmod(F.col("song") % 12 + F.col("moved"), F.lit(12)).cast("int"), F.col("song") % 2 == 1
    return m.select("song", "moved", "n", tonic.alias("tonic"), minor.alias("minor"), (F.when(minor, F.pmod(tonic + 9, F.lit(12))).otherwise(tonic) % 2 == 0).alias("even"))


@query(f"with {SQL_BAR_INDEX} select song, bar // 24 as win, (bar % 24) // 8 as segment, count(*) as bars_in, cast(sum(n) as bigint) as notes from bars group by 1,2,3 having sum(n) > 0")
def filled_windows(spark, sf_dir):
    """Windows of three times eight bars, as full as the song goes; blocks without notes are left out."""
    b = _bars(spark, sf_dir)
    g = b.groupBy("song", F.expr("cast(bar div 24 as bigint)").alias("win"), F.expr("cast((bar % 24) div 8 as bigint)").alias("segment"))
    return g.agg(F.count("*").alias("bars_in"), F.sum("n").alias("notes")).where("notes > 0")


@query(f"""with {SQL_MANIFEST}, r as (select song, dataset, row_number() over (partition by dataset order by md5('s'||cast(song as varchar)), song) as rn, count(*) over (partition by dataset) as n from manifest)
select dataset, case when rn <= floor(n*0.8e0) then 'train' when rn <= floor(n*0.8e0)+floor(n*0.1e0) then 'val' else 'test' end as split, count(*) as songs, cast(sum(song) as bigint) as ids from r group by 1,2""")
def per_dataset_split(spark, sf_dir):
    """Each dataset split by the same ratios, all of them put together."""
    s = C.stratified_split(manifest(spark, sf_dir), ["dataset"], "song")
    return s.groupBy("dataset", "split").agg(F.count("*").alias("songs"), F.sum("song").alias("ids"))


@query("""with f as (select doc_id // 4 as file, min(lang) as label from documents group by 1), r as (select *, row_number() over (partition by label order by md5('k'||cast(file as varchar)), file) as rn from f), k as (select *, (rn - 1) % 5 as fold from r)
select d.doc_id, cast(run as integer) as run, case when k.fold = run then 'test' when k.fold = (run + 1) % 5 then 'val' else 'train' end as part from documents d join k on k.file = d.doc_id // 4, range(0, 5) t(run)""")
def folds_of_clips(spark, sf_dir):
    """Files dealt to five folds, class by class; each clip's part in each of the five runs."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr("doc_id div 4").alias("file"))
    k = C.k_folds(d.groupBy("file").agg(F.min("lang").alias("label")), ["label"], "file", 5).select("file", "fold")
    runs = d.join(k, "file").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(4))))
    part = F.when(F.col("fold") == F.col("run"), "test").when(F.col("fold") == (F.col("run") + 1) % 5, "val").otherwise("train")
    return runs.select("doc_id", "run", part.alias("part"))


@query("""with n as (select doc_id, source||'/song'||doc_id||case when doc_id % 2 = 0 then '.mid' else '.MIDI' end as path from documents) select path from n where doc_id % 3 = 0""")
def allowed_stems(spark, sf_dir):
    """Files whose names, without folder and ending, are on a list."""
    d = table(spark, sf_dir, "documents")
    files = d.select(F.concat("source", F.lit("/song"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".mid").otherwise(".MIDI")).alias("path"))
    allowed = d.where("doc_id % 3 = 0").select(F.concat(F.lit("song"), F.col("doc_id").cast("string")).alias("stem"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return files.withColumn("stem", stem).join(allowed, "stem", "left_semi").select("path")


@query("select doc_id, case when doc_id % 10 in (7, 8) then 'eval' else 'train' end as split from documents")
def collapsed_split(spark, sf_dir):
    """A split looked up by name: validation and test are one, what is not listed is for training."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    listed = d.where("doc_id % 10 in (7, 8, 9)").select("doc_id", F.element_at(F.array(F.lit("validation"), F.lit("test"), F.lit("train")), (F.col("doc_id") % 10 - 6).cast("int")).alias("split"))
    s = C.with_default(d, listed, "doc_id", "split", F.lit("train"))
    return s.withColumn("split", F.when(F.col("split").isin("validation", "test"), "eval").otherwise(F.col("split")))


#: Kinds of tokens of one's own: loudness in eight steps, and a mark for notes that are held long.
KINDS = (V.TokenKind("loudness", 8, lambda: F.col("event_id") % 8), V.TokenKind("held", 1, lambda: F.when(F.col("dur") >= 200, 0)))


@query(f"""with {SQL_NOTES}, t as (select 694 + event_id % 8 as id, program from notes union all select 702, program from notes where dur >= 200 union all select shift + 51, program from notes),
k as (select program, case when id >= 702 then 'held' when id >= 694 then 'loudness' else 'shift' end as kind, case when id >= 702 then 0 when id >= 694 then id - 694 else id - 51 end as value from t)
select program, kind, cast(value as integer) as value, count(*) as n from k group by 1,2,3""")
def own_tokens(spark, sf_dir):
    """Sequences with kinds of tokens of one's own behind each note's, looked up in the vocabulary that has them."""
    seqs = notes_to_tokens(notes(spark, sf_dir), ["song", "program"], KINDS)
    t = seqs.select("program", F.explode("tokens").alias("token_id")).groupBy("program", "token_id").agg(F.count("*").alias("n"))
    v = V.vocabulary(spark, KINDS).where("kind in ('shift', 'held', 'loudness')")
    return t.join(F.broadcast(v), "token_id").select("program", "kind", "value", "n")


@query(f"""with f as ({ORACLE['foundation_samples']}) select song, cast(row_number() over (partition by song order by win) - 1 as bigint) as place, mode as pattern, len(string_split(sample, ' ')) as tokens, substr(md5(cast(song as varchar)), 1, 1) as shard from f""")
def patterned_samples(spark, sf_dir):
    """Songs saved with their samples and, side by side, the pattern of each, in folders by a hash; read back place by place."""
    root = f"{shared_folder(spark)}/patterned-{uuid.uuid4()}"
    one = F.array_sort(F.collect_list(F.struct("win", "mode", "sample")))
    songs = foundation_samples(spark, sf_dir).groupBy("song").agg(one.alias("o"))
    saved = songs.select("song", F.transform("o", lambda x: x["sample"]).alias("samples"), F.transform("o", lambda x: x["mode"]).alias("pattern_keys"))
    saved.withColumn("shard", F.substring(F.md5(F.col("song").cast("string")), 1, 1)).write.partitionBy("shard").parquet(root)
    back = spark.read.schema("song long, samples array<string>, pattern_keys array<string>, shard string").parquet(root)
    rows = back.select("song", "shard", F.posexplode(F.arrays_zip("samples", "pattern_keys")).alias("place", "x"))
    return rows.select("song", F.col("place").cast("long").alias("place"), F.col("x.pattern_keys").alias("pattern"), F.size(F.split("x.samples", " ")).cast("long").alias("tokens"), "shard")
