"""Queries that score: by source against shared negatives, emitted answers, cells with onsets and loudness, known classes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import md5_mod
from ..operators import metrics as M
from ..operators import rolls as R
from ..sources.tables import SQL_MOD, SQL_NOTES, SQL_PREDS, notes, predictions, table
from .metrics import SQL_GRAMS, _grams, _sql_shares
from .registry import query

_NUMBER = "cast(regexp_extract(source, '[0-9]+') as integer)"


@query(f"""with {SQL_PREDS}, x as (select source, score, {_NUMBER} % 4 < 2 as neg from preds), j as (select a.source, sum(case when a.score > b.score then 1e0 when a.score = b.score then 0.5e0 else 0e0 end) as w, count(*) as n from x a join x b on not a.neg and b.neg group by 1),
m as (select source, count(*) as positives, sum(score) as s from x where not neg group by 1), a as (select m.source, m.positives, j.w, j.n, m.s from m left join j using (source)), n as (select count(*) as negatives from x where neg)
select source, positives, negatives, round(w/n, 6) as auc, round(s/positives, 6) as mean from a, n union all select null, sum(positives)::bigint, max(negatives), round(sum(w)/sum(n), 6), round(sum(s)/sum(positives), 6) from a, n""")
def auc_by_source(spark, sf_dir):
    """How well a score tells each source of made texts from the same human ones, and all of them together."""
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    found = M.auc_by_source(predictions(spark, sf_dir), "source", "score", number % 4 < 2)
    return found.withColumns({c: F.round(c, 6) for c in ("auc", "mean")})


@query(f"""with {SQL_PREDS.split(", p as")[0]}, c as (select doc_id, lang, cand, {SQL_MOD.format(x="'e'||cand||cast(doc_id as varchar)", n=997)} as s from preds, (select distinct lang as cand from preds) v), r as (select *, row_number() over (partition by doc_id order by s desc, cand) as rank from c),
g as (select t.doc_id, t.lang, t.cand as top, k.rank, t.s >= 600 as emitted from r t join r k on k.doc_id=t.doc_id and k.cand=k.lang and t.rank=1)
select count(*) as n, round(avg(case when emitted then 1e0 else 0e0 end), 6) as emit_rate, round(avg(case when emitted and top=lang then 1e0 else 0e0 end), 6) as accuracy, round(avg(case when top=lang then 1e0 else 0e0 end) filter (where emitted), 6) as of_emitted,
 round(avg(case when emitted and rank<=2 then 1e0 else 0e0 end), 6) as top2, round((select max(n)/cast(sum(n) as double) from (select lang, count(*) as n from g group by 1) t), 6) as majority, round(1e0/(select count(distinct lang) from preds), 6) as chance from g""")
def emitted_accuracy(spark, sf_dir):
    """Accuracy where a model need not answer: how often it does, right answers of all and of those given, and what the
    commonest class and chance would give. An answer is given if its score is high enough."""
    p = predictions(spark, sf_dir).select("doc_id", "lang")
    # A row for each class.
    classes = p.select(F.col("lang").alias("cand")).distinct()
    s = md5_mod(F.concat(F.lit("e"), "cand", F.col("doc_id").cast("string")), 997)
    c = p.crossJoin(F.broadcast(classes)).withColumn("s", s).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("s"), "cand")))
    g = c.groupBy("doc_id", "lang").agg(F.max_by("cand", -F.col("rank")).alias("top"), F.max("s").alias("s"), F.max(F.when(F.col("cand") == F.col("lang"), F.col("rank"))).alias("rank"))
    emitted, right = F.col("s") >= 600, F.col("top") == F.col("lang")
    rate = lambda x: F.round(F.avg(x.cast("double")), 6)
    base = g.groupBy("lang").agg(F.count("*").alias("n")).agg(F.round(F.max("n") / F.sum("n"), 6).alias("majority"), F.round(F.lit(1.0) / F.count("*"), 6).alias("chance"))
    return g.agg(
        F.count("*").alias("n"), rate(emitted).alias("emit_rate"), rate(emitted & right).alias("accuracy"), F.round(F.avg(F.when(emitted, right.cast("double"))), 6).alias("of_emitted"),
        rate(emitted & (F.col("rank") <= 2)).alias("top2"),
    ).join(F.broadcast(base))


@query(f"""with {SQL_NOTES}, n as (select song, program, pitch, measure*96+shift as s, dur, 1 + event_id % 127 as v from notes where program in ('view','click')), c as (select distinct song, program, pitch, unnest(range(s, s+dur)) as step from n), o as (select song, program, pitch, s, max(v) as v from n group by 1,2,3,4),
k as (select song, sum(case when r and e then 1 else 0 end) as tp, sum(case when r then 1 else 0 end) as ref, sum(case when e then 1 else 0 end) as est from (select song, pitch, step, bool_or(program='view') as r, bool_or(program='click') as e from c group by 1,2,3) x group by 1),
q as (select song, sum(case when r is not null and e is not null then 1 else 0 end) as tp, count(r) as ref, count(e) as est, avg(abs(r - e)) as mae from (select song, pitch, s, max(v) filter (where program='view') as r, max(v) filter (where program='click') as e from o group by 1,2,3) x group by 1)
select k.song, cast(k.tp as bigint) as cells, round(k.tp/nullif(k.est,0)::double, 6) as precision, round(k.tp/nullif(k.ref,0)::double, 6) as recall, round(2e0*k.tp/(k.ref+k.est), 6) as f1, cast(q.tp as bigint) as onsets, round(2e0*q.tp/(q.ref+q.est), 6) as onset_f1, round(q.mae, 6) as velocity_error from k join q on q.song=k.song""")
def roll_scores(spark, sf_dir):
    """One part's roll against another's: cells and onsets that both have, and how far their loudness is apart where both
    start a note. Cells are lengths of spans."""
    n = notes(spark, sf_dir).where("program in ('view', 'click')").withColumn("v", (1 + F.col("event_id") % 127).cast("int"))
    spans, _ = R.roll_spans(n, ["song", "program"])
    length = F.col("stop") - F.col("start")
    size = lambda p: F.sum(F.when(F.col("program") == p, length).otherwise(0))
    sizes = spans.groupBy("song").agg(size("view").alias("ref"), size("click").alias("est"))
    both = R.steps_of(spans, ["song", "pitch"]).where("value = 2").groupBy("song").agg(F.sum(length).alias("cells"))
    own = lambda p: F.max(F.when(F.col("program") == p, F.col("v")))
    onsets = n.groupBy("song", "pitch", (F.col("measure") * 96 + F.col("shift")).alias("s")).agg(own("view").alias("r"), own("click").alias("e"))
    o = onsets.groupBy("song").agg(F.count_if(F.col("r").isNotNull() & F.col("e").isNotNull()).alias("onsets"), F.count("r").alias("nr"), F.count("e").alias("ne"), F.round(F.avg(F.abs(F.col("r") - F.col("e"))), 6).alias("velocity_error"))
    k = sizes.join(both, "song", "left").fillna(0, ["cells"]).join(o, "song")
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    tp = F.col("cells")
    return k.select(
        "song", "cells", share(tp, F.col("est")).alias("precision"), share(tp, F.col("ref")).alias("recall"), share(2.0 * tp, F.col("ref") + F.col("est")).alias("f1"),
        "onsets", share(2.0 * F.col("onsets"), F.col("nr") + F.col("ne")).alias("onset_f1"), "velocity_error",
    )


@query(f"""with {SQL_PREDS.split(", p as")[0]}, k as (select distinct lang as cand from preds where {_NUMBER} % 5 = 0), g as (select * from preds where {_NUMBER} % 5 <> 0 and lang in (select cand from k)),
c as (select doc_id, lang, cand, {SQL_MOD.format(x="'h'||cand||cast(doc_id as varchar)", n=997)} as s from g, k), r as (select *, row_number() over (partition by doc_id order by s desc, cand) as rank from c), t as (select doc_id, lang, max(cand) filter (where rank=1) as top, max(rank) filter (where cand=lang) as rank from r group by 1,2),
f as (select x, 2e0*sum(case when lang=x and top=x then 1 else 0 end)/sum(case when lang=x then 1 else 0 end + case when top=x then 1 else 0 end) as f from t, (select distinct lang as x from t union select distinct top from t) l group by 1)
select count(*) as n, (select count(*) from k) as n_classes, round(avg(case when top=lang then 1e0 else 0e0 end), 6) as accuracy, round(avg(case when rank<=2 then 1e0 else 0e0 end), 6) as top2, round((select avg(f) from f), 6) as macro_f1 from t""")
def head_eval(spark, sf_dir):
    """A classifier's ranks, scored on rows whose class it was taught; it knows no others."""
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    p = predictions(spark, sf_dir)
    known = p.where(number % 5 == 0).select(F.col("lang").alias("cand")).distinct()
    g = p.where(number % 5 != 0).join(known, F.col("lang") == F.col("cand"), "left_semi").select("doc_id", "lang")
    s = md5_mod(F.concat(F.lit("h"), "cand", F.col("doc_id").cast("string")), 997)
    r = g.crossJoin(F.broadcast(known)).withColumn("s", s).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("s"), "cand")))
    t = r.groupBy("doc_id", "lang").agg(F.max(F.when(F.col("rank") == 1, F.col("cand"))).alias("top"), F.max(F.when(F.col("cand") == F.col("lang"), F.col("rank"))).alias("rank"))
    # Counts by gold and answer are all that F1 needs.
    c = t.groupBy("lang", "top").agg(F.count("*").alias("n"))
    side = c.select(F.inline(F.array(F.struct(F.col("lang").alias("x"), F.col("n").alias("m"), F.when(F.col("lang") == F.col("top"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("top").alias("x"), F.col("n").alias("m"), F.lit(0).cast("long").alias("tp")))))
    f1 = side.groupBy("x").agg((2.0 * F.sum("tp") / F.sum("m")).alias("f")).agg(F.round(F.avg("f"), 6).alias("macro_f1"))
    rate = lambda x: F.round(F.avg(x.cast("double")), 6)
    head = t.agg(F.count("*").alias("n"), rate(F.col("top") == F.col("lang")).alias("accuracy"), rate(F.col("rank") <= 2).alias("top2"))
    return head.join(F.broadcast(f1)).join(F.broadcast(known.agg(F.count("*").alias("n_classes"))))


@query("""with b as (select conv_id, array_to_string(list(role order by turn), '>') as pattern from conversations group by 1) select pattern, count(*) as n from b group by 1 order by n desc, pattern limit 5""")
def top_patterns(spark, sf_dir):
    """The five commonest orders of roles; a report of the top."""
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    b = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(own.alias("pattern"))
    return b.groupBy("pattern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(5)


_AXIS = "select model, round(sum((p*log2(p/((p+q)/2)) + q*log2(q/((p+q)/2)))/2), 6) as js from (select model, p/sum(p) over (partition by model) as p, q/sum(q) over (partition by model) as q from (select a.model, a.p+1e-12 as p, b.p+1e-12 as q from {h} a join {h} b on a.model=b.model and a.bin=b.bin and a.program='view' and b.program='click') j) n group by 1"


@query(f"""with {SQL_GRAMS}, m as (select *, song % 3 as model from notes), {_sql_shares('hp', 'pitch', 12, 'model, program').replace('from notes', 'from m')}, {_sql_shares('hd', 'dur', 289, 'model, program').replace('from notes', 'from m')}, {_sql_shares('hh', 'measure*96+shift', 24, 'model, program').replace('from notes', 'from m')},
pj as ({_AXIS.format(h='hp')}), dj as ({_AXIS.format(h='hd')}), fj as ({_AXIS.format(h='hh')}), d as (select song % 3 as model, program, count(distinct (a,b,c))/cast(count(*) as double) as rate from g where program in ('view','click') group by 1,2),
k as (select model, song, program, avg(case when (pitch % 12 - song % 12 + 12) % 12 in (0,2,4,5,7,9,11) then 1e0 else 0e0 end) as agree from m where program in ('view','click') group by 1,2,3),
s as (select model, count(distinct song) as songs, count(distinct case when program='view' then song end) as made from m group by 1)
select s.model, s.songs, round(s.made/cast(s.songs as double), 6) as gate, pj.js as pitch_js, dj.js as duration_js, fj.js as phase_js, round(max(d.rate) filter (where d.program='view'), 6) as distinct_made, round(max(d.rate) filter (where d.program='click'), 6) as distinct_true,
 (select round(avg(agree), 6) from k where k.model=s.model and program='view') as key_made, (select round(avg(agree), 6) from k where k.model=s.model and program='click') as key_true from s join pj using (model) join dj using (model) join fj using (model) join d using (model) group by all""")
def generation_axes(spark, sf_dir):
    """Models by what they made against what was there: how often they made anything, how far the distributions of pitch
    classes, durations and places are apart, how varied both are, and how well they keep to the key."""
    n = notes(spark, sf_dir).withColumn("model", F.col("song") % 3)
    pair = n.where("program in ('view', 'click')")
    songs = n.groupBy("model").agg(F.countDistinct("song").alias("songs"), F.countDistinct(F.when(F.col("program") == "view", F.col("song"))).alias("made"))
    out = songs.select("model", "songs", F.round(F.col("made") / F.col("songs"), 6).alias("gate"))
    for name, value, k in (("pitch_js", F.col("pitch"), 12), ("duration_js", F.col("dur"), 289), ("phase_js", F.col("measure") * 96 + F.col("shift"), 24)):
        s = M.shares(pair, ["model", "program"], value, k)
        a, b = (s.where(F.col("program") == p).drop("program") for p in ("view", "click"))
        out = out.join(M.js_divergence(a, b, ["model"]).select("model", F.round("js", 6).alias(name)), "model")
    sides = (("view", "made"), ("click", "true"))
    grams = _grams(spark, sf_dir).where("program in ('view', 'click')").groupBy((F.col("song") % 3).alias("model"), "program").agg((F.countDistinct("a", "b", "c") / F.count("*")).alias("rate"))
    varied = grams.groupBy("model").agg(*[F.round(F.max(F.when(F.col("program") == p, F.col("rate"))), 6).alias(f"distinct_{x}") for p, x in sides])
    keeps = F.pmod(F.col("pitch") % 12 - F.col("song") % 12, F.lit(12)).isin(0, 2, 4, 5, 7, 9, 11).cast("double")
    agree = pair.groupBy("model", "song", "program").agg(F.avg(keeps).alias("agree"))
    keys = agree.groupBy("model").agg(*[F.round(F.avg(F.when(F.col("program") == p, F.col("agree"))), 6).alias(f"key_{x}") for p, x in sides])
    return out.join(varied, "model").join(keys, "model")
