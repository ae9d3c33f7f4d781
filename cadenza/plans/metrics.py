"""Queries for distribution, agreement and classification metrics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import MAJOR_PROFILE, MINOR_PROFILE, key_relation, md5_mod, mirex
from ..operators import metrics as M
from ..sources.tables import SQL_MOD, SQL_NOTES, SQL_PREDS, notes, predictions, table
from .registry import query


def _sql_shares(name, expr, k, by):
    return f"""{name}c as (select {by}, cast(((({expr}) % {k}) + {k}) % {k} as integer) as bin, count(*) as c from notes group by all),
{name}f as (select g.*, unnest(range(0,{k})) as bin from (select distinct {by} from {name}c) g),
{name} as (select f.*, coalesce(c.c,0)/cast(sum(coalesce(c.c,0)) over (partition by {", ".join("f." + x.strip() for x in by.split(","))}) as double) as p from {name}f f left join {name}c c on {" and ".join(f"f.{x.strip()}=c.{x.strip()}" for x in by.split(","))} and f.bin=c.bin)"""


@query(f"with {SQL_NOTES}, {_sql_shares('h', 'pitch', 12, 'program')} select program, cast(bin as integer) as bin, round(p, 6) as p from h")
def pitch_class_hist(spark, sf_dir):
    return M.shares(notes(spark, sf_dir), ["program"], F.col("pitch"), 12).withColumn("p", F.round("p", 6))


@query(f"with {SQL_NOTES}, {_sql_shares('h', 'measure*96+shift', 24, 'program')} select program, cast(bin as integer) as bin, round(p, 6) as p from h")
def phase_hist(spark, sf_dir):
    return M.shares(notes(spark, sf_dir), ["program"], F.col("measure") * 96 + F.col("shift"), 24).withColumn("p", F.round("p", 6))


@query(f"""with {SQL_NOTES}, {_sql_shares('h', 'pitch', 12, 'song, program')}, a as (select * from h where program='view'), b as (select * from h where program='click'),
j as (select a.song, a.bin, a.p+1e-12 as p, b.p+1e-12 as q from a join b on a.song=b.song and a.bin=b.bin), n as (select song, p/sum(p) over (partition by song) as p, q/sum(q) over (partition by song) as q from j)
select song, round(sum((p*log2(p/((p+q)/2)) + q*log2(q/((p+q)/2)))/2), 6) as js from n group by song""")
def js_divergence(spark, sf_dir):
    s = M.shares(notes(spark, sf_dir), ["song", "program"], F.col("pitch"), 12)
    a, b = (s.where(F.col("program") == p).drop("program") for p in ("view", "click"))
    return M.js_divergence(a, b, ["song"]).withColumn("js", F.round("js", 6))


@query(f"""with {SQL_NOTES}, v as (select song, pitch, cast(sum(case when program='view' then 1 else 0 end) as bigint) as a, cast(sum(case when program='click' then 1 else 0 end) as bigint) as b from notes where program in ('view','click') group by 1,2),
f as (select song, pitch, sum(a) over (partition by song order by pitch rows unbounded preceding)/cast(sum(a) over (partition by song) as double) as fa, sum(b) over (partition by song order by pitch rows unbounded preceding)/cast(sum(b) over (partition by song) as double) as fb,
 lead(pitch) over (partition by song order by pitch) - pitch as step from v) select song, round(sum(abs(fa-fb)*step), 6) as w1 from f group by song having sum(abs(fa-fb)*step) is not null""")
def wasserstein1(spark, sf_dir):
    n = notes(spark, sf_dir).where("program in ('view', 'click')").withColumn("side", (F.col("program") == "click").cast("int"))
    return M.wasserstein(n, ["song"], "pitch", "side").where("w1 is not null").withColumn("w1", F.round("w1", 6))


SQL_GRAMS = f"""{SQL_NOTES}, l as (select song, program, pitch, lead(pitch,1) over w - pitch as a, lead(pitch,2) over w - lead(pitch,1) over w as b, lead(pitch,3) over w - lead(pitch,2) over w as c from notes
 window w as (partition by song, program order by measure, shift, pitch, dur, event_id)), g as (select song, program, a, b, c from l where c is not null)"""


def _grams(spark, sf_dir):
    """(song, program, a, b, c): three pitch intervals in a row."""
    w = Window.partitionBy("song", "program").orderBy("measure", "shift", "pitch", "dur", "event_id")
    ahead = [F.lead("pitch", k).over(w) if k else F.col("pitch") for k in range(4)]
    return notes(spark, sf_dir).select("song", "program", *[(ahead[k + 1] - ahead[k]).alias(x) for k, x in enumerate("abc")]).where("c is not null")


@query(f"with {SQL_GRAMS}, u as (select distinct song, a, b, c from g where program='view'), v as (select distinct song, a, b, c from g where program='click') select u.song, round(avg(case when v.a is null then 0e0 else 1e0 end), 6) as overlap from u left join v on u.song=v.song and u.a=v.a and u.b=v.b and u.c=v.c group by u.song")
def ngram_overlap(spark, sf_dir):
    """Share of a part's n-grams that the part it stands against has, song by song."""
    g = _grams(spark, sf_dir)
    known = g.where("program = 'click'").select("song", "a", "b", "c", F.lit(1.0).alias("known")).distinct()
    own = g.where("program = 'view'").select("song", "a", "b", "c").distinct().join(known, ["song", "a", "b", "c"], "left")
    return own.groupBy("song").agg(F.round(F.avg(F.coalesce("known", F.lit(0.0))), 6).alias("overlap"))


@query(f"with {SQL_GRAMS} select program, count(*) as n, count(distinct (a, b, c)) as d, round(count(distinct (a, b, c))/cast(count(*) as double), 6) as rate from g group by program")
def distinct_n(spark, sf_dir):
    d = F.countDistinct("a", "b", "c")
    return _grams(spark, sf_dir).groupBy("program").agg(F.count("*").alias("n"), d.alias("d"), F.round(d / F.count("*"), 6).alias("rate"))


@query("""with w as (select doc_id, string_split(text, ' ') as w from documents), g as (select distinct doc_id, array_to_string(list_slice(w, i, i+7), ' ') as g from (select doc_id, w, unnest(range(1, len(w)-6)) as i from w) t),
bw as (select string_split(text, ' ') as w from benchmark), b as (select distinct array_to_string(list_slice(w, i, i+7), ' ') as g from (select w, unnest(range(1, len(w)-6)) as i from bw) t)
select g.doc_id, count(*) as grams, count(b.g) as hits from g left join b on g.g=b.g group by g.doc_id having count(b.g) > 0""")
def contamination_8gram(spark, sf_dir):
    """Documents with 8-grams of the benchmark: hashes find the documents that can have one, which are then compared by text.

    A document's hashes are tested against a Bloom filter of the benchmark's in the row; only those that pass are rows."""
    def words(df, *keys):
        return df.select(*keys, F.split("text", " ").alias("w")).where(F.size("w") >= 8)

    def grams(w):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 7), lambda i: F.array_join(F.slice(w, i, F.lit(8)), " ")))

    bench, docs = words(table(spark, sf_dir, "benchmark")), words(table(spark, sf_dir, "documents"), "doc_id")
    known = M.gram_hashes(bench, "w", 8).select(F.explode("h").alias("h")).distinct()
    hits = M.possible(M.gram_hashes(docs, "w", 8), "h", known, "doc_id").join(known, "h", "left_semi")
    few = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    listed = bench.select(F.explode(grams(F.col("w"))).alias("g")).distinct().withColumn("hit", F.lit(1))
    own = few.select("doc_id", F.explode(grams(F.col("w"))).alias("g")).join(listed, "g", "left")
    return own.groupBy("doc_id").agg(F.count("*").alias("grams"), F.count("hit").alias("hits")).where("hits > 0")


SQL_SCALE = f"""{SQL_NOTES}, k as (select t as tonic, m = 1 as minor from range(0,12) a(t), range(0,2) b(m)), c as (select song, pitch % 12 as pc, count(*) as c from notes group by 1,2),
a as (select song, tonic, minor, sum(case when (not minor and (pc-tonic+12)%12 in (0,2,4,5,7,9,11)) or (minor and (pc-tonic+12)%12 in (0,2,3,5,7,8,10,11)) then c else 0 end)/cast(sum(c) as double) as agree from c, k group by 1,2,3)"""


@query(f"with {SQL_SCALE} select song, cast(tonic as integer) as tonic, minor, round(agree, 6) as agree from a")
def scale_agreement(spark, sf_dir):
    return M.scale_agreement(notes(spark, sf_dir), ["song"]).withColumn("agree", F.round("agree", 6))


@query(f"with {SQL_SCALE} select song, cast(tonic as integer) as tonic, minor, round(agree, 6) as agree from (select *, row_number() over (partition by song order by round(agree, 9) desc, minor, tonic) as rn from a) t where rn = 1")
def best_scale_of_24(spark, sf_dir):
    w = Window.partitionBy("song").orderBy(F.desc(F.round("agree", 9)), "minor", "tonic")
    a = M.scale_agreement(notes(spark, sf_dir), ["song"]).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return a.select("song", "tonic", "minor", F.round("agree", 6).alias("agree"))


SQL_GROOVE = f"""{SQL_NOTES}, o as (select song, program, measure*96+shift as t, event_id from notes), i as (select song, program, t, lead(t) over (partition by song, program order by t, event_id) - t as d from o),
p as (select song, program, d as a, lead(d) over (partition by song, program order by t) as b from i where d > 0 and d <= 24), q as (select *, a/cast(b as double) as r from p where a+b between 18 and 30),
e as (select song, program, sum(case when r between 0.75e0 and 1.33e0 then 1 else 0 end) as even_, sum(case when not r between 0.75e0 and 1.33e0 and (r between 1.5e0 and 3e0 or r between 1e0/3e0 and 1e0/1.5e0) then 1 else 0 end) as swing from q group by 1,2),
groove as (select n.song, n.program, case when n.c < 3 or coalesce(even_+swing, 0) = 0 then 'undetermined' when even_ >= swing then 'even' else 'swing' end as groove, coalesce(even_, 0)::bigint as even_, coalesce(swing, 0)::bigint as swing
 from (select song, program, count(*) as c from notes group by 1,2) n left join e on e.song=n.song and e.program=n.program)"""


@query(f"with {SQL_GROOVE} select song, program, groove, even_, swing from groove")
def groove_class(spark, sf_dir):
    return M.groove(notes(spark, sf_dir), ["song", "program"])


@query(f"with {SQL_GROOVE}, c as (select song, groove from groove where program='view' and groove <> 'undetermined') select g.program, round(avg(case when g.groove=c.groove then 1e0 else 0e0 end), 6) as agreement, count(*) as n from groove g join c on c.song=g.song where g.program <> 'view' group by 1")
def groove_agreement(spark, sf_dir):
    """How often a part has the groove of the part it follows, where that one has any."""
    g = M.groove(notes(spark, sf_dir), ["song", "program"])
    context = g.where("program = 'view' and groove <> 'undetermined'").select("song", F.col("groove").alias("own"))
    same = g.where("program <> 'view'").join(context, "song")
    return same.groupBy("program").agg(F.round(F.avg((F.col("groove") == F.col("own")).cast("double")), 6).alias("agreement"), F.count("*").alias("n"))


@query(f"""with {SQL_NOTES} select song, arg_min(pitch, cast(measure*96+shift as hugeint)*1000000000000000000 + event_id) filter (where measure >= 15) - arg_max(pitch, cast(measure*96+shift as hugeint)*1000000000000000000 + event_id) filter (where measure < 15) as seam from notes group by song""")
def seam_interval(spark, sf_dir):
    at = F.struct("measure", "shift", "event_id")
    after, before = F.when(F.col("measure") >= 15, at), F.when(F.col("measure") < 15, at)
    return notes(spark, sf_dir).groupBy("song").agg((F.min_by("pitch", after) - F.max_by("pitch", before)).alias("seam"))


@query(f"with {SQL_NOTES} select song, max(pitch)-min(pitch) as span, round(abs(avg(pitch) filter (where measure >= 15) - avg(pitch) filter (where measure < 15)), 6) as jump from notes group by song")
def register_jump(spark, sf_dir):
    mean = lambda c: F.avg(F.when(c, F.col("pitch")))
    jump = F.abs(mean(F.col("measure") >= 15) - mean(F.col("measure") < 15))
    return notes(spark, sf_dir).groupBy("song").agg((F.max("pitch") - F.min("pitch")).alias("span"), F.round(jump, 6).alias("jump"))


@query(f"with {SQL_NOTES} select song, round(count(*)/cast(count(distinct measure) as double), 6) as per_used, round(count(*)/cast(max(measure)+1 as double), 6) as per_bar from notes group by song")
def notes_per_bar(spark, sf_dir):
    n = F.count("*")
    return notes(spark, sf_dir).groupBy("song").agg(F.round(n / F.countDistinct("measure"), 6).alias("per_used"), F.round(n / (F.max("measure") + 1), 6).alias("per_bar"))


@query(f"""with {SQL_NOTES}, h as (select song, shift // 12 as bin, count(*) as c from notes group by 1,2), s as (select song, bin, c/cast(sum(c) over (partition by song) as double) as p from h)
select cast(bin as integer) as bin, round(sum(p)/(select count(distinct song) from notes), 6) as p from s group by bin""")
def rhythm_histogram(spark, sf_dir):
    h = notes(spark, sf_dir).groupBy("song", F.expr("cast(shift div 12 as int)").alias("bin")).agg(F.count("*").alias("c"))
    s = h.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("song")))
    songs = h.agg(F.countDistinct("song").alias("songs"))
    return s.groupBy("bin").agg(F.sum("p").alias("p")).join(F.broadcast(songs)).select("bin", F.round(F.col("p") / F.col("songs"), 6).alias("p"))


@query(f"with {SQL_NOTES}, c as (select song, program, count(*) as votes, min(event_id) as f from notes group by 1,2) select song, program, votes from (select *, row_number() over (partition by song order by votes desc, f) as rn from c) t where rn = 1")
def majority_vote(spark, sf_dir):
    return M.majority(notes(spark, sf_dir), ["song"], "program", "event_id").select("song", "program", "votes")


@query(f"with {SQL_PREDS}, l as (select distinct gold as x from p), s as (select x, sum(case when gold=x and pred=x then 1e0 else 0e0 end) as tp, sum(case when gold=x then 1e0 else 0e0 end) as g, sum(case when pred=x then 1e0 else 0e0 end) as h from p, l group by x) select round(avg(2*tp/(g+h)), 6) as macro_f1, count(*) as labels from s")
def macro_f1(spark, sf_dir):
    return M.macro_f1(predictions(spark, sf_dir), "gold", "pred").withColumn("macro_f1", F.round("macro_f1", 6))


@query(f"with {SQL_PREDS}, c as (select a.lang, sum(case when a.score > b.score then 1e0 when a.score = b.score then 0.5e0 else 0e0 end) as w, count(*) as n from preds a join preds b on a.lang=b.lang and a.gold=1 and b.gold=0 group by 1) select l.lang, round(c.w/c.n, 6) as auc from (select distinct lang from preds) l left join c on l.lang=c.lang")
def roc_auc(spark, sf_dir):
    return M.auc(predictions(spark, sf_dir), ["lang"], "score", "gold").withColumn("auc", F.round("auc", 6))


@query(f"with {SQL_PREDS} select source, count(*) as n, round(avg(case when gold=pred then 1e0 else 0e0 end), 6) as accuracy from p group by source")
def accuracy_by_source(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 6).alias("accuracy"))


@query(f"with {SQL_PREDS} select lang, case when gold=1 and pred=1 then 'tp' when gold=1 then 'fn' when pred=1 then 'fp' else 'tn' end as kind, count(*) as n from p group by 1,2")
def confusion_taxonomy(spark, sf_dir):
    kind = F.when((F.col("gold") == 1) & (F.col("pred") == 1), "tp").when(F.col("gold") == 1, "fn").when(F.col("pred") == 1, "fp").otherwise("tn")
    return predictions(spark, sf_dir).groupBy("lang", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""with k as (select event_id, cast(event_id % 12 as integer) as gt, event_id % 5 = 0 as gm, cast((event_id*7) % 12 as integer) as t, event_id % 3 = 0 as m from events),
u as (select *, (t-gt+12)%12 as up from k), s as (select *, case when up=0 and gm=m then 1e0 when gm=m and up in (5,7) then 0.5e0 when gm<>m and up = case when gm then 3 else 9 end then 0.3e0 when gm<>m and up=0 then 0.2e0 else 0e0 end as s from u)
select case s when 1e0 then 'correct' when 0.5e0 then 'fifth' when 0.3e0 then 'relative' when 0.2e0 then 'parallel' else 'other' end as relation, count(*) as n, round(avg(s), 6) as mean from s group by 1""")
def mirex_relations(spark, sf_dir):
    e = F.col("event_id")
    args = (e % 12).cast("int"), e % 5 == 0, ((e * 7) % 12).cast("int"), e % 3 == 0
    k = table(spark, sf_dir, "events").select(key_relation(*args).alias("relation"), mirex(*args).alias("s"))
    return k.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"))


SQL_CANDS = f"""{SQL_PREDS.split(", p as")[0]}, c as (select doc_id, lang, cand, {SQL_MOD.format(x="cand||cast(doc_id as varchar)", n=997)} as s from preds, (values ('en'),('fr'),('de'),('es')) v(cand)), r as (select *, row_number() over (partition by doc_id order by s desc, cand) as rank from c)"""


def _ranks(spark, sf_dir):
    cands = spark.createDataFrame([(x,) for x in ("en", "fr", "de", "es")], "cand string")
    c = predictions(spark, sf_dir).select("doc_id", "lang").crossJoin(F.broadcast(cands))
    s = c.withColumn("s", md5_mod(F.concat("cand", F.col("doc_id").cast("string")), 997))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("s"), "cand"))).where("cand = lang")


@query(f"with {SQL_CANDS}, g as (select * from r where cand=lang) select round(avg(case when rank=1 then 1e0 else 0e0 end), 6) as top1, round(avg(case when rank<=2 then 1e0 else 0e0 end), 6) as top2, round(avg(rank), 6) as mean_rank, round(quantile_cont(rank, 0.5), 6) as median_rank, round((select max(n)/cast(sum(n) as double) from (select lang, count(*) as n from g group by 1) t), 6) as majority from g")
def topk_accuracy(spark, sf_dir):
    g = _ranks(spark, sf_dir)
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    base = g.groupBy("lang").agg(F.count("*").alias("n")).agg(F.round(F.max("n") / F.sum("n"), 6).alias("majority"))
    return g.agg(
        rate(F.col("rank") == 1).alias("top1"), rate(F.col("rank") <= 2).alias("top2"), F.round(F.avg("rank"), 6).alias("mean_rank"),
        F.round(F.percentile("rank", F.lit(0.5)), 6).alias("median_rank"),
    ).join(F.broadcast(base))


@query(f"""with {SQL_NOTES}, a as (select distinct song, measure, pitch from notes where program='view'), b as (select distinct song, measure, pitch from notes where program='click'),
j as (select coalesce(a.song,b.song) as song, case when a.song is not null and b.song is not null then 1 else 0 end as tp, case when a.song is not null then 1 else 0 end as ref, case when b.song is not null then 1 else 0 end as est from a full join b on a.song=b.song and a.measure=b.measure and a.pitch=b.pitch)
select song, cast(sum(tp) as bigint) as tp, round(2e0*sum(tp)/(sum(ref)+sum(est)), 6) as f1 from j group by song""")
def cell_f1(spark, sf_dir):
    cells = notes(spark, sf_dir).where("program in ('view', 'click')").groupBy("song", "measure", "pitch").agg(
        F.max((F.col("program") == "view").cast("int")).alias("ref"), F.max((F.col("program") == "click").cast("int")).alias("est")
    )
    tp = F.sum(F.col("ref") * F.col("est"))
    return cells.groupBy("song").agg(tp.alias("tp"), F.round(2.0 * tp / (F.sum("ref") + F.sum("est")), 6).alias("f1"))


@query(f"with {SQL_PREDS}, r as (select lang, source, avg(case when gold=pred then 1e0 else 0e0 end) as acc from p group by 1,2) select lang, round(avg(acc), 6) as mean, round(coalesce(stddev_samp(acc), 0), 6) as sd from r group by lang")
def seed_mean_sd(spark, sf_dir):
    r = predictions(spark, sf_dir).groupBy("lang", "source").agg(F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("acc"))
    return r.groupBy("lang").agg(F.round(F.avg("acc"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("acc"), F.lit(0.0)), 6).alias("sd"))


@query("with q as (select quantile_cont(n_chars, 0.25) as a, quantile_cont(n_chars, 0.5) as b, quantile_cont(n_chars, 0.75) as c from documents) select case when n_chars <= a then 1 when n_chars <= b then 2 when n_chars <= c then 3 else 4 end as quartile, count(*) as n, cast(sum(n_chars) as bigint) as total from documents, q group by 1")
def quartile_strata(spark, sf_dir):
    """Quartiles from counts of distinct lengths, so that rows are summed before they meet."""
    d = table(spark, sf_dir, "documents").groupBy("n_chars").agg(F.count("*").alias("c"))
    q = d.agg(*[F.percentile("n_chars", F.lit(p), F.col("c")).alias(x) for x, p in (("a", 0.25), ("b", 0.5), ("c_", 0.75))])
    band = F.when(F.col("n_chars") <= F.col("a"), 1).when(F.col("n_chars") <= F.col("b"), 2).when(F.col("n_chars") <= F.col("c_"), 3).otherwise(4)
    total = F.sum(F.col("n_chars") * F.col("c"))
    return d.join(F.broadcast(q)).groupBy(band.alias("quartile")).agg(F.sum("c").alias("n"), total.alias("total"))


@query(f"with {SQL_PREDS} select t, sum(case when score >= t then 1 else 0 end)::bigint as kept, round(sum(case when score >= t and gold=pred then 1e0 else 0e0 end)/nullif(sum(case when score >= t then 1 else 0 end), 0), 6) as of_kept, round(sum(case when score >= t and gold=pred then 1e0 else 0e0 end)/count(*), 6) as of_all from p, (values (0.0e0),(0.1e0),(0.3e0),(0.5e0),(0.7e0),(0.9e0),(0.95e0)) v(t) group by t")
def threshold_sweep(spark, sf_dir):
    t = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 0.95)], "t double")
    p = predictions(spark, sf_dir).crossJoin(F.broadcast(t))
    kept, right = F.col("score") >= F.col("t"), F.col("gold") == F.col("pred")
    return p.groupBy("t").agg(
        F.count_if(kept).alias("kept"), F.round(F.avg(F.when(kept, right.cast("double"))), 6).alias("of_kept"),
        F.round(F.count_if(kept & right) / F.count("*"), 6).alias("of_all"),
    )


@query(f"with {SQL_NOTES}, {_sql_shares('h', 'pitch', 12, 'song')} select song, round(sum(-p*ln(p+1e-12)), 6) as entropy, round(max(p), 6) as top from h group by song")
def entropy_maxprob(spark, sf_dir):
    s = M.shares(notes(spark, sf_dir), ["song"], F.col("pitch"), 12)
    return s.groupBy("song").agg(F.round(F.sum(-F.col("p") * F.log(F.col("p") + 1e-12)), 6).alias("entropy"), F.round(F.max("p"), 6).alias("top"))


@query("""with e as (select f.l_returnflag, x.expert from (select distinct l_returnflag from lineitem) f, range(0, 12) x(expert)), c as (select l_suppkey % 10 as expert, l_returnflag, count(*) as n from lineitem group by 1,2),
d as (select e.l_returnflag, e.expert, coalesce(c.n, 0) as n from e left join c on c.expert=e.expert and c.l_returnflag=e.l_returnflag) select l_returnflag, round(stddev_pop(n)/(avg(n)+1e-6), 6) as cv, cast(sum(case when n = 0 then 1 else 0 end) as bigint) as dead, min(n) as least, max(n) as most from d group by 1""")
def load_variation(spark, sf_dir, experts: int = 12):
    """Variation of the load of a layer's experts, and how many have none: experts without rows count, too."""
    c = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("expert"), "l_returnflag").agg(F.count("*").alias("n"))
    every = c.select("l_returnflag").distinct().withColumn("expert", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(experts - 1).cast("long"))))
    d = every.join(c, ["l_returnflag", "expert"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return d.groupBy("l_returnflag").agg(F.round(F.stddev_pop("n") / (F.avg("n") + 1e-6), 6).alias("cv"), F.count_if(F.col("n") == 0).alias("dead"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("select event_type, round(exp(avg(value/100e0)), 6) as perplexity, round(max(value), 2) as worst from events group by 1")
def perplexity(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.exp(F.avg(F.col("value") / 100.0)), 6).alias("perplexity"), F.round(F.max("value"), 2).alias("worst"))


_ROWS = [(t, m, (t + k) % 12, p) for m, prof in (("false", MAJOR_PROFILE), ("true", MINOR_PROFILE)) for t in range(12) for k, p in enumerate(prof)]
PROFILE_SQL = "(values " + ",".join(f"({t},{m},{c},{p}e0)" for t, m, c, p in _ROWS) + ") v(tonic, minor, pc, p)"


@query(f"""with {SQL_NOTES}, c as (select song, pitch % 12 as pc, cast(sum(dur) as double) as c from notes group by 1,2), f as (select s.song, pc.pc, coalesce(c.c,0) as c from (select distinct song from c) s cross join range(0,12) pc(pc) left join c on c.song=s.song and c.pc=pc.pc),
r as (select song, tonic, minor, round(corr(c, p), 6) as r from f join {PROFILE_SQL} on v.pc=f.pc group by 1,2,3) select song, cast(tonic as integer) as tonic, minor, r from (select *, row_number() over (partition by song order by r desc, minor, tonic) as rn from r) t where rn = 1""")
def key_correlation(spark, sf_dir):
    r = M.key_scores(notes(spark, sf_dir), ["song"], "dur").withColumn("r", F.round("r", 6))
    w = Window.partitionBy("song").orderBy(F.desc("r"), "minor", "tonic")
    return r.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("song", "tonic", "minor", "r")
