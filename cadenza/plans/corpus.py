"""Queries over the corpus: splits, budgets, samples, joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import jaccard_distance
from ..operators import corpus as C
from ..sources.tables import SQL_MANIFEST, SQL_MOD, manifest, table
from .registry import query

SPLIT = f"""m as (select *, {SQL_MOD.format(x="cast(song as varchar)", n=1000)} as b from manifest),
s as (select song, tokens, shard, dataset, label, case when b < 980 then 'train' when b < 990 then 'val' else 'test' end as split from m)"""
BUDGETS = [10_000, 50_000, 200_000, 1_000_000, 1_000_000_000_000]
SQL_BUDGET = "case " + " ".join(f"when cum - tokens < {b} then {b}" for b in BUDGETS) + " end"


@query(f"""with {SQL_MANIFEST}, {SPLIT}, t as (select *, sum(tokens) over (order by md5('b'||cast(song as varchar)), song rows unbounded preceding) as cum
 from s where split = 'train')
select t.song, t.tokens, t.dataset, cast(t.cum as bigint) as cum, cast({SQL_BUDGET} as bigint) as budget, l.quality
from t left join labels l on t.song = l.doc_id""")
def leakfree_budget_index(spark, sf_dir):
    rows = C.hash_split(manifest(spark, sf_dir))
    train = C.leak_free(rows, rows.where("split <> 'train'"))
    budget = C.budget_prefixes(train, BUDGETS, "b")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("song"), "quality")
    return budget.join(labels, "song", "left").select("song", "tokens", "dataset", "cum", "budget", "quality")


@query(f"with {SQL_MANIFEST}, {SPLIT} select song, dataset, split from s")
def hash_split(spark, sf_dir):
    return C.hash_split(manifest(spark, sf_dir)).select("song", "dataset", "split")


@query(f"""with {SQL_MANIFEST}, {SPLIT} select s.dataset, count(*) as n, cast(sum(s.tokens) as bigint) as tokens from s
where song not in (select song from s where split <> 'train') group by s.dataset""")
def leakfree_train(spark, sf_dir):
    rows = C.hash_split(manifest(spark, sf_dir))
    return C.leak_free(rows, rows.where("split <> 'train'")).groupBy("dataset").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query(f"with {SQL_MANIFEST}, {SPLIT} select song, split from s where split <> 'train' and song in (select doc_id from labels)")
def heldout_semi_join(spark, sf_dir):
    songs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("song"))
    return C.hash_split(manifest(spark, sf_dir)).where("split <> 'train'").join(songs, "song", "left_semi").select("song", "split")


@query(f"""with {SQL_MANIFEST}, t as (select *, sum(tokens) over (order by md5(cast(song as varchar)), song rows unbounded preceding) as cum from manifest)
select song, cast({SQL_BUDGET} as bigint) as budget, cast(cum as bigint) as cum from t""")
def budget_prefix(spark, sf_dir):
    return C.budget_prefixes(manifest(spark, sf_dir), BUDGETS).select("song", "budget", "cum")


@query(f"""with {SQL_MANIFEST}, t as (select *, sum(tokens) over (order by md5('t'||cast(song as varchar)), song rows unbounded preceding) as cum
 from manifest where tokens > 0) select song, tokens from t where cum - tokens < 100000""")
def budget_trim(spark, sf_dir):
    return C.budget_prefixes(manifest(spark, sf_dir).where("tokens > 0"), [100_000], "t").select("song", "tokens")


@query(f"""with {SQL_MANIFEST}, r as (select song, tokens, unnest(range(0, 5)) as round from manifest),
t as (select *, sum(tokens) over (order by round, md5(cast(song as varchar)), song rows unbounded preceding) as cum from r)
select song, cast(round as integer) as round, tokens from t where cum - tokens < 400000""")
def repeat_to_target(spark, sf_dir):
    return C.repeat_to_target(manifest(spark, sf_dir), 400_000, 5).select("song", "round", "tokens")


@query(f"""with {SQL_MANIFEST}, r as (select song, label, row_number() over (partition by label order by md5('s'||cast(song as varchar)), song) as rn,
 count(*) over (partition by label) as n from manifest)
select song, label, case when rn <= floor(n*0.8e0) then 'train' when rn <= floor(n*0.8e0)+floor(n*0.1e0) then 'val' else 'test' end as split from r""")
def stratified_split(spark, sf_dir):
    return C.stratified_split(manifest(spark, sf_dir), ["label"], "song").select("song", "label", "split")


@query(f"""with {SQL_MANIFEST}, r as (select song, dataset, row_number() over (partition by dataset order by md5('k'||cast(song as varchar)), song) as rn from manifest)
select song, dataset, cast((rn-1) % 5 as integer) as fold from r""")
def kfold_by_source(spark, sf_dir):
    return C.k_folds(manifest(spark, sf_dir), ["dataset"], "song", 5).select("song", "dataset", "fold")


@query(f"""with {SQL_MANIFEST}, r as (select song, label, row_number() over (partition by label order by md5('e'||cast(song as varchar)), song) as rn from manifest)
select song, label from r where rn <= case label when 'en' then 40 when 'fr' then 20 else 10 end""")
def percategory_eval(spark, sf_dir):
    r = C.ranked(manifest(spark, sf_dir), ["label"], "song", "e")
    most = F.when(F.col("label") == "en", 40).when(F.col("label") == "fr", 20).otherwise(10)
    return r.where(F.col("rn") <= most).select("song", "label")


@query(f"""with {SQL_MANIFEST}, g as (select dataset, cast(sum(tokens) as double) as w from manifest group by 1),
e as (select *, 1000e0*w/sum(w) over () as x from g), f as (select *, floor(x) as fl, x-floor(x) as fr from e)
select dataset, cast(fl + case when row_number() over (order by fr desc, w desc, dataset) <= 1000 - sum(fl) over () then 1 else 0 end as bigint) as alloc from f""")
def mixture_alloc(spark, sf_dir):
    g = manifest(spark, sf_dir).groupBy("dataset").agg(F.sum("tokens").cast("double").alias("w"))
    return C.largest_remainder(g, 1000, "w", "dataset").select("dataset", "alloc")


@query(f"""with {SQL_MANIFEST} select dataset, min(tokens) as least, max(tokens) as most, cast(sum(case when tokens > 100 and tokens < 5000 then 1 else 0 end) as bigint) as valid,
 cast(sum(case when tokens > 100 and tokens < 5000 then tokens else 0 end) as bigint) as valid_tokens, cast(ceil(count(*)/8e0) as bigint) as steps from manifest group by dataset""")
def dataset_stats_strict(spark, sf_dir):
    ok = (F.col("tokens") > 100) & (F.col("tokens") < 5000)
    return manifest(spark, sf_dir).groupBy("dataset").agg(
        F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.count_if(ok).alias("valid"),
        F.sum(F.when(ok, F.col("tokens")).otherwise(0)).alias("valid_tokens"), F.ceil(F.count("*") / 8).alias("steps"),
    )


@query(f"with {SQL_MANIFEST} select shard, count(*) as files, count(distinct song) as songs, cast(sum(tokens) as bigint) as tokens from manifest group by shard")
def shard_totals(spark, sf_dir):
    return manifest(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("files"), F.countDistinct("song").alias("songs"), F.sum("tokens").alias("tokens"))


@query("""select doc_id, 'unlabelled' as side from (select doc_id from documents except select doc_id from labels) a
union all select doc_id, 'labelled' from (select doc_id from documents intersect select doc_id from labels) b
union all select doc_id, 'either' from (select doc_id from documents union select doc_id from labels) c""")
def set_operations(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")  # noqa: E741
    side = lambda df, name: df.withColumn("side", F.lit(name))
    either = d.union(l).distinct()
    return side(d.exceptAll(l).distinct(), "unlabelled").union(side(d.intersect(l), "labelled")).union(side(either, "either"))


@query("select d.doc_id, d.source, coalesce(cast(l.quality as varchar), 'unknown') as quality from documents d left join labels l on d.doc_id = l.doc_id")
def lookup_with_default(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string"))
    return C.with_default(table(spark, sf_dir, "documents").select("doc_id", "source"), labels, "doc_id", "quality", F.lit("unknown"))


@query(f"""with {SQL_MANIFEST} select song, shard from (select *, row_number() over (partition by shard order by md5('x'||cast(song as varchar)), song) as rn from manifest) r where rn <= 5""")
def per_shard_sample(spark, sf_dir):
    return C.first_per_group(manifest(spark, sf_dir), ["shard"], "song", 5, "x").select("song", "shard")


@query("select source, count(*) as n from documents group by source order by n desc, source limit 5")
def top_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


@query("""select source, doc_id from (select *, row_number() over (order by doc_id) as r from (select source, doc_id,
 row_number() over (partition by source order by doc_id) as rn from documents) a where rn <= 3) b where r <= 40""")
def first_n_per_key(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id")
    three = table(spark, sf_dir, "documents").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    return three.orderBy("doc_id").limit(40).select("source", "doc_id")


@query("""with g as (select source, list(doc_id order by doc_id) as ids from documents group by source)
select source, count(*) as n, cast(sum(id) as bigint) as total from (select source, unnest(ids) as id from g union all select 'all', doc_id from documents) t group by source""")
def flatten_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    # Lists of some thousand ids each, however many a source has.
    nested = d.groupBy("source", F.expr("doc_id div 4096")).agg(F.collect_list("doc_id").alias("ids")).select("source", F.explode("ids").alias("id"))
    every = nested.union(d.select(F.lit("all"), "doc_id"))
    return every.groupBy("source").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query("""with w as (select doc_id, source, list_distinct(string_split(lower(text), ' ')) as w from documents)
select a.doc_id, round(case when len(list_distinct(list_concat(a.w, b.w))) = 0 then 0e0
 else 1 - len(list_intersect(a.w, b.w)) / cast(len(list_distinct(list_concat(a.w, b.w))) as double) end, 6) as distance
from w a join w b on b.doc_id = a.doc_id + 1""")
def neighbour_jaccard(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    b = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return w.join(b, "doc_id").select("doc_id", F.round(jaccard_distance(F.col("w"), F.col("v")), 6).alias("distance"))


@query(f"with {SQL_MANIFEST}, {SPLIT} select (select count(*) from (select song from s where split='train' intersect select song from s where split='test') x) as leaks, count(distinct song) as songs from s")
def leak_check(spark, sf_dir):
    s = C.hash_split(manifest(spark, sf_dir))
    both = s.where("split = 'train'").select("song").intersect(s.where("split = 'test'").select("song"))
    return both.agg(F.count("*").alias("leaks")).crossJoin(s.agg(F.countDistinct("song").alias("songs")))


@query(f"""with {SQL_MANIFEST}, g as (select dataset, song, row_number() over (partition by dataset order by md5('m'||cast(song as varchar)), song)-1 as r, count(*) over (partition by dataset) as n from manifest),
q as (select dataset, case when row_number() over (order by dataset) % 3 = 1 then 8 else 4 end as per from (select distinct dataset from manifest) x),
b as (select max(cast(ceil(n/cast(per as double)) as bigint)) as batches from g join q using (dataset)),
k as (select dataset, per, unnest(range(0, per*batches)) as slot from q, b)
select k.dataset, cast(k.slot // k.per as bigint) as batch, g.song from k join g on g.dataset = k.dataset and g.r = k.slot % g.n""")
def mixture_batches(spark, sf_dir):
    """Batches of fixed numbers per dataset; short datasets start again until the longest is through."""
    # A row for each dataset.
    number = F.row_number().over(Window.orderBy("dataset"))
    quota = manifest(spark, sf_dir).select("dataset").distinct().select("dataset", F.when(number % 3 == 1, 8).otherwise(4).alias("per"))
    g = C.ranked(manifest(spark, sf_dir), ["dataset"], "song", "m").join(quota, "dataset").withColumn("r", F.col("rn") - 1)
    batches = g.agg(F.max(F.ceil(F.col("n") / F.col("per"))).alias("batches"))
    slots = g.crossJoin(F.broadcast(batches)).withColumn("_last", F.floor((F.col("per") * F.col("batches") - 1 - F.col("r")) / F.col("n")))
    again = slots.where("_last >= 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    slot = F.col("r") + F.col("k") * F.col("n")
    return again.select("dataset", F.floor(slot / F.col("per")).alias("batch"), "song")


@query(f"""with {SQL_MANIFEST}, r as (select song, dataset, row_number() over (partition by dataset order by md5('q'||cast(song as varchar)), song) as rn from manifest)
select song, dataset from r where rn <= case dataset when 'src0' then 10 else 5 end""")
def source_mix_quota(spark, sf_dir):
    r = C.ranked(manifest(spark, sf_dir), ["dataset"], "song", "q")
    return r.where(F.col("rn") <= F.when(F.col("dataset") == "src0", 10).otherwise(5)).select("song", "dataset")


@query("""select r_name, n_name, o_orderpriority, count(*) as n, round(sum(l_extendedprice*(1-l_discount)), 2) as revenue
from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey
where l_shipdate >= timestamp '1995-01-01' group by 1,2,3""")
def star_revenue(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    facts = t("lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp"))
    joined = facts.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = joined.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return named.groupBy("r_name", "n_name", "o_orderpriority").agg(F.count("*").alias("n"), revenue.alias("revenue"))
