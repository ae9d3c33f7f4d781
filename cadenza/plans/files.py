"""Queries that write files to the shared folder and read them back: listings, indices, manifests, captions, samples, packs."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import md5_mod
from ..sources import tables as S
from ..sources.tables import SQL_MANIFEST, SQL_MOD, manifest, table
from .registry import query
from .samples import SQL_PARTS, parts, text

SQL_FILES = f"{SQL_MANIFEST}, f as (select song, tokens, dataset, label, shard, dataset||'/'||song||case when song%3=0 then '.MID' when song%3=1 then '.mid' else '.txt' end as path from manifest)"


def _folder(spark) -> str:
    return f"{S.shared_folder(spark)}/files-{uuid.uuid4()}"


def _files(spark, sf_dir):
    ending = F.element_at(F.array(F.lit(".MID"), F.lit(".mid"), F.lit(".txt")), (F.col("song") % 3 + 1).cast("int"))
    return manifest(spark, sf_dir).withColumn("path", F.concat("dataset", F.lit("/"), F.col("song").cast("string"), ending))


@query("select d.source, count(*) as files from documents d group by 1")
def file_scan(spark, sf_dir):
    """Files below a folder by their suffix, in either case; the contents are not read. Each document is a file."""
    root = _folder(spark)
    # In hexadecimals, so that null, empty and odd names are told apart and come back as they were.
    name = F.concat(F.lit("x"), F.hex("source")).alias("source")
    docs = table(spark, sf_dir, "documents").select(name, F.col("doc_id").cast("string").alias("value"))
    # Each task writes to folders of its own, which are moved into place whole.
    dealt = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("part", F.spark_partition_id())
    dealt.write.partitionBy("source", "part").option("maxRecordsPerFile", 1).text(root)
    found = S.read_files(spark, root, ".TXT".lower()).groupBy(F.regexp_extract("path", "source=(x[^/]*)/", 1).alias("x")).agg(F.count("*").alias("files"))
    return found.select(F.when(F.col("x") != "", F.unhex(F.expr("substring(x, 2)")).cast("string")).alias("source"), "files")


@query(f"with {SQL_FILES} select song, path from f where lower(path) like '%.mid' and dataset in ('src1','src2')")
def allowed_files(spark, sf_dir):
    """Files of a listing with the right suffix whose folder is on a list, read back from a JSON index."""
    root = _folder(spark)
    S.write_index(_files(spark, sf_dir), root)
    allow = spark.createDataFrame([("src1",), ("src2",)], "dataset string")
    f = S.read_index(spark, root).where(F.lower("path").endswith(".mid")).withColumn("dataset", F.substring_index("path", "/", 1))
    return f.join(F.broadcast(allow), "dataset", "left_semi").select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("song"), "path")


@query(f"with {SQL_FILES} select dataset, count(*) as files, min(path) as first_, max(path) as last_ from f group by 1")
def index_scan(spark, sf_dir):
    """A nested JSON index, one list for each folder, flattened."""
    root = _folder(spark)
    # A folder's list goes on in further files after some thousand paths.
    part = F.pmod(F.xxhash64("path"), F.ceil(F.count("*").over(Window.partitionBy("dataset")) / 5000)).alias("part")
    nested = _files(spark, sf_dir).select("dataset", "path", part).groupBy("dataset", "part").agg(F.to_json(F.array(F.sort_array(F.collect_list("path")))).alias("value")).select("value")
    nested.write.option("maxRecordsPerFile", 1).text(root)
    f = S.read_index(spark, root).withColumn("dataset", F.substring_index("path", "/", 1))
    return f.groupBy("dataset").agg(F.count("*").alias("files"), F.min("path").alias("first_"), F.max("path").alias("last_"))


@query(f"with {SQL_FILES} select dataset_id, dataset, count(*) as files from (select *, dense_rank() over (order by dataset) - 1 as dataset_id from f) x group by 1,2")
def multi_source_scan(spark, sf_dir):
    """Several folders read one after the other, each with its number."""
    root, out = _folder(spark), None
    names = sorted(r["dataset"] for r in manifest(spark, sf_dir).select("dataset").distinct().collect())
    _files(spark, sf_dir).select("dataset", "path").write.partitionBy("dataset").parquet(root)
    for k, name in enumerate(names):
        one = spark.read.schema("path string").parquet(f"{root}/dataset={name}").select(F.lit(k).cast("long").alias("dataset_id"), F.lit(name).alias("dataset"), "path")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("dataset_id", "dataset").agg(F.count("*").alias("files"))


@query(f"with {SQL_FILES} select path as missing from f where song % 50 = 0")
def missing_files(spark, sf_dir):
    """Paths of an index that are not in the listing."""
    root = _folder(spark)
    f = _files(spark, sf_dir)
    S.write_index(f, root)
    return S.read_index(spark, root).join(f.where("song % 50 <> 0").select("path"), "path", "left_anti").select(F.col("path").alias("missing"))


SQL_CAPTIONS = """cap as (select doc_id, 'midi/'||source||'/'||doc_id||'.npz' as location, lang as genre, case when doc_id%5=0 then '' else 'C major' end as key, case when doc_id%7=0 then null else 60e0+doc_id%100 end as tempo, doc_id%20 as n, doc_id%11=0 as gap from documents where doc_id%13 <> 0)"""


def _captions(spark, sf_dir):
    """Captions written as JSON lines, a thirteenth of them broken, and read again."""
    root, d = _folder(spark), F.col("doc_id")
    chords = F.transform(F.sequence(F.lit(1), (d % 20 + 1).cast("int")), lambda k: F.when((k == 1) & (d % 11 == 0), "N").otherwise("C"))
    one = F.to_json(
        F.struct(
            F.concat(F.lit("midi/"), "source", F.lit("/"), d.cast("string"), F.lit(".npz")).alias("location"), F.array("lang").alias("genre"),
            F.when(d % 5 == 0, "").otherwise("C major").alias("key"), F.when(d % 7 != 0, 60.0 + d % 100).alias("tempo"), F.slice(chords, F.lit(1), (d % 20).cast("int")).alias("all_chords"),
        )
    )
    table(spark, sf_dir, "documents").select(F.when(d % 13 == 0, F.lit('{"location": ')).otherwise(one).alias("value")).write.text(root)
    return S.read_captions(spark, root)


@query(f"with {SQL_CAPTIONS} select genre, count(*) as n from cap group by 1")
def caption_scan(spark, sf_dir):
    """Genres of JSON lines; broken lines are skipped."""
    c = _captions(spark, sf_dir)
    return c.select(F.explode("genre").alias("genre")).groupBy("genre").agg(F.count("*").alias("n"))


@query(f"with {SQL_CAPTIONS} select location, doc_id as n_file from cap where key <> '' and tempo is not null and n > 10 and not gap")
def caption_filter(spark, sf_dir):
    """Captions with a key, a tempo, and over ten chords, none of them unknown; with the name of the file in their path."""
    ok = (F.col("key") != "") & F.col("tempo").isNotNull() & (F.size("all_chords") > 10) & ~F.array_contains("all_chords", "N")
    name = F.regexp_extract(F.substring_index("location", "/", -1), r"^(\d+)\.", 1)
    return _captions(spark, sf_dir).where(ok).select("location", name.cast("long").alias("n_file"))


@query(f"with {SQL_CAPTIONS} select split_part(location, '/', 2) as folder, count(*) as files from cap where location like '%.npz' group by 1")
def nested_path_filter(spark, sf_dir):
    """Paths of nested JSON whose suffix and folders fit."""
    c = _captions(spark, sf_dir).where(F.col("location").endswith(".npz") & F.array_contains(F.split("location", "/"), "midi"))
    return c.groupBy(F.get(F.split("location", "/"), 1).alias("folder")).agg(F.count("*").alias("files"))


@query("select source as name, case count(*) % 3 when 0 then 'train' when 1 then 'validation' else 'test' end as split from documents group by 1")
def columnar_json_splits(spark, sf_dir):
    """A JSON object of columns, each a map of row to value, as rows of name and split."""
    root = _folder(spark)
    s = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.count("*") % 3 + 1).cast("int")).alias("split"))
    numbered = s.withColumn("i", (F.row_number().over(Window.orderBy("name")) - 1).cast("string"))
    column = lambda c: F.map_from_entries(F.collect_list(F.struct("i", c)))
    numbered.agg(F.to_json(F.struct(column("name").alias("name"), column("split").alias("split"))).alias("value")).write.text(root)
    m = spark.read.text(root, wholetext=True).select(F.from_json("value", "struct<name: map<string, string>, split: map<string, string>>").alias("m"))
    names, splits = (m.select(F.explode(f"m.{c}").alias("i", c)) for c in ("name", "split"))
    return names.join(splits, "i").select("name", "split")


@query("select d.doc_id, case d.doc_id % 10 when 9 then 'test' when 8 then 'val' else 'train' end as split from documents d where d.doc_id % 4 <> 3")
def official_split(spark, sf_dir):
    """A split that comes as CSV, joined to the files that are there."""
    root, d = _folder(spark), F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    docs.where("doc_id % 4 <> 3").select(d.alias("id"), F.when(d % 10 == 9, "test").when(d % 10 == 8, "val").otherwise("train").alias("split")).write.option("header", True).csv(root)
    s = spark.read.option("header", True).schema("id long, split string").csv(root)
    return docs.join(s, docs["doc_id"] == s["id"]).select("doc_id", "split")


@query(f"with {SQL_MANIFEST} select shard, count(*) as files, cast(sum(tokens) as bigint) as tokens from manifest group by 1")
def manifest_scan(spark, sf_dir):
    """Tab-separated shards, written once: a second write of the same shards is left out."""
    root = _folder(spark)
    m = manifest(spark, sf_dir).select(F.col("song").cast("string").alias("path"), F.col("song").cast("string"), F.lit(0).alias("shift"), "tokens", "shard")
    for _ in range(2):
        m.write.mode("ignore").partitionBy("shard").option("sep", "\t").csv(root)
    found = S.read_manifest(spark, root)
    return found.groupBy("shard").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"))


@query(f"with {SQL_PARTS}, q as (select song, win, inst, len(string_split(seq, ' ')) as n from parts where role='const') select ({SQL_MOD.format(x='cast(song as varchar)', n=16)}) as shard, count(*) as sequences, cast(sum(n) as bigint) as tokens from q where n > 8 and n < 60 group by 1")
def sample_shards(spark, sf_dir):
    """Sequences written in 16 folders by a hash of the song and read back with a limit on both sides of their length."""
    root = _folder(spark)
    p = parts(spark, sf_dir).where("role = 'const'").select("song", F.col("window").alias("win"), "inst", F.col("seq").alias("tokens"))
    S.write_samples(p, root)
    s = S.read_samples(spark, root, 8, 60)
    return s.groupBy(md5_mod(F.col("song").cast("string"), 16).alias("shard")).agg(F.count("*").alias("sequences"), F.sum(F.size("tokens")).alias("tokens"))


@query(f"with {SQL_PARTS}, q as (select song, win, inst, len(string_split(seq, ' ')) as n from parts where role='const') select cast(sum(n) as bigint) as tokens, count(*) as sequences from q")
def token_count_of_files(spark, sf_dir):
    """Tokens of files from a column of lengths: the tokens themselves are not read."""
    root = _folder(spark)
    p = parts(spark, sf_dir).where("role = 'const'").select("song", "inst", "seq", F.size("seq").alias("n"))
    p.write.parquet(root)
    return spark.read.schema("n int").parquet(root).agg(F.sum("n").alias("tokens"), F.count("*").alias("sequences"))


@query(f"with {SQL_PARTS} select song, string_agg(seq, ' ' order by win, inst) as packed, count(*) as parts from parts where role='const' group by 1")
def packed_songs(spark, sf_dir):
    """Many sequences of a song in one row, written and read again."""
    root = _folder(spark)
    own = F.array_sort(F.collect_list(F.struct("window", "inst", "seq")))
    parts(spark, sf_dir).where("role = 'const'").groupBy("song").agg(F.transform(own, lambda x: x["seq"]).alias("seqs")).write.parquet(root)
    s = spark.read.schema("song long, seqs array<array<int>>").parquet(root)
    return s.select("song", text(F.flatten("seqs"), "packed"), F.size("seqs").cast("long").alias("parts"))


@query("select event_type as kind, count(*) as n, row_number() over (order by event_type < 'm', event_type) as id from events group by 1")
def vocabulary_append(spark, sf_dir):
    """A vocabulary that is saved, read and extended: known names keep their ids, new ones follow."""
    root = _folder(spark)
    kinds = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    known = kinds.where("kind >= 'm'").withColumn("id", F.row_number().over(Window.orderBy("kind")))
    known.select("kind", "id").write.json(root)
    old = spark.read.schema("kind string, id int").json(root)
    top = old.agg(F.max("id").alias("top"))
    new = kinds.join(old, "kind", "left_anti").crossJoin(F.broadcast(top)).select("kind", (F.col("top") + F.row_number().over(Window.orderBy("kind"))).alias("id"))
    return kinds.join(old.unionByName(new), "kind").select("kind", "n", F.col("id").cast("long").alias("id"))


@query("""with n as (select user_id as track, event_id, cast(floor(epoch(ts)) as bigint) as a, cast(floor(epoch(ts)) as bigint)+1+cast(floor(value) as bigint) as b, cast(json_extract_string(props,'$.k') as integer) as pitch from events), m as (select track, a as tick, 1 as is_on, pitch, event_id from n union all select track, b, 0, pitch, event_id from n)
select track, tick, is_on, pitch, event_id, tick - coalesce(lag(tick) over (partition by track order by tick, is_on, pitch, event_id), tick) as delta from m""")
def midi_messages(spark, sf_dir):
    """Messages of a file in order: at equal ticks ends come before starts, then by pitch; with the ticks since the last one."""
    start = F.unix_timestamp("ts")
    n = table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), "event_id", start.alias("a"), (start + 1 + F.floor("value")).alias("b"), F.get_json_object("props", "$.k").cast("int").alias("pitch"))
    each = F.explode(F.array(F.struct(F.col("a").alias("tick"), F.lit(1).alias("is_on")), F.struct(F.col("b").alias("tick"), F.lit(0).alias("is_on")))).alias("m")
    m = n.select("track", "pitch", "event_id", each).select("track", "m.tick", "m.is_on", "pitch", "event_id")
    w = Window.partitionBy("track").orderBy("tick", "is_on", "pitch", "event_id")
    return m.withColumn("delta", F.col("tick") - F.coalesce(F.lag("tick").over(w), F.col("tick")))
