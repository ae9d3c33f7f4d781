"""Readers, and the views in which the test tables stand for manifests, notes, sequences and predictions."""

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, md5_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated manifest shards: path, song, shift, tokens."""
    return spark.read.csv(path, sep="\t", schema="path string, song string, shift int, tokens long")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """JSON index: an array of paths, or an array of such arrays."""
    text = spark.read.text(path, wholetext=True)
    nested = F.from_json("value", "array<array<string>>", {"mode": "PERMISSIVE"})
    flat = F.from_json("value", "array<string>")
    paths = F.when(F.ltrim(F.substring(F.ltrim("value"), 2, 100000000)).startswith("["), F.flatten(nested)).otherwise(flat)
    return text.select(F.explode(paths).alias("path"))


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of captions; malformed lines are left out."""
    schema = "location string, genre array<string>, key string, tempo double, all_chords array<string>, all_chords_timestamps array<double>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_files(spark: SparkSession, root: str, suffix: str = ".mid") -> DataFrame:
    """(path, length) of the files below root whose names hold suffix in either case; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.where(F.lower("path").contains(suffix)).select("path", "length")


def read_samples(spark: SparkSession, path: str, least: int, most: int) -> DataFrame:
    """Sequences with least < length < most."""
    return spark.read.parquet(path).where((F.size("tokens") > least) & (F.size("tokens") < most))


def write_index(files: DataFrame, path: str) -> None:
    """A JSON index of the paths, an array a file of at most 10,000."""
    one = files.select("path").withColumn("g", F.floor(F.monotonically_increasing_id() / 10_000))
    one.groupBy("g").agg(F.to_json(F.collect_list("path")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one, on a local master only."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-")


def write_samples(samples: DataFrame, path: str) -> None:
    """Sequences in 16 folders by the first hex digit of the song's MD5."""
    samples.withColumn("shard", F.substring(F.md5(F.col("song").cast("string")), 1, 1)).write.partitionBy("shard").parquet(path)


def manifest(spark, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("song"), F.col("n_chars").alias("tokens"), F.substring(F.md5(key), 1, 1).alias("shard"),
        F.col("source").alias("dataset"), F.col("lang").alias("label"),
    )


def notes(spark, sf_dir: str) -> DataFrame:
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("song"),
        F.col("event_type").alias("program"),
        "event_id",
        "ts",
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("measure"),
        F.floor(second * 96 / 86400).cast("int").alias("shift"),
        (F.get_json_object("props", "$.k").cast("int") + 14).alias("pitch"),
        clamp(F.floor("value").cast("int"), 1, 288).alias("dur"),
    )


def note_order() -> list:
    return ["measure", "shift", "pitch", "dur", "event_id"]


def sequences(spark, sf_dir: str) -> DataFrame:
    """(song, program, tokens): bars from the first to the last with notes, and the end token."""
    from ..operators.notes import notes_to_tokens

    return notes_to_tokens(notes(spark, sf_dir), ["song", "program"])


def predictions(spark, sf_dir: str) -> DataFrame:
    """(doc_id, source, gold, pred, score): labels with a pseudo-score that is a hash of the document's id."""
    score = md5_mod(F.concat(F.lit("p"), F.col("doc_id").cast("string")), 1000) / F.lit(1000.0)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return (
        table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .select("doc_id", "source", "lang", F.col("quality").alias("gold"), score.alias("score"))
        .withColumn("pred", (F.col("score") >= 0.3).cast("int"))
    )


#: DuckDB forms of the views.
def _sql_mod() -> str:
    part = lambda k: "cast('0x'||substr(md5({x})," + str(8 * k + 1) + ",8) as bigint)"
    folded = f"({part(0)} % {{n}})"
    for k in (1, 2, 3):
        folded = f"(({folded} * 4294967296 + {part(k)}) % {{n}})"
    return folded


SQL_MOD = _sql_mod()
SQL_NOTES = """notes as (select user_id as song, event_type as program, event_id, ts,
 date_diff('day', date '2024-01-01', cast(ts as date)) as measure,
 cast(floor((extract(hour from ts)*3600 + extract(minute from ts)*60 + floor(extract(second from ts)))*96/86400) as integer) as shift,
 cast(json_extract_string(props,'$.k') as integer) + 14 as pitch,
 greatest(1, least(288, cast(floor(value) as integer))) as dur from events)"""
SQL_MANIFEST = """manifest as (select doc_id as song, n_chars as tokens, substr(md5(cast(doc_id as varchar)),1,1) as shard,
 source as dataset, lang as label from documents)"""
SQL_PREDS = f"""preds as (select l.doc_id, d.source, d.lang, l.quality as gold, ({SQL_MOD.format(x="'p'||cast(l.doc_id as varchar)", n=1000)})/1000e0 as score
 from labels l join documents d on l.doc_id = d.doc_id), p as (select *, case when score >= 0.3e0 then 1 else 0 end as pred from preds)"""
