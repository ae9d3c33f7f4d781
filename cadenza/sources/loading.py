"""Loading with checks: records that are broken or too large are counted and left out; chunks with metadata; lengths from
the ends of files."""

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATES = ("ok", "empty", "broken", "oversize")


def checked(records: DataFrame, content: str, schema: str, most: int, empty: str) -> DataFrame:
    """records with status and record: content, JSON text, read by schema.

    status is oversize if the text has more than most bytes, which are then not parsed; broken if it is null or no record
    of the schema; empty where the SQL condition `empty` on record holds; else ok. record is null unless ok.
    """
    kind = T.StructType.fromDDL(schema)
    wide = T.StructType([*kind.fields, T.StructField("_fault", T.StringType())])
    short = F.when(F.octet_length(content) <= most, F.col(content))
    read = records.withColumn("record", F.from_json(short, wide, {"columnNameOfCorruptRecord": "_fault"}))
    status = (
        F.when(F.octet_length(content) > most, "oversize")
        .when(F.col(content).isNull() | F.col("record").isNull() | F.col("record._fault").isNotNull(), "broken")
        .when(F.coalesce(F.expr(empty), F.lit(False)), "empty")
        .otherwise("ok")
    )
    marked = read.withColumn("status", status)
    return marked.withColumn("record", F.when(F.col("status") == "ok", F.col("record").dropFields("_fault")))


def counted(marked: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The records that are ok, and an observation with the number of each status and of bad records' share: its figures
    arrive with the first action on the rows, from the same pass."""
    seen = Observation(name)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATES]
    return marked.observe(seen, *counts, F.count(F.lit(1)).alias("all")).where("status = 'ok'").drop("status"), seen


def chunk_rows(spans: DataFrame, meta: DataFrame, song: str = "song", chunk: int = 24) -> DataFrame:
    """(song, chunk, cells, meta): what sounds in each chunk of steps, cut at its ends, as an array of (lane, pitch, from,
    until, velocity) by steps from the chunk's start. spans: (song, lane, pitch, start, stop, velocity); meta: (song, meta),
    a struct. A span has a row for each chunk that it reaches into; chunks without any have none."""
    first, last = F.floor(F.col("start") / chunk), F.floor((F.col("stop") - 1) / chunk)
    each = spans.where("start < stop").withColumn("chunk", F.explode(F.sequence(first, last)))
    at = F.col("chunk") * chunk
    cell = F.struct(
        "lane", "pitch", F.greatest(F.col("start") - at, F.lit(0)).cast("int").alias("from"),
        F.least(F.col("stop") - at, F.lit(chunk)).cast("int").alias("until"), "velocity",
    )
    return each.groupBy(song, "chunk").agg(F.array_sort(F.collect_list(cell)).alias("cells")).join(meta, song)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks of a song stand together, so that what a reader asks of metadata leaves out whole parts of files."""
    chunks.repartition(F.col("song")).sortWithinPartitions("song", "chunk").write.parquet(path)


def read_chunks(spark: SparkSession, path: str, where: str = "true", columns: list[str] | None = None) -> DataFrame:
    """Chunks that meet a condition, on metadata (meta.steps_per_bar = 96) or other columns. Of nested columns only the
    fields that are asked for are read, and plain comparisons of them are pushed to the files."""
    rows = spark.read.parquet(path).where(where)
    return rows.select(*columns) if columns else rows


def spans_of_chunks(chunks: DataFrame, chunk: int = 24) -> DataFrame:
    """The inverse of chunk_rows(): (song, lane, pitch, start, stop, velocity) in pieces of a chunk at most."""
    at = F.col("chunk") * chunk
    rows = chunks.select("song", "chunk", F.explode("cells").alias("c"))
    return rows.select("song", "c.lane", "c.pitch", (at + F.col("c.from")).alias("start"), (at + F.col("c.until")).alias("stop"), "c.velocity")


def footer_counts(spark: SparkSession, path: str, column: str, tasks: int = 64) -> DataFrame:
    """(path, rows, values): rows of each Parquet file below path and how many values its array column holds, from the
    file's footer alone; neither rows nor pages are read. Files are dealt to tasks by the hash of their path."""

    def look(frames):
        import pyarrow.parquet as pq
        from pyarrow import fs

        for pdf in frames:
            rows = []
            for name in pdf["path"]:
                where, own = fs.FileSystem.from_uri(name)
                with where.open_input_file(own) as f:
                    meta = pq.read_metadata(f)
                values = 0
                for k in range(meta.num_row_groups):
                    group = meta.row_group(k)
                    for c in (group.column(i) for i in range(group.num_columns)):
                        if c.path_in_schema.split(".")[0] == column:
                            # An empty or null array counts as a value that is null.
                            values += c.num_values - (c.statistics.null_count if c.statistics and c.statistics.has_null_count else 0)
                rows.append((name, meta.num_rows, values))
            yield pd.DataFrame(rows, columns=["path", "rows", "values"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.repartition(tasks, "path").mapInPandas(look, "path string, rows long, values long")
