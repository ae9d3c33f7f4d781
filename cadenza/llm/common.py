"""Shared pieces of the training-data operators: reading, cutting lineage, connected components."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one, on a local master
    only: elsewhere each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df with its lineage cut by a Parquet table in the same folder: smaller than a checkpoint, and of known size."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound(df: DataFrame, columns: dict) -> DataFrame:
    """df with the columns added or replaced, each computed once a row.

    They come out of a generator of one row, which no filter is pushed through and no later projection is folded into;
    withColumns() would let the optimizer copy a costly expression into every place that reads it.
    """
    made = df.select("*", F.inline(F.array(F.struct(*[c.alias(f"_bound_{k}") for k, c in enumerate(columns.values())]))))
    return made.select(*[x for x in df.columns if x not in columns], *[F.col(f"_bound_{k}").alias(n) for k, n in enumerate(columns)])


def words(text) -> F.Column:
    """The words of a text, as an array of strings; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of edges.

    edges: (a, b), undirected, nodes comparable; self loops, repeats and nulls are allowed and mean nothing.
    Returns (node, component) for each node that has an edge to another node; an empty table gives an empty one.

    Alternating large-star and small-star rounds: each round is two aggregations and two joins on the edge table, and
    the table never grows. No link reaches the driver, only a count and a checksum of each round.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        # e: (a, b) with a > b. Each node moves its neighbours to the smallest of them and itself.
        if large:
            near = e.union(e.select("b", "a"))
            least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            moved = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            return moved.where("a <> b").distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(e)
    for _ in range(rounds):
        e = cut(star(star(e, True), False))
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(e.select("b", "b")).distinct()
