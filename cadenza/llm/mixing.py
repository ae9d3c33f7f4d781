"""Mixing sources to target weights by pivotal dependent rounding."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table, words

#: Rows that one task settles together on average, residuals that meet in one task of the tree, salts of the join.
GROUP, FAN_IN, SALTS = 4096, 256, 16


def source_targets(sources: DataFrame, weights=(1, 2, 3), limit: float = 3.0) -> DataFrame:
    """sources (source, source_size, n) with rank, weight and target added.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes. A target above limit
    times its source's size stops there and the excess is shared again by weight. The end of that process is known:
    target = min(limit * size, level * weight) with the one level that gives the sum; it is read off the sources in
    order of limit * size / weight. One row a source is all that these windows see.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.get(cycle, F.col("rank") % len(weights))
    )
    before = Window.orderBy("_full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit * F.col("source_size")).over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("_full_at", limit * F.col("source_size") / F.col("weight")).withColumn("_level", level)
    # The small allowance keeps a source that is just full in spite of rounding.
    fits = F.col("_full_at") * (1 + 1e-12) >= F.col("_level")
    return levels.withColumn("_at", F.max(F.when(fits, F.col("_level"))).over(everything)).select(
        "source",
        "source_size",
        "n",
        F.least(limit * F.col("source_size"), F.coalesce(F.col("_at"), F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def pivot(sizes: np.ndarray, p: np.ndarray, rng) -> np.ndarray:
    """p with all but one entry at most moved to 0 or 1, so that sum(sizes * p) and the mean of each entry stay.

    Each entry, the largest first, is paired with all smaller ones together. Words move between it and them, either way,
    as far as it or one of them becomes integral; the chances are such that nobody gains on average, and each of the
    smaller ones changes by the same share of a copy, either way. Were it paired with one smaller entry at a time, that
    one would be settled and the largest entry left to the end. What is left is the smallest entry, unless a large one
    outweighs the others together.
    """
    out = p.copy()
    order = np.lexsort((np.arange(len(p)), -sizes))
    order = order[(p[order] > 0) & (p[order] < 1)]
    while len(order) > 1:
        first, pool = order[0], order[1:]
        size, x, q, total = sizes[first], out[first], out[pool], sizes[pool].sum()
        low, high = q.min(), q.max()
        up, down = min(size * (1 - x), total * low), min(size * x, total * (1 - high))
        move = up if rng.random() * (up + down) < down else -down
        x, q = x + move / size, q - move / total
        # Rounding leaves what has come to an end a hair beside it.
        q[q < 1e-9], q[q > 1 - 1e-9] = 0.0, 1.0
        out[first], out[pool] = (0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x), q
        order = order[(out[order] > 0) & (out[order] < 1)]
    return out


def rounded(sizes: np.ndarray, p: np.ndarray, wanted: float) -> np.ndarray:
    """p, of which one entry may be fractional, as 0s and 1s with sum(sizes * p) near wanted: the fractional one goes to the
    nearer side, then entries change sides, the largest first, and then two at a time, where that brings the sum nearer."""
    out = np.floor(p + 0.5)
    over = float(sizes @ out) - wanted
    for i in np.lexsort((np.arange(len(p)), -sizes)).tolist():
        change = sizes[i] if out[i] == 0 else -sizes[i]
        if abs(over + change) < abs(over) - 1e-9:
            out[i], over = 1 - out[i], over + change
    # One in for one out, where their sizes differ by what is missing.
    for _ in range(8):
        outside, inside = (np.flatnonzero(out == x) for x in (0, 1))
        if not len(outside) or not len(inside):
            break
        outside = outside[np.argsort(sizes[outside], kind="stable")]
        wish = sizes[inside] - over
        at = np.clip(np.searchsorted(sizes[outside], wish) + np.array([[-1], [0]]), 0, len(outside) - 1)
        miss = np.abs(sizes[outside][at] - wish)
        side, k = np.unravel_index(miss.argmin(), miss.shape)
        if miss[side, k] >= abs(over) - 1e-9:
            break
        i, j = outside[at[side, k]], inside[k]
        over += sizes[i] - sizes[j]
        out[i], out[j] = 1, 0
    return out


def _rng(*key):
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little"))


def round_copies(items: DataFrame, seed: int = 0, group: int = GROUP) -> DataFrame:
    """items (source, key, nokey, size, p, n) with p moved to 0 or 1; column copies instead of p and n.

    n is the number of the source's rows. Each source is cut by a hash of its rows into groups of about `group` rows;
    a group leaves one fractional row at most. These residuals meet in a tree, FAN_IN groups to a task, until one a
    source is left; rounded() settles it, and what that misses with the other rows of the last task. Randomness comes from seed, source, level and group alone, and
    rows are taken in the order of size and key, so that reruns agree.
    """
    groups = F.ceil(F.col("n") / group).cast("long")
    state = items.withColumn("cell", F.pmod(F.xxhash64(F.when(~F.col("nokey"), F.col("key")), "size", F.lit(seed)), groups))
    most = items.agg(F.max(F.ceil(F.col("n") / group))).first()[0] or 1
    schema = "source string, key long, nokey boolean, size long, p double, cell long"

    def settle(level: int, last: bool):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "nokey", "key"], ascending=[False, True, True], kind="stable")
            first = pdf.iloc[0]
            name = None if pd.isna(first["source"]) else first["source"]
            size, before = pdf["size"].to_numpy(float), pdf["p"].to_numpy(float)
            p = pivot(size, before, _rng(seed, name, level, int(first["cell"])))
            return pdf.assign(p=rounded(size, p, float(size @ before)) if last else p)[["source", "key", "nokey", "size", "p", "cell"]]

        return one

    done, level = None, 0
    while True:
        last = most <= 1
        state = cut(state.select("source", "key", "nokey", "size", "p", "cell").groupBy("source", "cell").applyInPandas(settle(level, last), schema))
        whole = state.where("p = 0 or p = 1").select("source", "key", "nokey", "size", F.col("p").cast("int").alias("copies"))
        done = whole if done is None else done.unionByName(whole)
        if last:
            return done
        state = state.where("p > 0 and p < 1").withColumn("cell", F.floor(F.col("cell") / FAN_IN).cast("long"))
        most, level = -(-most // FAN_IN), level + 1


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=(1, 2, 3), seed: int = 0) -> DataFrame:
    """One row for each row of docs: key, source, size, source_size, target, copies.

    Each source's words (size times copies) come to its target of source_targets() but for half of its smallest document.
    Every document has target / source_size copies on average, rounded up or down: 3 at most. Null texts have size 0
    and no copies, as do documents without words. Null sources are a source; repeated rows are taken one by one. Keys
    are integers; an empty table gives an empty one.
    """
    sizes = cut(
        # A null key is a number and a mark: pandas would turn a column with nulls into doubles.
        docs.select(
            F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("key"),
            F.col(key).isNull().alias("nokey"),
            F.col(source).alias("source"),
            F.size(words(F.col(text))).cast("long").alias("size"),
        )
    )
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sources).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # The salt spreads a source that holds a large part of all rows.
    salted = sizes.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    t = targets.select(F.col("source").alias("_source"), "salt", "source_size", "target", "n")
    joined = salted.join(t, (salted["source"].eqNullSafe(t["_source"])) & (salted["salt"] == t["salt"])).select(
        salted["source"], "key", "nokey", "size", "source_size", "target", "n"
    )
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(3.0))).otherwise(F.lit(0.0))
    rated = cut(joined.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("int")))
    items = rated.where("size > 0").select("source", "key", "nokey", "size", (F.col("rate") - F.col("base")).alias("p"), "n")
    rounded = round_copies(items, seed)
    # Rows of a source share rate and base, so they come back with the source; rows of equal key and size are alike.
    s = rated.groupBy("source").agg(*[F.first(c).alias(c) for c in ("source_size", "target", "base")])
    s = s.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "_source")
    r = rounded.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    taken = r.join(s, r["source"].eqNullSafe(s["_source"]) & (r["_salt"] == s["salt"])).select(
        "key", "nokey", "source", "size", "source_size", "target", (F.col("base") + F.col("copies")).cast("int").alias("copies")
    )
    empty = rated.where("size = 0").select("key", "nokey", "source", "size", "source_size", "target", F.lit(0).alias("copies"))
    named = F.when(~F.col("nokey"), F.col("key")).alias(key)
    return taken.unionByName(empty).select(named, "source", "size", "source_size", "target", "copies")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Documents without words are not taken; rows that repeat a
    doc_id are taken alike."""
    names = docs.columns
    copies = mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies"))
    taken = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_id")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*names)
