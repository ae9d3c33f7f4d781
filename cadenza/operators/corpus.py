"""Corpus management: splits, leak-free joins, token budgets, allocation."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import split_of


def hashed(seed: str, column: str):
    return F.md5(F.concat(F.lit(seed), F.col(column).cast("string")))


def hash_split(manifest: DataFrame, song: str = "song") -> DataFrame:
    return manifest.withColumn("split", split_of(F.col(song).cast("string")))


def leak_free(manifest: DataFrame, held_out: DataFrame, song: str = "song") -> DataFrame:
    """Rows whose song is in no held-out row, in any transposition."""
    return manifest.join(held_out.select(song).distinct(), song, "left_anti")


def _digits(rows: DataFrame) -> int:
    """Hex digits of a hash that make 64 ranges or more for each task of a shuffle, so that ranges grow no larger than a
    part of what a task is given, however many rows there are."""
    n, digits = 64 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2
    while 16**digits < n and digits < 8:
        digits += 1
    return digits


def running_total(rows: DataFrame, order: str, tie: str, amount: str, rounds: str | None = None) -> DataFrame:
    """rows with cum: the sum of amount up to each row in the order of (rounds, order, tie). order: hex strings of equal
    length.

    Two passes, so that no task sees all rows: sums of the ranges by the first digits (of each round), running over these,
    a row each, then a window within each range.
    """
    ranged = rows.withColumns({"_range": F.substring(order, 1, _digits(rows)), "_round": F.col(rounds) if rounds else F.lit(0)})
    sums = ranged.groupBy("_round", "_range").agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy("_round", "_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_round", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_round", "_range").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(starts, ["_round", "_range"]).withColumn("cum", F.col("_before") + F.sum(amount).over(within))
    return out.drop("_round", "_range", "_before")


def budget_prefixes(manifest: DataFrame, budgets: list[int], seed: str = "", song: str = "song", tokens: str = "tokens") -> DataFrame:
    """Nested prefixes of a hash order: budget is the smallest of budgets that takes the row. The row that crosses a
    budget is still in it."""
    ordered = running_total(manifest.withColumn("_h", hashed(seed, song)), "_h", song, tokens)
    first = F.array_min(F.filter(F.array(*[F.lit(b).cast("long") for b in sorted(budgets)]), lambda b: F.col("cum") - F.col(tokens) < b))
    return ordered.withColumn("budget", first).where("budget is not null").drop("_h")


def repeat_to_target(pool: DataFrame, target: int, rounds: int, seed: str = "", song: str = "song", tokens: str = "tokens") -> DataFrame:
    """The pool in hash order, again and again (rounds times at most), until target tokens are reached."""
    copies = pool.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_h", hashed(seed, song))
    return running_total(copies, "_h", song, tokens, "round").where(F.col("cum") - F.col(tokens) < target).drop("_h")


def ranked(rows: DataFrame, by: list[str], key: str, seed: str = "") -> DataFrame:
    """rn: place of each row in the hash order of its group, from 1; n: the group's rows. Nulls of by are a group, too.

    Two passes, so that a large group is not ranked by one task: counts of ranges of the hash in each group, running
    within the group, then a window within each range.
    """
    keyed = rows.withColumn("_h", hashed(seed, key)).withColumn("_range", F.substring("_h", 1, _digits(rows)))
    counts = keyed.groupBy(*by, "_range").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    own = [F.col(c).alias(f"_by_{c}") for c in by]
    starts = counts.select(*own, F.col("_range").alias("_of"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(group).alias("n"))
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_h", key))
    match = F.col("_range") == F.col("_of")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = keyed.drop("n").withColumn("_place", place).join(starts, match)
    return out.withColumn("rn", F.col("_before") + F.col("_place")).drop("_h", "_range", "_of", "_place", "_before", *[f"_by_{c}" for c in by])


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with ordinal, their place from 1 in the order of a key of integers.

    Places come from counts of spans of 1,024 keys, and these from counts of spans of spans, so that no task sees more
    than a millionth of all rows, or a thousand of a kind.
    """
    small, large = F.expr(f"`{key}` div 1024"), F.expr(f"`{key}` div 1048576")
    counts = rows.groupBy(large.alias("_large"), small.alias("_small")).agg(F.count("*").alias("_c"))
    before = lambda w: F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_large = counts.groupBy("_large").agg(F.sum("_c").alias("_c")).select("_large", before(Window.orderBy("_large")).alias("_past"))
    starts = counts.withColumn("_start", before(Window.partitionBy("_large").orderBy("_small"))).join(of_large, "_large")
    placed = rows.withColumn("_small", small).withColumn("_place", F.row_number().over(Window.partitionBy("_small").orderBy(key)))
    found = placed.join(starts.select("_small", (F.col("_start") + F.col("_past")).alias("_start")), "_small")
    return found.withColumn("ordinal", F.col("_start") + F.col("_place")).drop("_small", "_place", "_start")


def stratified_split(rows: DataFrame, by: list[str], key: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    r = ranked(rows, by, key, "s")
    a, b = F.floor(F.col("n") * F.lit(train)), F.floor(F.col("n") * F.lit(val))
    return r.withColumn("split", F.when(F.col("rn") <= a, "train").when(F.col("rn") <= a + b, "val").otherwise("test"))


def k_folds(rows: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """fold of each row; fold f is tested in run f and validated in the run before."""
    return ranked(rows, by, key, "k").withColumn("fold", ((F.col("rn") - 1) % k).cast("int"))


def first_per_group(rows: DataFrame, by: list[str], key: str, most: int, seed: str = "") -> DataFrame:
    return ranked(rows, by, key, seed).where(F.col("rn") <= most)


def largest_remainder(groups: DataFrame, total: int, weight: str, order: str) -> DataFrame:
    """alloc: total dealt to the groups by weight; what is left over goes to the largest remainders, then weights, then order.
    One row a group, so one window over all of them."""
    everything = Window.partitionBy()
    exact = F.lit(float(total)) * F.col(weight) / F.sum(weight).over(everything)
    parts = groups.withColumn("_floor", F.floor(exact)).withColumn("_frac", exact - F.floor(exact))
    place = F.row_number().over(Window.orderBy(F.desc("_frac"), F.desc(weight), order))
    left = F.lit(total) - F.sum("_floor").over(everything)
    return parts.withColumn("alloc", (F.col("_floor") + (place <= left).cast("long")).cast("long")).drop("_floor", "_frac")


def with_default(left: DataFrame, right: DataFrame, on: str, column: str, default) -> DataFrame:
    """Left outer lookup; a missing value is default."""
    return left.join(right, on, "left").withColumn(column, F.coalesce(F.col(column), default))


def mixed_with_backfill(rows: DataFrame, by: list[str], role: str, key: str, size: str, shares: dict[str, tuple[int, int]], filler: str, seed: str = "") -> DataFrame:
    """(by, role, slot, rows' columns): a batch of `size` (a column, equal within by) places for each group. shares: the
    part of the batch, as a fraction, of each role but filler, which takes the rest.

    Roles are filled in the order of a hash of key. A role written with "!" in shares has each row once at most, and leaves
    the places that it is short of to filler; the others begin again when their rows are through. A role without rows
    leaves its places open.

    Quotas come from the counts of the roles by arithmetic; a row knows its places from its rank, so nothing is looped over.
    """
    once = {r.rstrip("!"): r.endswith("!") for r in shares}
    part = {r.rstrip("!"): x for r, x in shares.items()}
    r = ranked(rows, [*by, role], key, seed)
    counts = r.groupBy(*by).agg(*[F.max(F.when(F.col(role) == x, F.col("n"))).alias(f"_n_{x}") for x in part], F.max(size).alias("_size"))
    whole = {x: F.floor(F.col("_size") * a / b) for x, (a, b) in part.items()}
    have = {x: F.coalesce(f"_n_{x}", F.lit(0)) for x in part}
    taken = {x: F.least(q, have[x]) if once[x] else q for x, q in whole.items()}
    rest = F.col("_size") - sum(taken.values(), F.lit(0))
    quota = F.create_map(*[y for x, q in {**taken, filler: rest}.items() for y in (F.lit(x), q.cast("long"))])
    # One row a group; a group is found by its columns, be they null or not.
    told = counts.select(*[F.col(c).alias(f"_{c}") for c in by], quota.alias("_quota"))
    match = None
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        match = same if match is None else match & same
    q = F.col("_quota")[F.col(role)]
    placed = r.join(told, match).where(F.col("rn") <= q)
    slot = F.explode(F.sequence(F.col("rn") - 1, q - 1, F.col("n"))).alias("slot")
    return placed.select(*rows.columns, slot)
