"""Marker-delimited sequences: blocks, labels, masks, runs; and order-dependent folds."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """Runs of equal labels: (by, run, label, first_at, length), first_at the first value of order[0]."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce((F.lag(label).over(w) != F.col(label)).cast("int"), F.lit(1))
    marked = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return marked.groupBy(*by, "run").agg(F.first(label).alias(label), F.min(order[0]).alias("first_at"), F.count("*").alias("length"))


def smoothed(labels: Column, lengths: Column, least: int) -> Column:
    """Labels of runs after runs shorter than least were replaced, from left to right, by the label on their right
    (the last run: on its left; null if it has neither). A run that was replaced is a left neighbour with its new label.

    What stands on the right is not replaced yet, so only the last run depends on a new label, that of the run before it:
    each label is told from its neighbours."""
    short = lambda i: F.get(lengths, i) < least

    def one(own, i):
        before = F.when(short(i - 1), own).otherwise(F.get(labels, i - 1))
        return F.when(short(i), F.coalesce(F.get(labels, i + 1), F.when(i > 0, before))).otherwise(own)

    return F.transform(labels, one)


def monophonic(onsets: Column) -> Column:
    """True if no two notes share an onset: onsets is the array of (bar, shift) of a part."""
    return F.size(F.array_distinct(onsets)) == F.size(onsets)


def direction(blocks: Column) -> Column:
    """Label of a block order such as [PAST, CONST, FUTURE], by the first place of each kind. The first rule that fits:
    music before META is analysis; then what stands before CONST decides; without CONST there is no target."""
    at = {x: F.nullif(F.array_position(blocks, x), F.lit(0)) for x in ("PAST", "CONST", "FUTURE", "META")}
    before = lambda x, y: F.coalesce(at[x] < at[y], F.lit(False))
    past, future = before("PAST", "CONST"), before("FUTURE", "CONST")
    return (
        F.when(before("PAST", "META") | before("CONST", "META") | before("FUTURE", "META"), "analysis")
        .when(past & future, "infill")
        .when(future, "anticipation")
        .when(past, "continuation")
        .when(before("META", "CONST"), "meta_gen")
        .when(at["CONST"].isNotNull(), "uncond")
        .otherwise("no_target")
    )


def spans(rows: DataFrame, by: list[str], order: str, kind: str, start: str, end: str) -> DataFrame:
    """Non-overlapping spans from a start marker to the next end marker; starts inside a span are not markers."""
    w = Window.partitionBy(*by).orderBy(order)
    ends = F.sum((F.col(kind) == end).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cells = rows.withColumn("_cell", F.coalesce(ends, F.lit(0)))
    found = cells.groupBy(*by, "_cell").agg(
        F.min(F.when(F.col(kind) == start, F.col(order))).alias("span_start"), F.max(F.when(F.col(kind) == end, F.col(order))).alias("span_end")
    )
    return found.where("span_start < span_end").drop("_cell")


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c of doubles, rounded once: what rounding takes from the product and from the sum is added again."""
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    named = lambda v, **new: F.struct(*[v[n].alias(n) for n in "abcps"], *[x.alias(n) for n, x in new.items()])
    upper = lambda v: v * 134217729.0 - (v * 134217729.0 - v)

    def rest(v):
        # Halves of 26 bits, whose products are exact.
        low_a, low_b, other = v["a"] - v["ah"], v["b"] - v["bh"], v["s"] - v["c"]
        of_product = ((v["ah"] * v["bh"] - v["p"]) + v["ah"] * low_b + low_a * v["bh"]) + low_a * low_b
        return v["s"] + (((v["c"] - (v["s"] - other)) + (v["p"] - other)) + of_product)

    given = F.struct(a.alias("a"), b.alias("b"), c.alias("c"), (a * b).alias("p"), (a * b + c).alias("s"))
    return bound(given, lambda v: bound(named(v, ah=upper(v["a"]), bh=upper(v["b"])), rest))


def slope(pairs: Column) -> Column:
    """Slope of the line through an array of (x, y) in order, as regr_slope(y, x) has it, to the last bit of its running
    sums with one rounding a step, so that thresholds part the same rows; null for less than two x. Pairs with a null
    mean nothing."""
    zero = {n: F.lit(0.0) for n in ("n", "x", "y", "xy", "xx")}

    def add(s, v):
        n = s["n"] + 1.0
        dx, x, y = v["x"] - s["x"], s["x"] + (v["x"] - s["x"]) / n, s["y"] + (v["y"] - s["y"]) / n
        both = {"n": n, "x": x, "y": y, "xy": fused(dx, v["y"] - y, s["xy"]), "xx": fused(v["x"] - x, dx, s["xx"])}
        return F.struct(*[c.alias(k) for k, c in both.items()])

    whole = F.filter(pairs, lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    of = lambda s: F.try_divide(s["xy"] / s["n"], s["xx"] / s["n"])
    return F.aggregate(whole, F.struct(*[c.alias(k) for k, c in zero.items()]), add, lambda s: F.when(s["n"] > 1, of(s)))


def fit_law(x, y, target, start=None, delta: float = 1e-3, rounds: int = 200):
    """(log A, log B, log E, a, b) of target = log(A e^(-a x) + B e^(-b y) + E), by Huber loss with this delta.

    Levenberg-Marquardt steps on weighted squares: a residual beyond delta weighs delta / |residual|, which makes the
    squares' minimum that of the Huber loss. The derivatives by the logarithms of the three terms are the terms' shares
    of their sum. Where these do not tell two terms apart, more damping does. It starts from start, or else from
    exponents of a coarse grid, with A, B and E by linear least squares.
    """
    import numpy as np

    def model(t):
        terms = np.stack([t[0] - t[3] * x, t[1] - t[4] * y, np.full_like(x, t[2])])
        top = terms.max(0)
        share = np.exp(terms - top)
        total = share.sum(0)
        share /= total
        return top + np.log(total), np.stack([*share, -x * share[0], -y * share[1]], 1)

    def loss(r):
        size = np.abs(r)
        return np.where(size <= delta, size * size / 2, delta * (size - delta / 2)).sum()

    def descend(t):
        value, slope = model(t)
        r, damp = target - value, 1e-3
        best = loss(r)
        for _ in range(rounds):
            weight = np.minimum(1.0, delta / np.maximum(np.abs(r), 1e-300))
            normal = (slope * weight[:, None]).T @ slope
            try:
                step = np.linalg.solve(normal + damp * np.diag(np.diag(normal) + 1e-9), (slope * weight[:, None]).T @ r)
            except np.linalg.LinAlgError:  # two terms are told apart by the damping alone, and it is too small for that
                damp *= 6
                continue
            new_value, new_slope = model(t + step)
            new = loss(target - new_value)
            if new < best:
                small = best - new <= 1e-12 * best
                t, r, slope, best, damp = t + step, target - new_value, new_slope, new, max(damp / 4, 1e-15)
                if small:
                    break
            else:
                damp *= 6
                if damp > 1e12:
                    break
        return t, best

    def begin(a, b):
        level = np.exp(target)
        terms = np.stack([np.exp(-a * x), np.exp(-b * y), np.ones_like(x)], 1)
        found = np.linalg.lstsq(terms / level[:, None], np.ones_like(x), rcond=None)[0]
        least = 1e-3 * level.min()
        return np.array([*np.log(np.maximum(found, [least] * 3)), a, b])

    grid = (0.1, 0.3, 0.6, 1.0)
    starts = [np.array(start, float)] if start is not None else [begin(a, b) for a in grid for b in grid]
    return min((descend(t) for t in starts), key=lambda f: f[1])[0]


def scaling_law(points: DataFrame, reps: int, most: int = 100_000) -> DataFrame:
    """One row: the fit of points (x, y, l) and the 2.5 and 97.5 percentiles of its exponents over resamples. points are the
    runs of an experiment, which every resample gets whole; more than `most` are an error, and without any all is null."""
    import numpy as np
    import pandas as pd

    rows = sorted(tuple(r) for r in points.select("x", "y", "l").limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"more than {most} points")
    held = np.array(rows, float).reshape(-1, 3)
    best = fit_law(*held.T) if rows else None

    def fits(frames):
        for pdf in frames:
            for rep in pdf["id"].tolist():
                whole = best
                if rep:
                    at = np.random.default_rng(rep).integers(0, len(held), len(held))
                    whole = fit_law(*held[at].T, start=best)
                yield pd.DataFrame([[rep, *whole]], columns=["rep", "la", "lb", "le", "a", "b"])

    tasks = points.sparkSession.range(0, reps + 1 if rows else 0, 1, min(reps + 1, 64))
    fitted = tasks.mapInPandas(fits, "rep long, la double, lb double, le double, a double, b double")
    first = lambda c: F.max(F.when(F.col("rep") == 0, c))
    ends = [F.round(F.percentile(F.when(F.col("rep") > 0, F.col(c)), F.lit(p)), 4).alias(f"{c}_{n}") for c in ("a", "b") for n, p in (("low", 0.025), ("high", 0.975))]
    return fitted.agg(*[F.round(first(F.exp(c)), 4).alias(n) for c, n in (("la", "scale_n"), ("lb", "scale_d"), ("le", "floor"))], *[F.round(first(F.col(c)), 4).alias(c) for c in ("a", "b")], *ends)
