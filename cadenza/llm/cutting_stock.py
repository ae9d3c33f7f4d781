"""Packing by cutting stock: patterns of lengths from a linear program with priced columns, filled by ranked documents.

The driver sees nothing but a histogram of lengths, whose size is fixed. Documents are ranked within their length and
take the places that the patterns have for it by arithmetic on the rank, so no task needs more than its own rows.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written
from .packing import best_fit, token_pieces

#: Rows of a length that are ranked together on average, what a cut costs in sequences, how near to the bound is enough.
BUCKET, CUT_COST, GAP = 50_000, 0.02, 0.001


def length_classes(capacity: int) -> np.ndarray:
    """Upper ends of the classes of lengths: every length up to 256, then wider by a 128th of the length."""
    ends = [0]
    while ends[-1] < capacity:
        ends.append(min(capacity, ends[-1] + max(1, ends[-1] >> 7)))
    return np.array(ends[1:], np.int64)


def price(values: np.ndarray, sizes: np.ndarray, capacity: int, most: int = 64) -> tuple[float, list[dict[int, int]]]:
    """The greatest total value of a pattern within capacity, and patterns {class: count} of more than 1: for each class
    the best one that has it, those of the greatest value first.

    Knapsack by dynamic programming: the best value of exactly c tokens is the best of those of c - size with one more."""
    use = np.flatnonzero(values > 0)
    size, value = sizes[use], values[use]
    upto = np.searchsorted(size, np.arange(capacity + 1), "right").tolist()
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            total = best[c - size[:n]] + value[:n]
            k = total.argmax()
            if total[k] > best[c] + 1e-12:
                best[c], last[c] = total[k], k
    having = value + best[capacity - size]
    found = []
    for k in np.argsort(-having, kind="stable")[:most].tolist():
        if having[k] <= 1 + 1e-6:
            break
        pattern, c = {int(use[k]): 1}, int(capacity - size[k])
        while c > 0:
            if last[c] < 0:
                c -= 1
                continue
            u = int(use[last[c]])
            pattern[u] = pattern.get(u, 0) + 1
            c -= int(sizes[u])
        found.append(pattern)
    # The same pattern comes out for each of its classes.
    return float(best[capacity]), list({tuple(sorted(p.items())): p for p in found}.values())


def greedy(counts: np.ndarray, sizes: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Patterns that longest first uses for these counts."""
    left, found = counts.copy(), []
    while (some := np.flatnonzero(left)).size:
        room, pattern = capacity, {}
        for u in some[::-1].tolist():
            if sizes[u] <= room:
                k = int(min(left[u], room // sizes[u]))
                pattern[u] = k
                room -= k * int(sizes[u])
        times = min(int(left[u]) // k for u, k in pattern.items())
        for u, k in pattern.items():
            left[u] -= times * k
        found.append(pattern)
    return found


def solve(counts: np.ndarray, sizes: np.ndarray, capacity: int, rounds: int = 80) -> list[tuple[dict[int, int], float]]:
    """The linear program: columns {class: count} and how often each is used, so that every class is used counts times.

    A column is a pattern, at the cost of one sequence, or a cut, {class: 1, part: -1, other part: -1}, at CUT_COST: one
    item less of a class and one more of two others. Revised simplex method; columns are made as they are needed, by
    price() and by comparing each class with the sums of two others, until what the duals prove is within GAP, or after
    so many rounds. Classes without items are there if they fill up a sequence or are left over from that.
    """
    have = sizes[counts > 0]
    fill = capacity - have[have < capacity]
    over = (have[:, None] - fill[None, :]).ravel() if len(have) else fill
    rows = np.unique(np.concatenate([np.flatnonzero(counts), np.searchsorted(sizes, np.concatenate([fill, over[over > 0]]))]))
    d, size, m = counts[rows].astype(float), sizes[rows], len(rows)
    if not m:
        return []
    # A little more than asked for, so that no step has length 0.
    d += 1e-4 * (1 + np.arange(m) % 7)
    basis = [{u: int(capacity // size[u])} for u in range(m)]
    cost = np.ones(m)
    inverse = np.diag(1.0 / (capacity // size))
    x = inverse @ d
    rest = size[:, None] - size[None, :]
    # Lengths round up: what is left of the class's longest item.
    other = np.searchsorted(size, sizes[np.searchsorted(sizes, np.maximum(rest, 1))])
    lower = (rest > 0) & (size[np.minimum(other, m - 1)] >= rest) & (other < m)
    other = np.minimum(other, m - 1)
    held, price_of, columns = np.zeros((0, m)), np.zeros(0), []

    def add(made, c):
        nonlocal held, price_of
        new = np.zeros((len(made), m))
        for k, col in enumerate(made):
            for u, n in col.items():
                new[k, u] += n
        held, price_of = np.vstack([held, new]), np.append(price_of, np.full(len(made), c))
        columns.extend(made)

    add(greedy(counts[rows], size, capacity), 1.0)
    for _ in range(rounds):
        duals = cost @ inverse
        while len(columns):
            gain = held @ duals - price_of
            k = int(gain.argmax())
            if gain[k] <= 1e-7:
                break
            way = inverse @ held[k]
            can = way > 1e-9
            if not can.any():
                break
            step = np.full(m, np.inf)
            step[can] = x[can] / way[can]
            r = int(step.argmin())
            least = step[r]
            x -= least * way
            x[r] = least
            np.maximum(x, 0, out=x)
            row = inverse[r] / way[r]
            way[r] -= 1
            inverse -= way[:, None] * row
            basis[r], cost[r] = columns[k], price_of[k]
            duals = cost @ inverse
        most, made = price(duals, size, capacity)
        saved = np.where(lower, duals[:, None] - duals[None, :] - duals[other], -np.inf)
        # Scaled down until no column gains, the duals prove a bound.
        scale = max(1.0, most, float(saved.max()) / CUT_COST)
        if cost @ x <= (1 + GAP) * max(duals @ d / scale, d @ size / capacity):
            break
        cuts = []
        for u in np.argsort(-saved.max(1), kind="stable")[:16].tolist():
            a = int(saved[u].argmax())
            if saved[u, a] > CUT_COST + 1e-6:
                col = {u: 1}
                for part in (a, int(other[u, a])):
                    col[part] = col.get(part, 0) - 1
                cuts.append(col)
        if not made and not cuts:
            break
        if len(columns) > 4 * m:
            keep = np.argsort(-(held @ duals - price_of), kind="stable")[: 2 * m]
            held, price_of, columns = held[keep], price_of[keep], [columns[k] for k in keep.tolist()]
        add(made, 1.0)
        add(cuts, CUT_COST)
    return [({int(rows[u]): n for u, n in b.items()}, float(t)) for b, t in zip(basis, x) if t > 1e-6]


def plan(counts: np.ndarray, sizes: np.ndarray, capacity: int):
    """Patterns with whole numbers of sequences, [(pattern, times)], and cuts, [(class, part, other part, times)].

    The program's numbers are rounded down; then patterns are used once more while their items last, those rounded down
    furthest first; what is left, less than a sequence for each column, is packed by best fit.
    """
    found = solve(counts, sizes, capacity)
    left, cuts, patterns = counts.copy(), [], []
    for col, t in found:
        if any(n < 0 for n in col.values()):
            (u,) = [k for k, n in col.items() if n > 0]
            parts = [k for k, n in col.items() if n < 0 for _ in range(-n)]
            n = min(int(t + 1e-3), int(left[u]))
            if n:
                cuts.append((u, *parts, n))
                left[u] -= n
    # Only items of the table are cut, no parts.
    for _, a, b, n in cuts:
        left[a] += n
        left[b] += n
    whole = [(col, t) for col, t in found if all(n > 0 for n in col.values())]
    times = []
    for more in (False, True):
        for k in sorted(range(len(whole)), key=lambda k: (-(whole[k][1] % 1), k)) if more else range(len(whole)):
            col, t = whole[k]
            most = min(int(left[u]) // n for u, n in col.items())
            n = min(most, 1 if more else int(t + 1e-3))
            for u, each in col.items():
                left[u] -= n * each
            times.append((col, n))
    patterns = [(col, n) for col, n in times if n]
    rest = np.repeat(np.arange(len(sizes)), left)
    bins, _, _ = best_fit(sizes[rest], capacity)
    for b in range(bins.max(initial=-1) + 1):
        own, n = np.unique(rest[bins == b], return_counts=True)
        patterns.append((dict(zip(own.tolist(), n.tolist())), 1))
    return patterns, cuts


def intervals(patterns, m: int):
    """For each class the ranks at which its patterns begin: arrays (class, first rank, items a sequence, first sequence,
    first slot of it), by class and rank. Ranks of a class count through its patterns without a gap."""
    rows, used, sequence = [], np.zeros(m, np.int64), 0
    for pattern, times in patterns:
        slot = 0
        for u in sorted(pattern, reverse=True):
            rows.append((u, used[u], pattern[u], sequence, slot))
            used[u] += times * pattern[u]
            slot += pattern[u]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def pack_stock(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces, (row, start, length, ...) with cuts and places: start and length are the part's, whole is false for the
    parts of a piece that was cut in two, sequence_id and offset are added. Other columns are the piece's.

    row names a piece and is unique; pieces give the same rows whenever they are read. Lengths are 1 to capacity; those
    of capacity are sequences by themselves. An empty table gives an empty one.
    """
    sizes = length_classes(capacity)
    names = pieces.columns
    hist = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(len(sizes), np.int64)
    for r in hist:
        if r["length"] < capacity:
            counts[np.searchsorted(sizes, r["length"])] += r["n"]
    patterns, cuts = plan(counts, sizes, capacity)
    places, sequences = intervals(patterns, len(sizes))

    # The first ranks of a class are cut; parts stand behind the other items of their class.
    cut_from = np.zeros(len(sizes), np.int64)
    for u, _, _, n in cuts:
        cut_from[u] += n
    behind, seen, rows = counts - cut_from, np.zeros(len(sizes), np.int64), []
    for u, a, b, n in sorted(cuts):
        of_part = []
        for part in (a, b):
            of_part.append(behind[part])
            behind[part] += n
        rows.append((u, seen[u], a, b, *of_part))
        seen[u] += n
    cut_rows = np.array(rows, np.int64).reshape(-1, 6)

    # Ranks in two passes: counts of buckets, then rows within a bucket, so that a frequent length is dealt to many.
    buckets = int(counts.sum()) // BUCKET + 1
    ends = F.array(*[F.lit(int(x)) for x in sizes])
    short = pieces.where(F.col("length") < capacity).withColumn("_class", F.size(F.filter(ends, lambda e: e < F.col("length"))).cast("long"))
    dealt = short.withColumn("_bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    before = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    upto = dealt.groupBy("_class", "_bucket").agg(F.count("*").alias("n")).select("_class", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_upto"))
    at = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy("row"))
    ranked = dealt.join(upto, ["_class", "_bucket"]).select(*names, "_class", (F.col("_upto") + at - 1).cast("long").alias("_rank"))
    wide = 1 << 40

    def placed(batches):
        for batch in batches:
            start, length, u, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("start", "length", "_class", "_rank"))
            keep, split = np.flatnonzero(rank >= cut_from[u]), np.flatnonzero(rank < cut_from[u])
            j = np.searchsorted(cut_rows[:, 0] * wide + cut_rows[:, 1], u[split] * wide + rank[split], "right") - 1
            nth, first = rank[split] - cut_rows[j, 1], sizes[cut_rows[j, 2]]
            take = np.concatenate([keep, split, split])
            starts = np.concatenate([start[keep], start[split], start[split] + first])
            lengths = np.concatenate([length[keep], first, length[split] - first])
            classes = np.concatenate([u[keep], cut_rows[j, 2], cut_rows[j, 3]])
            ranks = np.concatenate([(rank - cut_from[u])[keep], cut_rows[j, 4] + nth, cut_rows[j, 5] + nth])
            j = np.searchsorted(places[:, 0] * wide + places[:, 1], classes * wide + ranks, "right") - 1
            each = ranks - places[j, 1]
            new = {"start": starts, "length": lengths}
            columns = [pa.array(new[c]) if c in new else batch.column(k).take(pa.array(take)) for k, c in enumerate(names)]
            more = [np.arange(len(take)) < len(keep), places[j, 3] + each // places[j, 2], places[j, 4] + each % places[j, 2]]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, more)], [*names, "whole", "sequence_id", "slot"])

    extra = [T.StructField("whole", T.BooleanType()), T.StructField("sequence_id", T.LongType()), T.StructField("slot", T.LongType())]
    laid = ranked.mapInArrow(placed, T.StructType([*pieces.schema.fields, *extra]))
    # A sequence holds capacity rows at most.
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")
    alone = [F.lit(True).alias("whole"), (F.col("row") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    return laid.unionByName(pieces.where(F.col("length") == capacity).select("*", *alone))


def pack_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, with_ids: bool = True
) -> DataFrame:
    """One row for each piece of docs: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, binary).

    A text is its ids followed by end_id; null is empty. Longer texts are cut every capacity ids; others only if the
    program finds that a cut saves more than it costs. Keys may be null or repeated. An empty table gives an empty one.
    """
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = token_pieces(named, "key", "text", tokenizer, capacity, end_id, with_ids=True).drop("piece")
    # Row numbers are kept in the table, so that all that follows sees the same ones.
    pieces = written(made.withColumn("row", F.monotonically_increasing_id()), "zstd")
    laid = pack_stock(pieces.drop("ids"), capacity)
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    ids_of = pieces.select(F.col("row").alias("_row"), F.col("start").alias("_from"), "ids")

    def parts(batches):
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns))
            at = [cols[c].to_pylist() for c in ("ids", "start", "_from", "length")]
            own = [ids[4 * (a - b) : 4 * (a - b + n)] for ids, a, b, n in zip(*at)]
            cols |= {"ids": pa.array(own, pa.binary()), "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    kinds = T.StructType([T.StructField("key", docs.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in names[1:7]]])
    kinds = kinds.add("ids", T.BinaryType()) if with_ids else kinds
    # Ids are moved where they are asked for, and for pieces that are cut.
    move = laid if with_ids else laid.where("not whole")
    moved = move.join(ids_of, F.col("row") == F.col("_row")).mapInArrow(parts, kinds)
    return (moved if with_ids else laid.where("whole").select(*names).unionByName(moved)).withColumnRenamed("key", key)


def op13_cutting_stock(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
