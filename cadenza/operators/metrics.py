"""Distribution, agreement and classification metrics."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import MAJOR_PROFILE, MINOR_PROFILE, in_scale


def shares(rows: DataFrame, by: list[str], value, k: int) -> DataFrame:
    """(by, bin, p) for the bins 0..k-1 of value modulo k; bins without rows have p 0."""
    counts = rows.groupBy(*by, F.pmod(value, F.lit(k)).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    groups = counts.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    full = groups.join(counts, [*by, "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return full.select(*by, "bin", (F.col("c") / F.sum("c").over(Window.partitionBy(*by))).alias("p"))


def js_divergence(a: DataFrame, b: DataFrame, by: list[str], eps: float = 1e-12) -> DataFrame:
    """Jensen-Shannon divergence (base 2) of the distributions (by, bin, p); eps is added before they are scaled."""
    both = a.join(b.withColumnRenamed("p", "q"), [*by, "bin"])
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    p, q = F.col("p") + eps, F.col("q") + eps
    scaled = both.withColumn("_p", p / F.sum(p).over(w)).withColumn("_q", q / F.sum(q).over(w))
    m = (F.col("_p") + F.col("_q")) / 2
    term = (F.col("_p") * F.log2(F.col("_p") / m) + F.col("_q") * F.log2(F.col("_q") / m)) / 2
    return scaled.groupBy(*by).agg(F.sum(term).alias("js"))


def wasserstein(rows: DataFrame, by: list[str], value: str, side: str) -> DataFrame:
    """Distance of the values of side 0 and side 1: area between the two distribution functions."""
    points = rows.groupBy(*by, value).agg(F.sum((F.col(side) == 0).cast("int")).alias("a"), F.sum((F.col(side) == 1).cast("int")).alias("b"))
    group = Window.partitionBy(*by)
    w = group.orderBy(value)
    f = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(c).over(group)
    steps = points.select(*by, F.abs(f("a") - f("b")).alias("d"), (F.lead(value).over(w) - F.col(value)).alias("step"))
    return steps.groupBy(*by).agg(F.sum(F.col("d") * F.col("step")).alias("w1"))


def auc(rows: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by mid-ranks, from counts per score, so rows are summed before they are ordered."""
    counts = rows.groupBy(*by, score).agg(F.sum(F.col(positive)).alias("p"), F.sum(1 - F.col(positive)).alias("q"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("p") * (F.coalesce(F.sum("q").over(below), F.lit(0)) + F.col("q") / F.lit(2.0))
    summed = counts.withColumn("wins", wins).groupBy(*by).agg(F.sum("wins").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return summed.select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w") / (F.col("p") * F.col("q"))).alias("auc"))


def majority(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; ties go to the one seen first in order."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    return counts.groupBy(*by).agg(F.max(F.struct("votes", (-F.col("_first")).alias("f"), value)).alias("m")).select(*by, F.col(f"m.{value}").alias(value), "m.votes")


def macro_f1(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """Mean F1 over the labels that occur in gold."""
    hits = rows.where(F.col(gold) == F.col(pred)).groupBy(F.col(gold).alias("label")).agg(F.count("*").alias("tp"))
    golds = rows.groupBy(F.col(gold).alias("label")).agg(F.count("*").alias("g"))
    preds = rows.groupBy(F.col(pred).alias("label")).agg(F.count("*").alias("h"))
    each = golds.join(preds, "label", "left").join(hits, "label", "left").fillna(0)
    return each.agg(F.avg(2 * F.col("tp") / (F.col("g") + F.col("h"))).alias("macro_f1"), F.count("*").alias("labels"))


def scales(spark) -> DataFrame:
    return spark.range(24).select((F.col("id") % 12).cast("int").alias("tonic"), (F.col("id") >= 12).alias("minor"))


def scale_agreement(pitches: DataFrame, by: list[str]) -> DataFrame:
    """Share of notes in each of the 24 scales, from pitch class counts: (by, tonic, minor, agree)."""
    counts = pitches.groupBy(*by, F.pmod("pitch", F.lit(12)).alias("pc")).agg(F.count("*").alias("c"))
    met = counts.join(F.broadcast(scales(pitches.sparkSession)))
    fits = in_scale(F.col("pc"), F.col("tonic"), F.col("minor")).cast("int")
    return met.groupBy(*by, "tonic", "minor").agg((F.sum(fits * F.col("c")) / F.sum("c")).alias("agree"))


def key_scores(pitches: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Correlation of the duration-weighted pitch classes with the profiles of the 24 keys: (by, tonic, minor, r)."""
    spark = pitches.sparkSession
    counts = pitches.groupBy(*by, F.pmod("pitch", F.lit(12)).cast("int").alias("pc")).agg(F.sum(weight).alias("c"))
    full = counts.select(*by).distinct().withColumn("pc", F.explode(F.sequence(F.lit(0), F.lit(11)))).join(counts, [*by, "pc"], "left")
    rows = [(t, bool(m), (t + k) % 12, p) for m, prof in enumerate((MAJOR_PROFILE, MINOR_PROFILE)) for t in range(12) for k, p in enumerate(prof)]
    profiles = spark.createDataFrame(rows, "tonic int, minor boolean, pc int, p double")
    met = full.withColumn("c", F.coalesce(F.col("c").cast("double"), F.lit(0.0))).join(F.broadcast(profiles), "pc")
    return met.groupBy(*by, "tonic", "minor").agg(F.corr("c", "p").alias("r"))


def groove(notes: DataFrame, by: list[str]) -> DataFrame:
    """(by, groove, even_, swing): even, swing or undetermined, by the majority of pairs of neighbouring gaps that make up
    about a beat (18 to 30 ticks). Gaps are those between onsets of up to 24 ticks; a ratio near 1 is even, one of 1.5 to 3
    either way is swing. Fewer than three notes, or no such pair, leave it undetermined."""
    t = notes.select(*by, "event_id", (F.col("measure") * 96 + F.col("shift")).alias("t"))
    gaps = t.withColumn("a", F.lead("t").over(Window.partitionBy(*by).orderBy("t", "event_id")) - F.col("t"))
    pairs = gaps.where("a > 0 and a <= 24").withColumn("b", F.lead("a").over(Window.partitionBy(*by).orderBy("t")))
    r = F.col("a") / F.col("b")
    even, swing = r.between(0.75, 1.33), r.between(1.5, 3.0) | r.between(F.lit(1.0) / 3.0, F.lit(1.0) / 1.5)
    counts = pairs.where((F.col("a") + F.col("b")).between(18, 30)).groupBy(*by).agg(F.count_if(even).alias("even_"), F.count_if(~even & swing).alias("swing"))
    every = notes.groupBy(*by).agg(F.count("*").alias("_n")).join(counts, by, "left").fillna(0, ["even_", "swing"])
    label = F.when((F.col("_n") < 3) | (F.col("even_") + F.col("swing") == 0), "undetermined").when(F.col("even_") >= F.col("swing"), "even").otherwise("swing")
    return every.select(*by, label.alias("groove"), "even_", "swing")


def voted_sweep(clips: DataFrame, file: str, label: str, pred: str, score: str, place: str, thresholds) -> DataFrame:
    """One row a threshold: (threshold, clips_kept, files_voted, of_voted, of_all). At each threshold the clips of at least
    that score vote anew for their file's class; ties go to the class of the clip that comes first by place. of_voted and
    of_all are the shares of files voted right, of those with a clip left and of all.

    Clips are counted once, by how many thresholds their score meets; only counts are copied for the thresholds.
    """
    levels = sorted(thresholds)
    met = F.size(F.filter(F.array(*[F.lit(t).cast("double") for t in levels]), lambda t: t <= F.col(score)))
    counts = clips.groupBy(file, F.col(pred).alias("_p"), met.alias("_met")).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    each = counts.where("_met > 0").withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_met") - 1)))
    votes = each.groupBy(file, "_t", "_p").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    order = F.struct(-F.col("_n"), F.col("_first"), F.col("_p"))
    chosen = votes.groupBy(file, "_t").agg(F.min_by("_p", order).alias("_p"), F.sum("_n").alias("_n"))
    gold = clips.groupBy(file).agg(F.max(label).alias("_gold"))
    right = chosen.join(gold, file).groupBy("_t").agg(F.sum("_n").alias("clips_kept"), F.count("*").alias("files_voted"), F.count_if(F.col("_p") == F.col("_gold")).alias("_ok"))
    spark = clips.sparkSession
    every = spark.createDataFrame(list(enumerate(map(float, levels))), "_t int, threshold double").crossJoin(gold.agg(F.count("*").alias("_all")))
    found = every.join(F.broadcast(right), "_t", "left").fillna(0, ["clips_kept", "files_voted", "_ok"])
    share = lambda of: F.col("_ok") / F.greatest(F.col(of), F.lit(1))
    return found.select("threshold", "clips_kept", "files_voted", share("files_voted").alias("of_voted"), share("_all").alias("of_all"))


def gram_hashes(rows: DataFrame, words: str, n: int) -> DataFrame:
    """rows with h, the hashes of the n-grams of an array of words, n a power of two; the words are dropped.

    Hashes of 2k-grams are made of those of k-grams, so that a word is hashed once and a gram costs log n steps."""
    out = rows.withColumn("h", F.transform(words, lambda x: F.xxhash64(x))).drop(words)
    k = 1
    while k < n:
        left = F.size("h") - k
        both = F.zip_with(F.slice("h", F.lit(1), left), F.slice("h", F.lit(1 + k), left), lambda a, b: F.xxhash64(a, b))
        out, k = out.withColumn("h", F.when(left > 0, both).otherwise(F.array().cast("array<bigint>"))), 2 * k
    return out


def possible(rows: DataFrame, hashes: str, known: DataFrame, *keep: str, most: int = 1 << 21) -> DataFrame:
    """(keep, h): of the arrays of hashes of rows, those that may be among known.h; no known one is missing.

    A Bloom filter of blocks of 64 bits, four of which a hash sets, with a block for five hashes, but `most` blocks
    (16 MB) at most: a filter of more hashes lets more of the others pass, which a join with known is to leave out."""
    blocks, n = 64, known.count()
    while blocks < most and blocks * 5 < n:
        blocks *= 2
    place = lambda h: F.pmod(h, F.lit(blocks)).cast("int")
    one = F.lit(1).cast("long")

    def bits(h):
        out = None
        for k in range(4):
            bit = F.call_function("shiftleft", one, F.shiftrightunsigned(h, 64 - 6 * (k + 1)).bitwiseAND(F.lit(63).cast("long")).cast("int"))
            out = bit if out is None else out.bitwiseOR(bit)
        return out

    filled = known.groupBy(place(F.col("h")).alias("at")).agg(F.bit_or(bits(F.col("h"))).alias("bits"))
    every = known.sparkSession.range(blocks).select(F.col("id").cast("int").alias("at")).join(filled, "at", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("_all"))
    one_row = row.select(F.col("_all.bits").alias("_bloom"))
    met = lambda h: F.get("_bloom", place(h)).bitwiseAND(bits(h)) == bits(h)
    return rows.join(F.broadcast(one_row)).select(*keep, F.explode(F.filter(hashes, met)).alias("h"))


def auc_by_source(rows: DataFrame, source: str, score: str, negative) -> DataFrame:
    """(source, positives, negatives, auc, mean): for each source of positive rows the chance that one of its rows has a
    higher score than a negative one, equal scores counting half. The negative rows, by a condition, are the same for all
    sources and are not copied: they are counted by score once. `null` as source stands for all positives together; mean
    is the mean score. Scores are within 0 and 1; rows without score are left out.

    Negatives below a score come from counts of 4,096 ranges of scores and windows within these.
    """
    known = rows.where(F.col(score).isNotNull()).select(F.col(source).alias("source"), F.col(score).alias("_s"), negative.alias("_negative"))
    values = known.groupBy("_s").agg(F.count_if("_negative").alias("_at")).withColumn("_range", F.floor(F.col("_s") * 4096))
    before = lambda w: F.coalesce(F.sum("_at").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = values.groupBy("_range").agg(F.sum("_at").alias("_at")).select("_range", before(Window.orderBy("_range")).alias("_lower"))
    below = values.withColumn("_own", before(Window.partitionBy("_range").orderBy("_s"))).join(ranges, "_range")
    wins = below.select("_s", (F.col("_own") + F.col("_lower") + F.col("_at") / 2).alias("_wins"))
    counts = known.where("not _negative").groupBy("source", "_s").agg(F.count("*").alias("_n"))
    total = known.agg(F.count_if("_negative").alias("negatives"))
    each = counts.join(wins, "_s").groupBy("source", "_s").agg(F.sum("_n").alias("_n"), F.first("_wins").alias("_wins"))
    found = each.rollup("source").agg(F.sum("_n").alias("positives"), F.sum(F.col("_n") * F.col("_wins")).alias("_w"), (F.sum(F.col("_n") * F.col("_s")) / F.sum("_n")).alias("mean"))
    return found.crossJoin(F.broadcast(total)).select("source", "positives", "negatives", (F.col("_w") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0))).alias("auc"), "mean")


def key_votes(windows: DataFrame, profiles: list, good: float = 0.2, clear: float = 0.05) -> DataFrame:
    """(song, win, key, weight, votes) of windows (song, win, c0 to c11: what each pitch class lasts), decided where they lie.

    Each profile (of major and of minor) correlates with the classes in 24 keys, which are 2 * tonic + (1 in minor), and
    votes for its best key, of equals the first, if that is good and clear of the next. The key with the most votes wins,
    of equals that of the earlier profile; windows without a vote are left out. As a correlation with equal sums is NaN,
    which is above all numbers, such a window has all votes for key 0.
    """
    import numpy as np
    import pyarrow as pa

    # Centred and of length 1, so that a product with centred sums is a correlation once it is divided by their length.
    every = np.array([[np.roll(both[k % 2], k // 2) for k in range(24)] for both in profiles], float)
    every -= every.mean(2, keepdims=True)
    every /= np.sqrt((every**2).sum(2, keepdims=True))

    def vote(batches):
        for batch in batches:
            sums = np.stack([batch.column(k + 2).to_numpy() for k in range(12)], 1)
            own = sums - sums.mean(1, keepdims=True)
            with np.errstate(all="ignore"):
                r = np.round(np.einsum("wc,pkc->wpk", own, every) / np.sqrt((own**2).sum(1))[:, None, None], 6)
                order = np.sort(r, 2)
                ok = ~(order[:, :, -1] < good) & ~(np.round(order[:, :, -1] - order[:, :, -2], 6) < clear)
            key = np.where(ok, r.argmax(2), -1)
            votes = ((key[:, :, None] == key[:, None, :]) & ok[:, :, None]).sum(2)
            first, row = votes.argmax(1), np.flatnonzero(ok.any(1))
            at = (row, first[row])
            columns = [key[at].astype(np.int32), ok.sum(1)[row], votes[at]]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(row)) for k in range(2)], *map(pa.array, columns)], ["song", "win", "key", "weight", "votes"])

    kinds = T.StructType([windows.schema["song"], windows.schema["win"], *[T.StructField(c, k) for c, k in (("key", T.IntegerType()), ("weight", T.LongType()), ("votes", T.LongType()))]])
    return windows.select("song", "win", *[f"c{k}" for k in range(12)]).mapInArrow(vote, kinds)
