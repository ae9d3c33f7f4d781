"""Piano rolls as intervals: what sounds from step to step is one row, however long; cells are never listed.

Each function takes a song's pitch as one window. A pitch of a song is a few thousand rows at most; songs are many.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(spans: DataFrame, by: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """(by, start, stop): the union of half-open spans of each group, as spans that do not touch. Empty spans are none."""
    w = Window.partitionBy(*by).orderBy(start, stop)
    real = spans.where(F.col(start) < F.col(stop))
    furthest = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = real.withColumn("_new", (furthest.isNull() | (F.col(start) > furthest)).cast("int")).withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(*by, "_island").agg(F.min(start).alias("start"), F.max(stop).alias("stop")).drop("_island")


def steps_of(spans: DataFrame, by: list[str], value: str | None = None) -> DataFrame:
    """(by, start, stop, value): pieces between the places where spans of a group begin and end, with the sum of the values
    of the spans that cover them (or their number). Pieces that nothing covers are left out."""
    amount = F.col(value) if value else F.lit(1)
    edges = spans.where("start < stop").select(*by, F.inline(F.array(F.struct(F.col("start").alias("at"), amount.alias("d")), F.struct(F.col("stop").alias("at"), (-amount).alias("d")))))
    counts = edges.groupBy(*by, "at").agg(F.sum("d").alias("d"), F.count_if(F.col("d") != 0).alias("n"))
    w = Window.partitionBy(*by).orderBy("at")
    level = counts.select(*by, F.col("at").alias("start"), F.lead("at").over(w).alias("stop"), F.sum("d").over(w).alias("value"))
    return level.where("value > 0 and stop is not null")


def roll_spans(notes: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The roll of notes (measure, shift, dur, pitch): spans (by, pitch, start, stop) in which a pitch sounds, and the
    distinct onsets (by, pitch, step)."""
    start = (F.col("measure") * 96 + F.col("shift")).cast("long")
    spans = notes.select(*by, "pitch", start.alias("start"), (start + F.col("dur")).alias("stop"))
    return merged(spans, [*by, "pitch"]), spans.select(*by, "pitch", F.col("start").alias("step")).distinct()


def sustained_notes(
    active: DataFrame, onsets: DataFrame, by: list[str], bridge: int = 3, chunk: int = 24, least: int = 6
) -> DataFrame:
    """Notes (by, start, stop) back out of a roll that may have dropouts: one for each onset.

    active: (by, start, stop) half-open spans in which a cell is on; they may overlap. onsets: (by, step). by names song
    and pitch. A note sounds for one step at least and ends where its cells do, but before the next onset. Off cells do
    not end it if there are bridge of them at most, or chunk at most when the cells that follow start at a multiple of
    chunk and least of them or more are on before the next onset: a chunk was cut off and the next one holds the note on.

    Two passes of islands. The first cuts the spans at the onsets; the second counts, within an onset's stretch, the gaps
    that do end a note; the pieces before the first of these are the note.
    """
    on = steps_of(merged(active, by), by).select(*by, "start", "stop")
    at = onsets.select(*by, F.col("step").cast("long").alias("step")).distinct()
    edges = (
        on.select(*by, F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))))
        .withColumn("onset", F.lit(0))
        .unionByName(at.select(*by, F.col("step").alias("at"), F.lit(0).alias("d"), F.lit(1).alias("onset")))
        .groupBy(*by, "at")
        .agg(F.sum("d").alias("d"), F.max("onset").alias("onset"))
    )
    w = Window.partitionBy(*by).orderBy("at")
    cut = edges.select(
        *by, F.col("at").alias("a"), F.lead("at").over(w).alias("b"), F.sum("d").over(w).alias("on"),
        F.last(F.when(F.col("onset") == 1, F.col("at")), True).over(w).alias("from"), "onset",
    )
    # A step with an onset is the note's, be it on or off.
    pieces = cut.where("from is not null and (on > 0 or onset = 1)").select(*by, "from", "a", F.when(F.col("on") > 0, F.col("b")).otherwise(F.col("a") + 1).alias("b"))
    own = Window.partitionBy(*by, "from").orderBy("a")
    gap = F.col("a") - F.lag("b").over(own)
    resumes = (gap <= chunk) & (F.col("a") % chunk == 0) & (F.col("b") - F.col("a") >= least)
    ends = F.when((gap <= bridge) | resumes, 0).otherwise(F.when(gap.isNull(), 0).otherwise(1))
    held = pieces.withColumn("_ends", ends).withColumn("_ended", F.sum("_ends").over(own)).where("_ended = 0")
    return held.groupBy(*by, F.col("from").alias("start")).agg(F.max("b").alias("stop"))


def velocity_roll(notes: DataFrame, songs: DataFrame, by: list[str], ticks: int) -> DataFrame:
    """The roll of one layer a program: (by, program, pitch, start, stop, velocity), half-open spans of ticks.

    notes: (by, program, instrument, pitch, velocity, start, stop), times in seconds. songs: (by, measures). A song's
    measures of `ticks` steps each are laid over its length up to the last end of a note. Notes of an instrument that
    sound together add up; of several instruments with one program the loudest counts. Songs without length have none.
    """
    length = notes.groupBy(*by).agg(F.max("stop").alias("_length")).join(songs, by)
    total = F.greatest(F.col("measures"), F.lit(1)) * ticks
    rate = length.where("_length > 0").select(*by, (total / F.col("_length")).alias("_rate"), total.cast("long").alias("_total"))
    tick = lambda c: F.least(F.floor(F.col(c) * F.col("_rate")), F.col("_total"))
    spans = notes.join(rate, by).select(*by, "program", "instrument", "pitch", "velocity", tick("start").alias("start"), tick("stop").alias("stop"))
    layer, one = [*by, "program", "pitch"], [*by, "program", "pitch", "instrument"]
    each = steps_of(spans, one, "velocity")
    # The loudest at each place where any instrument changes: each one's level there, the last it was set to.
    sets = each.select(*one, F.inline(F.array(F.struct(F.col("start").alias("at"), F.col("value").alias("v"), F.lit(1).alias("k")), F.struct(F.col("stop").alias("at"), F.lit(0).cast("long").alias("v"), F.lit(0).alias("k")))))
    levels = sets.groupBy(*one, "at").agg(F.max_by("v", "k").alias("v"))
    grid = levels.select(*layer, "at").distinct().join(levels.select(*one).distinct(), layer).join(levels, [*one, "at"], "left")
    known = grid.withColumn("v", F.coalesce(F.last("v", True).over(Window.partitionBy(*one).orderBy("at")), F.lit(0)))
    loudest = known.groupBy(*layer, "at").agg(F.max("v").alias("velocity"))
    w = Window.partitionBy(*layer).orderBy("at")
    return loudest.select(*layer, F.col("at").alias("start"), F.lead("at").over(w).alias("stop"), "velocity").where("velocity > 0 and stop is not null")


def notes_of_roll(roll: DataFrame, by: list[str]) -> DataFrame:
    """The inverse, as far as there is one: (by, start, stop, velocity), a note for each stretch without a silent step, as
    loud as its first. by names song, program and pitch. The roll keeps loudness as a 32-bit share of 127."""
    w = Window.partitionBy(*by).orderBy("start")
    new = (F.col("start") > F.lag("stop").over(w)) | F.lag("stop").over(w).isNull()
    held = roll.withColumn("_new", new.cast("int")).withColumn("_n", F.sum("_new").over(w))
    share = (F.col("velocity") / 127.0).cast("float") * F.lit(127.0).cast("float")
    loud = F.greatest(F.lit(1), F.floor(share)).cast("long")
    return held.withColumn("_v", loud).groupBy(*by, "_n").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("_v", "start").alias("velocity")).drop("_n")
