"""Notes and tokens: encoding, decoding, bars, transposition, lanes, sustain."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab as V
from ..functions.scalars import fold_pitch


def notes_to_tokens(notes: DataFrame, by: list[str], kinds=()) -> DataFrame:
    """(by, tokens): the notes' shift, pitch and duration, with a bar token for each bar line passed since bar 0, so that the
    parts of a song keep their common bars; a bar without notes is a blank. Bar 0 has no token. At the end the end token.
    kinds of one's own (functions.vocab.TokenKind) add their tokens to each note."""
    own = F.array(*[x.cast("int") for x in V.encoded(kinds)]) if kinds else F.array().cast("array<int>")
    notes = notes.withColumn("_own", F.filter(own, lambda x: x.isNotNull()))
    note = F.struct("shift", "pitch", "dur", "_own")
    bars = notes.groupBy(*by, "measure").agg(F.array_sort(F.collect_list(note)).alias("notes"))
    w = Window.partitionBy(*by).orderBy("measure")
    passed = F.col("measure") - F.coalesce(F.lag("measure").over(w), F.lit(0))
    told = F.flatten(
        F.transform(
            "notes",
            lambda x: F.concat(
                F.array((x["shift"] + V.SHIFT).cast("int"), (x["pitch"] + V.PITCH).cast("int"), (x["dur"] + V.DUR).cast("int")), x["_own"]
            ),
        )
    )
    empty = F.flatten(F.array_repeat(F.array(F.lit(V.SME), F.lit(V.BLANK)), F.greatest(passed - 1, F.lit(0)).cast("int")))
    line = F.when(passed > 0, F.array(F.lit(V.SME))).otherwise(F.array().cast("array<int>"))
    each = bars.select(*by, "measure", F.concat(empty, line, told).alias("t"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("measure", "t"))), lambda x: x["t"]))
    return each.groupBy(*by).agg(F.concat(whole, F.array(F.lit(V.TE))).alias("tokens"))


def tokens_to_notes(seqs: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure, shift, pitch, dur). Ranges are half-open, so the last pitch, duration and shift of each are not
    notes; what stands before the first bar belongs to bar 0; a pitch is used by one duration only. A null sequence has no
    notes.

    A sequence is taken to notes where it lies, a batch of sequences at a time; nothing is shuffled or sorted.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lists = batch.column(len(by))
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            tok, place = lists.flatten().to_numpy(), np.arange(size.sum())
            row = np.repeat(np.arange(len(batch)), size)
            first = (np.cumsum(size) - size)[row]
            within = lambda low, n: (tok >= low) & (tok < low + n)
            last = lambda mask: np.maximum.accumulate(np.where(mask, place, -1)) if len(place) else place
            before = lambda x: np.concatenate([[-1], x[:-1]]) if len(x) else x
            is_d, is_bar = within(V.DUR, 288), tok == V.SME
            shift, pitch, other = last(within(V.SHIFT, 96)), before(last(within(V.PITCH, 127))), before(last(is_d))
            at = np.flatnonzero(is_d & (pitch >= first) & (shift >= first) & (other < pitch))
            bars = np.cumsum(is_bar)
            start = np.concatenate([[0], bars])[first[at]]
            columns = (np.maximum(bars[at] - start - 1, 0), tok[shift[at]] - V.SHIFT, tok[pitch[at]] - V.PITCH, tok[at] - V.DUR)
            keys = [batch.column(k).take(pa.array(row[at])) for k in range(len(by))]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c.astype(np.int32)) for c in columns]], [*by, "measure", "shift", "pitch", "dur"])

    kinds = T.StructType([*[seqs.schema[c] for c in by], *[T.StructField(c, T.IntegerType()) for c in ("measure", "shift", "pitch", "dur")]])
    return seqs.select(*by, F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, kinds)


def transposed(notes: DataFrame, shifts=range(-5, 7), drums: str = "false") -> DataFrame:
    """Each note in every shift, folded into range by octaves; drums stay."""
    moved = notes.withColumn("moved", F.explode(F.array(*[F.lit(s) for s in shifts])))
    return moved.withColumn("pitch", F.when(F.expr(drums), F.col("pitch")).otherwise(fold_pitch(F.col("pitch") + F.col("moved"))))


def lanes(notes: DataFrame, by: list[str], lane: str, most: int) -> DataFrame:
    """The `most` lanes of each song with the most notes; ties by name."""
    counts = notes.groupBy(*by, lane).agg(F.count("*").alias("n"))
    slot = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), lane))
    return counts.withColumn("slot", slot).where(F.col("slot") <= most)


def bar_density(notes: DataFrame, by: list[str], most) -> DataFrame:
    """density 1..10 of each group: mean over its bars, from bar 0 to the last with notes, of notes / most, times ten, rounded
    up; null where a bar has more. most is a number or a column of by."""
    most = most if isinstance(most, Column) else F.lit(most)
    bars = notes.groupBy(*by, "measure").agg(F.count("*").alias("n"))
    mean = F.sum("n") / (F.max("measure") + 1) / F.first(most)
    grade = F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(F.round(mean * 10, 9)).cast("int")))
    return bars.groupBy(*by).agg(F.when(F.max("n") > F.first(most), F.lit(None).cast("int")).otherwise(grade).alias("density"))


def sustained(notes: DataFrame, pedal: DataFrame, by: list[str]) -> DataFrame:
    """Notes (start, end, pitch) that end while a pedal span [on, off) is down last until its end, but not into the next
    note of the same pitch. Spans and notes meet in an ordered union, so no range join is needed; spans of a group must
    not overlap."""
    w = Window.partitionBy(*by).orderBy("at", "kind")
    ends = notes.select(*by, F.col("end").alias("at"), F.lit(1).alias("kind"), F.struct(*notes.columns).alias("note"), F.lit(None).cast("struct<on:long,off:long>").alias("span"))
    spans = pedal.select(*by, F.col("on").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(ends.schema["note"].dataType).alias("note"), F.struct(F.col("on").cast("long").alias("on"), F.col("off").cast("long").alias("off")).alias("span"))
    met = ends.unionByName(spans).withColumn("down", F.last("span", True).over(w)).where("kind = 1").select("note.*", "down")
    following = F.lead("start").over(Window.partitionBy(*by, "pitch").orderBy("start", "end"))
    held = F.when(F.col("down.off") > F.col("end"), F.col("down.off")).otherwise(F.col("end"))
    cut = F.when(following.isNotNull() & (held > following), F.greatest(F.col("end"), following)).otherwise(held)
    return met.withColumn("sustained_end", cut).drop("down")


def paired(events: DataFrame, by: list[str], on: str, off: str) -> DataFrame:
    """(by, k, start, stop): first in, first out. An `off` ends the oldest open `on`; without one it means nothing. What is
    still open ends with the group's last event. A note lasts a second at least.

    Open notes are a running count; an `off` that takes the count below its least value so far (or 0) found none.
    """
    w = Window.partitionBy(*by).orderBy("ts", "event_id")
    step = F.when(F.col("kind") == on, 1).when(F.col("kind") == off, -1).otherwise(0)
    counted = events.withColumn("_open", F.sum(step).over(w))
    least = F.least(F.coalesce(F.min("_open").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    ends = (F.col("kind") == off) & (F.col("_open") >= F.col("_least"))
    found = counted.withColumn("_least", least).withColumn("_end", F.max("ts").over(Window.partitionBy(*by)))
    numbered = found.withColumns({"_on": F.sum((F.col("kind") == on).cast("int")).over(w), "_off": F.sum(ends.cast("int")).over(w)})
    a = numbered.where(F.col("kind") == on).select(*by, F.col("_on").alias("k"), F.col("ts").alias("start"), "_end")
    b = numbered.where(ends).select(*by, F.col("_off").alias("k"), F.col("ts").alias("stop"))
    stop = F.greatest(F.coalesce("stop", "_end"), F.col("start") + F.expr("interval 1 second"))
    return a.join(b, [*by, "k"], "left").select(*by, "k", "start", stop.alias("stop"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """left with the value of the last row of right at or before it; null before the first. An ordered union, so
    a key's rows are sorted once and never multiplied."""
    l = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_k", F.lit(1))  # noqa: E741
    r = right.select(*by, at, F.col(value).alias("_v")).withColumn("_k", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "_k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", True).over(w)).where("_k = 1").drop("_v", "_k")


def windows(bars: DataFrame, by: list[str], past: int, const: int, future: int) -> DataFrame:
    """(by, window, role, bar, n) over bars (by, bar, n; bars from 0): windows start every `past` bars and need one bar
    more than they hold; each bar of a window is past, const or future."""
    need = past + const + future
    total = Window.partitionBy(*by)
    counted = bars.withColumn("bars", F.max("bar").over(total) + 1)
    spread = counted.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit((need - 1) // past))))
    window = F.floor(F.col("bar") / past) - F.col("back")
    at = F.col("bar") - F.col("window") * past
    role = F.when(at < past, "past").when(at < past + const, "const").otherwise("future")
    fits = (F.col("window") >= 0) & (at < need) & (F.col("window") * past + need < F.col("bars"))
    return spread.withColumn("window", window).where(fits).withColumn("role", role).drop("back", "bars")


def tick_notes(messages: DataFrame, by: list[str], drums: int = 9) -> DataFrame:
    """(by, channel, pitch, velocity, program, start, stop): the notes that messages (by, seq, tick, kind, channel, a, b)
    play. by names a track; seq is the order of its messages.

    An off ends the oldest note of its channel and pitch that is held; without one it means nothing. While the channel's
    pedal (controller 64 at 64 or more) is down at that moment, the note sounds on until the pedal comes up or the pitch
    is struck again, whichever is first; drums have no pedal. What is still open at the end of the track ends there. A
    note lasts a tick at least. The program is the channel's last one before the note, 0 without any.

    Windows over a track's channel and over its pitches; a track is one group of a window.
    """
    of_channel, of_pitch = [*by, "channel"], [*by, "channel", "a"]
    w, here = Window.partitionBy(*of_channel).orderBy("seq"), Window.partitionBy(*of_pitch).orderBy("seq")
    later = (1, Window.unboundedFollowing)
    kind = F.col("kind")
    down = F.when((kind == "control") & (F.col("a") == 64), F.col("b") >= 64)
    told = messages.withColumn("_last", F.max("tick").over(Window.partitionBy(*by))).withColumns({
        "_program": F.last(F.when(kind == "program", F.col("a")), True).over(w),
        "_down": F.coalesce(F.last(down, True).over(w), F.lit(False)) & (F.col("channel") != drums),
        "_up": F.first(F.when(~down, F.struct("seq", "tick")), True).over(w.rowsBetween(*later)),
    })
    step = F.when(kind == "on", 1).otherwise(-1)
    keys = told.where("kind in ('on', 'off')").withColumn("_open", F.sum(step).over(here)).withColumn("_again", F.first(F.when(kind == "on", F.struct("seq", "tick")), True).over(here.rowsBetween(*later)))
    # An off that takes the count of open notes below its least value so far found none.
    least = F.least(F.coalesce(F.min("_open").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    ends = (kind == "off") & (F.col("_open") >= F.col("_least"))
    numbered = keys.withColumn("_least", least).withColumns({"_on": F.sum((kind == "on").cast("int")).over(here), "_off": F.sum(ends.cast("int")).over(here)})
    on = numbered.where(kind == "on").select(*of_pitch, F.col("_on").alias("_k"), F.col("b").alias("velocity"), F.coalesce("_program", F.lit(0)).alias("program"), F.col("tick").alias("start"), "_last")
    # Of pedal and next stroke, the one with the smaller seq; a null is neither.
    held = F.coalesce(F.least("_up", "_again")["tick"], F.col("_last"))
    off = numbered.where(ends).select(*of_pitch, F.col("_off").alias("_k"), F.when(F.col("_down"), held).otherwise(F.col("tick")).alias("_stop"))
    stop = F.greatest(F.coalesce("_stop", "_last"), F.col("start") + 1)
    return on.join(off, [*of_pitch, "_k"], "left").select(*of_channel, F.col("a").alias("pitch"), "velocity", "program", "start", stop.alias("stop"))
