"""Training samples: bars of tokens, marked blocks of instruments, system blocks, and what is built from them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V

SYSTEM, MGEN, EOS = 8, 12, 1
#: Markers of the three roles of a window.
MARKS = {"past": V.PAST, "const": V.CONST, "future": V.FUTURE}


def tokens(*ids: int) -> Column:
    return F.array(*[F.lit(x) for x in ids]).cast("array<int>")


def none() -> Column:
    return F.array().cast("array<int>")


def bar_tokens(notes: DataFrame, by: list[str]) -> DataFrame:
    """(by, bar, n, t) for every bar from 0 to the last of by[0]: the bar token, then the notes, or a blank."""
    note = F.array_sort(F.collect_list(F.struct("shift", "pitch", "dur")))
    told = F.flatten(F.transform(note, lambda x: F.array((x["shift"] + V.SHIFT).cast("int"), (x["pitch"] + V.PITCH).cast("int"), (x["dur"] + V.DUR).cast("int"))))
    own = notes.groupBy(*by, F.col("measure").alias("bar")).agg(told.alias("t"), F.count("*").alias("n"))
    last = notes.groupBy(by[0]).agg(F.max("measure").alias("last"))
    every = notes.select(*by).distinct().join(last, by[0]).withColumn("bar", F.explode(F.sequence(F.lit(0), F.col("last"))))
    full = every.join(own, [*by, "bar"], "left")
    return full.select(*by, "last", "bar", F.coalesce("n", F.lit(0)).alias("n"), F.concat(tokens(V.SME), F.coalesce("t", tokens(V.BLANK))).alias("t"))


def window_parts(bars: DataFrame, song: str, inst: str, size: int = 4) -> DataFrame:
    """(song, window, role, inst, n, bars, seq): three roles of `size` bars, windows start every `size` bars, and one bar more
    than they hold must exist."""
    spread = bars.withColumn("back", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    window = F.floor(F.col("bar") / size).cast("int") - F.col("back")
    kept = spread.withColumn("window", window).where((F.col("window") >= 0) & (F.col("window") * size + 3 * size <= F.col("last")))
    role = F.element_at(F.array(*[F.lit(x) for x in MARKS]), F.col("back") + 1)
    seq = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("bar", "t"))), lambda x: x["t"]))
    return kept.groupBy(song, "window", role.alias("role"), inst).agg(F.sum("n").alias("n"), F.count("*").alias("bars"), F.max("n").alias("most"), seq.alias("seq"))


def bound(x: Column, f) -> Column:
    """f(x), with x computed once a row however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def places(seq: Column, is_one) -> Column:
    """Where (from 0) the tokens of a sequence are for which is_one holds."""
    return F.filter(F.transform(seq, lambda t, i: F.when(is_one(t), i)), lambda i: i.isNotNull())


def framed(inst: Column, seq: Column) -> Column:
    return F.concat(F.array(inst.cast("int")), seq, tokens(V.ESEQ))


def blocks(parts: DataFrame, by: list[str], inst: str, order: str) -> DataFrame:
    """(by, role, body, block): body frames each instrument with notes, in order; block puts its marker and the end tag around."""
    with_notes = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct(F.col(order).alias("o"), framed(F.col(inst), F.col("seq")).alias("t")))))
    body = F.flatten(F.transform(with_notes, lambda x: x["t"]))
    mark = F.element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), F.col("role"))
    made = parts.groupBy(*by, "role").agg(body.alias("body"))
    return made.withColumn("block", F.concat(F.array(mark.cast("int")), "body", tokens(V.TAG_END)))


def grade(notes: Column, bars: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(F.round(notes / bars / F.lit(float(most)) * 10, 9)).cast("int")))


def system_block(key: Column, measures: Column, insts: Column, genre: Column) -> Column:
    """<SYSTEM> key, measures, each instrument with its density, genre <TAG_END>; insts: array of (inst, density)."""
    each = F.flatten(F.transform(insts, lambda x: F.array(x["inst"].cast("int"), (x["density"] + V.DENSE - 1).cast("int"))))
    head = F.array(F.lit(SYSTEM), (key + V.KEY).cast("int"), (measures + V.GMC - 1).cast("int"))
    return F.concat(head, each, F.array((genre + V.GENRE).cast("int"), F.lit(V.TAG_END)))


def inserted(array: Column, at: Column, item: Column) -> Column:
    """array with item put at place `at` (from 0)."""
    return F.concat(F.slice(array, F.lit(1), at), F.array(item), F.slice(array, at + 1, F.greatest(F.size(array) - at, F.lit(0))))


def cut_at(seq: Column, mark: int, after: bool = True) -> Column:
    """What stands behind the first `mark` (before it if not after); all of it, or nothing before, if there is none."""
    at = F.array_position(seq, mark).cast("int")
    return F.slice(seq, at + 1, F.size(seq)) if after else F.when(at > 0, F.slice(seq, F.lit(1), at - 1)).otherwise(seq)


def parsed_block(block: Column) -> Column:
    """Map of instrument to sequence of a block: sequences start behind an instrument token and end at <ESEQ>, at the next
    instrument or at <TAG_END>, which ends the block; the last sequence of an instrument counts, empty ones stay."""
    is_inst = lambda t: t.between(9, 10)

    def pairs(v):
        body = v["body"]

        def one(s):
            stop = F.coalesce(F.array_min(F.filter(v["ends"], lambda e: e > s)), F.size(body))
            return F.struct(F.get(body, s).alias("key"), F.slice(body, s + 2, stop - s - 1).alias("value"))

        return F.transform(v["starts"], one)

    def found(body):
        return F.struct(body.alias("body"), places(body, is_inst).alias("starts"), places(body, lambda t: is_inst(t) | (t == V.ESEQ)).alias("ends"))

    last = lambda x: F.filter(x, lambda p, i: ~F.exists(F.slice(x, i + 2, F.size(x)), lambda q: q["key"] == p["key"]))
    body = bound(block, lambda b: cut_at(b, V.TAG_END, after=False))
    return F.map_from_entries(bound(bound(bound(body, found), pairs), last))


#: What makes the model state the whole system block before it plays.
THINKING = 689


def partial_system(key: Column, measures: Column, insts: Column, genre: Column, density: Column, length: Column, with_genre: Column, with_key: Column, thinking: Column) -> Column:
    """A system block with what the conditions ask for: <SYSTEM>, each instrument and, if density, its density, then, if
    asked for, number of measures, genre, key and <thinking>, <TAG_END>. insts: array of (inst, density)."""
    each = F.flatten(F.transform(insts, lambda x: F.when(density, F.array(x["inst"].cast("int"), (x["density"] + V.DENSE - 1).cast("int"))).otherwise(F.array(x["inst"].cast("int")))))
    some = lambda asked, token: F.when(asked, F.array(token.cast("int"))).otherwise(none())
    return F.concat(
        tokens(SYSTEM), each, some(length, measures + V.GMC - 1), some(with_genre, genre + V.GENRE), some(with_key, key + V.KEY), some(thinking, F.lit(THINKING)), tokens(V.TAG_END)
    )


def parsed_sample(sample: Column) -> Column:
    """A sample of generation taken apart: (task, prompt, condition, past, future, other, gold); null without <MGEN> or
    without a system block before it.

    Before <MGEN> stand blocks from their marker to <TAG_END> or the next marker; of a marker that comes again the last
    block counts. condition is the system block with its marker and end, past, future and other are maps of instruments
    to sequences (null if their block is missing), prompt goes up to <MGEN>. Which blocks there are tells the task. gold
    is what follows <MGEN>, without a system block at its start and without <TE>.
    """
    marks = {"system": SYSTEM, **MARKS}

    def block(v, mark: int) -> Column:
        # From behind the last of these markers to the next marker or end.
        start = F.array_max(F.filter(v["stops"], lambda i: F.get(v["head"], i) == mark))
        stop = F.coalesce(F.array_min(F.filter(v["stops"], lambda i: i > start)), F.size(v["head"]))
        return F.when(start.isNotNull(), F.slice(v["head"], start + 2, stop - start - 1))

    def answer(tail):
        end = F.array_position(tail, V.TAG_END).cast("int")
        said = F.when(F.get(tail, F.lit(0)) == SYSTEM, F.when(end > 0, F.slice(tail, end + 1, F.size(tail))).otherwise(none())).otherwise(tail)
        return F.filter(said, lambda t: t != V.TE)

    def told(v):
        has = {n: v[n].isNotNull() for n in marks}
        task = (
            F.when(has["past"] & has["future"], "infill").when(has["past"], "meta_past").when(has["future"], "meta_future")
            .when(has["const"], "inst_comp").otherwise("meta")
        )
        seqs = lambda x: F.when(x.isNotNull(), parsed_block(F.concat(x, tokens(V.TAG_END))))
        sample, at = v["sample"], v["at"]
        return F.when(
            (at > 0) & has["system"],
            F.struct(
                task.alias("task"), F.slice(sample, F.lit(1), at).alias("prompt"), F.concat(tokens(SYSTEM), v["system"], tokens(V.TAG_END)).alias("condition"),
                seqs(v["past"]).alias("past"), seqs(v["future"]).alias("future"), seqs(v["const"]).alias("other"),
                bound(F.slice(sample, at + 1, F.size(sample)), answer).alias("gold"),
            ),
        )

    def head(v):
        own = F.slice(v["sample"], F.lit(1), F.greatest(v["at"] - 1, F.lit(0)))
        return F.struct(v["sample"].alias("sample"), v["at"].alias("at"), own.alias("head"), places(own, lambda t: t.isin(V.TAG_END, *marks.values())).alias("stops"))

    given = bound(sample, lambda x: F.struct(x.alias("sample"), F.array_position(x, MGEN).cast("int").alias("at")))
    blocks_ = lambda v: F.struct(v["sample"].alias("sample"), v["at"].alias("at"), *[block(v, m).alias(n) for n, m in marks.items()])
    return bound(bound(bound(given, head), blocks_), told)


#: The marker of chords that are given.
CHORDS = 4


def tagged(seq: Column, start: int, end: int, with_tags: bool = True) -> Column:
    """The stretches of a sequence from a start tag to the next end tag, which do not overlap: of several starts before an
    end the first one counts. With or without the tags; an empty array if there are none."""
    places = lambda tag: F.filter(F.transform(seq, lambda t, i: F.when(t == tag, i)), lambda i: i.isNotNull())
    starts, ends = places(start), places(end)

    def one(e, k):
        before = F.coalesce(F.get(ends, k - 1), F.lit(-1))
        s = F.array_min(F.filter(starts, lambda x: (x > before) & (x < e)))
        cut = F.slice(seq, s + 1, e - s + 1) if with_tags else F.slice(seq, s + 2, e - s - 1)
        return F.when(s.isNotNull(), cut)

    return F.filter(F.transform(ends, one), lambda x: x.isNotNull())


def chord_windows(chords: DataFrame, lasts: DataFrame, size: int = 4) -> DataFrame:
    """(song, window, chords): the chords of the middle part of each window of three times `size` bars, bar by bar, each as
    its place, root, quality and bass, or a blank. chords: (song, measure, shift, event_id, r, q, b); lasts: (song, last),
    the last bar, of which a window needs one more than it holds."""
    one = F.array_sort(F.collect_list(F.struct("shift", "event_id", "r", "q", "b")))
    told = F.flatten(F.transform(one, lambda x: F.array((x["shift"] + V.SHIFT).cast("int"), x["r"].cast("int"), x["q"].cast("int"), x["b"].cast("int"))))
    own = chords.groupBy("song", F.col("measure").alias("bar")).agg(told.alias("t"))
    every = lasts.withColumn("bar", F.explode(F.sequence(F.lit(0), F.col("last"))))
    window = F.floor(F.col("bar") / size) - 1
    full = every.join(own, ["song", "bar"], "left").withColumn("window", window.cast("int")).where((F.col("window") >= 0) & (F.col("window") * size + 3 * size <= F.col("last")))
    bar = F.struct("bar", F.concat(tokens(V.SME), F.coalesce("t", tokens(V.BLANK))).alias("t"))
    return full.groupBy("song", "window").agg(F.flatten(F.transform(F.array_sort(F.collect_list(bar)), lambda x: x["t"])).alias("chords"))
