"""Fill-in-middle transformation: an Aho-Corasick scan for events, units counted from the gaps between them."""

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Marks of the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Characters that end or begin a unit.
BLANKS = "\t\n\v\f\r "


def automaton(marks=MARKS):
    """The worker's automaton of the blanks (value 0) and the marks (value 1); one task after another uses it."""
    import ahocorasick

    held = sys.__dict__.setdefault("_fim_automata", {})
    if marks not in held:
        made = ahocorasick.Automaton()
        for x in BLANKS:
            made.add_word(x, 0)
        for x in marks:
            made.add_word(x, 1)
        made.make_automaton()
        held[marks] = made
    return held[marks]


class Units:
    """The units of a text, by the places of its blanks alone: blanks and what follows them up to the next blank.

    Between two blanks that are not neighbours stands one word, so the k-th word ends where the k-th gap that is not
    empty ends. Blanks at the end of the text are a unit of their own.
    """

    def __init__(self, text: str, marks=MARKS):
        found = list(automaton(marks).iter(text))
        at = np.array([-1, *[e for e, mark in found if not mark], len(text)])
        self.size = len(text)
        self.marked = len(at) - 2 < len(found)
        self.ends = at[1:][np.diff(at) > 1]
        self.count = len(self.ends) + int(self.size > (self.ends[-1] if len(self.ends) else 0))

    def end(self, k: int) -> int:
        """Where the first k units end, in code points."""
        return 0 if k == 0 else int(self.ends[k - 1]) if k <= len(self.ends) else self.size


def draws(key, seed: int) -> list[int]:
    """Four numbers below 2^32 for a row: the first digits of the SHA-256 of seed and key."""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 50, suffix_first: int = 80, seed: int = 42, marks=MARKS
) -> DataFrame:
    """One row for each row of docs: key, n, form, prefix_chars, middle_chars, output.

    n is the number of units. Of 100 texts, rate are cut at two places between units, of these suffix_first get the form
    spm (suffix, prefix, middle) and the others psm; which ones and where is a matter of seed and key alone. Other texts
    are plain, as are empty texts (null is empty) and those that hold one of marks; their lengths are null. Rows with a
    null key are drawn as by an empty one; rows that repeat a key are drawn alike. An empty table gives an empty one.
    """
    kind = docs.schema[key].dataType
    names = [key, "n", "form", "prefix_chars", "middle_chars", "output"]

    def one(k, whole: str):
        u = Units(whole, marks)
        h1, h2, h3, h4 = draws(k, seed)
        if not whole or u.marked or h3 % 100 >= rate:
            return u.count, "plain", None, None, whole
        first, last = sorted((h1 % (u.count + 1), h2 % (u.count + 1)))
        a, b = u.end(first), u.end(last)
        prefix, middle, suffix = marks[0] + whole[:a], marks[2] + whole[a:b], marks[1] + whole[b:]
        if h4 % 100 < suffix_first:
            return u.count, "spm", a, b - a, suffix + prefix + middle
        return u.count, "psm", a, b - a, prefix + suffix + middle

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 512):
                part = whole.slice(at, 512)
                keys, texts = part.column(0), part.column(1).to_pylist()
                made = list(zip(*map(one, keys.to_pylist(), (x or "" for x in texts)), strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([keys, *map(pa.array, made, kinds)], names)

    schema = T.StructType(
        [T.StructField(key, kind)] + [T.StructField(n, t) for n, t in zip(names[1:], (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()))]
    )
    return docs.select(key, text).mapInArrow(run, schema)


def restored(output: Column, form: Column, marks=MARKS) -> Column:
    """The text that an output of fill_in_middle() was made of."""
    parts = F.split(output, "|".join(rf"\Q{x}\E" for x in marks), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = restored(F.col("output"), F.col("form"))
    digests = [F.sha2(x, 256).alias(n) for x, n in ((F.col("output"), "output_sha256"), (text, "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
