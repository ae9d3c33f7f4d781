"""Names of keys, chords, programs and genres, on Columns."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the vocabulary, in its order.
ROOTS = ("C", "C#", "D", "D#", "E", "E#", "F", "F#", "G", "G#", "A", "A#", "B", "Cb", "Db", "Eb", "Fb", "Gb", "Ab", "Bb")
QUALITIES = ("None", "m", "7", "maj7", "m7", "dim", "aug", "m7b5", "b5", "sus2", "sus4", "6", "m6", "9", "maj9", "m9", "11", "13", "add9")
MAJOR_KEYS = ("C", "D", "E", "F", "G", "A", "B", "C#", "D#", "F#", "G#", "A#", "Db", "Eb", "Gb", "Ab", "Bb")
SHARPS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
#: Pitch classes of all spellings.
CLASSES = {n: k for k, n in enumerate(SHARPS)} | {"Db": 1, "Eb": 3, "Fb": 4, "E#": 5, "Gb": 6, "Ab": 8, "Bb": 10, "Cb": 11, "B#": 0}
FLATS = {"C#": "Db", "D#": "Eb", "F#": "Gb", "G#": "Ab", "A#": "Bb"}


def mapped(x: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x)


def chord_parts(chord: Column) -> tuple[Column, Column, Column]:
    """Root (the longest that fits; null if none does), quality and bass of a chord's name; None where there is none or it is
    unknown."""
    core = F.split_part(chord, F.lit("/"), F.lit(1))
    bass = F.when(F.contains(chord, F.lit("/")), F.concat(F.lit("/"), F.substring_index(chord, "/", -1))).otherwise("None")
    by_length = sorted(ROOTS, key=lambda x: -len(x))
    root = reduce(lambda a, r: a.when(F.startswith(core, F.lit(r)), F.lit(r)), by_length[1:], F.when(F.startswith(core, F.lit(by_length[0])), F.lit(by_length[0])))
    rest = F.substring(core, F.length(root) + 1, F.lit(100))
    return root, F.when(rest.isin(*QUALITIES), rest).otherwise("None"), bass


def key_token(tonic: Column, mode: Column) -> Column:
    """Name of a key in the vocabulary: - is a flat, other spellings of a key that is missing are tried, else Unknown."""
    t = F.regexp_replace(tonic, "-", "b")
    m = F.when(mode == "major", "M").otherwise("m")
    other = F.coalesce(mapped(t, FLATS | {v: k for k, v in FLATS.items()}), F.lit("?"))
    return F.when(t.isin(*MAJOR_KEYS), F.concat(t, m)).when(other.isin(*MAJOR_KEYS), F.concat(other, m)).otherwise("Unknown")


def transposed_key(tonic: Column, shift: Column, mode: Column) -> Column:
    """Key name of a tonic moved by half tones, in sharps."""
    k = F.pmod(mapped(tonic, CLASSES) + shift, F.lit(12))
    name = F.concat(F.get(F.array(*map(F.lit, SHARPS)), k.cast("int")), F.when(mode == "major", "M").otherwise("m"))
    return F.when(k.isNotNull(), name).otherwise("Unknown")


def in_flats(key: Column) -> Column:
    """A key's name with sharps in flats."""
    tonic = F.substring(key, F.lit(1), F.length(key) - 1)
    return F.concat(F.coalesce(mapped(tonic, FLATS), tonic), F.substring(key, -1, 1))


def human_count(n: Column) -> Column:
    """1234567 as 1.23M: thousands, millions and billions with two places."""
    short = lambda unit, name: F.concat(F.format_string("%.2f", n / unit), F.lit(name))
    return F.when(n >= 1e9, short(1e9, "B")).when(n >= 1e6, short(1e6, "M")).when(n >= 1e3, short(1e3, "K")).otherwise(n.cast("string"))


def noam_rate(step: Column, width: int, warmup: int) -> Column:
    s = F.greatest(step, F.lit(1)).cast("double")
    return F.lit(float(width)) ** -0.5 * F.least(s**-0.5, s * F.lit(float(warmup)) ** -1.5)


def cosine_rate(step: Column, warmup: int, total: int, most: float, least: float) -> Column:
    """Up to most in warmup steps, then down to least by half a cosine."""
    s = step.cast("double")
    share = F.least(F.lit(1.0), (s - warmup) / float(total - warmup))
    return F.when(s < warmup, most * s / float(warmup)).otherwise(least + (most - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * share)))
