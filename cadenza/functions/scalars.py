"""Scalar functions on Columns: hashes, keys, distances, rewards."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pitch classes of the major scale, and of natural minor with the leading tone (fixed values).
MAJOR = (0, 2, 4, 5, 7, 9, 11)
MINOR = (0, 2, 3, 5, 7, 8, 10, 11)
#: Krumhansl-Kessler key profiles (published values).
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def md5_mod(text: Column, n: int) -> Column:
    """The whole MD5 of a text, as a number, modulo n (n below 2^31): eight hex digits at a time."""
    digest = F.md5(text)
    part = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    return reduce(lambda a, k: (a * F.lit(4294967296) + part(k)) % n, range(4), F.lit(0).cast("long"))


def split_of(song: Column, buckets: int = 1000, val: int = 10, test: int = 10) -> Column:
    """train, val or test by the MD5 of a song's name: the same song always goes to the same side."""
    b = md5_mod(song, buckets)
    return F.when(b < buckets - val - test, "train").when(b < buckets - test, "val").otherwise("test")


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def mirex(gold_tonic: Column, gold_minor: Column, tonic: Column, minor: Column) -> Column:
    """1 for the key itself, 0.5 for its fifth, 0.3 for the relative, 0.2 for the parallel key, else 0."""
    up = F.pmod(tonic - gold_tonic, F.lit(12))
    relative = F.when(gold_minor, up == 3).otherwise(up == 9)
    return (
        F.when((up == 0) & (minor == gold_minor), F.lit(1.0))
        .when((minor == gold_minor) & up.isin(5, 7), F.lit(0.5))
        .when((minor != gold_minor) & relative, F.lit(0.3))
        .when((minor != gold_minor) & (up == 0), F.lit(0.2))
        .otherwise(F.lit(0.0))
    )


def key_relation(gold_tonic: Column, gold_minor: Column, tonic: Column, minor: Column) -> Column:
    score = mirex(gold_tonic, gold_minor, tonic, minor)
    return (
        F.when(score == 1.0, "correct").when(score == 0.5, "fifth").when(score == 0.3, "relative").when(score == 0.2, "parallel").otherwise("other")
    )


def in_scale(pitch: Column, tonic: Column, minor: Column) -> Column:
    step = F.pmod(pitch - tonic, F.lit(12))
    return F.when(minor, step.isin(*MINOR)).otherwise(step.isin(*MAJOR))


def fold_pitch(pitch: Column) -> Column:
    """A pitch moved by octaves into 0..127."""
    return F.when(pitch > 127, pitch - 12 * F.ceil((pitch - 127) / 12)).when(pitch < 0, pitch + 12 * F.ceil(-pitch / 12)).otherwise(pitch).cast("int")


def clamp_duration(start: Column, end: Column) -> Column:
    """At least 1 tick; more than 288 becomes 287."""
    d = F.greatest(F.abs(end - start), F.lit(1))
    return F.when(d > 288, F.lit(287)).otherwise(d).cast("int")


def ordinal_distance(a: Column, b: Column, span: float) -> Column:
    """Distance of two grades as a share of span, 1 at most; a missing grade is at distance 1."""
    return F.coalesce(F.least(F.lit(1.0), F.abs(a - b) / F.lit(float(span))), F.lit(1.0))


def attribute_score(distance: Column, bonus: float, penalty: float) -> Column:
    return F.lit(bonus) - F.lit(bonus + penalty) * clamp(distance, 0.0, 1.0)


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b|; two empty sets are at distance 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def similarity_reward(similarity: Column, weight: float = 0.5, center: float = 0.75, steep: float = 12.0) -> Column:
    """0 up to similarity 0.5, then a sigmoid around center down to -weight at similarity 1."""
    s = lambda x: 1 / (1 + F.exp(-F.lit(steep) * (x - F.lit(center))))
    low, high = s(F.lit(0.5)), s(F.lit(1.0))
    return F.when(similarity <= 0.5, F.lit(0.0)).otherwise(-F.lit(weight) * (s(F.least(F.lit(1.0), similarity)) - low) / (high - low))


def discriminator_reward(logit: Column, span: float = 8.0) -> Column:
    """1 at -span / 2, 0 at span / 2, linear between."""
    return clamp(F.lit(0.5) - logit / F.lit(span), 0.0, 1.0)


def smoothstep(x: Column, low: float, high: float) -> Column:
    t = clamp((x - F.lit(low)) / F.lit(high - low), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def rank_reward(rank: Column, n: Column, bonus: float, penalty: float) -> Column:
    """bonus for the first, 0 for the second, then linearly down to -penalty for the last of n; -penalty for what is not
    ranked, and from the third on where there are three or fewer."""
    down = -F.lit(penalty) * (rank - 2) / F.nullif(n - 2, F.lit(0))
    lost = rank.isNull() | (rank > n)
    return F.when(lost, F.lit(-penalty)).when(rank == 1, F.lit(bonus)).when(rank == 2, F.lit(0.0)).when(n <= 3, F.lit(-penalty)).otherwise(down)
