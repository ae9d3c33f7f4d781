"""The token vocabulary: a table built from its layout, names for its ranges, and kinds of tokens of one's own."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First ids and sizes of the ranges (fixed layout).
SME, BLANK, TAG_END, ESEQ, TE, META = 49, 50, 2, 626, 627, 628
PAST, CONST, FUTURE = 3, 5, 6
SHIFT, PITCH, DUR, KEY, GMC, DENSE, GENRE = 51, 209, 337, 14, 629, 637, 647
RANGES = (
    ("pad", 0, 1), ("mark", 1, 8), ("inst", 9, 2), ("mark", 11, 3), ("key", 14, 35), ("bar", 49, 1), ("blank", 50, 1),
    ("shift", 51, 97), ("chord_root", 148, 20), ("chord_quality", 168, 19), ("chord_bass", 187, 22), ("pitch", 209, 128),
    ("duration", 337, 289), ("end", 626, 2), ("meta", 628, 1), ("measures", 629, 8), ("density", 637, 10),
    ("genre", 647, 42), ("mark", 689, 5),
)


#: Where ids of one's own begin.
OWN = max(first + n for _, first, n in RANGES)


@dataclass(frozen=True)
class TokenKind:
    """A kind of token of one's own: its name, how many values it has, and the value of a note as a column of the notes'
    columns; a note whose value is null or out of range has no such token."""

    name: str
    size: int
    value: Callable[[], Column]


def firsts(kinds) -> dict[str, int]:
    """First ids: kinds follow the vocabulary in their order, so that no id that is in use changes."""
    at, out = OWN, {}
    for kind in kinds:
        out[kind.name], at = at, at + kind.size
    return out


def encoded(kinds) -> list[Column]:
    """A token for each kind, or null."""
    first = firsts(kinds)
    return [F.when(kind.value().between(0, kind.size - 1), kind.value() + first[kind.name]) for kind in kinds]


def vocabulary(spark, kinds=()):
    """(token_id, kind, value): one row an id; value counts from 0 within its range. Ids beyond it mean nothing."""
    own = [(name, at, kind.size) for (name, at), kind in zip(firsts(kinds).items(), kinds)]
    rows = [(first + k, kind, k) for kind, first, size in (*RANGES, *own) for k in range(size)]
    return spark.createDataFrame(rows, "token_id int, kind string, value int")
