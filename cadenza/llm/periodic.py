"""Runs of repeated words: Lyndon arrays of two orders, with matched stretches used again (Ellert and Fischer).

A run is a stretch with smallest period p, at least 2p long, that cannot be made longer. Its words can be cut into equal
Lyndon words in the order of words or in the reverse one, and each of those is the longest Lyndon word at its place. So
all runs show up if every longest Lyndon word is continued to both sides. Words are only ever compared in order: they are
numbered by sorting, and neither fingerprints nor suffix structures are built.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .text_words import split_words

#: Bytes of text that a worker looks at together, but for longer texts.
BATCH = 1 << 21
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word data[starts[k]:ends[k]]: equal for equal words alone. Words are sorted by eight bytes at a
    time, filled up with blanks, which no word holds."""
    size, out, base = ends - starts, np.zeros(len(starts), np.int64), 0
    full = np.concatenate([data, np.full(8, 32, np.uint8)])
    eight = np.ndarray((len(full) - 7,), "<u8", full, strides=(1,))
    keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    fill = np.uint64(0x2020202020202020)
    left, seen, at = np.arange(len(starts)), np.zeros(len(starts), np.int64), 0
    while len(left):
        mask = keep[np.minimum(size[left] - at, 8)]
        values, number = np.unique((eight[starts[left] + at] & mask) | (fill & ~mask), return_inverse=True)
        if at:
            values, number = np.unique(seen * len(values) + number, return_inverse=True)
        longer = size[left] > at + 8
        out[left[~longer]] = base + number[~longer]
        base, at = base + len(values), at + 8
        left, seen = left[longer], number[longer]
    return out


def lyndon_array(s: list, n: int) -> tuple[list, list]:
    """For each i < n the next smaller suffix j and how many words the suffixes of i and j have in common.

    s[n] is smaller than all of s[:n]. Suffixes wait on a stack, each greater than the one below. Of a waiting i and the
    next j, known matches tell most of what a comparison would: what i has in common with the one above it, and that a
    stretch s[zone - d : top - d] == s[zone : top] found before makes the pair (i, j) the copy of (i - d, j - d). Only
    beyond top are words compared anew, so their comparisons grow with n and not with the lengths matched.
    """
    following, common, shared, below = [n] * n, [0] * n, [0] * n, [-1] * n
    zone = top = d = 0
    for j in range(1, n):
        i, m = j - 1, 0
        while True:
            if s[i + m] == s[j + m]:
                if j < top and i >= zone:
                    a, b = i - d, j - d
                    known = common[a] if following[a] == b else shared[b] if below[b] == a else 0
                    m = max(m, min(known, top - j))
                while s[i + m] == s[j + m]:
                    m += 1
                if j + m >= top:
                    zone, top, d = j, j + m, j - i
            if s[i + m] < s[j + m]:
                below[j], shared[j] = i, m
                break
            following[i], common[i] = j, m
            of_both, i = shared[i], below[i]
            if i < 0:
                break
            if of_both < m:
                below[j], shared[j] = i, of_both
                break
    return following, common


def runs_of(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of least or more among words, numbers of 0 or more, by start and period."""
    n, found = len(words), set()
    if n < least:
        return []
    top = max(words)
    for order in (words, [top - x for x in words]):
        s = [*order, -1]
        following, common = lyndon_array(s, n)
        # Likewise to the left: s[low:zone] == s[low + d : zone + d]. Lyndon words that start in it end in it.
        before, low, zone, d = [-1] * n, n, n, 0
        for k in range(n - 1, -1, -1):
            right = common[k]
            if not right:
                continue
            j, m = following[k], 0
            p = j - k
            if low < k and j <= zone and k + d < n and following[k + d] == j + d:
                m = max(0, min(before[k + d], k - low))
            most = min(k, p)
            while m < most and s[k - 1 - m] == s[j - 1 - m]:
                m += 1
            before[k] = m
            if k - m <= low:
                low, zone, d = k - m, k, p
            # Of a run's Lyndon words the first one is at less than a period from its start.
            if m < p <= m + right and m + p + right >= least:
                found.add((k - m, m + p + right, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_stretches(texts: np.ndarray, words: np.ndarray, least: int, rounds: int = 3) -> list[tuple[int, int]]:
    """Stretches (start, end), of least words or more, outside of which no word of a run lies.

    In a run each word stands twice at least, so words that stand once in their text part the stretches; and so on for
    the stretches themselves, some rounds."""
    at, group = np.arange(len(words)), texts
    for _ in range(rounds):
        if not len(at):
            break
        key = group * (words.max() + 1) + words[at]
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        twice = np.zeros(len(at), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        at, group = at[twice], group[twice]
        new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(group) > 0)])[: len(at)]
        group = np.cumsum(new)
        long = np.bincount(group)[group] >= least if len(at) else twice[:0]
        at, group = at[long], group[long]
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(at) else []
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(edges, edges[1:])]


def batches_of(batch, most: int = BATCH):
    """Parts of a batch of (key, text) with some most bytes of text each, one row at least."""
    size = np.cumsum([len(x) for x in (y or b"" for y in batch.column(1).to_pylist())])
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, most + (size[at - 1] if at else 0), "right")))
        yield batch.slice(at, to - at)
        at = to


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12, rewrite=None) -> DataFrame:
    """One row for each row of docs: key, n_words, runs, collapsed.

    Words are what stands between ASCII white space. runs has (start, length, period) of the runs of least words or
    more, by start and period; word numbers count from 0. collapsed has the words, one blank apart, without those that
    some run holds after its first period. rewrite(key, n) may give (a, p): words from a on are then those from a to
    a + p again and again. Null texts have no words; keys may be null or repeated. An empty table gives an empty one.
    """
    kind = docs.schema[key].dataType
    names = [key, "n_words", "runs", "collapsed"]
    of_runs = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def look(batch):
        keys, raw = batch.column(0), [x or b"" for x in batch.column(1).to_pylist()]
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts, ends, bounds = split_words(data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
        takes, again = np.arange(len(starts)), {}
        for k, value in enumerate(keys.to_pylist() if rewrite else ()):
            lo, n = int(bounds[k]), int(bounds[k + 1] - bounds[k])
            if made := rewrite(value, n):
                a, p = made
                takes[lo + a : lo + n] = lo + a + np.arange(n - a) % p
                again[k] = takes[lo : lo + n] - lo
        numbers = numbered(data, starts, ends)[takes]
        which = np.repeat(np.arange(len(raw)), np.diff(bounds))
        found = [[] for _ in raw]
        for a, b in repeated_stretches(which, numbers, least):
            # Small numbers, so that Python needs no new objects for them.
            own = np.unique(numbers[a:b], return_inverse=True)[1].tolist()
            if runs := runs_of(own, least):
                lo = int(bounds[which[a]])
                found[which[a]] += [(a - lo + s, length, p) for s, length, p in runs]
        texts = []
        for k, x in enumerate(raw):
            words = x.split()
            if k in again:
                words = [words[t] for t in again[k].tolist()]
            if found[k]:
                change = np.zeros(len(words) + 1, np.int64)
                for s, length, p in found[k]:
                    change[s + p] += 1
                    change[s + length] -= 1
                words = [words[t] for t in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
            texts.append(b" ".join(words))
        n_words = pa.array(np.diff(bounds), pa.int64())
        return pa.RecordBatch.from_arrays([keys, n_words, pa.array(found, of_runs), pa.array(texts, pa.binary()).cast(pa.string())], names)

    def run(batches):
        for whole in batches:
            for part in batches_of(whole):
                yield look(part)

    schema = T.StructType([T.StructField(key, kind), T.StructField("n_words", T.LongType())])
    schema = schema.add("runs", RUNS).add("collapsed", T.StringType())
    return docs.select(key, F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)


def planted(key, n: int):
    """Where the query has a document repeat itself: one in ten, by the CRC-32 of its decimal id. A null id has none."""
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = longest["length"], -longest["period"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-longest["start"]).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
