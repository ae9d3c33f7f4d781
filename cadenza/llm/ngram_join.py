"""N-gram Jaccard join by vertical partitioning.

n-grams are 64-bit hashes. A first pass keeps the documents of whose smallest hashes enough are in other documents. Of
these, n-grams that no other of them has are taken out. The order of the hashes is cut into fragments; the overlap of a
pair is counted in each fragment by itself, and the counts are summed. Candidates are pairs that meet among the rarest
n-grams of both, if what their sets hold in each fragment, and share there with a common neighbour, leaves room for a link.

Between tasks travel packed rows, a block of hashes of one batch of documents for one range of hashes. A batch names a
hash once, however many of its documents have it, so frequent n-grams and groups of copies do not pile up in a range.
"""

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, table, written
from .text_words import LOWER, mixed, split_words, word_hashes

#: Fragments of the order (a power of two); n-grams and documents of a batch at most; n-grams of a range aimed at.
FRAGMENTS, BATCH_GRAMS, BATCH_DOCS, RANGE_GRAMS = 8, 300_000, 8_000, 400_000
#: Rows of one or two numbers sent to every executor at most, wide rows, and bytes of fragments; beyond these they are
#: joined by hash.
NAMED, WIDE, HELD = 200_000, 20_000, 4_000_000
#: Ratio of two set sizes of neighbouring size classes.
CLASS = 1.05
_IDX = 13
_NOBODY = (1 << _IDX) - 1
_FACTORS = np.random.default_rng(20240301).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-grams of the texts data[offsets[k]:offsets[k + 1]]."""
    at = int(offsets[0])
    data, offsets = LOWER[data[at : int(offsets[-1])]], offsets.astype(np.int64) - at
    starts, ends, bounds = split_words(data, offsets)
    w = word_hashes(data, starts, ends)
    grams = np.zeros(0, np.uint64)
    if len(w) >= n:
        grams = w[: len(w) - n + 1] * _FACTORS[0]
        for j in range(1, n):
            grams += w[j : j + len(grams)] * _FACTORS[j]
        grams = mixed(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            out.append(g if len(g) < 2 or (g[1:] != g[:-1]).all() else np.unique(g))
        elif b > a:
            short = (w[a:b] * _FACTORS[8 : 8 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(grams[:0])
    return out


def shingles(texts, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-grams of each UTF-8 text; null and texts without words give none.

    A-Z are lower-cased, words are what stands between ASCII white space; a text of fewer than n words is one n-gram.
    """
    raw = [x or b"" for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return _sets(np.frombuffer(b"".join(raw), np.uint8), offsets, n)


def _read(batches, n: int, piece: int = 1 << 20):
    """(key or None, set) for each row of Arrow batches of key and text, a few texts at a time."""
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        _, places, raw = texts.buffers()
        offsets = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
        k = 0
        while k < len(keys):
            to = max(k + 1, int(np.searchsorted(offsets, int(offsets[k]) + piece, "right")) - 1)
            to = min(to, len(keys))
            yield from zip(keys[k:to], _sets(data, offsets[k : to + 1], n), strict=True)
            k = to


def needed(n, percent: int):
    """Least overlap of a set of n with any set it can link with."""
    return (percent * n + 99) // 100


def posted(n: int, percent: int) -> int:
    """How many of a set's smallest hashes the first pass looks at: enough that one, and n div 9 more, must be common."""
    return min(n, n - needed(n, percent) + 1 + n // 9)


def _signature(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _rows(rows: list, names: list[str]) -> pa.RecordBatch:
    kinds = {"r": pa.int32(), "batch": pa.int64(), "kind": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kinds.get(c, pa.binary())) for k, c in enumerate(names)], names)


def _range_bits(grams: float) -> int:
    return max(4, min(30, math.ceil(math.log2(max(1.0, grams / RANGE_GRAMS)))))


def _slices(top: np.ndarray):
    """(value, from, to) of the runs of a sorted array."""
    at = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])) if len(top) else []
    return zip([int(top[a]) for a in at], at, [*at[1:], len(top)])


def _survey(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc, n, sig, live) for each row of docs (key, text): the size and signature of its set, and whether so many of its
    posted hashes are in other documents that it can have a link. live errs on the side of true.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = _range_bits(size / 6)
    names = ["r", "batch", "kind", "a", "b", "c", "d"]
    schema = "r int, batch long, kind int, a binary, b binary, c binary, d binary"

    def post(batches):
        part, made = TaskContext.get().partitionId(), 0
        keys, sizes, sigs, heads, many = [], [], [], [], 0

        def flush():
            nonlocal made, keys, sizes, sigs, heads, many
            name = (part << 32) + made
            lengths = [0 if k is None else len(h) for k, h in zip(keys, heads)]
            at = np.repeat(np.arange(len(keys), dtype=np.uint64), lengths)
            grams = np.concatenate([h[:c] for h, c in zip(heads, lengths)])
            packed = np.sort((grams >> np.uint64(_IDX) << np.uint64(_IDX)) | at)
            token = packed >> np.uint64(_IDX)
            same = token[1:] == token[:-1]
            multi = np.zeros(len(token), bool)
            multi[1:] |= same
            multi[:-1] |= same
            first = np.ones(len(token), bool)
            first[1:] = ~same
            local = np.bincount((packed[multi] & np.uint64(_NOBODY)).astype(np.int64), minlength=len(keys)).astype("<i4")
            # A hash of several documents of the batch is known to be shared; it is named once, for other batches.
            packed[multi & first] |= np.uint64(_NOBODY)
            sent = packed[~multi | first]
            low = ((sent >> np.uint64(_IDX)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            who = (sent & np.uint64(_NOBODY)).astype("<u2")
            ids = np.array([0 if k is None else k for k in keys], "<i8")
            nulls = np.array([k is None for k in keys], "<u1")
            rows = [(name % (1 << bits), name, 0, ids.tobytes() + nulls.tobytes(), np.array(sizes, "<i4").tobytes(), b"".join(sigs), local.tobytes())]
            rows += [(r, name, 1, low[a:b].tobytes(), who[a:b].tobytes(), None, None) for r, a, b in _slices(sent >> np.uint64(64 - bits))]
            made += 1
            keys, sizes, sigs, heads, many = [], [], [], [], 0
            return _rows(rows, names)

        for key, s in _read(batches, n):
            keys.append(key)
            sizes.append(len(s))
            sigs.append(_signature(s))
            heads.append(s[: posted(len(s), percent)].copy())
            many += len(heads[-1])
            if many > BATCH_GRAMS or len(keys) >= BATCH_DOCS:
                yield flush()
        if keys:
            yield flush()

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = pdf[pdf["kind"] == 0]
        posts = pdf[pdf["kind"] == 1]
        low = [np.frombuffer(x, "<u4") for x in posts["a"]]
        if not low:
            return kept
        ordered = np.sort((np.concatenate(low).astype(np.uint64) << np.uint64(32)) | np.arange(sum(map(len, low)), dtype=np.uint64))
        same = (ordered[1:] >> np.uint64(32)) == (ordered[:-1] >> np.uint64(32))
        multi = np.zeros(len(ordered), bool)
        multi[1:] |= same
        multi[:-1] |= same
        hit = np.zeros(len(ordered), bool)
        hit[(ordered[multi] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
        rows, at = [], 0
        for batch, who in zip(posts["batch"], posts["b"]):
            who = np.frombuffer(who, "<u2")
            found = who[hit[at : at + len(who)] & (who != _NOBODY)]
            at += len(who)
            if len(found):
                rows.append((0, batch, 2, None, found.tobytes(), None, None))
        return pd.concat([kept, pd.DataFrame(rows, columns=names)]) if rows else kept

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["kind"] == 0].iloc[0]
        sizes = np.frombuffer(own["b"], "<i4")
        ids, nulls = np.frombuffer(own["a"][: 8 * len(sizes)], "<i8"), np.frombuffer(own["a"][8 * len(sizes) :], "<u1")
        common = np.frombuffer(own["d"], "<i4").astype(np.int64)
        hits = [np.frombuffer(x, "<u2") for x in pdf.loc[pdf["kind"] == 2, "b"]]
        if hits:
            common = common + np.bincount(np.concatenate(hits), minlength=len(sizes))
        wide = sizes.astype(np.int64)
        spare = wide - needed(wide, percent)
        least = np.minimum(wide, spare + 1 + wide // 9) - spare
        return pd.DataFrame(
            {
                "doc": pd.array(ids, "Int64").copy() if not nulls.any() else pd.array(np.where(nulls, None, ids), "Int64"),
                "n": wide,
                "sig": [own["c"][k : k + 16] for k in range(0, 16 * len(sizes), 16)],
                "live": (wide > 0) & (nulls == 0) & (common >= least),
            }
        )

    posts = docs.mapInArrow(post, schema)
    hits = posts.groupBy("r").applyInPandas(shared, schema)
    return hits.groupBy("batch").applyInPandas(count, "doc long, n long, sig binary, live boolean")


def _small(df: DataFrame, rows: int = NAMED) -> DataFrame:
    """df, to be sent to every executor if it has few rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _fragment(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(65 - FRAGMENTS.bit_length())).astype(np.int64)


def _reduced(docs: DataFrame, n: int, percent: int, grams: int) -> DataFrame:
    """(node, sig, n, m, sizes, grams) for the sets of docs (key, text) that can have a link: without the n-grams that no
    other set has, m remain, ordered by powers of two of their document frequency, rarest first, then by hash. sizes:
    how many of them each fragment has. grams: how many n-grams docs have in all, about.
    """
    bits = _range_bits(grams)

    def collect(batches):
        part, made = TaskContext.get().partitionId(), 0
        held, many = [], 0
        names = ["batch", "sigs", "sizes", "grams"]

        def flush():
            nonlocal made, held, many
            row = ((part << 32) + made, b"".join(map(_signature, held)), np.array([len(s) for s in held], "<i4").tobytes(), np.concatenate(held).astype("<u8").tobytes())
            made, held, many = made + 1, [], 0
            return _rows([row], names)

        for _, s in _read(batches, n):
            if len(s):
                held.append(s)
                many += len(s)
                if many > BATCH_GRAMS or len(held) >= BATCH_DOCS:
                    yield flush()
        if held:
            yield flush()

    sets = written(docs.mapInArrow(collect, "batch long, sigs binary, sizes binary, grams binary"))

    def ask(frames):
        for pdf in frames:
            for batch, raw in zip(pdf["batch"], pdf["grams"]):
                values, counts = np.unique(np.frombuffer(raw, "<u8"), return_counts=True)
                rows = [(r, batch, values[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for r, a, b in _slices(values >> np.uint64(64 - bits))]
                yield pd.DataFrame(rows, columns=["r", "batch", "grams", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(x, "<u8") for x in pdf["grams"]]
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["counts"]]).astype(np.int64)
        values, at = np.unique(np.concatenate(own), return_inverse=True)
        frequency = np.bincount(at, weights=counts).astype(np.int64)[at]
        rows, k = [], 0
        for batch, x in zip(pdf["batch"], own):
            f = frequency[k : k + len(x)]
            k += len(x)
            if (f > 1).any():
                rows.append((batch, x[f > 1].tobytes(), f[f > 1].astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["batch", "grams", "counts"])

    answers = sets.select("batch", "grams").mapInPandas(ask, "r int, batch long, grams binary, counts binary")
    answers = answers.groupBy("r").applyInPandas(answer, "batch long, grams binary, counts binary")

    def take(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own) and len(told):
            values = np.concatenate([np.frombuffer(x, "<u8") for x in told["grams"]])
            counts = np.concatenate([np.frombuffer(x, "<u4") for x in told["counts"]])
            order = np.argsort(values)
            values, power = values[order], np.frexp(counts[order].astype(float))[1].astype(np.uint8)
            sizes = np.frombuffer(own["sizes"].iloc[0], "<i4")
            flat, sigs = np.frombuffer(own["grams"].iloc[0], "<u8"), own["sigs"].iloc[0]
            at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
            known = values[at] == flat
            start = 0
            for k, size in enumerate(sizes.tolist()):
                mask = known[start : start + size]
                m = int(mask.sum())
                if m >= needed(size, percent):
                    g, p = flat[start : start + size][mask], power[at[start : start + size][mask]]
                    by = np.lexsort((g, p))
                    rows.append((sigs[16 * k : 16 * k + 16], size, m, np.bincount(_fragment(g), minlength=FRAGMENTS), g[by].tobytes()))
                start += size
        return pd.DataFrame(rows, columns=["sig", "n", "m", "sizes", "grams"])

    schema = "sig binary, n long, m long, sizes array<int>, grams binary"
    kept = sets.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(take, schema)
    return written(kept.dropDuplicates(["sig"]).withColumn("node", F.monotonically_increasing_id()))


def _postings(reduced: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, m, place, as_small): the prefixes of the sets in the order of frequency.

    Of a pair with enough overlap, the larger set has a common n-gram among its first m - needed + 1, and the smaller
    one, as their overlap is at least 2 p n / (100 + p) of its n, among fewer: as_small tells which.
    """

    def run(frames):
        for pdf in frames:
            parts = []
            for node, n, m, raw in zip(pdf["node"], pdf["n"], pdf["m"], pdf["grams"]):
                large, small = m - needed(n, percent) + 1, m + (-2 * percent * n // (100 + percent)) + 1
                place = np.arange(large)
                parts.append((np.frombuffer(raw[: 8 * large], "<i8"), np.full(large, node), np.full(large, n), np.full(large, m), place, place < small))
            if parts:
                yield pd.DataFrame(dict(zip(["token", "node", "n", "m", "place", "as_small"], map(np.concatenate, zip(*parts)))))

    return reduced.select("node", "n", "m", "grams").mapInPandas(run, "token long, node long, n long, m long, place long, as_small boolean")


def _hubs(postings: DataFrame, percent: int) -> DataFrame:
    """(node, hub): each set with the hub that most of its posting lists have. A list's hub is the set of which the largest
    share is in other sets: the source of a group of near copies.
    """
    hub = F.max(F.struct((F.col("m") / F.col("n")).alias("share"), (-F.col("node")).alias("least"), F.col("n"))).alias("hub")
    lists = postings.groupBy("token").agg(hub, F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    met = postings.join(lists.select("token", (-F.col("hub.least")).alias("to"), F.col("hub.n").alias("size")), "token").where("node <> to")
    fits = met.where(100 * F.least("n", "size") >= percent * F.greatest("n", "size"))
    return fits.groupBy("node", "to").count().groupBy("node").agg(F.max_by("to", F.struct("count", -F.col("to"))).alias("hub"))


def _least(a: str, b: str) -> F.Column:
    """Sum over the fragments of the lesser of two arrays' numbers."""
    parts = [F.least(F.get(a, F.lit(k)), F.get(b, F.lit(k))) for k in range(FRAGMENTS)]
    return reduce(lambda x, y: x + y, parts)


def _across(postings: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of sets of different components that meet in their prefixes and can still link.

    nodes: node, component, sizes (by fragment), rest and common: what the set shares with its hub in each fragment, and
    what it does not. Size classes rule out pairs by an equality, before they are made. An overlap is, in each fragment,
    at most the smaller of the two sizes; with a hub of both, what the two share with it is at most the smaller of what
    each does, and so for what they share beside it. So members of a group of near copies that differ from its hub at
    too many places of their own are told apart without comparing them.
    """
    tagged = postings.join(_small(nodes, WIDE), "node")
    lists = tagged.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    open_ = written(tagged.join(lists, "token", "left_semi"))

    def level(size):
        return F.floor(F.log(CLASS, size)).cast("int")

    def side(df: DataFrame, z: str, *more) -> DataFrame:
        names = {"node": z, "n": f"n{z}", "m": f"m{z}", "place": f"p{z}", "component": f"c{z}", "sizes": f"s{z}", "hub": f"h{z}", "common": f"o{z}", "rest": f"r{z}"}
        return df.select("token", *[F.col(k).alias(v) for k, v in names.items()], *more)

    p = F.lit(percent)
    # |x| + |y| is at most (100 + p) / p times the overlap, and that is at most m of either.
    x = side(open_.where("as_small"), "x", level(F.col("n")).alias("level"))
    most = F.least(F.col("n"), F.floor((100 + p) * F.col("m") / p).cast("long") - F.col("n"))
    y = open_.withColumn("lo", F.ceil(p * F.col("n") / 100).cast("long")).withColumn("hi", most).where("lo <= hi")
    y = side(y, "y", "lo", "hi", F.explode(F.sequence(level(F.col("lo")), level(F.col("hi")))).alias("level"))
    room = lambda overlap: p * (F.col("nx") + F.col("ny")) <= (100 + p) * overlap
    fits = (F.col("cx") != F.col("cy")) & F.col("nx").between(F.col("lo"), F.col("hi")) & room(F.col("mx"))
    fits &= (F.col("nx") < F.col("ny")) | (F.col("x") < F.col("y"))
    # Before a common n-gram there are at most as many as before it in either set, and behind it likewise.
    fits &= room(F.least("px", "py") + F.least(F.col("mx") - F.col("px"), F.col("my") - F.col("py")))
    fits &= room(_least("sx", "sy"))
    fits &= F.coalesce(F.col("hx") != F.col("hy"), F.lit(True)) | room(_least("ox", "oy") + _least("rx", "ry"))
    pairs = x.join(y, ["token", "level"]).where(fits)
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _fragments(reduced: DataFrame) -> DataFrame:
    """(node, fragment, n, grams): the part of each set in each fragment of the order, sorted by hash."""

    def run(frames):
        for pdf in frames:
            rows = []
            for node, n, g in zip(pdf["node"], pdf["n"], pdf["grams"]):
                h = np.sort(np.frombuffer(g, "<u8"))
                rows += [(node, f, n, h[a:b].tobytes()) for f, a, b in _slices(_fragment(h))]
            yield pd.DataFrame(rows, columns=["node", "fragment", "n", "grams"])

    return reduced.select("node", "n", "grams").mapInPandas(run, "node long, fragment int, n long, grams binary")


@F.pandas_udf(T.LongType())
def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Partial overlap of two sets in one fragment."""

    def one(x, y):
        x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        x, y = (x, y) if len(x) >= len(y) else (y, x)
        return int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int64")


def _compared(pairs: DataFrame, reduced: DataFrame, percent: int) -> DataFrame:
    """(a, b, common, link) for pairs (a, b): the overlap in each fragment, and whether their sum meets the threshold.

    Pairs without any common n-gram may be missing.
    """
    pairs = written(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    parts = written(_fragments(reduced.join(_small(ids), "node", "left_semi")))
    held = parts.agg(F.coalesce(F.sum(F.length("grams") + 64), F.lit(0))).first()[0]
    small = F.broadcast if held <= HELD else lambda x: x
    each = pairs.withColumn("fragment", F.explode(F.array(*[F.lit(k) for k in range(FRAGMENTS)])))
    left = parts.select(F.col("node").alias("a"), "fragment", F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = parts.select(F.col("node").alias("b"), "fragment", F.col("n").alias("nb"), F.col("grams").alias("gb"))
    joined = each.join(small(left), ["a", "fragment"]).join(small(right), ["b", "fragment"])
    partial = joined.select("a", "b", "na", "nb", "fragment", _overlap("ga", "gb").alias("part"))
    counts = [F.sum(F.when(F.col("fragment") == k, F.col("part")).otherwise(0)).cast("int") for k in range(FRAGMENTS)]
    total = partial.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("part").alias("both"), F.array(*counts).alias("common"))
    link = 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))
    return written(total.select("a", "b", "common", link.alias("link")))


def _pair(x: str, y: str) -> list:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id) for each row of docs. Keys are integers.

    Documents link when 100 * |intersection| >= percent * |union| of their sets of word n-grams; component_id is the
    smallest key reachable by links. Null and empty texts, and those without words, have n_shingles 0 and their own
    key; rows with a null key have a null component. Rows that repeat a key are documents of their own with that key. An
    empty table gives an empty one.

    No link between different texts is lost, and large groups of copies give no pairs of all with all: documents with
    equal sets are one node; every node is first compared with one hub of its posting lists, which joins near copies to
    their source; then, wherever a list still has members of different components, the pairs across components that
    sizes and prefixes allow are compared.
    """
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    stats = written(_survey(d, n, percent))
    groups = written(stats.where("live").groupBy("sig").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n")))
    chosen = groups.select(F.col("rep").alias("key"))
    grams = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    reduced = _reduced(d.join(_small(chosen), "key", "left_semi"), n, percent, grams)
    postings = written(_postings(reduced, percent))
    hubs = written(_hubs(postings, percent))
    tested = _compared(hubs.select(*_pair("node", "hub")).distinct(), reduced, percent)
    named = cut(connected_components(tested.where("link").select("a", "b")))
    # A hub is its own neighbour, with all that it holds.
    near = hubs.select("node", "hub", *_pair("node", "hub")).join(tested.drop("link"), ["a", "b"]).select("node", "hub", "common")
    heads = hubs.select(F.col("hub").alias("node")).distinct().withColumn("head", F.lit(True))
    tags = reduced.select("node", "sizes").join(named, "node", "left").join(near, "node", "left").join(heads, "node", "left")
    tags = tags.select(
        "node",
        F.coalesce("component", "node").alias("component"),
        "sizes",
        F.when(F.col("head"), F.col("node")).otherwise(F.col("hub")).alias("hub"),
        F.when(F.col("head"), F.col("sizes")).otherwise(F.col("common")).alias("common"),
    )
    tags = written(tags.withColumn("rest", F.zip_with("sizes", "common", lambda x, y: x - y)))
    more = _compared(_across(postings, tags, percent), reduced, percent).where("link")
    # Links across components join components.
    own = lambda side: named.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    over = more.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = connected_components(over)
    nodes = reduced.select("node", "sig").join(named, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    nodes = nodes.join(second.withColumnRenamed("node", "c"), "c", "left").select("sig", F.coalesce("component", "c").alias("c"))
    with_reps = written(groups.join(nodes, "sig", "left"))
    least = with_reps.where("c is not null").groupBy("c").agg(F.min("rep").alias("least"))
    found = with_reps.join(least, "c", "left").select("sig", F.coalesce("least", "rep").alias("component"), "copies", "rep")
    grouped = written(found.where("copies > 1 or component <> rep").select("sig", "component"))
    return stats.join(_small(grouped), "sig", "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("live"), F.coalesce("component", "doc")).otherwise(F.col("doc")).alias("component_id")
    )


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component; of an empty table, nothing. Rows with a null doc_id stay.

    Documents go by doc_id, so rows that repeat one stay or go together.
    """
    names = docs.columns
    found = jaccard_components(docs.select("doc_id", "text"))
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*names)
