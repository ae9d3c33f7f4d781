"""Best-fit packing of token sequences by hierarchical residual packing."""

import json
import os
import sys
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table
from .text_words import split_words, word_hashes

#: Items that a task packs at once, items of a later group on average at most, groups that meet in one, fill that ends a bin.
BATCH, GROUP, FAN_IN, NEARLY_FULL = 100_000, 131_072, 16, 0.99
#: Words that a worker remembers at most: a power of two; some 60 bytes each.
CACHE = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TextIds:
    """Ids of a text as little-endian unsigned 32-bit bytes, by any tokenizer file; null has none."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([(x or b"").decode() for x in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]


#: What WordIds takes for granted: letters are lower-cased, nothing crosses white space, runs of letters stand alone.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_words(path: str) -> bool:
    """Whether a tokenizer file is of the kind that WordIds can take apart."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    normal, pre, model = (made.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps, cuts = normal.get("normalizers") or [], pre.get("pretokenizers") or [{}]
    return (
        [x.get("type") for x in steps] == _NORMAL
        and (steps[1].get("pattern"), steps[1].get("content")) == ({"Regex": r"\s+"}, " ")
        and [x.get("type") for x in cuts] == ["Split", "ByteLevel"]
        and cuts[0].get("pattern") == {"Regex": _SPLIT}
        and (cuts[0].get("behavior"), cuts[0].get("invert"), cuts[1].get("add_prefix_space")) == ("Removed", True, False)
        and (model.get("type"), model.get("end_of_word_suffix")) == ("BPE", "</w>")
        and not any(x["content"].isalpha() or " " in x["content"] for x in made.get("added_tokens") or [])
    )


class WordIds(TextIds):
    """The same ids, for tokenizers that splits_words() knows.

    Such a tokenizer gives a text the ids of its pieces between ASCII white space, one after the other, so each piece is
    looked up by a 64-bit hash, and only pieces not seen before are encoded. A piece of ASCII letters, but for a full
    stop or comma at its end, has the ids of its letters in lower case and those of the mark. What is remembered is
    bounded.
    """

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # For words of a-z alone, which the normalizer leaves as they are and white space parts.
        self.simple = Tokenizer.from_file(path)
        self.simple.normalizer, self.simple.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.added = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([self.tokenizer.id_to_token(k).endswith("</w>") for k in range(size)])
        self.marks = {c: super(WordIds, self).encode([c])[0] for c in (b".", b",")}
        self._forget()

    def _forget(self) -> None:
        """An empty table: places by hash, then the hash of each word, where its ids start in the pool, and how many."""
        self.table = np.full(4 * CACHE, -1, np.int32)
        self.hashes, self.starts, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each word in the table; -1 if it is not there."""
        mask = np.uint64(len(self.table) - 1)
        out, left, at = np.full(len(h), -1, np.int64), np.arange(len(h)), (h & mask).astype(np.int64)
        while len(left):
            slot = self.table[at]
            same = (slot >= 0) & (self.hashes[slot] == h[left]) if len(self.hashes) else np.zeros(len(left), bool)
            out[left[same]] = slot[same]
            going = (slot >= 0) & ~same
            left, at = left[going], (at[going] + 1) & int(mask)
        return out

    def _add(self, h: np.ndarray, ids: list[bytes]) -> None:
        """Words that are not in the table; h distinct."""
        number, size = np.arange(len(self.hashes), len(self.hashes) + len(h)), np.array([len(x) // 4 for x in ids], np.int64)
        start = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
        self.hashes, self.starts, self.counts = (np.concatenate(x) for x in ((self.hashes, h), (self.starts, start), (self.counts, size)))
        mask = len(self.table) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        while len(number):
            free = self.table[at] < 0
            self.table[at[free]] = number[free]
            lost = self.table[at] != number
            number, at = number[lost], (at[lost] + 1) & mask

    def _joined(self, words: list[bytes], tokenizer) -> list[bytes]:
        """Ids of words of letters, encoded as one text: each of them ends with the end of a word."""
        out = []
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                out += super().encode(part)
            else:
                raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
                out += [raw[x:y] for x, y in zip(at, at[1:])]
        return out

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """Ids of lower-case words that were not seen before."""
        ended = [w[-1:] in self.marks and w[:-1].isalpha() for w in words]
        bare = [w[:-1] if e else w for w, e in zip(words, ended)]
        letters = [k for k, w in enumerate(bare) if w.isalpha()]
        other = [k for k, w in enumerate(bare) if not w.isalpha() and w.decode().isalpha()]
        odd = sorted(set(range(len(words))).difference(letters, other))
        known = {}
        for at, tokenizer in ((letters, self.simple), (other, self.tokenizer)):
            fresh = list({bare[k] for k in at})
            known.update(zip(fresh, self._joined(fresh, tokenizer)))
        known.update(zip([words[k] for k in odd], super().encode([words[k] for k in odd])))
        return [known[w] + self.marks[whole[-1:]] if e else known[w] for w, e, whole in zip(bare, ended, words)]

    def _learn(self, low: bytes, data: np.ndarray, new: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add the words at these places. Those of a known word and a mark are put together."""
        marked = np.isin(data[ends - 1], np.frombuffer(b"".join(self.marks), np.uint8)) & (ends - starts > 1)
        number = np.full(len(new), -1)
        number[marked] = self._find(word_hashes(data, starts[marked], ends[marked] - 1))
        rest, ids = np.flatnonzero(number < 0), [b""] * len(new)
        for k in np.flatnonzero(number >= 0).tolist():
            word, n = low[starts[k] : ends[k]], number[k]
            if word[:-1].isalpha():
                ids[k] = self.pool[self.starts[n] : self.starts[n] + self.counts[n]].tobytes() + self.marks[word[-1:]]
            else:
                ids[k] = super().encode([word])[0]
        for k, found in zip(rest.tolist(), self._encoded([low[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist())])):
            ids[k] = found
        self._add(new, ids)

    def encode(self, texts) -> list[bytes]:
        raw = [x or b"" for x in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        low = b"".join(raw).lower()
        data = np.frombuffer(low, np.uint8)
        starts, ends, bounds = split_words(data, offsets)
        h = word_hashes(data, starts, ends)
        number = self._find(h)
        new, first = np.unique(h[number < 0], return_index=True)
        if len(new):
            at = np.flatnonzero(number < 0)[first]
            if len(self.hashes) + len(new) > CACHE:
                self._forget()
                new, at = np.unique(h, return_index=True)
                if len(new) > CACHE:
                    half = len(raw) // 2
                    return super().encode(raw) if not half else self.encode(raw[:half]) + self.encode(raw[half:])
            order = np.argsort(at)
            at, new = at[order], new[order]
            self._learn(low, data, new, starts[at], ends[at])
            number = self._find(h)
        counts = self.counts[number]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pool[np.repeat(self.starts[number] - upto[:-1], counts) + np.arange(upto[-1])]
        places = upto[bounds].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(places, places[1:])]
        # An added token is one in its own letters only, so texts that may have one are encoded as they are.
        if any(t in low for t in self.added):
            for k, x in enumerate(raw):
                if any(t in x.lower() for t in self.added):
                    out[k] = super().encode([x])[0]
        return out


def word_ids(path: str) -> TextIds:
    """The worker's encoder for this file; one task after another uses it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    held = sys.__dict__.setdefault("_word_ids", {})
    if path not in held:
        held[path] = WordIds(path) if splits_words(path) else TextIds(path)
    return held[path]


def token_pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and doc_tokens and ids, binary, if with_ids) of each row's pieces.

    A text is its ids followed by end_id; only more than capacity ids are cut, every capacity ids. Null is empty. Keys
    stay in Arrow arrays, so that large ones keep all digits beside a null.
    """
    path, end = tokenizer or default_tokenizer(), np.array([end_id], "<u4").tobytes()
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("doc_tokens", pa.int64()), ("ids", pa.binary())] if with_ids else []
    names = [key, *[n for n, _ in fields]]

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 512):
                part = whole.slice(at, 512)
                of, rows = [], []
                for k, ids in enumerate(word_ids(path).encode(part.column(1).to_pylist())):
                    ids += end
                    for piece in range(-(-len(ids) // (4 * capacity))):
                        own = ids[4 * capacity * piece : 4 * capacity * (piece + 1)]
                        of.append(k)
                        rows.append((piece, capacity * piece, len(own) // 4, zlib.crc32(own)) + ((len(ids) // 4, own) if with_ids else ()))
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), *columns], names)

    kinds = {pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.binary(): T.BinaryType()}
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(n, kinds[t]) for n, t in fields]])
    return docs.select(key, F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin: longest first, each into the fullest bin that has room."""
    n = len(lengths)
    bins, offsets, fills = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    room: dict[int, list[int]] = {}
    free = 0  # bit r is set where a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        above = free >> size
        if above:
            left = size + (above & -above).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                free &= ~(1 << left)
        else:
            left, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left -= size
        room.setdefault(left, []).append(b)
        free |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def settle(lengths: np.ndarray, capacity: int, last: bool):
    """best_fit() of a group's bins, and which of them the group hands on: those that ended in a bin not nearly full.

    Nothing is handed on in the last round. What is handed on has offset 0 and no bin (-1).
    """
    bins, offsets, fills = best_fit(lengths, capacity)
    up = np.zeros(len(lengths), bool) if last else (fills < NEARLY_FULL * capacity)[bins]
    return np.where(up, -1, bins), np.where(up, 0, offsets), up


def pack(pieces: DataFrame, length: str = "length", capacity: int = 4096) -> DataFrame:
    """pieces with sequence_id and offset: the sequence that takes a piece and the piece's place in it, from 0, gapless.

    Each partition packs its own pieces by best fit and emits the bins that are nearly full. The others are the items of
    the next round, which deals them by hash to one group for FAN_IN of the round before, and to more where they would be
    over GROUP items each, so a group's memory is bounded however many there are. An underfull bin of several pieces is
    first taken apart into bins of one: two pieces of 1,990 kept together would shut out two of 2,100. Underfull bins
    are closed in the last round only.

    Lengths are 1 to capacity; pieces of equal length are taken in the order they stand in. An empty table gives an empty
    one. Other columns stay, whatever their names; columns named sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    cells = pieces.rdd.getNumPartitions()
    # No column of pieces has a name of ours.
    seq, off, climbs = (x + "_" * max(map(len, names)) for x in ("sequence_id", "offset", "up"))

    def local(batches):
        part, made, wait, n = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal made, wait, n
            whole = pa.Table.from_batches(wait).combine_chunks()
            wait, n = [], 0
            bins, offsets, up = settle(whole[length].to_numpy().astype(np.int64), capacity, False)
            bins[up] = bins.max(initial=-1) + 1 + np.arange(up.sum())
            for name, column in ((seq, (part << 32) + made + bins), (off, offsets), (climbs, up)):
                whole = whole.append_column(name, pa.array(column))
            made += bins.max(initial=-1) + 1
            return whole.to_batches()

        for batch in batches:
            wait.append(batch)
            n += len(batch)
            if n >= BATCH:
                yield from flush()
        if n:
            yield from flush()

    new = [T.StructField(x, T.LongType()) for x in (seq, off)] + [T.StructField(climbs, T.BooleanType())]
    placed = cut(pieces.mapInArrow(local, T.StructType(pieces.schema.fields + new)))
    items = placed.where(F.col(climbs)).select(F.col(seq).alias("bin"), F.col(length).cast("long").alias("fill"))

    def merge(last: bool):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["fill", "bin"], kind="stable")
            bins, offsets, up = settle(pdf["fill"].to_numpy(np.int64), capacity, last)
            # A bin takes the name of its first item, the one at its start.
            name = pdf["bin"].to_numpy()
            first = ~up & (offsets == 0)
            head = np.zeros(bins.max(initial=-1) + 1, np.int64)
            head[bins[first]] = name[first]
            into = np.where(up, name, head[bins] if len(head) else name)
            return pdf.assign(into=into, shift=offsets, up=up)[["bin", "into", "shift", "up", "fill"]]

        return one

    moves = []
    while True:
        last = cells <= FAN_IN
        cells = -(-cells // FAN_IN)
        groups = max(cells, -(-items.count() // GROUP))
        dealt = items.withColumn("cell", F.pmod(F.xxhash64("bin", F.lit(len(moves))), F.lit(groups)))
        step = cut(dealt.groupBy("cell").applyInPandas(merge(last), "bin long, into long, shift long, up boolean, fill long"))
        moves.append(step.where("not up").select("bin", "into", "shift"))
        if last:
            break
        items = step.where("up").select("bin", "fill")
    # An item is moved once: in the round that does not hand it on.
    total = moves[0]
    for step in moves[1:]:
        total = total.unionByName(step)
    kept = [F.col(f"p.`{x}`") for x in names]
    stays = placed.alias("p").where(~F.col(climbs)).select(*kept, F.col(seq).alias("sequence_id"), F.col(off).alias("offset"))
    climbed = placed.where(F.col(climbs)).alias("p").join(total.alias("t"), F.col(f"p.{seq}") == F.col("t.bin"))
    return stays.unionByName(climbed.select(*kept, F.col("t.into").alias("sequence_id"), F.col("t.shift").alias("offset")))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and where they are packed. Null and empty texts have one piece, of the end id alone; null
    doc_ids and repeated rows stay; an empty table gives an empty one.
    """
    # Cut, so that a task needs one Python worker at a time.
    return pack(cut(token_pieces(docs)))
