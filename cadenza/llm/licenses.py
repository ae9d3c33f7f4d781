"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license notices."""

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

#: Fixed phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices of well-known licenses (fixed texts) and their labels. A block that holds enough of one's words has its label.
#: Of a template's words, those that tell it from others; a block without them does not match, whatever else it holds.
MARKS = ("mit", "apache", "nc", "noncommercial", "sharealike", "gnu")
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def block_words(text) -> list[bytes]:
    """Words of a text: runs of letters and digits of ASCII, A-Z lower-cased, and of all other characters."""
    return _WORD.findall((text or "").encode().lower())


def _needed(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def reach_of(templates=TEMPLATES, percent: int = 80) -> int:
    """Words that a stretch with a match has at most: those of the longest template, and those that a match may lack."""
    return -(-100 * max((len(block_words(x)) for _, x in templates), default=0) // percent)


def _windows(words: list[bytes], reach: int):
    """A line, or, if it is long, windows of twice the reach, each beginning in the middle of the one before."""
    return [words[k : k + 2 * reach] for k in range(0, max(1, len(words) - reach), max(1, reach))]


def _around_ends(lines: list[list[bytes]], reach: int):
    """For each end of a line inside a paragraph, the reach words before it in the line and the reach after it."""
    for k in range(len(lines) - 1):
        if lines[k]:
            after, at = [], k + 1
            while at < len(lines) and lines[at] and len(after) < reach:
                after += lines[at][: reach - len(after)]
                at += 1
            if after:
                yield lines[k][-reach:] + after


def token_counts(docs: DataFrame, tokens: set[bytes]) -> dict[bytes, int]:
    """How often each of these tokens stands in the whole table. tokens is bounded by the templates."""

    def run(frames):
        total = dict.fromkeys(tokens, 0)
        for pdf in frames:
            for text in pdf["text"]:
                for w in block_words(text):
                    if w in total:
                        total[w] += 1
        yield pd.DataFrame({"token": list(total), "n": list(total.values())})

    rows = docs.select("text").mapInPandas(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(tokens, 0) | {bytes(r["token"]): r["n"] for r in rows}


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES, percent: int = 80) -> DataFrame:
    """One row for each row of docs: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: places where a phrase's words stand one after the other. Besides, a label is given where a block holds
    percent % of the distinct words of one of its templates, and those of its words that are in MARKS. A block is a line,
    a window of a long line, or, for notices wrapped over lines, what stands around a line's end in its paragraph: reach
    words to each side, as many as the longest template has and the words that a match may lack. score is the largest share of a template that a
    block with a label holds, 1 with a base label and 0 without any. Null texts count as empty. Keys may be null or
    repeated; an empty table gives an empty one.

    The join is exact: words in the order of their frequency in docs, rarest first. A block can only meet the threshold
    if it has a word of the template's prefix (all but the needed ones less one), as many words as are needed, and, with
    its first common word at a place of the template, enough words of it after that.
    """
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sets = [(label, set(block_words(x))) for label, x in templates]
    reach = reach_of(templates, percent)
    count = token_counts(d, set().union(*(s for _, s in sets)))
    order = sorted(count, key=lambda w: (count[w], w))
    rank = {w: k for k, w in enumerate(order)}
    ordered = [(label, sorted(rank[w] for w in s)) for label, s in sets]
    prefix = {k for _, s in ordered for k in s[: len(s) - _needed(len(s), percent) + 1]}
    starts = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(re.escape(order[k]) for k in sorted(prefix)) + rb")(?![0-9a-z\x80-\xff])")
    wanted = [(tuple(p.encode().split()), label) for p, label in phrases]
    labels_of = [label for _, label in phrases]

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column(1).to_pylist():
                x = (x or "").encode().lower()
                w = _WORD.findall(x)
                joined = b" " + b" ".join(w) + b" "
                places, found = [], []
                for (phrase, label), name in zip(wanted, labels_of, strict=True):
                    needle, at, before, number = b" " + b" ".join(phrase) + b" ", -1, 0, 0
                    while (at := joined.find(needle, at + 1)) >= 0:
                        # Words before a place are counted on from the place before.
                        number, before = number + joined.count(b" ", before, at), at
                        places.append(number)
                        found.append(name)
                blocks = []
                if starts.search(x):
                    lines = [_WORD.findall(line) for line in x.split(b"\n")]
                    for part in (*(w for line in lines for w in _windows(line, reach)), *_around_ends(lines, reach)):
                        own = sorted({rank[t] for t in part if t in rank})
                        if own and not prefix.isdisjoint(own):
                            blocks.append(own)
                rows.append((len(w), len(places), min(places, default=None), max(places, default=None), sorted(set(found)), blocks))
            # Keys stay in Arrow arrays: large ones keep all digits beside a null.
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows), arrow)], names)

    names = ["key", "n_words", "n_base", "first_word", "last_word", "base", "blocks"]
    arrow = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.list_(pa.int32()))]
    kinds = [d.schema["key"].dataType] + [T.LongType()] * 4 + [T.ArrayType(T.StringType()), T.ArrayType(T.ArrayType(T.IntegerType()))]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, kinds)])
    read = cut(d.mapInArrow(run, schema).withColumn("has", F.xxhash64("blocks")))
    # Blocks with equal token sets are one block of the join.
    blocks = read.where(F.size("blocks") > 0).select(F.explode("blocks").alias("block")).distinct()
    posted = [
        (token, at, k, label, len(s), _needed(len(s), percent), s, [x for x in s if order[x].decode() in MARKS])
        for k, (label, s) in enumerate(ordered)
        for at, token in enumerate(s[: len(s) - _needed(len(s), percent) + 1])
    ]
    # Bounded by the templates, whatever the corpus.
    postings = docs.sparkSession.createDataFrame(posted, "token int, at int, template int, label string, size int, needed int, tokens array<int>, marks array<int>")
    probe = blocks.select("block", F.explode("block").alias("token"))
    candidates = probe.join(F.broadcast(postings), "token").where((F.size("block") >= F.col("needed")) & (F.col("size") - F.col("at") >= F.col("needed")))
    matched = candidates.withColumn("both", F.size(F.array_intersect("block", "tokens"))).where("both >= needed and size(array_except(marks, block)) = 0")
    per_block = matched.groupBy("block").agg(F.collect_set("label").alias("labels"), F.max(F.col("both") / F.col("size")).alias("share"))
    with_blocks = read.where(F.size("blocks") > 0).select("has", "blocks").distinct()
    by_text = (
        with_blocks.select("has", F.explode("blocks").alias("block"))
        .join(per_block, "block")
        .groupBy("has")
        .agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("more"), F.max("share").alias("share"))
    )
    hit = read.where(F.size("blocks") > 0).join(by_text, "has", "left")
    none = read.where(F.size("blocks") == 0).withColumn("more", F.lit(None).cast("array<string>")).withColumn("share", F.lit(None).cast("double"))
    every = hit.select(*none.columns).unionByName(none)
    all_labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return every.select(
        F.col("key").alias(key),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op7_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
