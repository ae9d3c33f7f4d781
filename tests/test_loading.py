"""Checked loading, chunks with metadata, and lengths from footers."""

import contextlib
import io

from pyspark.sql import functions as F

from cadenza.sources import loading as L

SCHEMA = "id long, tokens array<int>"


def test_states_and_counters(spark, tmp_path):
    rows = [
        ("a", '{"id": 1, "tokens": [1, 2]}'), ("b", '{"id": 2, "tokens": [1'), ("c", None), ("d", '{"id": 3, "tokens": []}'), ("e", "nonsense"),
        ("f", '{"id": 4, "tokens": "x"}'), ("g", '{"id": 5, "tokens": [' + "7, " * 200 + "7]}"), ("h", '{"id": 6, "tokens": null}'), ("i", '{"id": 7, "tokens": [9], "more": 1}'), ("j", ""),
    ]
    df = spark.createDataFrame(rows, "name string, line string").repartition(3)
    marked = L.checked(df, "line", SCHEMA, 100, "tokens is null or size(tokens) = 0".replace("tokens", "record.tokens"))
    assert {r["name"]: r["status"] for r in marked.collect()} == {
        "a": "ok", "b": "broken", "c": "broken", "d": "empty", "e": "broken", "f": "broken", "g": "oversize", "h": "empty", "i": "ok", "j": "broken",
    }
    assert {r["name"] for r in marked.collect() if r["record"] is not None} == {"a", "i"}
    ok, seen = L.counted(marked, "load")
    ok.write.parquet(f"{tmp_path}/ok")
    assert seen.get == {"ok": 2, "empty": 2, "broken": 5, "oversize": 1, "all": 10}
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/ok").select("record.id").collect()) == [1, 7]


def test_chunks_and_back(spark, tmp_path):
    spans = [("s", 0, 60, 0, 24, 100), ("s", 0, 62, 20, 50, 90), ("t", 1, 60, 47, 49, 3), ("t", 1, 61, 5, 5, 9)]
    df = spark.createDataFrame(spans, "song string, lane int, pitch int, start long, stop long, velocity int")
    meta = spark.createDataFrame([("s", (480, 96, [("piano",)])), ("t", (240, 192, []))], "song string, meta struct<ticks_per_beat int, steps_per_bar int, slots array<struct<name string>>>")
    L.write_chunks(L.chunk_rows(df, meta), f"{tmp_path}/c")
    back = L.spans_of_chunks(L.read_chunks(spark, f"{tmp_path}/c"))
    want = [("s", 0, 60, 0, 24, 100), ("s", 0, 62, 20, 24, 90), ("s", 0, 62, 24, 48, 90), ("s", 0, 62, 48, 50, 90), ("t", 1, 60, 47, 48, 3), ("t", 1, 60, 48, 49, 3)]
    assert sorted(map(tuple, back.collect())) == want
    some = L.read_chunks(spark, f"{tmp_path}/c", "meta.steps_per_bar = 96", ["song", "chunk", "meta.ticks_per_beat"])
    assert sorted(map(tuple, some.collect())) == [("s", k, 480) for k in range(3)]
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        some.explain("formatted")
    plan = told.getvalue()
    assert "EqualTo(meta.steps_per_bar,96)" in plan and "slots" not in plan.split("ReadSchema")[1].split("\n")[0] and "cells" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_lengths_from_footers(spark, tmp_path):
    rows = [(k, list(range(k % 5)) if k % 7 else None) for k in range(100)]
    spark.createDataFrame(rows, "song int, tokens array<int>").repartition(6).write.parquet(f"{tmp_path}/t")
    found = L.footer_counts(spark, f"{tmp_path}/t", "tokens")
    each = spark.read.parquet(f"{tmp_path}/t").groupBy(F.input_file_name().alias("path")).agg(F.count("*"), F.sum(F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0))))
    key = lambda r: (r[0].rsplit("/", 1)[1], r[1], r[2])
    assert sorted(map(key, found.collect())) == sorted(map(key, each.collect()))
    assert sum(r["values"] for r in found.collect()) == sum(len(t or []) for _, t in rows)
