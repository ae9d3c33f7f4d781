"""Messages to notes against a queue, songs as files and back, and a sink that leaves no half files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import notes as N
from cadenza.sources import midi as M


def played(messages, drums=9):
    """One message after the other, with queues of what is held by keys and by the pedal."""
    out, keys, pedal, down, program, last = [], {}, {}, {}, {}, 0

    def end(note, key, tick):
        start, velocity, p = note
        out.append((key[0], key[1], velocity, p, start, max(tick, start + 1)))

    for _, tick, kind, channel, a, b in messages:
        key, last = (channel, a), tick
        if kind == "program":
            program[channel] = a
        elif kind == "control" and a == 64 and channel != drums:
            if down.get(channel) and b < 64:
                for k in [k for k in pedal if k[0] == channel]:
                    for note in pedal.pop(k):
                        end(note, k, tick)
            down[channel] = b >= 64
        elif kind == "on":
            for note in pedal.pop(key, []):
                end(note, key, tick)
            keys.setdefault(key, []).append((tick, b, program.get(channel, 0)))
        elif kind == "off" and keys.get(key):
            note = keys[key].pop(0)
            if down.get(channel):
                pedal.setdefault(key, []).append(note)
            else:
                end(note, key, tick)
    for held in (keys, pedal):
        for key, queue in held.items():
            for note in queue:
                end(note, key, last)
    return out


def test_messages_to_notes(spark):
    rng = random.Random(4)
    rows, want = [], []
    for song in range(40):
        tick, own = 0, []
        for seq in range(rng.randint(0, 80)):
            tick += rng.choice((0, 0, 1, 3))
            kind = rng.choice(("on", "on", "off", "off", "control", "program", "other"))
            a = rng.choice((60, 61)) if kind in ("on", "off") else rng.choice((64, 64, 7)) if kind == "control" else rng.randint(0, 5)
            own.append((seq, tick, kind, rng.choice((0, 1, 9)), a, rng.choice((1, 63, 64, 100))))
        rows += [(song, *m) for m in own]
        want += [(song, *n) for n in played(own)]
    df = spark.createDataFrame(rows, "song int, seq long, tick long, kind string, channel int, a int, b int")
    got = N.tick_notes(df, ["song"]).select("song", "channel", "pitch", "velocity", "program", "start", "stop").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 300
    assert N.tick_notes(df.limit(0), ["song"]).collect() == []


def test_files_and_back(spark, tmp_path):
    tracks = [[(0, "program", 0, 5, 0), (0, "on", 0, 60, 100), (200, "control", 0, 64, 127), (20000, "off", 0, 60, 0)], [], [(3, "on", 9, 36, 1), (3, "off", 9, 36, 0)]]
    content = M.song_bytes(tracks)
    got = [m[1:] for m in M.song_messages(content) if m[3] != "end"]
    assert got == [(t, *m) for t, own in enumerate(tracks) for m in own]
    for cut in (3, 13, 20, len(content) - 1):
        with pytest.raises((ValueError, IndexError)):
            list(M.song_messages(content[:cut]))
    # Running status and messages of other kinds.
    body = bytes([0, 0x90, 60, 9, 5, 60, 0, 0, 0xFF, 3, 2, 65, 66, 0, 0xE0, 1, 2, 0, 0xFF, 0x2F, 0])
    raw = content[:8] + b"\0\0\0\1\0\x60" + b"MTrk" + len(body).to_bytes(4, "big") + body
    assert [m[2:4] for m in M.song_messages(raw)] == [(0, "on"), (5, "off"), (5, "other"), (5, "other"), (5, "end")]
    M.write_files(spark.createDataFrame([("a.mid", content), ("b.MID", raw), ("c.mid", content[:20]), ("d.txt", raw)], "name string, content binary").repartition(3), f"{tmp_path}/out")
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["_SUCCESS", "a.mid", "b.MID", "c.mid", "d.txt"]
    kinds = {(r["f"], r["kind"]): r["n"] for r in M.read_songs(spark, f"{tmp_path}/out").groupBy(F.substring_index("path", "/", -1).alias("f"), "kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["c.mid", "broken"] == 1 and kinds["a.mid", "on"] == 2 and kinds["b.MID", "off"] == 1 and not any(f == "d.txt" for f, _ in kinds)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    def some(frames):
        for pdf in frames:
            yield pdf
            raise RuntimeError("lost")

    files = spark.createDataFrame([(f"{k}.mid", b"x") for k in range(20)], "name string, content binary").repartition(2)
    with pytest.raises(Exception, match="lost"):
        M.write_files(files.mapInPandas(some, files.schema), f"{tmp_path}/out")
    assert [x for x in os.listdir(f"{tmp_path}/out") if x != "_tries"] == [] if os.path.exists(f"{tmp_path}/out") else True


def test_a_try_that_does_not_count_leaves_nothing(tmp_path):
    writer = M.FileSinkWriter(f"{tmp_path}/out")
    rows = [{"name": "a", "content": b"1"}, {"name": "b", "content": b"2"}]

    def breaks():
        yield rows[0]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(breaks())
    writer.write(iter(rows))
    writer.commit([writer.write(iter(rows)), None])
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["_SUCCESS", "a", "b"]
    writer = M.FileSinkWriter(f"{tmp_path}/none")
    writer.abort([writer.write(iter(rows))])
    assert os.listdir(f"{tmp_path}/none") == []


def test_songs_are_encoded_one_by_one(spark):
    """A batch's messages do not all become objects at once: it stays in columns, and goes out in pieces."""
    songs = spark.range(600).withColumnRenamed("id", "song")
    each = F.explode(F.sequence(F.lit(0), F.lit(199))).alias("tick")
    m = songs.select("song", (F.col("song") % 2).cast("int").alias("track"), each).select(
        "song", "track", F.col("tick").cast("long").alias("tick"), F.lit("on").alias("kind"), F.lit(0).alias("channel"), F.lit(60).alias("a"), F.lit(1).alias("b")
    )
    files = M.song_files(m.repartition(1, "song"))
    assert "MapInArrow" in files._jdf.queryExecution().executedPlan().toString()
    got = {r["name"]: len(list(M.song_messages(bytes(r["content"])))) for r in files.collect()}
    assert got == {f"{k}.mid": 201 for k in range(600)}
