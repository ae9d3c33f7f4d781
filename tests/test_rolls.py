"""Rolls as intervals against cells, one by one."""

import random

from cadenza.operators import rolls as R


def runs(cells):
    out = []
    for t in sorted(cells):
        if out and out[-1][1] == t:
            out[-1][1] = t + 1
        else:
            out.append([t, t + 1])
    return [tuple(x) for x in out]


def plain_sustain(active, onsets, bridge=3, chunk=24, least=6):
    """A step after the other, with a look ahead of one chunk."""
    last = max([*active, *onsets], default=0) + 1
    found = []
    for start in sorted(onsets):
        bound = min((o for o in onsets if o > start), default=last)
        end = start + 1
        while end < bound:
            ahead = next((t for t in range(end, min(bound, end + chunk + 1)) if t in active), None)
            if ahead is None:
                break
            stop = ahead
            while stop < bound and stop in active:
                stop += 1
            if ahead != end and ahead - end > bridge and not (ahead % chunk == 0 and stop - ahead >= least):
                break
            end = stop
        found.append((start, end))
    return found


def test_sustained_notes(spark):
    rng = random.Random(7)
    spans, onsets, want = [], [], []
    for song in range(60):
        at, active, starts = 0, set(), set()
        for _ in range(rng.randint(0, 14)):
            at += rng.choice((0, 1, 2, 3, 4, 5, 20, 24, 30))
            if rng.random() < 0.4:
                at = -(-at // 24) * 24
            length = rng.choice((1, 2, 5, 6, 7, 24, 40))
            spans.append((song, at, at + length))
            active |= set(range(at, at + length))
            at += length
        for _ in range(rng.randint(0, 4)):
            starts.add(rng.randint(0, at))
        onsets += [(song, t) for t in starts for _ in range(rng.randint(1, 2))]
        want += [(song, *x) for x in plain_sustain(active, starts)]
    a = spark.createDataFrame(spans, "song int, start long, stop long")
    o = spark.createDataFrame(onsets, "song int, step long")
    got = R.sustained_notes(a, o, ["song"]).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    # A roll without dropouts is left alone: notes end with their spans.
    assert R.sustained_notes(a.limit(0), o.limit(0), ["song"]).collect() == []


def test_chunks_resume(spark):
    cases = {
        "a gap of three": ([(0, 10), (13, 15)], [0], [(0, 15)]),
        "a gap of four": ([(0, 10), (14, 20)], [0], [(0, 10)]),
        "four, at a chunk": ([(0, 20), (24, 30)], [0], [(0, 30)]),
        "too short": ([(0, 20), (24, 29)], [0], [(0, 20)]),
        "too far": ([(0, 23), (48, 60)], [0], [(0, 23)]),
        "just near enough": ([(0, 24), (48, 60)], [0], [(0, 60)]),
        "up to the next onset": ([(0, 20), (24, 40)], [0, 28], [(0, 20), (28, 40)]),
        "an onset that is off": ([(5, 9)], [3], [(3, 9)]),
        "nothing on": ([], [3], [(3, 4)]),
        "before any onset": ([(0, 9)], [4], [(4, 9)]),
    }
    for name, (spans, onsets, want) in cases.items():
        a = spark.createDataFrame([("x", *s) for s in spans], "p string, start long, stop long")
        o = spark.createDataFrame([("x", t) for t in onsets], "p string, step long")
        assert sorted((r["start"], r["stop"]) for r in R.sustained_notes(a, o, ["p"]).collect()) == want, name


def test_merged_and_steps(spark):
    rng = random.Random(3)
    rows = [(g, s, s + rng.randint(0, 9), rng.randint(1, 5)) for g in range(20) for s in rng.sample(range(80), rng.randint(0, 12))]
    df = spark.createDataFrame(rows, "g int, start long, stop long, v long")
    want, levels = [], []
    for g in range(20):
        cells = {}
        for _, s, e, v in (r for r in rows if r[0] == g):
            for t in range(s, e):
                cells[t] = cells.get(t, 0) + v
        want += [(g, *x) for x in runs(cells)]
        levels += [(g, t, v) for t, v in cells.items()]
    assert sorted((r["g"], r["start"], r["stop"]) for r in R.merged(df, ["g"]).collect()) == sorted(want)
    got = [(r["g"], t, r["value"]) for r in R.steps_of(df, ["g"], "v").collect() for t in range(r["start"], r["stop"])]
    assert sorted(got) == sorted(levels)


def test_velocity_roll_and_back(spark):
    """Three notes of two instruments: sums within one, the loudest of both; a song without length has no roll."""
    notes = [("s", 0, 0, 60, 50, 0.0, 2.0), ("s", 0, 0, 60, 40, 1.0, 3.0), ("s", 0, 1, 60, 70, 0.0, 4.0), ("s", 0, 1, 62, 9, 7.0, 8.0), ("z", 0, 0, 60, 9, 0.0, 0.0)]
    n = spark.createDataFrame(notes, "song string, program int, instrument int, pitch int, velocity long, start double, stop double")
    songs = spark.createDataFrame([("s", 2), ("z", 1)], "song string, measures int")
    roll = R.velocity_roll(n, songs, ["song"], 16)
    cells = {(r["pitch"], t): r["velocity"] for r in roll.collect() for t in range(r["start"], r["stop"])}
    want = {(60, t): 70 if t < 4 or t >= 8 else 90 for t in range(16)} | {(62, t): 9 for t in range(28, 32)}
    assert cells == want
    back = R.notes_of_roll(roll, ["song", "program", "pitch"])
    assert sorted((r["pitch"], r["start"], r["stop"], r["velocity"]) for r in back.collect()) == [(60, 0, 16, 70), (62, 28, 32, 9)]


def test_notes_survive_the_roll(spark):
    """Notes of a pitch that do not touch come back as they were, with loudness by 32-bit shares."""
    import numpy as np

    rng = random.Random(5)
    notes = []
    for pitch in range(20, 40):
        at = 0
        while at < 180:
            at += rng.randint(1, 9)
            length = rng.randint(1, 12)
            notes.append(("s", 0, 0, pitch, rng.randint(1, 127), at / 8.0, min(at + length, 192) / 8.0))
            at += length
    notes.append(("s", 0, 0, 1, 64, 23.0, 24.0))
    n = spark.createDataFrame(notes, "song string, program int, instrument int, pitch int, velocity long, start double, stop double")
    back = R.notes_of_roll(R.velocity_roll(n, spark.createDataFrame([("s", 2)], "song string, measures int"), ["song"], 96), ["song", "program", "pitch"])
    loud = lambda v: max(1, int(np.float32(v / 127.0) * np.float32(127)))
    want = [(p, int(a * 8), int(b * 8), loud(v)) for _, _, _, p, v, a, b in notes if a < b]
    assert sorted((r["pitch"], r["start"], r["stop"], r["velocity"]) for r in back.collect()) == sorted(want)
