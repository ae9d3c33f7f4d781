"""Streams that are stopped and go on, batches prepared ahead, and averages with state, against batch queries."""

import threading

import pytest
from pyspark.sql import functions as F

from cadenza.streaming import batches as B
from cadenza.streaming.batches import event_stream


def source(spark, path, n=6):
    rows = spark.range(60).selectExpr("id", "id % 7 as k")
    for k in range(n):
        rows.where(f"id div 10 = {k}").coalesce(1).write.mode("append").parquet(path)
    return rows


def prepare(df):
    return df.select("id", (F.col("k") * 10).alias("k"))


def test_a_stopped_stream_goes_on(spark, tmp_path):
    rows = source(spark, f"{tmp_path}/in")
    stream = lambda: event_stream(spark, f"{tmp_path}/in", rows.schema)
    first = B.resumable(stream(), str(tmp_path), prepare, stop_after=2)
    assert first == [0, 1] and B.finished(spark, str(tmp_path)).count() == 20
    rest = B.resumable(stream(), str(tmp_path), prepare)
    assert rest == [2, 3, 4, 5]
    assert B.resumable(stream(), str(tmp_path), prepare) == []
    got = sorted((r["id"], r["k"]) for r in B.finished(spark, str(tmp_path)).collect())
    assert got == sorted((r["id"], r["k"]) for r in prepare(rows).collect())
    # New files are further batches.
    spark.range(60, 65).selectExpr("id", "id % 7 as k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert B.resumable(stream(), str(tmp_path), prepare) == [6]


def test_a_batch_that_failed_is_run_again(spark, tmp_path):
    rows = source(spark, f"{tmp_path}/in")
    seen = []

    def faulty(df):
        seen.append(df)
        if len(seen) == 3:
            # Half of the batch is left behind by the run that fails.
            df.limit(5).select("id", F.lit(-1).cast("long").alias("k")).write.mode("overwrite").parquet(B.batch_folder(f"{tmp_path}/data", 2))
            raise RuntimeError("lost")
        return prepare(df)

    stream = lambda: event_stream(spark, f"{tmp_path}/in", rows.schema)
    with pytest.raises(Exception, match="lost"):
        B.resumable(stream(), str(tmp_path), faulty)
    assert B.resumable(stream(), str(tmp_path), prepare) == [2, 3, 4, 5]
    got = sorted((r["id"], r["k"]) for r in B.finished(spark, str(tmp_path)).collect())
    assert got == sorted((r["id"], r["k"]) for r in prepare(rows).collect())


def test_the_next_batch_is_prepared_meanwhile(spark, tmp_path):
    rows = spark.range(50).selectExpr("id", "cast(id div 10 as int) as batch", "id as k")
    begun, events = [], {k: threading.Event() for k in range(5)}

    def noted(df):
        k = df.select("batch").first()[0]
        begun.append(k)
        events[k].set()
        return df

    got = []
    for number, df in B.prefetched(rows, "batch", f"{tmp_path}/a", noted):
        if number < 4:
            # The one after this is begun while this one is in the caller's hands; no other is.
            assert events[number + 1].wait(60) and max(begun) == number + 1
        got += [(number, r["id"]) for r in df.collect()]
    assert sorted(got) == [(k // 10, k) for k in range(50)]
    begun.clear()
    assert [n for n, _ in B.prefetched(rows, "batch", f"{tmp_path}/b", noted, skip_until=3)] == [3, 4] and begun == [3, 4]
    assert list(B.prefetched(rows.limit(0), "batch", f"{tmp_path}/c", noted)) == []


@pytest.mark.parametrize("files", [[8], [1] * 8, [3, 5]])
def test_averages_for_any_cut(spark, tmp_path, files):
    B.use_rocksdb(spark)
    rows = [(layer, expert, step, (step * 7 + expert * 3) % 5) for layer in ("a", "b") for expert in (0, 1) for step in range(8)]
    at = 0
    for n in files:
        part = [r for r in rows if at <= r[2] < at + n]
        # Repeated steps mean nothing.
        again = [r for r in rows if r[2] == at - 1]
        spark.createDataFrame(part[::-1] + again, "layer string, expert int, step long, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        at += n
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = B.load_averages(event_stream(spark, f"{tmp_path}/in", schema))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    want = []
    for layer in ("a", "b"):
        for expert in (0, 1):
            mean = square = slow = idle = None
            for _, _, step, n in (r for r in rows if r[:2] == (layer, expert)):
                mean = n if mean is None else 0.9 * mean + 0.1 * n
                square = n * n if square is None else 0.9 * square + 0.1 * n * n
                slow = n if slow is None else 0.99 * slow + 0.01 * n
                idle = 0 if n else (idle or 0) + 1
                want.append((layer, expert, step, *(round(float(x), 9) for x in (mean, square, slow)), idle))
    got = [(*r[:3], *(round(x, 9) for x in r[3:6]), r[6]) for r in map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())]
    assert sorted(got) == sorted(want)
