"""Batches prepared ahead, and streams that go on where they were stopped."""

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

Prepare = Callable[[DataFrame], DataFrame]


def event_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Files of a folder as a stream, `files` of them a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def batch_folder(folder: str, number: int) -> str:
    return f"{folder}/batch={number:09d}"


def resumable(stream: DataFrame, folder: str, prepare: Prepare, stop_after: int | None = None) -> list[int]:
    """Run a stream of micro-batches to the end of its input and give the numbers of the batches done in this run.

    Each batch goes through prepare and becomes the folder batch=<number> of folder/data, written anew as a whole: a batch
    that is run again after a fault, by the same number, replaces what it had left. Progress is the stream's checkpoint
    in folder/progress, so another run goes on with the batch after the last one that was finished; after stop_after
    batches this run ends before its input does.
    """
    done: list[int] = []

    class Enough(Exception):
        pass

    def write(df: DataFrame, number: int) -> None:
        if stop_after is not None and len(done) >= stop_after:
            raise Enough
        prepare(df).write.mode("overwrite").parquet(batch_folder(f"{folder}/data", number))
        done.append(number)

    query = stream.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{folder}/progress").start()
    try:
        query.awaitTermination()
    except Exception:
        # The run that was told to stop does so at the start of the batch too many, which stays undone.
        if stop_after is None or len(done) < stop_after:
            raise
    return done


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """What resumable() has written so far, with the column batch."""
    return spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data/batch=*")


def prefetched(batches: DataFrame, by: str, folder: str, prepare: Prepare, skip_until: int = 0) -> Iterator[tuple[int, DataFrame]]:
    """(number, DataFrame) of each batch of rows, by the column that numbers them; the next one is prepared meanwhile.

    The job that prepares a batch and writes it to folder starts when the batch before is handed out, so that it runs
    while the caller works on that one; two batches at most are in work. Batches below skip_until are passed over
    without any work on them: a run that was stopped goes on with the first batch that it had not finished.
    """
    spark = batches.sparkSession
    numbers = [r[0] for r in batches.select(by).distinct().where(F.col(by) >= skip_until).orderBy(by).collect()]

    def write(number: int) -> str:
        path = batch_folder(folder, number)
        prepare(batches.where(F.col(by) == number)).write.mode("overwrite").parquet(path)
        return path

    with ThreadPoolExecutor(1) as pool:
        ahead = {number: None for number in numbers}
        if numbers:
            ahead[numbers[0]] = pool.submit(write, numbers[0])
        for number, following in zip(numbers, [*numbers[1:], None]):
            path = ahead.pop(number).result()
            if following is not None:
                ahead[following] = pool.submit(write, following)
            yield number, spark.read.parquet(path)


class LoadAverages(StatefulProcessor):
    """State of an expert's load: its averages after the last step, and for how many steps it had no load."""

    KIND = StructType(
        [StructField("step", LongType()), *[StructField(c, DoubleType()) for c in ("mean", "square", "slow")], StructField("idle", LongType())]
    )

    def __init__(self, decay: float, slow: float):
        self.decay, self.slow = decay, slow

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.KIND)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [x for x in rows if len(x)]
        if not frames:
            return
        own = pd.concat(frames).sort_values("step", kind="stable")
        step, mean, square, slow, idle = self.held.get() if self.held.exists() else (None, 0.0, 0.0, 0.0, 0)
        out = []
        for at, n in zip(own["step"].tolist(), own["n"].astype(float).tolist()):
            if step is not None and at <= step:
                continue
            first = step is None
            mean = n if first else self.decay * mean + (1 - self.decay) * n
            square = n * n if first else self.decay * square + (1 - self.decay) * n * n
            slow = n if first else self.slow * slow + (1 - self.slow) * n
            idle, step = (0 if n else idle + 1), at
            out.append((*key, step, mean, square, slow, idle))
        self.held.update((step, mean, square, slow, idle))
        yield pd.DataFrame(out, columns=["layer", "expert", "step", "mean", "square", "slow", "idle"])

    def close(self) -> None:
        pass


def load_averages(counts: DataFrame, decay: float = 0.9, slow: float = 0.99) -> DataFrame:
    """Moving averages of loads as a stream: (layer, expert, step, mean, square, slow, idle) for each row of counts.

    counts: layer, expert, step long, n: one row a step, in the order of steps from batch to batch; within a batch in any.
    The first step of an expert starts its averages; a step that is not after the last one is a repetition and is left
    out. mean and square are averages of n and n * n by decay, slow that of n by the slower decay, idle the number of
    steps in a row without load up to now. For any division into batches the rows are the same. State lives in RocksDB.
    """
    kinds = [counts.schema["layer"], counts.schema["expert"], StructField("step", LongType())]
    kinds += [StructField(c, DoubleType()) for c in ("mean", "square", "slow")] + [StructField("idle", LongType())]
    return counts.groupBy("layer", "expert").transformWithStateInPandas(LoadAverages(decay, slow), StructType(kinds), "Append", "None")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that load_averages() needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
