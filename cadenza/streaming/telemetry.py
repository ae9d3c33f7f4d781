"""Streams: telemetry windows with a watermark, and a replay pool with state."""

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..plans.telemetry import alerts
from .batches import event_stream  # noqa: F401


def alert_stream(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """States of windows of time, each given once, when events older than `late` can no longer come."""
    return alerts(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width)


def replay_pool(items: DataFrame, size: int) -> DataFrame:
    """A bounded pool per source: (source, seq, rank, seen). Each micro-batch the pool keeps the `size` items of the
    smallest hash among those it held and the new ones, so it is a uniform sample of all items so far, and the same
    for any division into batches.

    items: source string, seq string, rank long (a hash of the item). Rows come out whenever a source has new items.
    """

    def update(key, frames, state):
        pool, seen = state.get if state.exists else ([], 0)
        pool = [(r, s) for r, s in zip(pool[::2], pool[1::2], strict=True)] if pool and not isinstance(pool[0], tuple) else pool
        pool = [(int(r), s) for r, s in pool]
        for pdf in frames:
            seen += len(pdf)
            pool = sorted([*pool, *zip(pdf["rank"].astype(int).tolist(), pdf["seq"], strict=True)])[:size]
        flat = [str(x) for pair in pool for x in pair]
        state.update((flat, seen))
        yield pd.DataFrame({"source": key[0], "seq": [s for _, s in pool], "rank": [r for r, _ in pool], "seen": seen})

    return items.groupBy("source").applyInPandasWithState(
        update, "source string, seq string, rank long, seen long", "pool array<string>, seen long", "update", GroupStateTimeout.NoTimeout
    )


def forgetting_pool(items: DataFrame, cap: int) -> DataFrame:
    """A replay pool per source that goes round by round, a round being a micro-batch with new items: the first fills the
    pool up to cap; each later one forgets a quarter of it and takes a quarter of the new items, as far as there is room.
    Who goes and who comes is the order of a hash of round and item.

    items: source string, seq string. Rows (source, round, seq) are the pool after each round; its state is cap items.
    """

    def order(number: int, what: str, seqs) -> list:
        return sorted(seqs, key=lambda s: (zlib.crc32(f"{what}{number}-{s}".encode()), s))

    def update(key, frames, state):
        pool, number = state.get if state.exists else ([], 0)
        pool, new, count = list(pool), [], 0
        for pdf in frames:
            # At most cap of the new ones can be taken, so no more are held.
            new = order(number, "new", [*new, *pdf["seq"]])[:cap]
            count += len(pdf)
        if number:
            pool = order(number, "keep", pool)[: len(pool) - len(pool) // 4]
            new = new[: min(count // 4, cap - len(pool))]
        pool += new
        state.update((pool, number + 1))
        yield pd.DataFrame({"source": key[0], "round": number, "seq": pool})

    return items.groupBy("source").applyInPandasWithState(
        update, "source string, round long, seq string", "pool array<string>, round long", "update", GroupStateTimeout.NoTimeout
    )
