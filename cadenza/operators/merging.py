"""Aggregates of one's own, as states that merge: batches give partial states, which meet in a tree."""

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Moments:
    """Number, mean and the sums of squared and cubed deviations, by the exact rules for putting two such states together.
    Not numbers are left out."""

    schema = "n long, mean double, sd double, skewness double"

    def start(self, values: np.ndarray) -> bytes:
        x = values[~np.isnan(values)]
        mean = x.mean() if len(x) else 0.0
        d = x - mean
        return struct.pack("<qddd", len(x), mean, float((d * d).sum()), float((d * d * d).sum()))

    def merge(self, states: list[bytes]) -> bytes:
        n, mean, m2, m3 = 0, 0.0, 0.0, 0.0
        for s in states:
            k, other, o2, o3 = struct.unpack("<qddd", s)
            if not k:
                continue
            total, d = n + k, other - mean
            m3 += o3 + d**3 * n * k * (n - k) / total**2 + 3 * d * (n * o2 - k * m2) / total
            m2 += o2 + d * d * n * k / total
            mean += d * k / total
            n = total
        return struct.pack("<qddd", n, mean, m2, m3)

    def finish(self, state: bytes) -> tuple:
        n, mean, m2, m3 = struct.unpack("<qddd", state)
        if not n:
            return 0, None, None, None
        sd = math.sqrt(m2 / n)
        return n, mean, sd, m3 / n / sd**3 if m2 > 0 else None


def merged_states(rows: DataFrame, by: list[str], value: str, state=Moments, fan_in: int = 64) -> DataFrame:
    """(by, and what state().finish() gives) for each group of rows.

    state: a class with schema, start(values) -> bytes, merge(list of bytes) -> bytes and finish(bytes) -> tuple; merging
    is free of order up to rounding. Each batch of a task gives one state a group. These meet fan_in at a time, so that no
    task has more states of a group than that on average, however many rows it has; only states are shuffled.
    """
    made = state()
    keys = [rows.schema[c] for c in by]
    partial = T.StructType([*keys, T.StructField("_state", T.BinaryType())])

    def starts(frames):
        for pdf in frames:
            groups = [(*(k if isinstance(k, tuple) else (k,)), made.start(own[value].to_numpy(float))) for k, own in pdf.groupby(by, dropna=False, sort=False)]
            yield pd.DataFrame(groups, columns=[*by, "_state"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(_state=[made.merge([bytes(s) for s in pdf["_state"]])])[[*by, "_state"]]

    states = rows.select(*by, F.col(value).cast("double").alias(value)).mapInPandas(starts, partial)
    # Tasks of the first level: a batch has 10,000 rows at most, and a partition several.
    cells = -(-rows.rdd.getNumPartitions() // fan_in)
    while cells > 1:
        cell = F.pmod(F.spark_partition_id(), F.lit(cells)).alias("_cell")
        states = states.select("*", cell).groupBy(*by, "_cell").applyInPandas(meet, partial)
        cells = -(-cells // fan_in)

    out = T.StructType([*keys, *T.StructType.fromDDL(state.schema).fields])

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        done = made.finish(made.merge([bytes(s) for s in pdf["_state"]]))
        return pd.DataFrame([[*pdf.iloc[0][by].tolist(), *done]], columns=out.names)

    return states.groupBy(*by).applyInPandas(end, out)
