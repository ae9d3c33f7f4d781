"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact rerank."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, table

#: Vectors that the rotations are learned on at most, rows of a bucket compared at once, rows of a task on average.
SAMPLE, BLOCK, TASK = 10_000, 1024, 4096
#: Vectors of a label and bucket aimed at, and the share of links at the threshold that may be in no common bucket.
BUCKET, MISS = 32, 0.001


def learn_rotation(x: np.ndarray, seed: int = 0, rounds: int = 40) -> np.ndarray:
    """Matrix whose projections' signs are a code of x.shape[1] balanced bits: principal axes, then a rotation that
    brings them close to the corners of the cube, found by turns of taking signs and solving for the rotation.
    """
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    v = x @ axes.T
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[0],) * 2))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes.T @ r


def tables_for(most: int, cosine: float, dim: int) -> tuple[int, int]:
    """Bits of a table's key and number of tables, for `most` vectors of a label.

    A bit differs with chance angle / pi for vectors at the threshold.
    """
    same = 1 - math.acos(cosine) / math.pi
    bits = min(40, max(8, math.ceil(math.log2(max(2, most / BUCKET)))))
    return bits, math.ceil(math.log(MISS) / math.log(1 - same**bits))


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1, in double precision."""
    x = x.astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def radius_for(width: int, cosine: float) -> int:
    """Hamming distance of two codes of that many bits that a pair at the threshold hardly ever exceeds: the mean and eight
    deviations, as bits of one rotation are not independent.
    """
    share = math.acos(cosine) / math.pi
    return math.ceil(width * share + 8 * math.sqrt(width * share * (1 - share)))


def _linked(rows: pd.DataFrame, cosine: float, pairs: list, kind: str, bits: int, tables: int) -> None:
    """Links within one bucket, or between its left and right rows, that no earlier table has shown.

    Appends (vector, links to it) and, per connected part, (vector, smallest vector of the part).
    """
    v = _unit(np.stack([np.frombuffer(x, kind) for x in rows["v"]]))
    code = np.stack([np.unpackbits(np.frombuffer(x, np.uint8)) for x in rows["k"]])[:, : bits * tables]
    k = code.reshape(len(code), tables, bits)
    ids, weight, side, t = rows["id"].to_numpy(), rows["weight"].to_numpy(), rows["side"].to_numpy(), int(rows["t"].iloc[0])
    radius = radius_for(bits * tables, cosine)
    within = (side == 0).all() or (side == 2).all()
    a = np.arange(len(ids)) if within else np.flatnonzero(side == 0)
    b = a if within else np.flatnonzero(side == 1)
    if not len(a) or not len(b):
        return
    # Hamming distances of whole codes, as products of signs; only pairs within the radius are compared as vectors.
    sign = code.astype(np.float32) * 2 - 1
    near = sign[a] @ sign[b].T >= code.shape[1] - 2 * radius
    if within:
        np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    dot = np.concatenate([np.einsum("ij,ij->i", v[a[i[s : s + 65536]]], v[b[j[s : s + 65536]]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
    i, j = i[dot >= cosine], j[dot >= cosine]
    before = (k[a[i], :t] == k[b[j], :t]).all(2).any(1) if t else np.zeros(len(i), bool)
    i, j = i[~before], j[~before]
    if not len(i):
        return
    n = np.bincount(a[i], weights=weight[b[j]], minlength=len(ids))
    if not within:
        n += np.bincount(b[j], weights=weight[a[i]], minlength=len(ids))
    label = ids.copy()
    while True:
        low = label.copy()
        np.minimum.at(low, a[i], label[b[j]])
        np.minimum.at(low, b[j], label[a[i]])
        if (low == label).all():
            break
        label = low
    for x in np.unique(np.concatenate([a[i], b[j]])).tolist():
        pairs.append((int(ids[x]), int(label[x]), int(n[x])))


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of vectors. Keys are integers.

    Vectors of equal label (null equals nothing) link when their cosine, in double precision, is cosine or more. Null
    and zero vectors, and those with null or non-finite components, link with nothing, as do vectors of different
    length. A row with a null key has null component_id. Equal vectors of a label stand for each other, so that a group
    of copies is compared as one; rows that repeat key, label and vector count as separate vectors.

    Rotations are learned on SAMPLE vectors at most; all vectors are indexed. Each bucket is compared in full: a large
    one is cut into blocks, and blocks meet in pairs.
    """
    known = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"), F.col(label).alias("label"))
    good = (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    marked = cut(known.withColumn("good", F.coalesce(good & F.col("id").isNotNull() & F.col("label").isNotNull(), F.lit(False))))
    reps = cut(marked.where("good").groupBy("label", "e").agg(F.min("id").alias("rep"), F.count("*").alias("weight")))

    dims = {r["d"]: r["most"] for r in reps.groupBy("label", F.size("e").alias("d")).count().groupBy("d").agg(F.max("count").alias("most")).collect()}
    plans = {}
    for dim, most in dims.items():
        sample = reps.where(F.size("e") == dim).orderBy(F.xxhash64("rep")).select("e").limit(SAMPLE).collect()
        x = _unit(np.array([r["e"] for r in sample], float))
        bits, tables = tables_for(most, cosine, dim)
        if len(x) < dim:
            x = np.concatenate([x, np.eye(dim)])
        mean = x.mean(0)
        need = -(-bits * tables // dim)
        # The first rotation fits the centred sample. Where more bits are wanted than it has, the others are taken after
        # a few rounds from random starts, around the origin, so that they differ from it and from each other.
        turns = [learn_rotation(x - mean)] + [learn_rotation(x, k, 2) for k in range(1, need)]
        level = np.concatenate([mean @ turns[0]] + [np.zeros(dim)] * (need - 1))
        plans[dim] = level, np.concatenate(turns, 1), bits, tables

    # What is given in single precision travels so, which loses nothing.
    kind = "<f4" if "float" in vectors.schema[embedding].dataType.simpleString() else "<f8"

    def index(frames):
        for pdf in frames:
            out = []
            for dim, own in pdf.groupby(pdf["e"].map(len)):
                level, turn, bits, tables = plans[dim]
                given = np.stack(own["e"].to_numpy()).astype(kind)
                x = _unit(given)
                # Bits are dealt over the tables in turn, so that each rotation's strong axes are in all of them.
                bit = (x @ turn >= level)[:, : bits * tables].reshape(len(x), bits, tables)
                bit = bit.transpose(0, 2, 1)
                keys = (bit << np.arange(bits)).sum(2).astype("<i8")
                codes = np.packbits(bit.reshape(len(x), -1), axis=1)
                for k, (rep, lab, weight) in enumerate(zip(own["rep"], own["label"], own["weight"], strict=True)):
                    v, code = given[k].tobytes(), codes[k].tobytes()
                    out += [(rep, lab, weight, dim, t, keys[k, t], v, code) for t in range(tables)]
            yield pd.DataFrame(out, columns=["id", "label", "weight", "dim", "t", "key", "v", "k"])

    of_label = vectors.schema[label].dataType.simpleString()
    rows = reps.mapInPandas(index, f"id long, label {of_label}, weight long, dim int, t int, key long, v binary, k binary")
    rows = rows.withColumn("bucket", F.xxhash64("label", "dim", "t", "key"))
    sizes = rows.groupBy("bucket").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    met = rows.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    met = met.withColumn("side", F.when(F.col("own") == F.col("hi"), F.when(F.col("lo") == F.col("hi"), 2).otherwise(1)).otherwise(0))
    total = dims and sum(r["n"] for r in reps.agg(F.count("*").alias("n")).collect()) * max(p[3] for p in plans.values())
    cells = max(1, -(-(total or 0) // TASK))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        for _, own in pdf.groupby(["bucket", "lo", "hi"], sort=True):
            if len(own) > 1:
                bits, tables = plans[int(own["dim"].iloc[0])][2:]
                _linked(own, cosine, found, kind, bits, tables)
        return pd.DataFrame(found, columns=["a", "b", "n"]).astype("int64")

    cell = F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(cells)).alias("cell")
    seen = cut(
        met.select(cell, "bucket", "lo", "hi", "id", "weight", "dim", "t", "v", "k", F.col("side").cast("int").alias("side"))
        .groupBy("cell")
        .applyInPandas(compare, "a long, b long, n long")
    )
    links = seen.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    groups = connected_components(seen.select("a", "b")).withColumnRenamed("node", "rep")
    judged = reps.join(links, "rep", "left").join(groups, "rep", "left").select(
        F.col("label").alias("_label"),
        F.col("e").alias("_e"),
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    fine = marked.where("good").join(judged, (F.col("label") == F.col("_label")) & (F.col("e") == F.col("_e"))).select("id", "n_links", "component_id")
    lone = marked.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return fine.unionByName(lone).withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", key)


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
