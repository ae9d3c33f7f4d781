"""Toxicity: a chain of linear classifiers, each fed the probabilities of the categories before it."""

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

#: Labelled rows that the models are fitted on at most, words that are features, folds, weight decay.
SAMPLE, FEATURES, FOLDS, DECAY = 20_000, 384, 4, 1.0
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def text_words(text) -> list[bytes]:
    return _WORD.findall((text or b"").lower())


def shape(text, n: int) -> list[float]:
    """Figures of a text besides its words: length, symbols, shouting and bars a word."""
    t = text or b""
    m = max(1, n)
    symbols = sum(t.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"<", b">"))
    return [np.log1p(n), min(2.0, symbols / m), min(2.0, t.count(b"!!") / m), min(2.0, t.count(b"|") / m)]


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = DECAY, rounds: int = 12) -> np.ndarray:
    """Weights (the last one the constant) of a ridge logistic regression, by Newton's method.

    The two classes weigh the same together, however rare one is; with one class only its side is predicted.
    """
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    share = y.mean() if len(y) else 0.0
    if not 0 < share < 1:
        w[-1] = 9.0 if share >= 1 else -9.0
        return w
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    ridge = np.full(x.shape[1], decay)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """A model for each column of y. Model k sees x and the probabilities of the columns before it.

    These are out-of-fold: each row's come from models that have not seen the row's fold, so that a later model is
    trained with probabilities as good as those it meets in use. Unknown labels are NaN and left out.
    """
    models, known = [], np.zeros((len(x), 0))
    for k in range(y.shape[1]):
        z = np.concatenate([x, known], 1)
        have = ~np.isnan(y[:, k])
        models.append(fit_logistic(z[have], y[have, k]))
        out = np.zeros(len(x))
        for f in np.unique(folds):
            use = have & (folds != f)
            out[folds == f] = predict(z[folds == f], fit_logistic(z[use], y[use, k]))
        known = np.concatenate([known, out[:, None]], 1)
    return models


def run_chain(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    p = np.zeros((len(x), 0))
    for w in models:
        p = np.concatenate([p, predict(np.concatenate([x, p], 1), w)[:, None]], 1)
    return p


def _features(words_: list[bytes], text, places: dict[bytes, int]) -> np.ndarray:
    out = np.zeros(len(places) + 4)
    for w in words_:
        k = places.get(w)
        if k is not None:
            out[k] += 1
    np.log1p(out, out=out)
    out[len(places) :] = shape(text, len(words_))
    return out


def score_documents(
    docs: DataFrame, labels: DataFrame, categories, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, threshold: float = 0.5
) -> DataFrame:
    """One row for each row of docs: key, p_<category> for each category, and flagged: the last one at threshold or more.

    labels: key and a column 0/1 for each category, in the order of the chain; null means unknown. The models are
    fitted on at most `sample` labelled documents (a key with several labels has the greater), those with the smallest hash of the key, with FEATURES words: those
    whose numbers of documents differ most between the classes. All documents are scored, on their whole texts; null
    texts count as empty. Without any usable label all probabilities are near 0. Repeated rows get equal scores.
    """
    d = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    y = labels.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(f"_y{k}") for k, c in enumerate(categories)]).where("_key is not null")
    # At most `sample` rows, so they are sent to every executor and no text is shuffled.
    chosen = cut(y.groupBy("_key").agg(*[F.max(f"_y{k}").alias(f"_y{k}") for k in range(len(categories))]).orderBy(F.xxhash64("_key"), "_key").limit(sample))
    taught = d.join(F.broadcast(chosen), F.col("key") == F.col("_key"))

    kinds = [f"_y{k}" for k in range(len(categories))]

    def count(frames):
        """Documents of each class that have a word, for the words of this partition."""
        total: dict = {}
        for pdf in frames:
            ys = pdf[kinds].to_numpy(float)
            for t, row in zip(pdf["text"], ys, strict=True):
                add = np.concatenate([row == 0, row == 1]).astype(np.int64)
                for w in set(text_words(t)):
                    total[w] = total[w] + add if w in total else add
        if total:
            yield pd.DataFrame({"word": list(total), "n": [x.tolist() for x in total.values()]})

    n = len(kinds)
    counts = taught.mapInPandas(count, "word binary, n array<long>").groupBy("word").agg(*[F.sum(F.get("n", k)).alias(f"n{k}") for k in range(2 * n)])
    sums = chosen.agg(*[F.count_if(F.col(c) == v).alias(f"{c}_{v}") for v in (0, 1) for c in kinds]).first()
    totals = [max(1, sums[k]) for k in range(2 * n)]
    picked: list[bytes] = []
    kept = cut(counts.where(" or ".join(f"n{k} >= 5" for k in range(2 * n))))
    for k in range(n):
        # Log-likelihood ratio of the two classes' counts, which is fair to rare words.
        ratio = F.lit(0.0)
        for j in (n + k, k):
            expected = (F.col(f"n{k}") + F.col(f"n{n + k}")) * (totals[j] / (totals[k] + totals[n + k]))
            ratio = ratio + F.when(F.col(f"n{j}") > 0, F.col(f"n{j}") * F.log(F.col(f"n{j}") / expected)).otherwise(F.lit(0.0))
        best = kept.orderBy(F.desc(ratio), "word").select("word").limit(FEATURES // n).collect()
        picked += [bytes(r["word"]) for r in best]
    places = {w: k for k, w in enumerate(dict.fromkeys(picked))}

    def featured(frames):
        for pdf in frames:
            rows = [_features(text_words(t), t, places).astype("<f4").tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"h": pdf["h"], "x": rows} | {c: pdf[c] for c in kinds})

    # Where keys repeat in docs, there are more rows than labels; a hash tells which of them are taken.
    hashed = taught.select(F.xxhash64("key").alias("h"), "text", *kinds)
    rows = hashed.mapInPandas(featured, "h long, x binary, " + ", ".join(f"{c} double" for c in kinds)).orderBy("h", "x").limit(sample).collect()
    x = np.array([np.frombuffer(r["x"], "<f4") for r in rows], float).reshape(len(rows), len(places) + 4)
    labelled = np.array([[np.nan if r[c] is None else r[c] for c in kinds] for r in rows], float).reshape(len(rows), n)
    # Equal texts have equal features and so one fold; else a model would have seen its copy.
    folds = np.array([zlib.crc32(r["x"]) % FOLDS for r in rows], np.int64)
    models = fit_chain(x, labelled, folds)

    def score(batches):
        for whole in batches:
            for at in range(0, len(whole), 1024):
                part = whole.slice(at, 1024)
                texts = part.column(1).to_pylist()
                z = np.array([_features(text_words(t), t, places) for t in texts]).reshape(len(part), len(places) + 4)
                p = run_chain(z, models)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, p.T), pa.array(p[:, -1] >= threshold)], names)

    # Keys stay in Arrow arrays: large ones keep all digits beside a null.
    names = [key, *[f"p_{c}" for c in categories], "flagged"]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(n, T.DoubleType()) for n in names[1:-1]], T.StructField("flagged", T.BooleanType())])
    return d.mapInArrow(score, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Chain: junk (quality 0), then toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    found = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, ("junk", "toxic"))
    return found.select("doc_id", F.round("p_junk", 6).alias("p_junk"), F.round("p_toxic", 6).alias("p_toxic"), F.col("flagged").alias("toxic"))
