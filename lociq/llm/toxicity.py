"""Toxicity categories by a classifier chain.

Categories are predicted one after the other by linear models over hashed
words; each model also gets the probabilities of all categories before it.  In
training these are out-of-fold predictions: every fold is predicted by a model
that has not seen it, so a later model learns how far an earlier one is to be
trusted.  The default chain is quality, then toxic.

Features: the words of the whole text (runs of letters and digits of any
script, lower-cased) and their first four, five and six letters, which carry
over to inflected and compound words; hashed into 2**18 places, present or not.  A model uses
the places whose presence differs between its classes beyond chance (squared
z-score of CHANCE or more, in MIN_DOCS documents or more; the KEEP most
telling).  Models: logistic regression with L2, weighted for balance, fitted by
accelerated gradient steps from zero, so that equal data give equal models.
The threshold of a category is the one of best F1 on out-of-fold predictions.

Training takes at most TRAIN_ROWS labelled rows, those of smallest hashed
doc_id (a documented bound: the models do not change with more); features of
that sample are computed on executors.  Scoring is one pass over all rows and
whole texts without a shuffle.

Null or blank text has no features: its scores are those of the intercepts.
Labels that are null, or rows without a text, take no part in training; with
no labels, or one class only, a model predicts the smoothed share of its
class.  Repeated rows are scored each; of the texts of one doc_id the smallest
trains, of its labels the least row.  Empty tables give empty results; extra
columns pass through unless a score has their name, which then replaces them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.llm._common import table

CHAIN = ("quality", "toxic")
TRAIN_ROWS, FOLDS, BITS = 8000, 5, 18
CHANCE, MIN_DOCS, KEEP = 20.0, 5, 512
_WORD = re.compile(r"[^\W_]+")


def word_places(word: str) -> set[int]:
    """Places of a word and of its beginnings."""
    return {zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in (word, *("^" + word[:k] for k in (4, 5, 6) if len(word) > k))}


def places(text: str | None) -> np.ndarray:
    """Sorted places of the distinct words of a text."""
    found = set().union(*map(word_places, set(_WORD.findall((text or "").lower()))))
    return np.array(sorted(found), np.int32)


class Linear:
    """Logistic regression on the presence of places and a few dense columns."""

    def __init__(self, used: np.ndarray, w: np.ndarray, dense: np.ndarray, bias: float):
        self.used, self.w, self.dense, self.bias = used, w, dense, bias

    def probability(self, at: np.ndarray, row: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
        full = np.zeros(1 << BITS)
        full[self.used] = self.w
        return sigmoid(np.bincount(row, full[at], n) + dense @ self.dense + self.bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def stack(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Places, their rows, and the count of rows."""
    n = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if len(sets) else np.zeros(0, np.int32), np.repeat(np.arange(len(sets), dtype=np.int32), n), len(sets)


def telling(at: np.ndarray, row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sorted places whose share differs between the classes beyond chance."""
    n1, n0 = y.sum(), (1 - y).sum()
    hit = (y == 1)[row]
    with_, without = np.bincount(at[hit], minlength=1 << BITS), np.bincount(at[~hit], minlength=1 << BITS)
    p = (with_ + without) / (n1 + n0)
    z = (with_ / n1 - without / n0) ** 2 / np.maximum(p * (1 - p) * (1 / n1 + 1 / n0), 1e-12)
    z[with_ + without < MIN_DOCS] = 0
    best = np.argsort(-z, kind="stable")[:KEEP]
    return np.sort(best[z[best] >= CHANCE])


def fit(sets: list[np.ndarray], dense: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 400) -> Linear:
    """Accelerated gradient descent on the balanced logistic loss."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(dense.shape[1]), float(np.log(share / (1 - share))))
    at, row, n = stack(sets)
    used = telling(at, row, y)
    x = np.zeros((n, len(used) + dense.shape[1] + 1))
    where = np.searchsorted(used, at)
    hit = where < len(used)
    hit[hit] = used[where[hit]] == at[hit]
    x[row[hit], where[hit]] = 1
    x[:, len(used) : -1] = dense
    x[:, -1] = 1
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n
    ridge = np.append(np.full(x.shape[1] - 1, l2), 0)
    rate = 1 / (0.25 * np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 + l2)
    w = v = np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        new = v - rate * (x.T @ ((sigmoid(x @ v) - y) * weight) + ridge * v)
        w, v = new, new + (t - 1) / (t + 2) * (new - w)
    k = len(used)
    return Linear(used, w[:k], w[k:-1], float(w[-1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Midway between the last score let in and the first left out at the best F1; a half if there is no choice."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = 0
    k = int(np.argmax(f1))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)


def fit_chain(sets: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> tuple[list[Linear], list[float]]:
    """A model and a threshold per column of labels; later models see out-of-fold probabilities of earlier ones."""
    models, thresholds, dense = [], [], np.zeros((len(sets), 0))
    for y in labels.T:
        models.append(fit(sets, dense, y))
        out = np.zeros(len(sets))
        for f in np.unique(folds):
            held = folds == f
            part = fit([s for s, h in zip(sets, held, strict=True) if not h], dense[~held], y[~held])
            out[held] = part.probability(*stack([s for s, h in zip(sets, held, strict=True) if h]), dense[held])
        thresholds.append(best_threshold(out, y))
        dense = np.column_stack([dense, out])
    return models, thresholds


def predict_chain(models: list[Linear], sets: list[np.ndarray]) -> np.ndarray:
    dense = np.zeros((len(sets), 0))
    x = stack(sets)
    for m in models:
        dense = np.column_stack([dense, m.probability(*x, dense)])
    return dense


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [places(t.as_py()).tobytes() for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([*(c for c, n in zip(b.columns, b.schema.names, strict=True) if n != "text"), pa.array(sets, pa.binary())], names=[*(n for n in b.schema.names if n != "text"), "places"])


def train(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = CHAIN, rows: int = TRAIN_ROWS) -> tuple[list[Linear], list[float]]:
    known = labels.where(" and ".join(f"{c} is not null" for c in ("doc_id", *chain)))
    least = known.groupBy("doc_id").agg(F.min(F.struct(*(F.col(c).cast("int").alias(c) for c in chain))).alias("y"))
    picked = least.select("doc_id", "y.*").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` rows, so this side may be broadcast
    both = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").groupBy("doc_id", *chain).agg(F.min("text").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{c} int" for c in chain) + ", places binary"
    found = both.select(F.col("doc_id").cast("long").alias("doc_id"), *chain, "text").mapInArrow(_features, schema).toPandas()
    found = found.sort_values("doc_id", kind="stable")  # at most `rows` rows
    sets = [np.frombuffer(x, np.int32) for x in found["places"]]
    folds = np.array([zlib.crc32(str(d).encode()) % FOLDS for d in found["doc_id"]], np.int64)
    return fit_chain(sets, found[list(chain)].to_numpy(np.float64), folds)


def score(docs: DataFrame, models: list[Linear], chain: tuple[str, ...] = CHAIN) -> DataFrame:
    """docs with p_<category> for each category."""
    names = [f"p_{c}" for c in chain]
    docs = docs.drop(*names)
    text = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(models)  # at most KEEP weights each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        wanted = set(np.concatenate([m.used for m in held]).tolist())
        seen: dict[str, tuple] = {}
        for b in batches:
            sets = []
            for t in b.column(text):
                found: set[int] = set()
                for w in set(_WORD.findall((t.as_py() or "").lower())):
                    at = seen.get(w)
                    if at is None:
                        if len(seen) > 200_000:
                            seen.clear()
                        at = seen[w] = tuple(word_places(w) & wanted)
                    if at:
                        found.update(at)
                sets.append(np.fromiter(sorted(found), np.int32, len(found)))
            p = predict_chain(held, sets)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(len(names)))], names=[*b.schema.names, *names])

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # Arrow functions refuse some column names
    scored = plain.mapInArrow(run, T.StructType([*plain.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))
    return scored.toDF(*docs.columns, *names)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models, thresholds = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, models)
    return out.select("doc_id", *(F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CHAIN), (F.col("p_toxic") >= thresholds[-1]).alias("toxic"))


QUERIES = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
