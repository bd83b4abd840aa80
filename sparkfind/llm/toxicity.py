"""Toxicity by class-conditional Kneser-Ney models of word pieces.

An expression is a piece of five bytes inside a word (blanks at its ends mark the word's; A-Z
lower-cased). Three distributions over the expressions of the training texts, each summing to 1:

- shared: both classes' counts, less a discount of ``DISCOUNT`` each; the discounted mass backs off to
  continuation counts (how many different expressions an expression follows), as Kneser and Ney have it.
- toxic and ordinary: the class's count, less a discount as large as what the shared distribution
  explains (the count it leads one to expect and ``DOUBT`` standard errors of it); the discounted mass
  backs off to the shared distribution. So a rare expression has no say of its own in either class,
  and one that is frequent in one class keeps the part of its count that is its class's own.

A text's feature is the difference of its log-likelihoods per expression; a logistic curve makes it a
score. Counts come from labelled rows of remainder 1 to 3, the curve from those of remainder 4,
which the counts have not seen. An expression that is in neither class's own part, or in no training
text, has the same ratio as all others of its kind, so only the classes' own expressions are listed.

Training reads at most ``max_rows`` labelled rows (a documented bound: those of least hash of id), so the
list that executors receive is bounded by their texts; scoring reads every row and every whole text.

Null and empty texts score as a text without evidence. Labels that are null or neither 0 nor 1, or
whose document is missing, teach nothing; repeated labels of a document count once, as toxic if any
is. Without labels of both classes all scores are alike. A row without doc_id is scored;
its id as text is taken to be "null". An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import _LOWER, _SPACE, U64, schema_columns, text_chunks

MAX_ROWS = 20_000
PIECE, DISCOUNT, DOUBT = 5, 0.75, 5.0
#: What an expression at a text's start follows.
START = (1 << 40) - 1
_SLOTS = 21
_CODE = np.where(_SPACE, 0x20, _LOWER).astype(U64)


def remainder(doc_id: str = "doc_id") -> "F.Column":
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % 5


def pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The expressions of a chunk of texts as 40-bit numbers, and the text of each, in order."""
    n = len(off) - 1
    # a blank before and after each text: its first and last words are marked like all others
    at = np.arange(len(buf)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))
    code = np.full(len(buf) + 2 * n, 0x20, U64)
    code[at] = _CODE[buf]
    m = len(code) - PIECE + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    blank = code == U64(0x20)
    inside = ~(blank[1 : m + 1] | blank[2 : m + 2] | blank[3 : m + 3])
    key = np.zeros(m, U64)
    for i in range(PIECE):
        key = key << U64(8) | code[i : i + m]
    where = np.flatnonzero(inside)
    bounds = off[1:] + 2 * np.arange(n) + 2
    return key[where], np.searchsorted(bounds, where, "right")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each expression after each other one."""
    for batch in batches:
        text, toxic = schema_columns(batch, "text", "toxic")
        toxic = toxic.to_numpy().astype(np.int64)
        for i, j, buf, off in text_chunks(text):
            key, row = pieces(buf, off)
            follows = np.full(len(key), START, U64)
            follows[1:] = np.where(row[1:] == row[:-1], key[:-1], U64(START))
            order = np.lexsort((follows, key))
            key, follows, ones = key[order], follows[order], toxic[i:j][row[order]]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (follows[1:] != follows[:-1])])[: len(key)])
            total = np.diff(np.concatenate([new, [len(key)]]))
            ones = np.add.reduceat(ones, new) if len(new) else ones
            yield pa.RecordBatch.from_arrays([pa.array(key[new].astype(np.int64)), pa.array(follows[new].astype(np.int64)), pa.array(ones), pa.array(total - ones)], ["piece", "follows", "n1", "n0"])


def shared_distribution(n: np.ndarray, kinds: np.ndarray, total: float, seen: float, total_kinds: float) -> np.ndarray:
    """Interpolated: discounted counts, and continuation counts for what they leave (``seen`` expressions are discounted)."""
    return (n - DISCOUNT + DISCOUNT * seen * kinds / total_kinds) / total


def own_part(n: np.ndarray, total: float, shared: np.ndarray, doubt: float = DOUBT) -> np.ndarray:
    """What is left of a class's counts without what the shared distribution explains."""
    expected = total * shared
    return np.maximum(n - expected - doubt * np.sqrt(expected + 1), 0)


def ratios(own1: np.ndarray, own0: np.ndarray, shared: np.ndarray, all1: float, all0: float, sum1: float, sum0: float) -> np.ndarray:
    """The difference of log-likelihoods of expressions under the two models; sum1 and sum0 are all own parts."""
    p1 = own1 / all1 + (1 - sum1 / all1) * shared
    p0 = own0 / all0 + (1 - sum0 / all0) * shared
    return np.log(p1 / p0)


class Model:
    """The classes' own expressions with their log ratios, that of all others, and the curve's weights; ``features`` works on chunks of texts."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, other: float = 0.0, weights: tuple[float, float] = (0.0, 1.0)):
        self.keys, self.values, self.other, self.weights, self._table = keys.astype(U64), values.astype(np.float64), other, weights, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U64(0x9E3779B97F4A7C15) >> U64(64 - _SLOTS)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The ratio of each expression: a table of slots, then the rest by search."""
        if self._table is None:
            slots, held, value = self._slot(self.keys), np.full(1 << _SLOTS, ~U64(0), U64), np.zeros(1 << _SLOTS)
            held[slots], value[slots] = self.keys, self.values
            lost = np.flatnonzero(held[slots] != self.keys)
            order = lost[np.argsort(self.keys[lost])]
            crowded = np.zeros(1 << _SLOTS, bool)
            crowded[slots[lost]] = True
            self._table = held, value, crowded, self.keys[order], self.values[order]
        held, value, crowded, rest, rest_values = self._table
        slot = self._slot(keys)
        same = held[slot] == keys
        out = np.where(same, value[slot], self.other)
        if len(rest):
            odd = np.flatnonzero(~same & crowded[slot])
            at = np.minimum(np.searchsorted(rest, keys[odd]), len(rest) - 1)
            out[odd] = np.where(rest[at] == keys[odd], rest_values[at], self.other)
        return out

    def features(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The mean ratio of each text's expressions (0 without any)."""
        key, row = pieces(buf, off)
        n = len(off) - 1
        total = np.bincount(row, weights=self.lookup(key), minlength=n)
        return total / np.maximum(np.bincount(row, minlength=n), 1)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * features, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Intercept and slope by Newton's method, slightly ridged; the intercept alone if x says nothing."""
    scale = x.std() or 1.0
    design = np.stack([np.ones(len(x)), x / scale], 1)
    t = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ t, -30, 30)))
        grad = design.T @ (y - p) - 1e-3 * t
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-3 * np.eye(2), grad)
        t = t + step
        if np.abs(step).max() < 1e-8:
            break
    return t / np.array([1.0, scale])


def fitted(counted: DataFrame) -> Model:
    """A model (without a curve) of counts (piece, n1, n0, kinds); the classes' own expressions reach the driver."""
    all1, all0, seen, kinds = (float(x or 0) for x in counted.agg(F.sum("n1"), F.sum("n0"), F.count(F.lit(1)), F.sum("kinds")).first())
    if not all1 or not all0:
        return Model(np.zeros(0, U64), np.zeros(0))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece, n1, n0, k = (c.to_numpy() for c in schema_columns(batch, "piece", "n1", "n0", "kinds"))
            shared = shared_distribution(n1 + n0, k, all1 + all0, seen, kinds)
            own1, own0 = own_part(n1, all1, shared), own_part(n0, all0, shared)
            some = (own1 > 0) | (own0 > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (piece, own1, own0, shared)], ["piece", "own1", "own0", "shared"])

    found = counted.select("piece", "n1", "n0", "kinds").mapInArrow(own, "piece long, own1 double, own0 double, shared double").toPandas().sort_values("piece")
    sum1, sum0 = found["own1"].sum(), found["own0"].sum()
    values = ratios(found["own1"].to_numpy(), found["own0"].to_numpy(), found["shared"].to_numpy(), all1, all0, sum1, sum0)
    return Model(found["piece"].to_numpy(np.int64), values, math.log((1 - sum1 / all1) / (1 - sum0 / all0)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from the labelled rows of ``docs`` whose remainder is not 0."""
    known = labels.filter("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    taught = known.filter(remainder() != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(taught), "doc_id").select("text", "toxic", (remainder() == 4).alias("curve"))
    pairs = rows.filter("not curve").select("text", "toxic").mapInArrow(_count, "piece long, follows long, n1 long, n0 long").groupBy("piece", "follows").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counted = pairs.groupBy("piece").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count(F.lit(1)).alias("kinds")).persist()
    model = fitted(counted)
    counted.unpersist()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    curve = rows.filter("curve").select("text", "toxic").mapInArrow(_features(shared), "x double, y int").toPandas()  # max_rows rows at most
    if curve["y"].nunique() == 2:
        model.weights = tuple(logistic(curve["x"].to_numpy(), curve["y"].to_numpy().astype(float)))
    else:
        model.weights = (-2.0, 1.0)
    return model


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text, y = schema_columns(batch, "text", "toxic")
            for i, j, buf, off in text_chunks(text):
                yield pa.RecordBatch.from_arrays([pa.array(model.features(buf, off)), y.slice(i, j - i).cast(pa.int32())], ["x", "y"])

    return run


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores (named ``name``, which docs must not have): every row, whole texts of its column text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, buf, off in text_chunks(batch.column(names.index("text"))):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.scores(m.features(buf, off)))], [*names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder() == 0).alias("held_out"), "score", F.expr("int(score >= 0.5)").alias("predicted"))
