"""Linear models: regression, logistic and softmax regression.

An epoch is one Spark job: every partition runs mini-batch gradient steps from the shared weights
on its own rows (numpy), and the weights are averaged by rows.  Results depend on the data's
partitioning only, not on timing.  Features come as an array column, or as sparse rows (see sparse):
then a step touches only the weights of what its rows hold, and predictions are one pass over the rows
with the weights beside it, so that neither memory nor plans grow with the number of features.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.numbers import dot, sigmoid, softmax
from loomstat.operators.sparse import Rows, is_sparse, rows_of

#: Weights that one row of sums holds.
CHUNK = 4096


@dataclass
class LinearModel:
    """kind: regression, binary or multiclass; weights and biases have one row per output."""

    kind: str
    weights: list[list[float]]
    biases: list[float]
    means: list[float]
    losses: list[float] = field(default_factory=list)

    def scores(self, features: Column) -> list[Column]:
        return [dot(features, w) + F.lit(b) for w, b in zip(self.weights, self.biases, strict=True)]

    def output(self, features: Column) -> Column:
        """The value, the probability of the second class, or the array of class probabilities."""
        s = self.scores(features)
        return softmax(F.array(*s)) if self.kind == "multiclass" else sigmoid(s[0]) if self.kind == "binary" else s[0]

    def contributions(self, features: Column, k: int = 0) -> Column:
        """w * (x - mean) per feature: with `baseline` they add up to the score."""
        w, m = (F.array(*(F.lit(float(x)) for x in xs)) for xs in (self.weights[k], self.means))
        return F.zip_with(F.zip_with(features, m, lambda x, c: x - c), w, lambda a, b: a * b)

    def baseline(self, k: int = 0) -> float:
        return self.biases[k] + float(np.dot(self.weights[k], self.means))

    @property
    def importances(self) -> list[float]:
        w = np.abs(np.array(self.weights)).mean(axis=0)
        return list(w / w.sum()) if w.sum() else list(w)


class EarlyStopping:
    """Says when `rounds` values in a row didn't get better by `least`."""

    def __init__(self, rounds: int = 5, least: float = 1e-5):
        self.rounds, self.least, self.last, self.bad = rounds, least, None, 0

    def stop(self, value: float) -> bool:
        worse = self.last is not None and (value > self.last or abs(value - self.last) < self.least)
        self.bad = self.bad + 1 if worse else 0
        self.last = value
        return self.bad >= self.rounds


def _link(kind: str, z: np.ndarray) -> np.ndarray:
    if kind == "regression":
        return z
    if kind == "binary":
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _loss(kind: str, p: np.ndarray, y: np.ndarray) -> float:
    if kind == "regression":
        return float(((p[:, 0] - y) ** 2).sum())
    own = np.where(y == 1, p[:, 0], 1 - p[:, 0]) if kind == "binary" else p[np.arange(len(y)), y.astype(int)]
    return float(-np.log(np.clip(own, 1e-7, 1)).sum())


def train_linear(
    df: DataFrame, features: str, label: str, kind: str, n_classes: int = 1, learning_rate: float = 0.1, epochs: int = 100, batch: int = 32, l2: float = 0.0, stopping: EarlyStopping | None = None, watch: DataFrame | None = None, deadline: float | None = None,
    width: int | None = None,
) -> LinearModel:
    """label: a number, 0/1, or a class index from 0.  watch: rows whose loss decides on stopping; deadline: a
    time of time.monotonic() after which no further epoch begins; width: how many features sparse rows have."""
    outputs = n_classes if kind == "multiclass" else 1
    data = df.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y")).persist()
    wide = is_sparse(data, "x")
    if watch is not None:
        watch = watch.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y")).persist()
    try:
        if wide:
            k, mean = _sparse_means(data, width)
        else:
            head = data.select(F.size("x").alias("k")).first()
            if head is None:
                raise ValueError("no rows to train on")
            k = head["k"]
            means = data.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m")).collect()  # one row per feature
            mean = np.zeros(k)
            mean[[r.pos for r in means]] = [r.m for r in means]
        w = np.zeros((outputs, k + 1))
        losses = []
        for _ in range(epochs):
            if losses and deadline is not None and time.monotonic() > deadline:
                break
            now = w.copy()

            def epoch(batches, now=now):
                v, n, loss = now.copy(), 0, 0.0
                for b in batches:
                    x, y = _features(b, k, wide)
                    loss += _loss(kind, _link(kind, _scores(x, now)), y)
                    for i in range(0, len(y), batch):
                        xs, ys = x.slice(i, i + batch) if wide else x[i : i + batch], y[i : i + batch]
                        target = np.eye(outputs)[ys.astype(int)] if kind == "multiclass" else ys[:, None]
                        off = (_link(kind, _scores(xs, v)) - target) / len(ys)
                        if wide:
                            _sparse_step(v, xs, off, learning_rate, l2)
                        else:
                            step = off.T @ xs
                            step[:, :-1] += l2 * v[:, :-1]
                            v -= learning_rate * step
                    n += len(y)
                if n:
                    flat = v.ravel() * n
                    for c in range(0, len(flat), CHUNK):
                        yield pa.RecordBatch.from_pydict({"chunk": [c], "n": [n], "loss": [loss], "sums": pa.array([flat[c : c + CHUNK].tobytes()], pa.binary())})

            def add(t: pa.Table) -> pa.Table:
                s = np.sum([np.frombuffer(x.as_buffer()) for x in t["sums"]], axis=0)
                return pa.table({"chunk": t["chunk"].slice(0, 1), "n": [sum(t["n"].to_pylist())], "loss": [sum(t["loss"].to_pylist())], "sums": pa.array([s.tobytes()], pa.binary())})

            schema = "chunk long, n long, loss double, sums binary"
            sums = data.mapInArrow(epoch, schema).groupBy("chunk").applyInArrow(add, schema).collect()  # the weights
            for r in sums:
                w.ravel()[r.chunk : r.chunk + CHUNK] = np.frombuffer(r["sums"]) / r.n
            losses.append(sums[0].loss / sums[0].n)
            if stopping and stopping.stop(_watched(watch, kind, w, k, wide) if watch is not None else losses[-1]):
                break
    finally:
        data.unpersist()
        if watch is not None:
            watch.unpersist()
    return LinearModel(kind, w[:, :-1].tolist(), w[:, -1].tolist(), mean.tolist(), losses)


def _sparse_means(data: DataFrame, width: int | None) -> tuple[int, np.ndarray]:
    """The number of features and their means, from one pass that adds up what is stored."""
    k = width if width is not None else (data.select(F.max(F.array_max("x.i")).alias("m")).first().m or 0) + 1

    def run(batches):
        total, n = np.zeros(k), 0
        for b in batches:
            x = rows_of(b.column(0), k)
            total += np.bincount(x.index, x.value, k)
            n += len(x)
        for c in range(0, k if n else 0, CHUNK):
            yield pa.RecordBatch.from_pydict({"chunk": [c], "n": [n], "sums": pa.array([total[c : c + CHUNK].tobytes()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        s = np.sum([np.frombuffer(x.as_buffer()) for x in t["sums"]], axis=0)
        return pa.table({"chunk": t["chunk"].slice(0, 1), "n": [sum(t["n"].to_pylist())], "sums": pa.array([s.tobytes()], pa.binary())})

    schema, mean = "chunk long, n long, sums binary", np.zeros(k)
    rows = data.mapInArrow(run, schema).groupBy("chunk").applyInArrow(add, schema).collect()  # k numbers
    if not rows and k:
        raise ValueError("no rows to train on")
    for r in rows:
        mean[r.chunk : r.chunk + CHUNK] = np.frombuffer(r["sums"]) / r.n
    return k, mean


def _sparse_step(v: np.ndarray, x: Rows, off: np.ndarray, learning_rate: float, l2: float) -> None:
    """A gradient step on v (outputs x (features + bias)), touching what the rows hold and, with l2, all weights."""
    if l2:
        v[:, :-1] *= 1 - learning_rate * l2
    columns, at = np.unique(x.index, return_inverse=True)
    row = x.row
    for o in range(len(v)):
        v[o, columns] -= learning_rate * np.bincount(at, off[row, o] * x.value, len(columns))
    v[:, -1] -= learning_rate * off.sum(axis=0)


def _scores(x: np.ndarray | Rows, w: np.ndarray) -> np.ndarray:
    return x.dot(w[:, :-1]) + w[:, -1] if isinstance(x, Rows) else x @ w.T


def _features(b: pa.RecordBatch, k: int, wide: bool) -> tuple[np.ndarray | Rows, np.ndarray]:
    return (rows_of(b.column(0), k), np.asarray(b.column(1), float)) if wide else _matrix(b, k)


def with_linear_scores(df: DataFrame, model: LinearModel, features: str, name: str = "score") -> DataFrame:
    """df with the score of each output before any link function, of sparse rows, by one pass."""
    n, at = len(df.columns), df.columns.index(features)
    w = np.hstack((np.array(model.weights), np.array(model.biases)[:, None]))

    def run(batches):
        for b in batches:
            s = _scores(rows_of(b.column(at), w.shape[1] - 1), w)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(list(s), pa.list_(pa.float64()))], names=[*b.schema.names[:n], name])

    return df.mapInArrow(run, df.withColumn(name, F.lit(None).cast("array<double>")).schema)


def _matrix(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(b.column(0).flatten(), float).reshape(-1, k)
    return np.hstack((x, np.ones((len(x), 1)))), np.asarray(b.column(1), float)


def _watched(watch: DataFrame, kind: str, w: np.ndarray, k: int, wide: bool) -> float:
    def run(batches):
        for b in batches:
            x, y = _features(b, k, wide)
            yield pa.RecordBatch.from_pydict({"loss": [_loss(kind, _link(kind, _scores(x, w)), y)], "n": [len(y)]})

    r = watch.mapInArrow(run, "loss double, n long").agg(F.sum("loss").alias("a"), F.sum("n").alias("n")).first()
    return r.a / r.n if r.n else 0.0
