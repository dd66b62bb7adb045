"""Quality scores by Bradley-Terry ranking.

Documents are preferred by label: each pair (label 1, label 0) is a preference.  The score of a
document is linear in standardised text statistics; weights minimise the logistic loss on the
feature differences of pairs, P(a over b) = sigmoid(w (x_a - x_b)).  Scores are then cut at a
quantile of the training scores: the one with the best balanced accuracy.  The returned score is
the sigmoid of the distance from that cut, so 0.5 is the cut.

Training takes at most ``MOST_ROWS`` labelled rows of each label, chosen by hash of the id, and where
ids are repeated of the row, and ``MOST_PAIRS`` pairs; only their statistics reach the driver.

Defined results: null text is empty and is scored by its (zero) statistics; labels that are null
or on no document teach nothing; without rows of both labels every score is 0.5; equal rows are
scored each; a text of any length is scored whole, by the task that holds its row; columns besides those
asked for are not read, and may have any names but the score's; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, fold_of, slices, table, texts_of
from .text_stats import Texts

MOST_ROWS, MOST_PAIRS = 3000, 20_000


def features(t: Texts) -> np.ndarray:
    n, c, lines = np.maximum(t.n_words, 1), np.maximum(t.word_chars, 1), np.maximum(t.n_lines, 1)
    return np.column_stack([
        np.log1p(t.n_words), np.minimum(t.word_chars / n, 40), np.minimum(t.n_symbols / n, 5), np.sqrt(t.n_symbols / c), t.n_dup_lines / lines,
        t.n_repeat_words / n, t.n_letter_words / n, t.n_short_words / n, t.n_upper / c, t.n_digits / c, t.n_punct / n,
        t.n_distinct_words / n, np.log1p(t.n_words / lines), t.n_words < 20,
    ]).astype(np.float64)


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.cut), -30, 30)))


def fit_pairs(x: np.ndarray, label: np.ndarray, l2: float = 1e-3, steps: int = 60, seed: int = 7) -> Ranker:
    width = x.shape[1]
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    k = min(MOST_PAIRS, len(good) * len(bad))
    d = z[rng.choice(good, k)] - z[rng.choice(bad, k)]
    w = np.zeros(width)
    for _ in range(steps):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / k + l2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / k + l2 * np.eye(width)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / (np.linalg.norm(step) + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    cuts = np.quantile(s, np.linspace(0.001, 0.999, 999))
    hit = np.searchsorted(np.sort(s[bad]), cuts) / len(bad) + 1 - np.searchsorted(np.sort(s[good]), cuts) / len(good)
    best = np.flatnonzero(hit >= hit.max() - 1e-12)
    cut = float(cuts[best[len(best) // 2]])
    return Ranker(mean, scale, w, cut, 1.0)


def feature_rows(docs: DataFrame, extra: list[str]) -> DataFrame:
    def run(batches):
        for b in batches:
            x = [features(Texts(raw, offsets)) for _, _, raw, offsets in slices(column(b, "text"))]
            flat = np.concatenate(x).ravel() if x else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.linspace(0, len(flat), b.num_rows + 1).round().astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in extra), lists], names=[*extra, "x"])

    kinds = dict(docs.dtypes)
    return docs.select(*extra, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in extra) + ", x array<double>")


def bounded_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` labelled ids of each label outside the held-out fold, by hash: a table small enough to broadcast."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where((fold_of("doc_id", 3) != 1) & F.col("label").isNotNull())
    one = lambda v: lab.where(F.col("label") == v).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return one(1).unionAll(one(0))


def bounded_rows(rows: DataFrame, what: str, most: int) -> DataFrame:
    """At most `most` rows of each label, by hash of id and `what`: as ids may be repeated, their bound isn't one of rows.

    Tasks keep no more than that before rows of a label meet.
    """
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id", what), "doc_id"))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Ranker:
    some = docs.join(F.broadcast(bounded_labels(labels, label, MOST_ROWS)), "doc_id")  # at most 2 * MOST_ROWS ids
    rows = bounded_rows(feature_rows(some, ["doc_id", "label"]), "x", MOST_ROWS).toPandas().sort_values(["doc_id", "label", "place"])
    x = np.array(rows["x"].tolist(), np.float64) if len(rows) else np.zeros((0, features(Texts(np.zeros(0, np.uint8), np.zeros(2, np.int64))).shape[1]))
    return fit_pairs(x, rows["label"].to_numpy())


def score_texts(docs: DataFrame, ranker: Ranker, extra: list[str], out: str = "score") -> DataFrame:
    """The columns `extra` of docs, and the score under the name `out`."""

    def run(batches):
        for b in batches:
            s = [ranker.score(features(Texts(raw, offsets))) for _, _, raw, offsets in slices(column(b, "text"))]
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in extra), pa.array(np.concatenate(s) if s else np.zeros(0))], names=[*extra, out])

    kinds = dict(docs.dtypes)
    return docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*extra, "text"]))).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in extra) + f", `{out}` double")


def op2_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts_of(table(spark, sf_dir, "documents"))
    ranker = train(docs, table(spark, sf_dir, "labels"))
    s = score_texts(docs, ranker, ["doc_id"])
    return s.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
