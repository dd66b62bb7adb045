"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams (4 and 5 characters, A-Z as a-z, with the
text's ends padded) that it holds at least once.  On labelled texts each n-gram gets the ratio
r = ln(p / q) of its smoothed shares in toxic and clean texts; a logistic regression is then
trained on features scaled by r.  All n-grams of the labelled texts count; the L2 penalty holds weak
ones down.  Training rows are sparse: memory follows the labelled texts, not rows times n-grams.

Training takes at most ``MOST_ROWS`` labelled texts of each label, chosen by hash of the id, and where
ids are repeated of the text.

Defined results: null text is empty and gets the intercept's score; labels that are null or on no
document teach nothing; without rows of both labels every score is 0; equal rows are scored each; a text
of any length is scored whole, by the task that holds its row, and if it teaches gives the driver its
distinct buckets, 4 MB at most; columns besides those asked for are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fold_of, table, texts_of
from .quality_rank import bounded_labels, bounded_rows

MOST_ROWS, BITS, SIZES = 1500, 20, (4, 5)
SLICE_CHARS, STEPS, RATE = 1 << 18, 80, 0.02
_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def grams(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of `size`, and the text each belongs to."""
    pad = " " * 4
    chars = np.frombuffer("".join([x for t in texts for x in (pad, t)] + [pad]).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.where((chars >= 65) & (chars <= 90), chars + 32, chars)
    lengths = np.fromiter((len(t) + 4 for t in texts), np.int64, len(texts))
    n = int(lengths.sum())
    h = np.full(n, size, np.uint32)
    for k in range(size):
        h = (h ^ chars[k : k + n]) * _MULTIPLY[k]
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), np.repeat(np.arange(len(texts)), lengths)


def runs(texts: list[str]):
    """Neighbouring texts, about SLICE_CHARS characters at a time."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t) + 4
    if start < len(texts):
        yield start, len(texts)


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray  # by bucket, 0 for n-grams that no labelled text holds
    intercept: float

    def margin(self, texts: list[str]) -> np.ndarray:
        out, last = np.full(len(texts), self.intercept), np.empty(1 << BITS, np.int32)
        for i, j in runs(texts):
            each = [grams(texts[i:j], size)[0] for size in SIZES]
            ends = np.cumsum([len(t) + 4 for t in texts[i:j]]).tolist()
            for k, (a, z) in enumerate(zip([0, *ends[:-1]], ends, strict=True), i):
                g = np.concatenate([x[a:z] for x in each])
                place = np.arange(len(g), dtype=np.int32)
                last[g] = place  # each n-gram counts once a text, where it was last
                out[k] += self.weights[g[last[g] == place]].sum(dtype=float)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(texts), -30, 30)))


def fit(features: list[np.ndarray], label: np.ndarray, base_rate: float, smoothing: float = 0.5, l2: float = 2e-3, steps: int = STEPS, rate: float = RATE) -> Classifier:
    """Logistic loss of both labels in equal shares plus the L2 penalty, by Adam on all rows."""
    size = 1 << BITS
    toxic, clean = int((label == 1).sum()), int((label == 0).sum())
    if not toxic or not clean:
        return Classifier(np.zeros(size, np.float32), -30.0)
    count = [np.zeros(size), np.zeros(size)]
    for f, y in zip(features, label, strict=True):
        count[int(y)][f] += 1
    r = np.log((count[1] + smoothing) / (toxic + 2 * smoothing)) - np.log((count[0] + smoothing) / (clean + 2 * smoothing))
    place = np.flatnonzero(count[0] + count[1])
    lookup = np.zeros(size, np.int32)
    lookup[place] = np.arange(len(place))
    some = [features[i : i + 64] for i in range(0, len(features), 64)]  # temporaries of a step stay small
    rows = [(64 * i, 64 * i + len(k), np.array([len(f) for f in k]), lookup[np.concatenate(k)]) for i, k in enumerate(some)]
    scale, y = r[place].astype(np.float32), label.astype(np.float32)
    weight = np.where(y == 1, 0.5 / toxic, 0.5 / clean).astype(np.float32)
    w, b = np.zeros(len(place), np.float32), 0.0
    m, v, b_m, b_v = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        g, b_g, scaled = np.zeros_like(w), 0.0, w * scale
        for i, j, n, at in rows:
            sums = np.concatenate(([0.0], np.cumsum(scaled[at], dtype=float)))[np.concatenate(([0], np.cumsum(n)))]
            e = (1 / (1 + np.exp(-np.clip(np.diff(sums) + b, -30, 30))) - y[i:j]) * weight[i:j]
            g += np.bincount(at, np.repeat(e, n), len(place)).astype(np.float32)
            b_g += float(e.sum())
        g = g * scale + np.float32(l2) * w
        m, v = np.float32(0.9) * m + np.float32(0.1) * g, np.float32(0.99) * v + np.float32(0.01) * g * g
        b_m, b_v = 0.9 * b_m + 0.1 * b_g, 0.99 * b_v + 0.01 * b_g * b_g
        w -= np.float32(rate / (1 - 0.9**t)) * m / (np.sqrt(v / np.float32(1 - 0.99**t)) + np.float32(1e-9))
        b -= rate * (b_m / (1 - 0.9**t)) / (np.sqrt(b_v / (1 - 0.99**t)) + 1e-9)
    full = np.zeros(size, np.float32)
    full[place] = w * scale
    base = min(max(base_rate, 1e-4), 1 - 1e-4)
    return Classifier(full, float(b + np.log(base / (1 - base)) / 2))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Classifier:
    some = docs.join(F.broadcast(bounded_labels(labels, label, MOST_ROWS)), "doc_id")  # at most 2 * MOST_ROWS ids

    def run(batches):
        for b in batches:
            found = [np.unique(np.concatenate([grams([t], s)[0] for s in SIZES])).astype(np.uint32).tobytes() for t in column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "label"), pa.array(found, pa.binary())], names=["doc_id", "label", "f"])

    rows = bounded_rows(some.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, f binary"), "f", MOST_ROWS).toPandas().sort_values(["doc_id", "label", "place"])
    lab = labels.where((fold_of("doc_id", 3) != 1) & F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return fit([np.frombuffer(f, np.uint32) for f in rows["f"]], rows["label"].to_numpy(), lab or 0.0)


def score_texts(docs: DataFrame, model: Classifier, extra: list[str], out: str = "score") -> DataFrame:
    """The columns `extra` of docs, and the score under the name `out`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the corpus

    def run(batches):
        for b in batches:
            s = shared.value.score([t or "" for t in column(b, "text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in extra), pa.array(s)], names=[*extra, out])

    kinds = dict(docs.dtypes)
    return docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*extra, "text"]))).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in extra) + f", `{out}` double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts_of(table(spark, sf_dir, "documents"))
    s = score_texts(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return s.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
