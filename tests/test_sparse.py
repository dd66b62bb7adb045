"""Sparse rows: equal to dense ones in features, training, prediction and explanation, and bounded by what is stored."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstat.operators import features as feat
from loomstat.operators import linear, sparse, trees
from loomstat.plans import train as t
from loomstat.schema import ColumnType, typed_load


def matrix(seed=1, rows=400, width=30, holes=0.7):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, width)), 1) * (rng.random((rows, width)) > holes)
    x[:, 3], x[:, 4] = 7.0, 0.0  # features that cannot split
    x[:2, 5] = 1.0
    x[2:, 5] = 0.0
    x[:30, 6] = np.nan
    x[:, 7] = rng.integers(0, 4, rows)
    y = np.nan_to_num(x) @ rng.normal(size=width) + rng.normal(size=rows) * 0.1
    return x, y


def frames(spark, x, y):
    """The same rows dense and sparse, in one partition, so that sums run in one order."""
    d = spark.createDataFrame([(i, [float(v) for v in r], float(b)) for i, (r, b) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double").coalesce(1)
    s = spark.createDataFrame([(i, {"i": [int(k) for k in np.flatnonzero(r)], "v": [float(v) for v in r[np.flatnonzero(r)]]}, float(b)) for i, (r, b) in enumerate(zip(x, y, strict=True))], f"id long, x {sparse.TYPE}, y double").coalesce(1)
    return d, s


def test_rows():
    x, _ = matrix(rows=20)
    r = sparse.rows_of(pa.array([list(v) for v in x], pa.list_(pa.float64())), x.shape[1])
    assert np.array_equal(r.dense(), x, equal_nan=True) and np.array_equal(sparse.rows_of(sparse.column_of(r), x.shape[1]).dense(), x, equal_nan=True)
    part = sparse.rows_of(sparse.column_of(r).slice(5, 7), x.shape[1])
    assert np.array_equal(part.dense(), x[5:12], equal_nan=True) and np.array_equal(r.slice(5, 12).dense(), x[5:12], equal_nan=True)
    clean = r.slice(0, 0)
    assert len(clean) == 0 and clean.dense().shape == (0, x.shape[1])
    w = np.arange(2 * x.shape[1], dtype=float).reshape(2, -1)
    full = sparse.rows_of(pa.array([list(v) for v in np.nan_to_num(x)], pa.list_(pa.float64())), x.shape[1])
    assert np.allclose(full.dot(w), np.nan_to_num(x) @ w.T)


def test_bins_are_those_of_dense_rows():
    x, _ = matrix(rows=60)
    m = trees.Trees("regression", [0.0], [sorted({-0.5, 0.2, float(i)}) for i in range(x.shape[1])], [7])
    col = sparse.column_of(sparse.rows_of(pa.array([list(v) for v in x], pa.list_(pa.float64())), x.shape[1]))
    b, dense = m.bins(col), m.binned(x)
    assert all(np.array_equal(b.column(f), dense[:, f]) for f in range(x.shape[1]))
    again = sparse.unpack(sparse.pack(b), m.defaults)
    assert all(np.array_equal(again.column(f), dense[:, f]) for f in range(x.shape[1]))


@pytest.mark.parametrize("kind,l2", [("regression", 0.0), ("binary", 0.1), ("multiclass", 0.0)])
def test_linear_models_are_equal(spark, kind, l2):
    x, y = matrix()
    x = np.nan_to_num(x)
    label = {"regression": y, "binary": (y > 0).astype(float), "multiclass": np.digitize(y, [-1.0, 1.0]).astype(float)}[kind]
    a, b = (linear.train_linear(f, "x", "y", kind, 3, learning_rate=0.01, epochs=3, l2=l2) for f in frames(spark, x, label))
    assert np.allclose(a.weights, b.weights, atol=1e-9) and np.allclose(a.biases, b.biases, atol=1e-9) and np.allclose(a.means, b.means) and np.allclose(a.losses, b.losses)
    _, s = frames(spark, x, label)
    got = np.array([r.score for r in linear.with_linear_scores(s, a, "x").orderBy("id").collect()])
    assert np.allclose(got, x @ np.array(a.weights).T + a.biases)


@pytest.mark.parametrize("kind", ["regression", "multiclass"])
def test_tree_models_are_equal(spark, kind):
    x, y = matrix(3)
    label = y if kind == "regression" else np.digitize(y, [-1.0, 1.0]).astype(float)
    o = trees.TreeOptions(rounds=2, max_leaves=5, min_rows=10)
    d, s = frames(spark, x, label)
    a, b = (trees.train_trees(f, "x", "y", kind, 3, [7], o) for f in (d, s))
    splits = lambda m: [[[(n.feature, n.bin, n.left_bins) for n in nodes] for nodes in r] for r in m.trees]
    used = {n.feature for r in a.trees for nodes in r for n in nodes}
    assert splits(a) == splits(b) and len(used) > 2 and not used & {3, 4, 5} and b.thresholds[3] == b.thresholds[5] == []
    of = lambda f, m: np.array([r.score for r in trees.with_scores(f, m, "x").orderBy("id").collect()])
    assert np.allclose(of(d, a), of(s, b))
    why = lambda f, m: trees.with_contributions(f, m, "x").orderBy("id").collect()
    one, two = why(d, a), why(s, b)
    assert all(np.allclose(p.contributions, q.contributions) and abs(p.baseline - q.baseline) < 1e-9 for p, q in zip(one, two, strict=True))
    assert np.allclose([p.baseline + sum(p.contributions) for p in one], of(d, a)[:, 0])


def table(spark, rows=300, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    text = lambda good: " ".join([rng.choice(words) for _ in range(12)] + (["splendid"] if good else ["dreadful"]) * (rng.random() < 0.9))
    data = [(text(i % 2), str(rng.random()), "yes" if i % 2 else "no") for i in range(rows)]
    raw = spark.createDataFrame(data, "text string, number string, y string")
    return typed_load(raw, {"text": ColumnType("text"), "number": ColumnType("number"), "y": ColumnType("enum", ("no", "yes"))})


def test_sparse_features_equal_dense_ones(spark):
    df = table(spark, 40)
    types = {"text": ColumnType("text"), "number": ColumnType("number"), "y": ColumnType("enum", ("no", "yes"))}
    groups = feat.fit(df, [feat.Group("normalized", "number"), feat.Group("bag_of_words", "text", strategy="tfidf"), feat.Group("one_hot", "y"), feat.Group("bag_of_words_cosine", "text", other="text")], types, 50)
    width = sum(len(g.names) for g in groups)
    d = {r.number: r.x for r in feat.with_features(df, groups, "x").collect()}
    for r in feat.with_features(df, groups, "x", sparse=True).collect():
        full = np.zeros(width)
        full[r.x["i"]] = r.x["v"]
        assert np.allclose(full, d[r.number]) and all(r.x["v"])
    numbers = feat.with_features(df, groups[:1], "x", sparse=True).first()
    assert len(numbers.x["i"]) == 1


def test_a_wide_text_column_trains_both_models(spark):
    df = table(spark)
    for g in ({"model": "linear", "l2": 0.0, "learning_rate": 0.1, "epochs": 3, "batch": 32}, {"model": "tree", "learning_rate": 0.3, "max_leaves": 4, "rounds": 3}):
        m = t.train(df, "y", t.Config(grid=(g,)))
        assert m.wide and len(m.feature_names) > 2000 and m.metrics["accuracy"] > 0.8
        out = t.predict(df.limit(4), m, contributions=True)
        assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 100_000  # names and weights are not in it
        plain = {r.number: r.prediction.probability for r in t.predict(df.limit(4), m).collect()}
        for r in out.collect():
            assert abs(r.prediction.probability - plain[r.number]) < 1e-9 and [c.feature for c in r.contributions] == m.feature_names
            score = r.baseline + sum(c.value for c in r.contributions)
            p = 1 / (1 + np.exp(-score))
            assert abs((p if r.prediction.class_name == "yes" else 1 - p) - r.prediction.probability) < 1e-6
        best = [x["feature"] for x in sorted(m.importances, key=lambda x: -x["importance"])[:4]]
        assert {"text: splendid", "text: dreadful"} & set(best)


def test_time_follows_what_is_stored(spark):
    """The same rows among a hundred times as many features."""
    x, y = matrix(rows=300)
    _, s = frames(spark, np.nan_to_num(x), y)
    far = s.withColumn("x", F.struct(F.transform("x.i", lambda i: i * 100).alias("i"), F.col("x.v").alias("v")))
    times = []
    for f, width in ((s, 30), (far, 3000)):
        began = time.perf_counter()
        m = linear.train_linear(f, "x", "y", "regression", learning_rate=0.01, epochs=2, width=width)
        linear.with_linear_scores(f, m, "x").count()
        times.append(time.perf_counter() - began)
    assert times[1] < 4 * times[0] + 3
