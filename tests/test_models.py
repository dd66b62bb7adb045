"""Splits, linear models, trees and their explanations, training end to end."""

import csv
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import binning
from loomstat.operators.linear import EarlyStopping, train_linear
from loomstat.operators.split import early_stopping_split, shuffled, split
from loomstat.operators.trees import Node, TreeOptions, scores, train_trees, tree_contributions, with_contributions, with_scores
from loomstat.plans import train as t
from loomstat.schema import ColumnType
from loomstat.sources.tables import read_csv


@pytest.fixture(scope="module")
def clinic(tmp_path_factory):
    """A CSV of 303 patients: numbers with gaps, enums, notes with quotes and line breaks, two rows without a diagnosis."""
    rng = random.Random(7)
    path = tmp_path_factory.mktemp("csv") / "clinic.csv"
    with path.open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["age", "gender", "chest_pain", "cholesterol", "note", "diagnosis"])
        for i in range(303):
            pain, age, high = rng.choice(["none", "typical", "atypical"]), rng.randrange(30, 78), rng.gauss(240, 40)
            ill = rng.random() < 1 / (1 + math.exp(-((age - 55) / 8 + (2 if pain == "typical" else -1) + (high - 240) / 60)))
            note = rng.choice(["seen\nonce", 'said "fine"', "two, visits", ""]) + " " + ("pressure pain" if ill and rng.random() < 0.7 else "calm")
            out.writerow([age, rng.choice(["male", "female"]), pain, "?" if i % 17 == 0 else round(high, 1), note, "NA" if i in (5, 50) else "Positive" if ill else "Negative"])
    return str(path)


def test_split_sizes(spark):
    df = spark.range(103)
    parts = {r["part"]: r["count"] for r in split(df, 0.1, 0.2).groupBy("part").count().collect()}
    assert parts == {"train": 73, "comparison": 10, "test": 20}
    rows = sorted(r.row_number for r in shuffled(df).collect())
    assert rows == list(range(103))
    learn, watch = early_stopping_split(shuffled(df), 0.1, last=True)
    assert (learn.count(), watch.count(), watch.agg(F.min("row_number")).first()[0]) == (93, 10, 93)


def test_early_stopping():
    s = EarlyStopping(2, 0.1)
    assert [s.stop(v) for v in (5, 4, 3.99, 3.98)] == [False, False, False, True]


def test_linear_regression(spark):
    d = spark.range(400).select(F.array((F.col("id") % 20 / 10 - 1).cast("double"), (F.col("id") % 7 / 3 - 1).cast("double")).alias("x"))
    d = d.withColumn("y", 3 * F.col("x")[0] - F.col("x")[1] + 0.5).repartition(2)
    m = train_linear(d, "x", "y", "regression", epochs=60)
    assert np.allclose(m.weights, [[3, -1]], atol=0.02) and abs(m.biases[0] - 0.5) < 0.02
    r = d.select(m.output(F.col("x")).alias("p"), m.contributions(F.col("x")).alias("c")).first()
    assert math.isclose(sum(r.c) + m.baseline(), r.p, rel_tol=1e-9)


def test_linear_multiclass(spark):
    d = spark.range(300).select((F.col("id") % 3).alias("y")).withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (i == F.col("y")).cast("double")))
    m = train_linear(d, "x", "y", "multiclass", 3, epochs=20)
    good = d.where(F.array_position(m.output(F.col("x")), F.array_max(m.output(F.col("x")))) == F.col("y") + 1).count()
    assert good == 300


def rows_for_trees(spark, n=600):
    return spark.range(n).select(
        "id", F.array((F.col("id") % 50).cast("double"), F.when(F.col("id") % 11 == 0, float("nan")).otherwise(F.col("id") % 13).cast("double"), (1 + F.col("id") % 3).cast("double")).alias("x"),
    ).withColumn("y", F.when(F.col("x")[0] > 20, 5.0).otherwise(1.0) + F.when(F.col("x")[2] == 2, 2.0).otherwise(0.0))


def test_trees_fit_and_explain(spark):
    d = rows_for_trees(spark)
    m = train_trees(d, "x", "y", "regression", enums=[2], options=TreeOptions(learning_rate=1.0, rounds=3, max_leaves=4, l2_enum=0.0, smoothing=0.0))
    out = with_contributions(with_scores(d, m, "x"), m, "x").collect()
    assert max(abs(r.score[0] - r.y) for r in out) < 0.01
    assert all(math.isclose(sum(r.contributions) + r.baseline, r.score[0], abs_tol=1e-9) for r in out)
    assert math.isclose(sum(m.importances), 1.0) and m.importances[1] < 0.2


def grown_one_by_one(bins, y, o):
    """Best-first growth by plain loops over number features, as a yardstick."""
    g, h = y.mean() - y, np.ones(len(y))
    leaves, splits = {0: np.arange(len(y))}, []

    def best(rows):
        top = None
        for f in range(bins.shape[1]):
            for b in range(bins[:, f].max() + 1):
                left = rows[bins[rows, f] <= b]
                right = rows[bins[rows, f] > b]
                if min(len(left), len(right)) < o.min_rows:
                    continue
                gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[rows].sum() ** 2 / h[rows].sum()
                if top is None or gain > top[0] + 1e-9:
                    top = (gain, f, b, left, right)
        return top

    while len(leaves) < o.max_leaves:
        found = [(best(rows), k) for k, rows in leaves.items()]
        found = [(x, k) for x, k in found if x and x[0] > 1e-9]
        if not found:
            break
        x, k = max(found, key=lambda p: (p[0][0], -p[1]))
        del leaves[k]
        n = 1 + 2 * len(splits)
        leaves[n], leaves[n + 1] = x[3], x[4]
        splits.append((x[1], x[2]))
    return splits


def test_growth_equals_one_by_one(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (300, 2)).astype(float)
    y = np.sin(x[:, 0]) * 3 + x[:, 1] * 0.3 + rng.normal(0, 0.1, 300)
    d = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<double>, y double")
    o = TreeOptions(rounds=1, max_leaves=9, min_rows=10)
    m = train_trees(d, "x", "y", "regression", options=o)
    bins = np.column_stack([1 + np.searchsorted(m.thresholds[f], x[:, f], "left") for f in range(2)])
    want = grown_one_by_one(bins, y, o)
    got = [(n.feature, n.bin) for n in m.trees[0][0] if n.feature >= 0]
    assert sorted(got) == sorted(want)


def test_shapley_by_brute_force():
    nodes = [Node(0, 1.0, 0, bin=2, children=(1, 2)), Node(0, 0.6, 1, bin=1, children=(3, 4)), Node(4.0, 0.4), Node(1.0, 0.2), Node(0, 0.4, 0, bin=1, children=(5, 6)), Node(2.0, 0.1), Node(3.0, 0.3)]
    bins = np.array([[1, 1], [2, 2], [3, 0], [1, 2]])
    out = np.zeros((4, 2))
    base = tree_contributions(nodes, bins, out)

    def value(i, row, known):
        x = nodes[i]
        if x.feature < 0:
            return x.value
        a, b = x.children
        if x.feature in known:
            return value(a if row[x.feature] <= x.bin else b, row, known)
        return sum(nodes[c].share / x.share * value(c, row, known) for c in (a, b))

    for r, row in enumerate(bins):
        for f, other in ((0, 1), (1, 0)):
            want = (value(0, row, {f}) - value(0, row, set()) + value(0, row, {0, 1}) - value(0, row, {other})) / 2
            assert math.isclose(out[r, f], want, abs_tol=1e-12)
    assert math.isclose(base, value(0, bins[0], set()))


def random_tree(rng, features, leaves):
    """A tree in which features come again on a path, with shares as rows would give them."""
    nodes, open_ = [Node(0.0, 1.0)], [0]
    while len(open_) < leaves:
        i = open_.pop(rng.integers(len(open_)))
        a, part = len(nodes), rng.uniform(0.1, 0.9)
        nodes[i] = Node(0.0, nodes[i].share, int(rng.integers(features)), bin=int(rng.integers(1, 9)), children=(a, a + 1))
        nodes += [Node(float(rng.normal()), nodes[i].share * part), Node(float(rng.normal()), nodes[i].share * (1 - part))]
        open_ += [a, a + 1]
    return nodes


def test_shapley_of_deep_trees_by_all_subsets():
    import itertools

    rng = np.random.default_rng(6)
    for _ in range(4):
        nodes, bins, out = random_tree(rng, 5, 14), rng.integers(0, 10, (6, 5)), np.zeros((6, 5))
        base = tree_contributions(nodes, bins, out)

        def value(i, row, known):
            x = nodes[i]
            if x.feature < 0:
                return x.value
            a, b = x.children
            if x.feature in known:
                return value(a if row[x.feature] <= x.bin else b, row, known)
            return sum(nodes[c].share / x.share * value(c, row, known) for c in (a, b))

        for r, row in enumerate(bins):
            for f in range(5):
                rest, want = [x for x in range(5) if x != f], 0.0
                for n in range(5):
                    for some in itertools.combinations(rest, n):
                        want += math.factorial(n) * math.factorial(4 - n) / math.factorial(5) * (value(0, row, {*some, f}) - value(0, row, set(some)))
                assert math.isclose(out[r, f], want, abs_tol=1e-9)
            assert math.isclose(base + out[r].sum(), value(0, row, set(range(5))), abs_tol=1e-9)


def test_contributions_of_many_leaves_take_seconds():
    import time

    rng = np.random.default_rng(2)
    nodes, bins = random_tree(rng, 12, 512), rng.integers(0, 10, (2000, 12))
    out, began = np.zeros((2000, 12)), time.perf_counter()
    base = tree_contributions(nodes, bins, out)
    assert time.perf_counter() - began < 30
    from loomstat.operators.trees import walk

    assert np.allclose(base + out.sum(axis=1), np.array([n.value for n in nodes])[walk(nodes, bins)])


def test_passes_of_a_round_do_not_depend_on_classes(spark, monkeypatch):
    from loomstat.operators import trees as module

    x = np.random.default_rng(4).integers(0, 9, (300, 3)).astype(float)
    passes = {}
    for classes in (3, 6):
        d = spark.createDataFrame([(v.tolist(), float(int(v.sum()) % classes)) for v in x], "x array<double>, y double")
        seen, real = [], module._Rows._sums
        monkeypatch.setattr(module._Rows, "_sums", lambda self, requests, wanted, first, seen=seen, real=real: seen.append(len(requests)) or real(self, requests, wanted, first))
        m = train_trees(d, "x", "y", "multiclass", classes, options=TreeOptions(rounds=1, max_leaves=4, min_rows=5))
        monkeypatch.setattr(module._Rows, "_sums", real)
        assert len(m.trees[0]) == classes and seen[0] == classes
        passes[classes] = len(seen)
    assert passes[6] <= 4 and passes[3] <= 4


def test_multiclass_and_binary_trees(spark):
    d = rows_for_trees(spark).withColumn("k", (F.col("x")[2] - 1).cast("int"))
    m = train_trees(d, "x", "k", "multiclass", 3, enums=[2], options=TreeOptions(learning_rate=0.5, rounds=2, max_leaves=3))
    right = with_scores(d, m, "x").where(F.array_position("score", F.array_max("score")) == F.col("k") + 1).count()
    assert right == 600
    b = train_trees(d.withColumn("b", (F.col("x")[0] > 20).cast("int")), "x", "b", "binary", enums=[2], options=TreeOptions(rounds=2, max_leaves=3), stopping=EarlyStopping())
    assert b.losses[-1] < b.losses[0] and scores(b, np.array([[40, 1, 1]]))[0, 0] > scores(b, np.array([[5, 1, 1]]))[0, 0]


def test_bins_of_invalid_numbers(spark):
    d = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (5.0,), (6.0,)], "v double")
    assert [r.b for r in d.select(binning.bin_of(F.col("v"), [1.0, 5.0]).alias("b")).collect()] == [0, 0, 1, 2, 3]


GRID = ({"model": "linear", "learning_rate": 0.05, "epochs": 20}, {"model": "tree", "rounds": 3, "learning_rate": 0.3, "max_leaves": 6})


def test_clinic(spark, tmp_path, clinic):
    df = read_csv(spark, clinic, {"note": ColumnType("text")})
    assert df.count() == 303 and df.where("note like 'seen%once%'").count() > 40 and df.where('cholesterol is null').count() == 18
    m = t.train(df, "diagnosis", t.Config(grid=GRID))
    assert m.task == "binary" and m.metrics["auc"] > 0.8 and len(m.metrics["thresholds"]) == 99 and not t.worse_than_baseline(m)
    t.save(spark, m, str(tmp_path / "m"))
    again = t.load(spark, str(tmp_path / "m"))
    a = t.predict(df, m, contributions=True).select("prediction", "contributions", "baseline").collect()
    b = t.predict(df, again).select("prediction").collect()
    assert [r.prediction for r in a] == [r.prediction for r in b] and len(a) == 303
    p = a[0].prediction.probabilities
    assert math.isclose(sum(p.values()), 1.0) and a[0].prediction.class_name == max(p, key=p.get)
    assert sorted((x["importance"] for x in m.importances), reverse=True) == [x["importance"] for x in m.importances] and {x["feature"] for x in m.importances} == set(m.feature_names) and again.importances == m.importances
    assert len(m.baseline["thresholds"]) == 99 and {c.feature: c.feature_value for c in a[0].contributions}.keys() == set(m.feature_names)
    score = sum(c.value for c in a[0].contributions) + a[0].baseline
    assert math.isclose(1 / (1 + math.exp(-score)), p["Positive"], rel_tol=1e-9)
    assert math.isclose(t.evaluate(again, df)["auc"], t.evaluate(m, df)["auc"])


def test_regression_and_errors(spark, clinic):
    df = read_csv(spark, clinic, {"age": ColumnType("number"), "note": ColumnType("text")})
    m = t.train(df, "age", t.Config(grid=GRID[1:], exclude_columns=("diagnosis",)))
    assert m.task == "regression" and m.metrics["rmse"] < 13.9 and not any("diagnosis" in n for n in m.feature_names)
    with pytest.raises(ValueError, match="compare"):
        t.train(df, "age", t.Config(comparison_metric="auc"))
    with pytest.raises(ValueError, match="unknown configuration"):
        t.Config.of({"train": {"nothing": 1}})
    with pytest.raises(ValueError, match="target"):
        t.task_of(ColumnType("text"))


def test_command_line(spark, tmp_path, clinic):
    from loomstat.__main__ import main

    (tmp_path / "c.json").write_text('{"train": {"grid": [{"model": "linear", "epochs": 5}]}, "dataset": {"columns": [{"name": "note", "type": "text"}]}}')
    main(["train", "--file", clinic, "--target", "diagnosis", "--output", str(tmp_path / "m"), "--config", str(tmp_path / "c.json")])
    main(["predict", "--file", clinic, "--model", str(tmp_path / "m"), "--output", str(tmp_path / "p"), "--probabilities"])
    out = spark.read.csv(str(tmp_path / "p"), header=True)
    assert out.columns == ["diagnosis", "Negative", "Positive"] and out.count() == 303


def test_stopping_watches_rows_that_taught_nothing(spark, clinic, monkeypatch):
    seen = {}
    for name in ("train_linear", "train_trees"):
        real = getattr(t, name)

        def spy(learn, *a, name=name, real=real, **k):
            watch = k.get("watch", a[7] if len(a) > 7 else None)
            seen[name] = [{r.row_number for r in d.collect()} for d in (learn, watch)]
            return real(learn, *a, **k)

        monkeypatch.setattr(t, name, spy)
    t.train(read_csv(spark, clinic, {"note": ColumnType("text")}), "diagnosis", t.Config(grid=({"model": "linear", "epochs": 2}, {"model": "tree", "rounds": 1, "max_leaves": 3})))
    (learn, watch), (tree_learn, tree_watch) = seen["train_linear"], seen["train_trees"]
    assert learn | watch == tree_learn | tree_watch and not learn & watch and not tree_learn & tree_watch and len(watch) == len(tree_watch) == 21
    assert min(watch) > max(learn) and max(tree_watch) < min(tree_learn)


@pytest.mark.parametrize("group", [
    {"type": "identity", "source_column": "age"}, {"type": "normalized", "source_column": "age"}, {"type": "one_hot_encoded", "source_column": "gender"}, {"type": "bag_of_words", "source_column": "note", "strategy": "tfidf"},
    {"type": "bag_of_words", "source_column": "note", "strategy": "count", "ngrams": [1]}, {"type": "bag_of_words_cosine_similarity", "source_column_a": "note", "source_column_b": "other"},
], ids=lambda g: "-".join(map(str, g.values())))
def test_configured_groups(spark, group):
    rows = [(float(i % 40), 1 + i % 2, ["a b", "a a c", "", "b b b"][i % 4], ["a", "c a", "b", "b"][i % 4], 1 + int(i % 4 > 1)) for i in range(120)]
    types = {"age": ColumnType("number"), "gender": ColumnType("enum", ("f", "m")), "note": ColumnType("text"), "other": ColumnType("text"), "y": ColumnType("enum", ("no", "yes"))}
    df = spark.createDataFrame(rows, "age double, gender int, note string, other string, y int")
    df = df.select(*(F.col(n).alias(n, metadata={"ltype": x.kind, "variants": list(x.variants)}) for n, x in types.items()))
    c = t.Config.of({"features": {"auto": {"enable": False}, "include": [group]}, "train": {"grid": [{"model": "linear", "epochs": 1}]}})
    m = t.train(df, "y", c)
    assert [g.kind for g in m.groups] == [t.feat.included([group])[0].kind]
    got = t.feat.with_features(df, m.groups, "f").select("f", "age", "gender", "note", "other").collect()
    assert {len(r.f) for r in got} == {len(m.feature_names)}
    idf = dict(m.groups[0].vocabulary)

    def words(text):
        k = text.split()
        k += [f"{a} {b}" for a, b in zip(k, k[1:], strict=False)] if m.groups[0].sizes == (1, 2) else []
        return [k.count(g) for g in idf]

    def unit(x):
        n = math.sqrt(sum(v * v for v in x))
        return [v / n if n else 0.0 for v in x]

    for r in got[:8]:
        kind = m.groups[0].kind
        if kind == "identity":
            want = [r.age]
        elif kind == "normalized":
            want = [(r.age - m.groups[0].mean) / math.sqrt(m.groups[0].variance)]
        elif kind == "one_hot":
            want = [0.0, float(r.gender == 1), float(r.gender == 2)]
        elif kind == "bag_of_words":
            want = words(r.note) if group["strategy"] == "count" else unit([n * w for n, w in zip(words(r.note), idf.values(), strict=True)])
        else:
            sides = (unit([n * w for n, w in zip(words(x), idf.values(), strict=True)]) for x in (r.note, r.other))
            want = [sum(a * b for a, b in zip(*sides, strict=True))]
        assert np.allclose(r.f, want)


def test_word_embeddings_as_features(spark):
    g = t.feat.Group("word_embedding", "s", vectors=(("a", (1.0, 0.0)), ("b", (0.0, 2.0))))
    df = spark.createDataFrame([("a B x",), ("",), (None,), ("b",)], "s string")
    assert [r.f for r in t.feat.with_features(df, [g], "f").collect()] == [[0.5, 1.0], [0.0, 0.0], [0.0, 0.0], [0.0, 2.0]] and len(g.names) == 2


def test_configuration_errors():
    for bad in ({"features": {"include": [{"type": "nothing", "source_column": "a"}]}}, {"features": {"auto": {"what": 1}}}, {"dataset": {"shuffle": {"sed": 1}}}, {"features": {"include": [{"type": "bag_of_words", "source_column": "a", "strategy": "no"}]}}):
        with pytest.raises(ValueError):
            t.Config.of(bad)


def test_deadline_ends_training(spark):
    d = rows_for_trees(spark)
    assert len(train_trees(d, "x", "y", "regression", enums=[2], options=TreeOptions(rounds=50), deadline=0.0).trees) == 0
    assert len(train_linear(d.where("not isnan(x[1])"), "x", "y", "regression", epochs=50, learning_rate=1e-4, deadline=0.0).losses) == 1


def test_scores_are_written_anew_between_rounds(spark, monkeypatch):
    from loomstat.operators import trees

    d, o = rows_for_trees(spark), TreeOptions(rounds=5, max_leaves=4)
    often = []
    for k in (1, 2, 10):
        monkeypatch.setattr(trees, "ROUNDS_A_TABLE", k)
        often.append([[(n.feature, n.bin, round(n.value, 9)) for n in r[0]] for r in train_trees(d, "x", "y", "regression", enums=[2], options=o).trees])
    assert often[0] == often[1] == often[2]


def test_csv_from_standard_input(spark, tmp_path, monkeypatch):
    import io
    import sys

    from loomstat.__main__ import main

    lines = ["a,b,y"] + [f'{i},"t, {i % 3}",{"yes" if i % 2 else "no"}' for i in range(80)]
    monkeypatch.setattr(sys, "stdin", io.StringIO("\n".join(lines)))
    (tmp_path / "c.json").write_text(json.dumps({"train": {"grid": [{"model": "linear", "epochs": 2}]}}))
    main(["train", "--file", "-", "--target", "y", "--output", str(tmp_path / "m"), "--config", str(tmp_path / "c.json")])
    m = t.load(spark, str(tmp_path / "m"))
    parts = {(r["part"], r["column_name"]) for r in m.stats}
    assert {("train", "a"), ("test", "a"), ("train", "y"), ("test", "y")} <= parts
    of = {r["part"]: r for r in m.stats if r["column_name"] == "y"}
    assert sum(of["train"]["histogram"].values()) == of["train"]["row_count"] and set(of["test"]["histogram"]) == {"yes", "no"}
    monkeypatch.setattr(sys, "stdin", io.StringIO("\n".join(x.rsplit(",", 1)[0] for x in lines)))
    main(["predict", "--file", "-", "--model", str(tmp_path / "m"), "--output", str(tmp_path / "out")])
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 80


def test_line_breaks_in_quotes_are_found(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('a,b\n1,"x, ""y"""\n2,z\n')
    (tmp_path / "broken.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    types = {"a": ColumnType("number"), "b": ColumnType("text")}
    plain, broken = (read_csv(spark, str(tmp_path / f"{n}.csv"), types) for n in ("plain", "broken"))
    assert sorted(r.b for r in plain.collect()) == ['x, "y"', "z"] and sorted(r.b for r in broken.collect()) == ["x\ny", "z"]


def test_yaml_configuration(spark, tmp_path):
    from loomstat.sources.tables import read_config

    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("train:\n  grid:\n  - model: linear\n    epochs: 2\n")
    assert t.Config.of(read_config(spark, str(tmp_path / "c.yaml"))).grid == ({"model": "linear", "epochs": 2},)
