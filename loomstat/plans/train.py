"""Training from a table to a tested model: types, split, features, grid, comparison, test."""

from __future__ import annotations

import itertools
import json
import math
import time
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions.numbers import sigmoid, softmax
from loomstat.operators import features as feat
from loomstat.operators import metrics, profile
from loomstat.operators.linear import EarlyStopping, LinearModel, train_linear, with_linear_scores
from loomstat.operators.sparse import rows_of
from loomstat.operators.split import drop_invalid_target, early_stopping_split, split
from loomstat.operators.trees import Node, TreeOptions, Trees, train_trees, tree_contributions, with_contributions, with_scores
from loomstat.schema import ColumnType, types_of
from loomstat.sources.tables import dropped, written

REVISION = 1
FEW_ROWS = {"train": 35, "comparison": 5, "test": 10}
COMPARISONS = {"regression": ("rmse", "mae", "mse", "r2"), "binary": ("auc", "accuracy", "f1"), "multiclass": ("accuracy",)}
HIGHER_IS_BETTER = {"r2", "auc", "accuracy", "f1"}
#: Models of more features than this learn and predict from sparse rows.
WIDE = 512


@dataclass(frozen=True)
class Config:
    """comparison_metric None: the first one of the task.  include: feature groups besides those that auto chooses.
    stopping_fraction of the training rows is held out for early stopping.  budget_seconds: no further model, epoch or
    round is begun after it."""

    comparison_fraction: float = 0.1
    test_fraction: float = 0.2
    seed: int = 42
    exclude_columns: tuple[str, ...] = ()
    comparison_metric: str | None = None
    grid: tuple[dict, ...] | None = None
    model_types: tuple[str, ...] = ("linear", "tree")
    max_vocabulary: int = profile.TOP_NGRAMS
    budget_seconds: float | None = None
    include: tuple[dict, ...] = ()
    auto: bool = True
    shuffle: bool = True
    stopping_fraction: float = 0.1

    @staticmethod
    def of(d: dict) -> Config:
        """From a parsed configuration file; names that don't exist are errors."""
        known = {"dataset": {"shuffle", "comparison_fraction", "test_fraction", "columns"}, "features": {"auto", "include"}, "train": {"autogrid", "grid", "comparison_metric"}}
        for part, x in d.items():
            if part not in known or set(x) - known[part]:
                raise ValueError(f"unknown configuration: {part}: {sorted(set(x) - known.get(part, set()))}")
        data, fs, tr = (d.get(k, {}) for k in ("dataset", "features", "train"))
        shuffle, auto = (x if isinstance(x, dict) else {"enable": bool(x)} for x in (data.get("shuffle", {}), fs.get("auto", {})))
        if set(shuffle) - {"enable", "seed"} or set(auto) - {"enable", "exclude_columns"}:
            raise ValueError(f"unknown configuration: {sorted({*shuffle, *auto} - {'enable', 'seed', 'exclude_columns'})}")
        include, grid = tuple(fs.get("include", ())), tr.get("grid")
        feat.included(list(include))  # errors now, not after the split
        return Config(
            data.get("comparison_fraction", 0.1), data.get("test_fraction", 0.2), shuffle.get("seed", 42), tuple(auto.get("exclude_columns", ())), tr.get("comparison_metric"),
            tuple(grid) if grid else None, tuple((tr.get("autogrid") or {}).get("model_types", ("linear", "tree"))), include=include, auto=auto.get("enable", True), shuffle=shuffle.get("enable", True),
        )


def configured_types(d: dict) -> dict[str, ColumnType]:
    """Column types of a configuration's dataset.columns."""
    return {c["name"]: ColumnType(c["type"], tuple(c.get("variants", ()))) for c in d.get("dataset", {}).get("columns", [])}


@dataclass
class Model:
    task: str
    target: str
    classes: list[str]
    groups: list[feat.Group]
    kind: str
    model: LinearModel | Trees
    metrics: dict = field(default_factory=dict)
    baseline: dict = field(default_factory=dict)
    stats: list[dict] = field(default_factory=list)
    tried: list[dict] = field(default_factory=list)
    importances: list[dict] = field(default_factory=list)

    @property
    def feature_names(self) -> list[str]:
        return [n for g in self.groups for n in g.names]

    @property
    def wide(self) -> bool:
        return is_wide(self.groups)

    def outputs(self, df: DataFrame, name: str = "__output") -> DataFrame:
        """df with the value, or the array of class probabilities."""
        d = feat.with_features(df, self.groups, "__features", sparse=self.wide)
        if self.kind == "linear" and not self.wide:
            out = self.model.output(F.col("__features"))
        else:
            d = (with_linear_scores if self.kind == "linear" else with_scores)(d, self.model, "__features", "__score")
            s = F.col("__score")
            out = softmax(s) if self.task == "multiclass" else sigmoid(s[0]) if self.task == "binary" else s[0]
        if self.task == "binary":
            out = F.array(1 - out, out)
        return d.withColumn(name, out).drop("__score")


def is_wide(groups: list[feat.Group]) -> bool:
    return sum(len(g.names) for g in groups) > WIDE


def task_of(t: ColumnType) -> str:
    if t.kind == "number":
        return "regression"
    if t.kind == "enum":
        return "binary" if len(t.variants) == 2 else "multiclass"
    raise ValueError(f"a {t.kind} column can't be the target")


def default_grid(model_types: tuple[str, ...]) -> list[dict]:
    grid: list[dict] = []
    if "linear" in model_types:
        grid += [{"model": "linear", "l2": l2, "learning_rate": lr, "epochs": 1000, "batch": 128} for l2, lr in itertools.product((0.0, 0.1), (0.1, 0.01))]
    if "tree" in model_types:
        grid += [{"model": "tree", "learning_rate": lr, "l2_number": l2, "max_leaves": 512, "rounds": 1000, "max_depth": 50} for lr, l2 in itertools.product((0.1, 0.01), (0.0, 0.1))]
    return grid


def evaluate(model: Model, df: DataFrame, n_thresholds: int = 99) -> dict:
    """Metrics of a model on labelled rows."""
    d = model.outputs(df)
    if model.task == "regression":
        return metrics.regression_metrics(d, "__output", f"`{model.target}`").first().asDict()
    label = F.col(f"`{model.target}`")
    if model.task == "binary":
        s = d.select(F.col("__output")[1].alias("p"), (label == 2).alias("y"))
        t = metrics.threshold_metrics(s, "p", "y", n_thresholds)
        rows = [r.asDict() for r in t.orderBy("threshold").collect()]  # a row per threshold
        middle = rows[len(rows) // 2]
        auc = metrics.auc_exact(s, "p", "y").first()["auc"]
        return {"auc": auc, "accuracy": middle["accuracy"], "f1": middle["f1"], "precision": middle["precision"], "recall": middle["recall"], "thresholds": rows}
    best = F.array_position(F.col("__output"), F.array_max("__output")).cast("int")
    classes = metrics.class_metrics(metrics.confusion(d.select(best.alias("p"), label.alias("y")), "p", "y"))
    return metrics.overall_class_metrics(classes).first().asDict() | {"classes": [r.asDict() for r in classes.orderBy("class").collect()]}


def train(df: DataFrame, target: str, config: Config | None = None) -> Model:
    """df: a typed table (see schema.typed_load)."""
    c, types = config or Config(), types_of(df)
    if target not in types:
        raise ValueError(f"no column {target}")
    task, began = task_of(types[target]), time.monotonic()
    metric = c.comparison_metric or COMPARISONS[task][0]
    if metric not in COMPARISONS[task]:
        raise ValueError(f"{metric} doesn't compare models of {task}; use one of {COMPARISONS[task]}")
    rows = written(split(drop_invalid_target(df, target), c.comparison_fraction, c.test_fraction, c.seed if c.shuffle else None), "dataset")
    tables = [rows]  # go when the model is tested
    part = {p: rows.where(F.col("part") == p) for p in FEW_ROWS}
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # three rows
    if not sizes.get("train"):
        raise ValueError("no rows to train on")
    warnings = [f"{p} has only {sizes.get(p, 0)} rows" for p, few in FEW_ROWS.items() if sizes.get(p, 0) < few]
    if lost := df.count() - sum(sizes.values()):
        warnings.append(f"{lost} rows have no valid target and were dropped")
    classes = list(types[target].variants)
    label = F.col(f"`{target}`") if task == "regression" else F.col(f"`{target}`") - 1
    best, score, tried = None, math.nan, []
    groups: dict[str, list[feat.Group]] = {}
    sets: dict[str, tuple[DataFrame, DataFrame]] = {}  # rows to learn from and rows to watch
    deadline = None if c.budget_seconds is None else began + c.budget_seconds
    for g in c.grid or default_grid(c.model_types):
        if best is not None and deadline is not None and time.monotonic() > deadline:
            break
        g = dict(g)
        kind = g.pop("model")
        if kind not in groups:
            asked = (feat.plan(types, target, kind == "linear", c.exclude_columns) if c.auto else []) + feat.included(list(c.include))
            groups[kind] = feat.fit(part["train"], asked, types, c.max_vocabulary)
            featured = feat.with_features(part["train"], groups[kind], "__features", sparse=is_wide(groups[kind])).withColumn("__label", label.cast("double"))
            tables.append(written(featured.select("__features", "__label", "row_number"), "features"))
            sets[kind] = early_stopping_split(tables[-1], c.stopping_fraction, last=kind == "linear")
        learn, watch = sets[kind]
        if watch.isEmpty():
            watch = None
        n_features = sum(len(x.names) for x in groups[kind])
        if kind == "linear":
            m = train_linear(learn, "__features", "__label", task, len(classes), stopping=EarlyStopping(), watch=watch, deadline=deadline, width=n_features, **g)
        else:
            enums, i = [], 0
            for group in groups[kind]:
                enums += [i] if group.kind == "identity" and types[group.column].kind == "enum" else []
                i += len(group.names)
            m = train_trees(learn, "__features", "__label", task, len(classes), enums, TreeOptions(**g), EarlyStopping(), watch, deadline, n_features)
        model = Model(task, target, classes, groups[kind], kind, m)
        got = evaluate(model, part["comparison"] if sizes.get("comparison") else part["train"])[metric]
        tried.append({"model": kind, **g, metric: got})
        better = got is not None and not math.isnan(got) and (best is None or (got >= score if metric in HIGHER_IS_BETTER else got <= score))
        if better or best is None:
            best, score = model, got if got is not None else math.nan
    best.tried = tried
    test = part["test"] if sizes.get("test") else part["train"]
    best.metrics = evaluate(best, test) | {"warnings": warnings}
    best.baseline = metrics.baseline(part["train"], test, target, types[target].kind).first().asDict()
    if task == "binary":
        share = part["train"].agg(F.avg((F.col(f"`{target}`") == 2).cast("double")).alias("s")).first()["s"]
        n = test.agg(F.count_if(F.col(f"`{target}`") == 2).alias("p"), F.count_if(F.col(f"`{target}`") != 2).alias("n")).first()
        best.baseline["thresholds"] = metrics.threshold_baseline(share, n["p"], n["n"])
    order = sorted(zip(best.feature_names, best.model.importances, strict=True), key=lambda x: (-x[1], x[0]))
    best.importances = [{"feature": f, "importance": float(v)} for f, v in order]
    best.stats = part_stats(rows.where(F.col("part").isin("train", "test")), types)
    for x in tables:
        dropped(x)
    return best


def part_stats(rows: DataFrame, types: dict[str, ColumnType]) -> list[dict]:
    """Statistics of the number columns and histograms of the enum columns of each part, from a pass of each kind."""
    out = []
    numbers, enums = ([n for n, t in types.items() if t.kind == kind] for kind in ("number", "enum"))
    if numbers:
        value = lambda n: F.when(~F.isnan(v := F.col(f"`{n}`").cast("double")) & (F.abs(v) < float("inf")), v)
        cells = F.array(*(F.struct(F.concat("part", F.lit(f":{n}")).alias("column_name"), value(n).alias("value")) for n in numbers))
        for r in profile.melted_stats(rows.select(F.inline(cells))).collect():  # a row a part and column
            part, _, name = r["column_name"].partition(":")
            out.append({**r.asDict(), "part": part, "column_name": name})
    if enums:
        cells = F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").cast("int").alias("code")) for n in enums))
        counts = rows.select("part", F.inline(cells)).groupBy("part", "column_name", "code").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a variant
        for part in ("train", "test"):
            for name in enums:
                n = {r["code"] or 0: r["n"] for r in counts if (r["part"], r["column_name"]) == (part, name)}
                out.append({"part": part, "column_name": name, "row_count": sum(n.values()), "invalid_count": n.get(0, 0), "histogram": {v: n.get(i + 1, 0) for i, v in enumerate(types[name].variants)}})
    return out


def predict(df: DataFrame, model: Model, threshold: float = 0.5, contributions: bool = False) -> DataFrame:
    """df with `prediction`: a value, or (class_name, probability, probabilities); and with
    `contributions` (feature, feature_value, value) and `baseline` of the value, or of the predicted class's score."""
    d = model.outputs(df)
    if model.task == "regression":
        d = d.withColumn("prediction", F.col("__output"))
    else:
        p = F.col("__output")
        names = F.array(*(F.lit(c) for c in model.classes))
        if model.task == "binary":
            k = F.when(p[1] >= threshold, 2).otherwise(1)
        else:
            k = F.array_position(p, F.array_max(p)).cast("int")
        d = d.withColumn("prediction", F.struct(F.element_at(names, k).alias("class_name"), F.element_at(p, k).alias("probability"), F.map_from_arrays(names, p).alias("probabilities")))
    if contributions and model.wide:
        at = F.array_position(F.array(*(F.lit(c) for c in model.classes)), F.col("prediction.class_name")).cast("int") - 1 if model.task == "multiclass" else F.lit(0)
        d = explained(d.withColumn("__class", at), model, "__features", "__class").drop("__class")
    elif contributions:
        names = F.array(*(F.lit(n) for n in model.feature_names))
        outputs = len(model.classes) if model.task == "multiclass" else 1
        if model.kind == "linear":
            each = [(model.model.contributions(F.col("__features"), k), F.lit(model.model.baseline(k))) for k in range(outputs)]
        else:
            each = []
            for k in range(outputs):
                d = with_contributions(d, model.model, "__features", k).withColumnRenamed("contributions", f"__c{k}").withColumnRenamed("baseline", f"__b{k}")
                each.append((F.col(f"__c{k}"), F.col(f"__b{k}")))
        at = F.array_position(F.array(*(F.lit(c) for c in model.classes)), F.col("prediction.class_name")).cast("int") if outputs > 1 else F.lit(1)
        known = F.zip_with(names, F.col("__features"), lambda n, x: F.struct(n.alias("feature"), x.alias("feature_value")))
        pair = F.zip_with(known, F.element_at(F.array(*(e for e, _ in each)), at), lambda k, v: F.struct(k["feature"].alias("feature"), k["feature_value"].alias("feature_value"), v.alias("value")))
        d = d.withColumn("contributions", pair).withColumn("baseline", F.element_at(F.array(*(b for _, b in each)), at))
    return d.drop("__output", "__features", *(f"__{x}{k}" for x in "cb" for k in range(len(model.classes) + 1)))


def explained(df: DataFrame, model: Model, features: str, output: str) -> DataFrame:
    """df with `contributions` and `baseline` of one output of each row (its number in the column `output`), of sparse rows.

    One pass, a bounded number of rows at a time; names and weights travel beside the plan, not in it.
    """
    n, at, of = len(df.columns), df.columns.index(features), df.columns.index(output)
    kind = "array<struct<feature:string,feature_value:double,value:double>>"
    schema = df.withColumn("contributions", F.lit(None).cast(kind)).withColumn("baseline", F.lit(None).cast("double")).schema
    names, m, width = model.feature_names, model.model, len(model.feature_names)

    def run(batches):
        text = pa.array(names, pa.string())
        step = max(1, feat.BATCH_BYTES // (64 * width))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                x, k = rows_of(b.column(at), width).dense(), np.asarray(b.column(of))
                out, base = np.zeros(x.shape), np.zeros(len(x))
                for c in np.unique(k):
                    rows = np.flatnonzero(k == c)
                    if model.kind == "linear":
                        out[rows], base[rows] = (x[rows] - np.array(m.means)) * np.array(m.weights[c]), m.baseline(int(c))
                    else:
                        bins, part, expected = m.bins(b.column(at).take(pa.array(rows))), np.zeros((len(rows), width)), m.biases[c]
                        for r in m.trees:
                            expected += tree_contributions(r[c], bins, part)
                        out[rows], base[rows] = part, expected
                entries = pa.StructArray.from_arrays([text.take(pa.array(np.tile(np.arange(width), len(x)))), pa.array(x.ravel()), pa.array(out.ravel())], ["feature", "feature_value", "value"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([*b.columns[:n], lists, pa.array(base)], names=[*b.schema.names[:n], "contributions", "baseline"])

    return df.mapInArrow(run, schema)


def save(spark: SparkSession, model: Model, path: str) -> None:
    """As JSON text with a revision, through Spark, so that any store it reaches will do."""
    doc = {"revision": REVISION, **asdict(model)}
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(path)


def load(spark: SparkSession, path: str) -> Model:
    doc = json.loads("".join(r.value for r in spark.read.text(path).collect()))
    if doc["revision"] != REVISION:
        raise ValueError(f"the model's revision {doc['revision']} is too {'new' if doc['revision'] > REVISION else 'old'}; this library reads {REVISION}")
    del doc["revision"]
    whole = lambda v: tuple(map(whole, v)) if isinstance(v, list) else v
    doc["groups"] = [feat.Group(**{k: whole(v) for k, v in g.items()}) for g in doc["groups"]]
    m = doc["model"]
    if doc["kind"] == "linear":
        doc["model"] = LinearModel(**m)
    else:
        m["trees"] = [[[Node(**(n | {"children": tuple(n["children"])})) for n in nodes] for nodes in r] for r in m["trees"]]
        doc["model"] = Trees(**m)
    return Model(**doc)


def worse_than_baseline(model: Model) -> bool:
    """Whether ignoring every feature would have done as well."""
    key = "mse" if model.task == "regression" else "accuracy"
    ours, base = model.metrics[key], model.baseline[key]
    return ours >= base if key == "mse" else ours <= base


def monitored(event_id: str, model_id: str, date: str, **fields) -> dict:
    """An event as a client would log it: pass `input` and `output`, or `true_value`."""
    kind = "true_value" if "true_value" in fields else "prediction"
    return {"type": kind, "model_id": model_id, "identifier": event_id, "date": date, **fields}


class EventQueue:
    """Events kept in the client until flushed to a folder of JSON lines."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.held = spark, folder, []

    def enqueue(self, event: dict) -> None:
        self.held.append(json.dumps(event))

    def log(self, event: dict) -> None:
        self.enqueue(event)
        self.flush()

    def flush(self) -> None:
        if self.held:
            self.spark.createDataFrame([(x,) for x in self.held], "value string").write.mode("append").text(self.folder)
            self.held = []
