"""Metrics of predictions, each as a DataFrame of sums that combine before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.numbers import clamp
from loomstat.operators.ranks import running_totals


def regression_sums(pred: Column, label: Column) -> list[Column]:
    """mse, rmse, mae (of absolute errors) and r2 (null where labels don't vary) as aggregates."""
    e = label - pred
    mse = F.avg(e * e)
    return [F.count(e).alias("n"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(mse, F.var_pop(F.when(pred.isNotNull(), label)))).alias("r2")]


def regression_metrics(df: DataFrame, pred: str, label: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*regression_sums(F.col(pred).cast("double"), F.col(label).cast("double")))


def threshold_metrics(df: DataFrame, probability: str, positive: str, n_thresholds: int = 99) -> DataFrame:
    """Confusion counts and rates at thresholds (i + 1) / (n + 1); a row is positive when p >= threshold.

    Rows are counted once, by the number of thresholds they reach; counts per threshold are running
    sums over these n + 1 groups.  Precision, recall and f1 are null where they divide by zero.
    """
    p, m = F.col(probability).cast("double"), n_thresholds + 1
    guess = F.least(F.greatest(F.floor(p * m), F.lit(0)), F.lit(n_thresholds))
    up = F.when((guess < n_thresholds) & (p >= (guess + 1) / m), 1).otherwise(0)
    down = F.when((guess > 0) & (p < guess / m), 1).otherwise(0)
    y = F.col(positive).cast("boolean")
    g = df.where(p.isNotNull() & y.isNotNull()).groupBy((guess + up - down).alias("reach")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    steps = df.sparkSession.range(n_thresholds + 1).select(F.col("id").alias("reach"))
    g = steps.join(g, "reach", "left").na.fill(0)
    upward = Window.orderBy(F.desc("reach")).rowsBetween(Window.unboundedPreceding, 0)  # n_thresholds + 1 rows
    every = Window.orderBy(F.desc("reach")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = g.select("reach", F.sum("pos").over(upward).alias("tp"), F.sum("neg").over(upward).alias("fp"), F.sum("pos").over(every).alias("p"), F.sum("neg").over(every).alias("n"))
    t = t.where("reach > 0").select((F.col("reach") / m).alias("threshold"), "tp", "fp", (F.col("n") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"))
    return t.select("*", *rates())


def rates() -> list[Column]:
    """Of columns tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return [
        F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(tp, tp + fn).alias("tpr"), F.try_divide(fp, fp + tn).alias("fpr"),
    ]


def auc_from_thresholds(t: DataFrame) -> DataFrame:
    """(auc): trapezoids between the thresholds' points, and to (0, 0) and (1, 1)."""
    order = Window.orderBy("threshold")
    right, top = F.lag("fpr", 1, 1.0).over(order), F.lag("tpr", 1, 1.0).over(order)
    last = F.lead("fpr").over(order).isNull()
    area = (right - F.col("fpr")) * (top + F.col("tpr")) / 2 + F.when(last, F.col("fpr") * F.col("tpr") / 2).otherwise(0.0)
    return t.select(area.alias("a")).agg(F.sum("a").alias("auc"))


def auc_exact(df: DataFrame, probability: str, positive: str) -> DataFrame:
    """(auc): the share of pairs of a positive and a negative row in the right order, ties half."""
    y = F.col(positive).cast("int")
    g = df.where(F.col(probability).isNotNull() & y.isNotNull()).groupBy(F.col(probability).cast("double").alias("p")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    r = running_totals(g, [], "p", ["neg"])
    pairs = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return r.agg(F.try_divide(pairs, F.sum("pos") * F.sum("neg")).alias("auc"))


def binary_cross_entropy(p: Column, y: Column) -> Column:
    c, t = clamp(p), y.cast("double")
    return F.avg(-(t * F.ln(c) + (1 - t) * F.ln(1 - c)))


def cross_entropy(probabilities: Column, label_index: Column) -> Column:
    """probabilities: array; label_index: from 0."""
    return F.avg(-F.ln(clamp(F.get(probabilities, label_index))))


def accuracy(pred: Column, label: Column) -> Column:
    return F.avg((pred == label).cast("double"))


def confusion(df: DataFrame, pred: str, label: str) -> DataFrame:
    """(prediction, label, n) of rows that have both."""
    d = df.where(F.col(pred).isNotNull() & F.col(label).isNotNull())
    return d.groupBy(F.col(pred).alias("prediction"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(conf: DataFrame) -> DataFrame:
    """One row per class of a confusion table: tp, fp, tn, fn and rates."""
    as_pred = conf.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"), F.sum(F.when(F.col("prediction") == F.col("label"), F.col("n")).otherwise(0)).alias("tp"))
    as_label = conf.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("labelled"))
    total = conf.agg(F.sum("n").alias("total"))
    c = as_pred.join(as_label, "class", "full").na.fill(0).crossJoin(F.broadcast(total))
    c = c.select("class", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("total") - F.col("predicted") - F.col("labelled") + F.col("tp")).alias("tn"), (F.col("labelled") - F.col("tp")).alias("fn"))
    return c.select("*", *rates()[:4])


def overall_class_metrics(classes: DataFrame) -> DataFrame:
    """accuracy, and precision and recall over classes, plain and weighted by labels; null rates count as 0."""
    weight = F.col("tp") + F.col("fn")
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    heavy = lambda c: F.try_divide(F.sum(F.coalesce(F.col(c), F.lit(0.0)) * weight), F.sum(weight))
    return classes.agg(F.try_divide(F.sum("tp"), F.sum(weight)).alias("accuracy"), mean("precision").alias("precision_unweighted"), mean("recall").alias("recall_unweighted"), heavy("precision").alias("precision_weighted"), heavy("recall").alias("recall_weighted"))


def baseline(train: DataFrame, test: DataFrame, target: str, kind: str) -> DataFrame:
    """Metrics on test of the best guess that ignores every feature: the mean, or the largest class."""
    if kind == "number":
        guess = train.agg(F.avg(target).alias("__guess"))
        return regression_metrics(test.crossJoin(F.broadcast(guess)), "__guess", target)
    counts = train.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    guess = counts.agg(F.max_by(target, F.struct("n", target)).alias("__guess"))
    return overall_class_metrics(class_metrics(confusion(test.crossJoin(F.broadcast(guess)), "__guess", target)))


def threshold_baseline(share: float, positives: int, negatives: int, n_thresholds: int = 99) -> list[dict]:
    """Metrics, per threshold, of giving every row the probability `share`: all rows positive up to it, none above."""
    out = []
    for k in range(1, n_thresholds + 1):
        t = k / (n_thresholds + 1)
        tp, fp = (positives, negatives) if share >= t else (0, 0)
        tn, fn = negatives - fp, positives - tp
        ratio = lambda a, b: a / b if b else None
        out.append({"threshold": t, "tp": tp, "fp": fp, "tn": tn, "fn": fn, "accuracy": ratio(tp + tn, positives + negatives), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})
    return out


def roc_points(thresholds: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) of threshold metrics."""
    return thresholds.select("threshold", "fpr", "tpr")


def precision_recall_points(thresholds: DataFrame) -> DataFrame:
    """(threshold, recall, precision) of threshold metrics; precision is null where nothing is positive."""
    return thresholds.select("threshold", "recall", "precision")
