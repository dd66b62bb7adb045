"""Bins of features, gradients, and split search over bin sums, as DataFrame operations.

Bins of a number: 0 for invalid values, then 1 + how many thresholds lie below the value, so a
split "bin <= b" is "value <= threshold b" with invalid values on the left.  Bins of an enum are
its codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.numbers import EPSILON
from loomstat.operators.ranks import quantiles
from loomstat.sources.tables import written

MAX_BINS = 255


def midpoints(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, threshold): the middle of each two neighbouring distinct values; for columns with few of them."""
    after = F.lead(value).over(Window.partitionBy(*by).orderBy(value))
    return counts.select(*by, ((F.col(value) + after) / 2).alias("threshold")).where("threshold is not null")


def bin_thresholds(counts: DataFrame, by: list[str], value: str, max_bins: int = MAX_BINS) -> DataFrame:
    """(by, threshold): midpoints if a column has fewer than max_bins values, else max_bins - 1 quantiles, without repeats."""
    counts = written(counts, "counts")  # read several times
    few = counts.groupBy(*by).agg((F.count(F.lit(1)) < max_bins).alias("few"))
    c = counts.join(F.broadcast(few), by)  # one row per column
    steps = tuple(k / max_bins for k in range(1, max_bins))
    q = quantiles(c.where("not few").drop("few"), by, value, steps, counts.count()).select(*by, F.col("quantile").alias("threshold")).distinct()
    return midpoints(c.where("few").drop("few"), by, value).unionByName(q)


def bin_of(value: Column, thresholds: list[float]) -> Column:
    t = F.array(*(F.lit(float(x)) for x in thresholds)).cast("array<double>")
    return F.when(value.isNull() | F.isnan(value), 0).otherwise(1 + F.size(F.filter(t, lambda x: x < value))).cast("int")


def gradients(kind: str, score: Column, label: Column) -> tuple[Column, Column]:
    """(gradient, hessian) of the loss by the score: p - y and 1, or p - y and p (1 - p)."""
    if kind == "regression":
        return score - label, F.lit(1.0)
    p = 1 / (1 + F.exp(-score))
    return p - label, p * (1 - p)


def bin_sums(binned: DataFrame, node: str, bins: str, gradient: str, hessian: str) -> DataFrame:
    """(node, feature, bin, g, h, n) summed over rows; partial sums before the shuffle."""
    e = binned.select(F.col(node).alias("node"), F.posexplode(bins).alias("feature", "bin"), F.col(gradient).alias("g"), F.col(hessian).alias("h"))
    return e.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))


def splits(sums: DataFrame, enums: list[int], l2_number: float = 0.0, l2_enum: float = 10.0, smoothing: float = 10.0, min_rows: int = 20, min_hessian: float = 1e-3) -> DataFrame:
    """(node, feature, kind, bin, left, gain, lg, lh, ln, rg, rh, rn) of every allowed split.

    Numbers split after a bin.  Enum bins are put in the order of g / (h + smoothing) first, and the
    bins of a prefix go left.  gain = G^2 / (H + l2) of both sides less that of the whole.
    """
    is_enum = F.col("feature").isin(*enums) if enums else F.lit(False)
    s = sums.withColumn("enum", is_enum).withColumn("place", F.when(is_enum, F.col("g") / (F.col("h") + smoothing)).otherwise(F.col("bin").cast("double")))
    one = Window.partitionBy("node", "feature")  # a row per bin
    upto = one.orderBy("place", "bin").rowsBetween(Window.unboundedPreceding, 0)
    s = s.select("node", "feature", "enum", "bin", *(F.sum(c).over(upto).alias(f"l{c}") for c in "ghn"), *((F.sum(c).over(one) - F.sum(c).over(upto)).alias(f"r{c}") for c in "ghn"), F.when(is_enum, F.collect_list("bin").over(upto)).alias("left"))
    l2 = F.when(F.col("enum"), l2_enum).otherwise(l2_number)
    worth = lambda g, h: F.try_divide(g * g, h + l2)
    g, h = F.col("lg") + F.col("rg"), F.col("lh") + F.col("rh")
    gain = worth(F.col("lg"), F.col("lh")) + worth(F.col("rg"), F.col("rh")) - worth(g, h)
    allowed = (F.least("ln", "rn") >= min_rows) & (F.least("lh", "rh") >= min_hessian)
    kind = F.when(F.col("enum"), "enum").otherwise("number").alias("kind")
    return s.where(allowed).select("node", "feature", kind, "bin", F.array_sort("left").alias("left"), gain.alias("gain"), "lg", "lh", "ln", "rg", "rh", "rn").where("gain is not null")


def best_splits(every: DataFrame) -> DataFrame:
    """The split of the largest gain of each node; ties by the smallest feature and bin."""
    order = F.struct(F.col("gain"), -F.col("feature"), -F.col("bin"))
    row = F.struct(*(F.col(c) for c in every.columns if c != "node"))
    return every.groupBy("node").agg(F.max_by(row, order).alias("s")).select("node", "s.*")


def leaf_value(g: float, h: float, learning_rate: float, l2: float = 0.0) -> float:
    return -learning_rate * g / (h + l2 + EPSILON)
