"""Exact ranks, running totals and quantiles without a task that sees all rows.

A window over a whole column would put it into one task.  Here values are first counted per
distinct value, then dealt to ranges of about equal size (bounds from a sketch), so that a window
runs inside each range only; totals of the ranges, a few per column, give the offset of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def _ranged(values: DataFrame, by: list[str], order: str, ranges: int) -> DataFrame:
    """values with `__range`: equal values are in one range, greater values in later ranges."""
    steps = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    bounds = values.groupBy(*by).agg(F.array_distinct(F.percentile_approx(order, steps, F.lit(50 * ranges))).alias("__bounds"))
    # one row per group of `by` and `ranges` numbers in it
    joined = values.join(F.broadcast(bounds), by) if by else values.crossJoin(F.broadcast(bounds))
    return joined.withColumn("__range", F.size(F.filter("__bounds", lambda b: b < F.col(order)))).drop("__bounds")


def running_totals(values: DataFrame, by: list[str], order: str, sums: list[str], ranges: int = RANGES) -> DataFrame:
    """values, one row per (by, order), with `before_X` for each X of sums: the total over smaller values of order.

    `by` must tell few groups apart (columns of a table, classes, models).
    """
    v = _ranged(values, by, order, ranges)
    totals = v.groupBy(*by, "__range").agg(*(F.sum(c).alias(f"__t_{c}") for c in sums))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__range", *(F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in sums))
    inside = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = v.join(F.broadcast(offsets), [*by, "__range"])
    return out.select(*values.columns, *((F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__o_{c}")).alias(f"before_{c}") for c in sums))


def value_counts(long: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n): how many rows hold each value; null values don't count."""
    return long.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


#: Cells that one level of a quantile search divides a range of values into.
CELLS = 4096


def _celled(counts: DataFrame, within: list[str], value: str, cell: str) -> DataFrame:
    """counts with `cell`: which of CELLS equal parts of its group's range a value lies in."""
    ends = counts.groupBy(*within).agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    share = F.nanvl(F.try_divide(F.col(value).cast("double") - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    return counts.join(F.broadcast(ends), within).withColumn(cell, F.least(F.floor(F.coalesce(share, F.lit(0.0)) * CELLS), F.lit(CELLS - 1)).cast("int")).drop("__lo", "__hi")


def _found(wanted: DataFrame, celled: DataFrame, within: list[str], cell: str) -> DataFrame:
    """wanted (within, rank, ...), each with the cell its rank lies in and its rank there."""
    totals = celled.groupBy(*within, cell).agg(F.sum("n").alias("__t"))
    upto = Window.partitionBy(*within).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)  # CELLS rows a group at most
    totals = totals.withColumn("__upto", F.sum("__t").over(upto))
    hit = totals.join(F.broadcast(wanted), within).where((F.col("rank") < F.col("__upto")) & (F.col("rank") >= F.col("__upto") - F.col("__t")))
    return hit.withColumn("rank", F.col("rank") - F.col("__upto") + F.col("__t")).drop("__t", "__upto")


def quantiles(counts: DataFrame, by: list[str], value: str, at: tuple[float, ...], rows: int | None = None) -> DataFrame:
    """(by, at, quantile) from value counts: exact, linear between the neighbours of rank (n - 1) * at.

    Ranks are searched by counts of cells of equal width, twice; only values in the cells that hold a rank
    asked for are sorted.  Counts that are known to be of few `rows` are sorted as they are, in one job.  `by` must tell
    few groups apart.
    """
    names = by or ["__all"]
    c = counts if by else counts.withColumn("__all", F.lit(0))
    if rows is not None and rows <= SORTED_ROWS:
        return _sorted_quantiles(c, names, value, at).select(*by, "at", "quantile")
    asked = F.explode(F.array(*(F.lit(float(q)) for q in at))).alias("at")
    wanted = c.groupBy(*names).agg(F.sum("n").alias("__total")).select(*names, "__total", asked).withColumn("__place", (F.col("__total") - 1) * F.col("at"))
    wanted = wanted.select(*names, "at", "__place", F.explode(F.array_distinct(F.array(F.floor("__place"), F.ceil("__place")))).alias("rank"))
    c = _celled(c, names, value, "__c1")
    wanted = _found(wanted, c, names, "__c1")
    names1 = [*names, "__c1"]
    c = _celled(c.join(F.broadcast(wanted.select(*names1).distinct()), names1, "left_semi"), names1, value, "__c2")
    wanted = _found(wanted, c, names1, "__c2")
    names2 = [*names1, "__c2"]
    upto = Window.partitionBy(*names2).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = c.join(F.broadcast(wanted.select(*names2).distinct()), names2, "left_semi").withColumn("__upto", F.sum("n").over(upto))
    hit = c.join(F.broadcast(wanted), names2).where((F.col("rank") < F.col("__upto")) & (F.col("rank") >= F.col("__upto") - F.col("n")))
    ends = hit.groupBy(*names, "at", "__place").agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    low, high, part = F.col("__low"), F.col("__high"), F.col("__place") - F.floor("__place")
    return ends.select(*by, "at", (low + (high - low) * part).alias("quantile"))


#: Distinct values, of all groups, that a window may sort without being divided.
SORTED_ROWS = 1 << 20


def _sorted_quantiles(counts: DataFrame, names: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    w = Window.partitionBy(*names)
    c = counts.select(*names, F.col(value).alias("__v"), F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"), F.sum("n").over(w).alias("__total"), "n")
    asked = F.explode(F.array(*(F.lit(float(q)) for q in at))).alias("at")
    wanted = c.groupBy(*names).agg(F.first("__total").alias("__total")).select(*names, asked, (F.col("__total") - 1).alias("__last")).withColumn("__place", F.col("__last") * F.col("at"))
    j = c.join(F.broadcast(wanted), names)
    holds = lambda rank: (rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("n"))
    low, high = F.floor("__place"), F.ceil("__place")
    ends = j.where(holds(low) | holds(high)).groupBy(*names, "at", "__place").agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    part = F.col("__place") - F.floor("__place")
    return ends.select(*names, "at", (F.col("__low") + (F.col("__high") - F.col("__low")) * part).alias("quantile"))


def numbered(df: DataFrame, key: Column, number: str = "row_number") -> DataFrame:
    """df with exact row numbers from 0 in the order of a 64-bit hash (ties in any order), by 4096 ranges of it."""
    k = df.withColumn("__key", key).withColumn("__range", F.shiftrightunsigned("__key", 52)).withColumn("__key", F.shiftleft("__key", 12))
    totals = k.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = totals.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("__range").orderBy("__key")
    return k.join(F.broadcast(offsets), "__range").withColumn(number, F.row_number().over(inside) - 1 + F.col("__o")).drop("__key", "__range", "__o")
