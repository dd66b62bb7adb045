"""Column profiles: counts, moments, quantiles, histograms and n-gram statistics.

All states merge: histograms and n-gram counts by adding counts per key, moments by (n, mean, m2).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.text import idf, tokens
from loomstat.operators.grams import counted, pieces
from loomstat.operators.ranks import quantiles, value_counts
from loomstat.schema import ColumnType
from loomstat.sources.tables import spread, written

KEPT_DISTINCT = 100
TOP_NGRAMS = 20_000


def _finite(c: Column) -> Column:
    v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def melt(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value double) of number columns; values that aren't finite are null."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), _finite(F.col(f"`{c}`")).alias("value")) for c in columns))
    return df.select(F.inline(pairs))


def number_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n): the exact value counts of number columns."""
    return value_counts(melt(df, columns), ["column_name"], "value")


def number_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per number column: counts, distinct values, min, max, mean, population variance, quartiles.

    Columns without a valid value have null statistics and 0 distinct values.
    """
    return melted_stats(melt(df, columns))


def melted_stats(rows: DataFrame) -> DataFrame:
    """number_stats of rows (column_name, value): columns may be parts of one, told apart by their names."""
    # written once, since all that follows reads it; under null, how many are invalid
    counts = written(rows.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")), "counts")
    v, n = F.col("value"), F.col("n")
    valid = F.sum(F.when(v.isNotNull(), n).otherwise(0))
    first = counts.groupBy("column_name").agg(F.sum("n").alias("row_count"), valid.alias("valid_count"), F.count(v).alias("unique_count"), F.min(v).alias("min"), F.max(v).alias("max"), F.try_divide(F.sum(v * n), valid).alias("mean"))
    spread = counts.join(F.broadcast(first.select("column_name", "mean")), "column_name").groupBy("column_name").agg(F.try_divide(F.sum(n * F.pow(v - F.col("mean"), 2)), valid).alias("variance"))
    moments = first.join(F.broadcast(spread), "column_name").withColumn("invalid_count", F.col("row_count") - F.col("valid_count")).withColumn("std", F.sqrt("variance"))
    counts = counts.where("value is not null")
    q = quantiles(counts, ["column_name"], "value", (0.25, 0.5, 0.75), counts.count())
    flat = q.groupBy("column_name").agg(*(F.max(F.when(F.col("at") == a, F.col("quantile"))).alias(n) for a, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))))
    out = moments.join(F.broadcast(flat), "column_name", "left")
    return out.select("column_name", "row_count", "valid_count", "invalid_count", "min", "max", "mean", "variance", "std", "unique_count", "p25", "p50", "p75")


def table_stats(df: DataFrame, types: dict[str, ColumnType]) -> DataFrame:
    """(column_name, kind, row_count, valid_count, invalid_count) of columns of any kind, in one aggregate.

    Invalid are numbers that aren't finite or are null, enum codes that are 0 or null and null texts; of an unknown column, all rows.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (name, t) in enumerate(types.items()):
        c = F.col(f"`{name}`")
        valid = {"number": lambda c=c: _finite(c).isNotNull(), "enum": lambda c=c: c.isNotNull() & (c != 0), "text": lambda c=c: c.isNotNull(), "unknown": lambda: F.lit(False)}[t.kind]()
        aggs.append(F.count_if(valid).alias(f"v{i}"))
    rows = F.array(*(F.struct(F.lit(name).alias("column_name"), F.lit(t.kind).alias("kind"), F.col("n").alias("row_count"), F.col(f"v{i}").alias("valid_count"), (F.col("n") - F.col(f"v{i}")).alias("invalid_count")) for i, (name, t) in enumerate(types.items())))
    return df.agg(*aggs).select(F.inline(rows))


def table_profile(df: DataFrame, types: dict[str, ColumnType], most: int = KEPT_DISTINCT, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """One row for each column of any kind: table_stats, the moments and quartiles of numbers (else null), and `items`,
    its values with their counts: of enums every variant seen, of numbers with few values each, of texts the most frequent
    n-grams with the rows that hold them; most frequent first, ties by item, and `most` of them."""
    numbers = [n for n, t in types.items() if t.kind == "number"]
    out = table_stats(df, types)
    stats = ["unique_count", "min", "max", "mean", "variance", "p25", "p50", "p75"]
    if numbers:
        out = out.join(F.broadcast(number_stats(df, numbers).select("column_name", *stats)), "column_name", "left")
    else:
        out = out.select("*", *(F.lit(None).cast("long" if c == "unique_count" else "double").alias(c) for c in stats))
    counts = [kept_histogram(df, numbers).select("column_name", F.col("value").cast("string").alias("item"), "n")] if numbers else []
    for name, t in types.items():
        if t.kind == "enum":
            code = F.col(f"`{name}`")
            item = F.get(F.array(*(F.lit(v) for v in t.variants)).cast("array<string>"), code - 1)
            counts.append(df.where(code > 0).groupBy(F.lit(name).alias("column_name"), item.alias("item")).agg(F.count(F.lit(1)).alias("n")))
        elif t.kind == "text":
            top = ngram_counts(df, name, sizes).orderBy(F.desc("row_count"), "ngram").limit(most)
            counts.append(top.select(F.lit(name).alias("column_name"), F.col("ngram").alias("item"), F.col("row_count").alias("n")))
    if not counts:
        return out.withColumn("items", F.array().cast("array<struct<item:string,n:bigint>>"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "item")))  # `most` values of a column, or its variants
    items = reduce(DataFrame.unionByName, counts).groupBy("column_name").agg(F.transform(F.slice(ordered, 1, most), lambda x: F.struct(x["item"].alias("item"), (-x["m"]).alias("n"))).alias("items"))
    return out.join(F.broadcast(items), "column_name", "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<item:string,n:bigint>>")))


def kept_histogram(df: DataFrame, columns: list[str], most: int = KEPT_DISTINCT) -> DataFrame:
    """number_histogram of the columns with at most `most` distinct values."""
    h = number_histogram(df, columns)
    few = h.groupBy("column_name").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= most)
    return h.join(F.broadcast(few.select("column_name")), "column_name", "left_semi")


def enum_histogram(df: DataFrame, column: str, variants: list[str]) -> DataFrame:
    """(variant, n) for every variant, those without rows too, and null for invalid values."""
    c = F.col(f"`{column}`").cast("string")
    seen = df.groupBy(F.when(c.isin(*variants), c).alias("variant")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(v,) for v in [*variants, None]], "variant string")
    return every.alias("e").join(seen.alias("s"), F.expr("e.variant <=> s.variant"), "left").select("e.variant", F.coalesce("s.n", F.lit(0)).alias("n"))


def merge_counts(states: list[DataFrame], keys: list[str], counts: list[str]) -> DataFrame:
    """Adds up counts of several states by key."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The mergeable state (n, mean, m2) of a number column."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))


def merge_moments(states: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean, variance) of states merged: m2 of the parts and the spread of their means."""
    s = states.where("n > 0").select(*by, "n", "mean", "m2")
    total = s.groupBy(*by).agg(F.sum("n").alias("all_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all_mean"))
    both = s.join(total, by) if by else s.crossJoin(F.broadcast(total))
    spread = F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("all_mean"), 2))
    return both.groupBy(*by, "all_n", "all_mean").agg((spread / F.col("all_n")).alias("variance")).select(*by, F.col("all_n").alias("n"), F.col("all_mean").alias("mean"), "variance")


def mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value; of several the largest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("mode", F.struct("n", "mode")).alias("mode"), F.max("n").alias("n"))


def ngram_counts(df: DataFrame, text: str, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(ngram, row_count, occurrence_count), in one pass over the rows.

    Texts are cut to tokens by column expressions.  Tasks count the n-grams of MOST_TOKENS tokens at a time, and
    Spark adds those counts up before and after the shuffle, so that what is shuffled is an n-gram a task and not
    one an occurrence, and Python holds the same whatever the table's size.
    """

    def run(batches):
        for b in batches:
            for part in pieces(b, [0]):
                for size in sizes:
                    yield counted(part.column(0), size)

    parts = spread(df.select(text)).select(tokens(text).alias("t")).mapInArrow(run, "ngram string, r long, o long")
    return parts.groupBy("ngram").agg(F.sum("r").alias("row_count"), F.sum("o").alias("occurrence_count"))


def top_ngrams(counts: DataFrame, n_rows: int | Column, most: int = TOP_NGRAMS) -> DataFrame:
    """(ngram, row_count, occurrence_count, idf) of the n-grams of the most rows; ties by n-gram."""
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    top = counts.orderBy(F.desc("row_count"), "ngram").limit(most)
    return top.withColumn("idf", idf(n, F.col("row_count")))
