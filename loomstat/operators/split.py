"""Deterministic shuffles and splits of exact sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.operators.ranks import numbered


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """df with `row_number`, from 0, in an order that depends on the rows and the seed only."""
    return numbered(df, F.xxhash64(F.lit(seed), *df.columns))


def split(df: DataFrame, comparison_fraction: float = 0.1, test_fraction: float = 0.2, seed: int | None = 42) -> DataFrame:
    """df with `part`: train, then floor(n * fraction) rows of comparison and of test."""
    rows = shuffled(df, seed or 0)
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    r = rows.crossJoin(F.broadcast(n))
    test, comparison = F.floor(F.col("__n") * test_fraction), F.floor(F.col("__n") * comparison_fraction)
    part = F.when(F.col("row_number") < F.col("__n") - test - comparison, "train").when(F.col("row_number") < F.col("__n") - test, "comparison").otherwise("test")
    return r.withColumn("part", part).drop("__n")


def early_stopping_split(train: DataFrame, fraction: float, last: bool) -> tuple[DataFrame, DataFrame]:
    """(rows to learn from, rows to watch) by `row_number`: linear models watch the last rows, trees the first."""
    n = train.agg(F.count(F.lit(1)).alias("n"), F.min("row_number").alias("low")).first()
    k = int(n["n"] * fraction)
    watch = F.col("row_number") >= (n["low"] or 0) + n["n"] - k if last else F.col("row_number") < (n["low"] or 0) + k
    return train.where(~watch), train.where(watch)


def _valid_target(df: DataFrame, target: str) -> Column:
    c = F.col(f"`{target}`")
    kind = df.schema[target]
    good = c.isNotNull()
    if kind.dataType.typeName() in ("float", "double"):
        good = good & ~F.isnan(c)
    if (kind.metadata or {}).get("ltype") == "enum":
        good = good & (c != 0)
    return good


def drop_invalid_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is null, not a number, or the invalid code 0 of an enum column go."""
    return df.where(_valid_target(df, target))


def invalid_targets(df: DataFrame, target: str, most: int = 20) -> list[int]:
    """Up to `most` row numbers, in the order of the whole table's shuffle, of rows that drop_invalid_target drops: for a warning."""
    r = shuffled(df).where(~_valid_target(df, target))
    return [x["row_number"] for x in r.select("row_number").orderBy("row_number").limit(most).collect()]
