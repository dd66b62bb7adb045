"""States of fixed size per column and hour, of all kinds of columns, that merge to any interval.

A state has the counts by validity, the moments and a KLL quantile sketch of numbers, and frequent-item
sketches of the variants of enums, of invalid values, and of the n-grams of texts (how often they occur, and
in how many rows).  None grows with the data: a quantile sketch of ``k`` holds some thousand numbers, and is
wrong by less than ``rank_error(k)`` of all ranks in 99 of 100 cases; a frequent-item sketch tracks up to
``tracked`` items, is exact while there are no more than three quarters of that, and of others keeps the most
frequent.  With a vocabulary only its n-grams are tracked and all others count as one number.

Everything is an aggregate of Spark's: partial states are merged before the shuffle, and no group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.numbers import hour_start
from loomstat.functions.text import ngrams
from loomstat.operators.monitoring import merge_states, number_state

QUANTILE_K, TRACKED = 400, 1024


def rank_error(k: int = QUANTILE_K) -> float:
    """How far, as a part of all ranks, a quantile of a sketch of k may be off (99 of 100 are nearer)."""
    return 2.3 / k**0.9


def quantile_state(value: Column, k: int = QUANTILE_K) -> Column:
    return F.kll_sketch_agg_double(value.cast("double"), k)


def hourly_quantiles(df: DataFrame, by: list[str], date: str, value: str, k: int = QUANTILE_K) -> DataFrame:
    """(by, hour, n, quantiles): a sketch of the numbers of each hour; NaN and null are left out."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, hour_start(F.col(date)).alias("hour")).agg(F.count(F.lit(1)).alias("n"), quantile_state(v, k).alias("quantiles"))


def merged_quantiles(states: DataFrame, by: list[str]) -> DataFrame:
    return states.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def quantile_rows(states: DataFrame, by: list[str], at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(by, n, at, quantile) of sketches."""
    each = F.array(*(F.struct(F.lit(a).alias("at"), F.kll_sketch_get_quantile_double("quantiles", F.lit(a)).alias("quantile")) for a in at))
    return states.where("n > 0").select(*by, "n", F.inline(each))


def _tracked(item: str, most: int, where: str) -> Column:
    return F.expr(f"approx_top_k_accumulate({item}, {most}) FILTER (WHERE {where})")


ITEMS = ("variants", "invalid_values", "ngrams", "ngram_rows")


def column_states(df: DataFrame, by: list[str], date: str, vocabulary: DataFrame | None = None, sizes: tuple[int, ...] = (1, 2), k: int = QUANTILE_K, tracked: int = TRACKED) -> DataFrame:
    """The state of each column and hour of (by, date, column_name, kind, validity, value), value being a string.

    vocabulary: (column_name, ngram), the n-grams to be counted, as many as training kept; without it, all.
    """
    grams = F.when((F.col("kind") == "text") & (F.col("validity") == "valid"), ngrams("value", sizes))
    role = lambda name: lambda g: F.struct(F.lit(name).alias("role"), g.alias("item"))
    items = F.concat(F.array(role("row")(F.col("value"))), F.coalesce(F.transform(grams, role("ngram")), F.array()), F.coalesce(F.transform(F.array_distinct(grams), role("ngram_row")), F.array()))
    rows = df.select(*by, hour_start(F.col(date)).alias("hour"), "column_name", "kind", "validity", F.inline(items))
    if vocabulary is None:
        rows = rows.withColumn("known", F.lit(True))
    else:
        v = vocabulary.select(F.col("column_name").alias("__column"), F.col("ngram").alias("__ngram"), F.lit(True).alias("known"))
        rows = rows.join(v, (F.col("column_name") == F.col("__column")) & (F.col("item") == F.col("__ngram")) & (F.col("role") != "row"), "left").drop("__column", "__ngram")
    number = F.when((F.col("role") == "row") & (F.col("kind") == "number") & (F.col("validity") == "valid"), F.col("item").try_cast("double"))
    is_row = F.col("role") == "row"
    return rows.groupBy(*by, "column_name", "hour").agg(
        F.first("kind").alias("kind"), F.count_if(is_row).alias("row_count"), *(F.count_if(is_row & (F.col("validity") == x)).alias(f"{x}_count") for x in ("absent", "invalid", "valid")),
        *number_state(number), quantile_state(number, k).alias("quantiles"),
        _tracked("item", tracked, "role = 'row' and kind = 'enum' and validity = 'valid'").alias("variants"),
        _tracked("item", tracked, "role = 'row' and validity = 'invalid' and item is not null").alias("invalid_values"),
        _tracked("item", tracked, "role = 'ngram' and known").alias("ngrams"), _tracked("item", tracked, "role = 'ngram_row' and known").alias("ngram_rows"),
        F.count_if((F.col("role") == "ngram") & F.col("known").isNull()).alias("other_ngrams"),
    )


def merged_columns(states: DataFrame, by: list[str], tracked: int = TRACKED) -> DataFrame:
    """States merged per group of `by` and column."""
    counts = (F.sum(c).alias(c) for c in ("absent_count", "invalid_count", "valid_count", "other_ngrams"))
    sketches = (F.expr(f"approx_top_k_combine({c}, {tracked})").alias(c) for c in ITEMS)
    return merge_states(states, [*by, "column_name"], F.first("kind").alias("kind"), *counts, F.kll_merge_agg_double("quantiles").alias("quantiles"), *sketches)


def frequent(states: DataFrame, by: list[str], sketch: str, most: int = 100) -> DataFrame:
    """(by, item, n): the most frequent items of a sketch of each state, `most` of them."""
    return states.select(*by, F.inline(F.expr(f"approx_top_k_estimate({sketch}, {most})"))).withColumnRenamed("count", "n")
