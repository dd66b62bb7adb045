"""Number functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
#: The step of single-precision floats at 1: probabilities are kept that far from 0 and 1.
EPSILON = 2.0**-23


def parse_float(c: Column) -> Column:
    """The single-precision number a string spells, null where it spells none or one that isn't finite."""
    v = F.when(c.rlike(FLOAT), c.try_cast("float"))
    return F.when(F.abs(v) < float("inf"), v)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(xs: Column) -> Column:
    """Over an array, shifted by its largest value so that no power overflows."""
    raised = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def clamp(p: Column) -> Column:
    return F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), p))


def dot(xs: Column, weights: list[float]) -> Column:
    """Sum of products with fixed weights."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    return F.aggregate(F.zip_with(xs, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def difference(new: Column, old: Column, mode: str) -> Column:
    """mode absolute: new - old; percentage: relative to old, null where old is 0."""
    return new - old if mode == "absolute" else F.try_divide(new - old, old) * 100


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a time stamp without zone, whatever the session's zone is."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def hour_start(ts: Column) -> Column:
    """Epoch seconds of the start of the hour."""
    s = epoch_seconds(ts)
    return s - F.pmod(s, F.lit(3600))
