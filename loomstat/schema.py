"""Logical column types: number, enum, text, unknown; inference from strings and typed loading.

A number column is stored as float with null for invalid values.  An enum column is stored as
its code, from 1 in the order of the variants, with 0 for invalid values; the variants are in the
column's metadata.  A text column has '' for null.  An unknown column has no valid value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.numbers import parse_float

#: Strings that stand for "no value".
INVALID_VALUES = ("", "+Inf", "+inf", "-Inf", "-NaN", "-inf", "-nan", "?", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null")
MAX_VARIANTS = 100


@dataclass(frozen=True)
class ColumnType:
    kind: str
    variants: tuple[str, ...] = ()

    def __post_init__(self):
        if self.kind not in ("number", "enum", "text", "unknown"):
            raise ValueError(f"no such column type: {self.kind}")


def infer_types(df: DataFrame, max_variants: int = MAX_VARIANTS, invalid_values: tuple[str, ...] = INVALID_VALUES, configured: dict[str, ColumnType] | None = None) -> dict[str, ColumnType]:
    """The type of each column of strings.

    No valid value: unknown; all finite numbers: number, or enum if they are just '0' and '1';
    at most `max_variants` different values: enum; else text.  A first scan keeps a state of fixed
    size per column; only columns that it shows to have few values have them collected by a second.
    Configured columns are taken as they are, and skipped.
    """
    known = dict(configured or {})
    names = [c for c in df.columns if c not in known]
    if names:
        aggs = []
        for i, name in enumerate(names):
            c = F.col(f"`{name}`").cast("string")
            valid = c.isNotNull() & ~c.isin(*invalid_values)
            aggs += [
                F.count_if(valid).alias(f"valid{i}"), F.count_if(valid & parse_float(c).isNull()).alias(f"other{i}"),
                F.count_if(valid & ~c.isin("0", "1")).alias(f"wide{i}"), F.max(valid & (c == "0")).alias(f"zero{i}"), F.max(valid & (c == "1")).alias(f"one{i}"),
                F.approx_count_distinct(F.when(valid, c)).alias(f"about{i}"),
            ]
        seen = df.agg(*aggs).first()
        few = []
        for i, name in enumerate(names):
            if not seen[f"valid{i}"]:
                known[name] = ColumnType("unknown")
            elif not seen[f"other{i}"]:
                binary = not seen[f"wide{i}"] and seen[f"zero{i}"] and seen[f"one{i}"]
                known[name] = ColumnType("enum", ("0", "1")) if binary else ColumnType("number")
            elif seen[f"about{i}"] > 2 * max_variants + 10:  # beyond any error of the estimate
                known[name] = ColumnType("text")
            else:
                few.append(name)
        if few:
            cs = [F.col(f"`{n}`").cast("string") for n in few]
            sets = df.agg(*(F.collect_set(F.when(~c.isin(*invalid_values), c)).alias(f"v{i}") for i, c in enumerate(cs))).first()
            for i, name in enumerate(few):
                values = sorted(sets[f"v{i}"])
                known[name] = ColumnType("enum", tuple(values)) if len(values) <= max_variants else ColumnType("text")
    return {c: known[c] for c in df.columns if c in known}


def typed(value: Column, name: str, t: ColumnType) -> Column:
    """A column of a loaded table: numbers as they are, and of strings the codes of variants or texts."""
    if t.kind == "enum":
        value = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in t.variants)).cast("array<string>"), value), F.lit(0)).cast("int")
    elif t.kind == "text":
        value = F.coalesce(value, F.lit(""))
    elif t.kind != "number":
        value = F.lit(None).cast("string")
    return value.alias(name, metadata={"ltype": t.kind, "variants": list(t.variants)})


def typed_load(df: DataFrame, types: dict[str, ColumnType]) -> DataFrame:
    """Columns of strings as columns of their types."""
    text = lambda name: F.col(f"`{name}`").cast("string")
    return df.select(*(typed(parse_float(text(name)) if t.kind == "number" else text(name), name, t) for name, t in types.items()))


def types_of(df: DataFrame) -> dict[str, ColumnType]:
    """The types that a loaded table carries, or the natural ones of Spark's types."""
    found = {}
    for f in df.schema.fields:
        if "ltype" in (f.metadata or {}):
            found[f.name] = ColumnType(f.metadata["ltype"], tuple(f.metadata["variants"]))
        elif isinstance(f.dataType, T.NumericType):
            found[f.name] = ColumnType("number")
        elif isinstance(f.dataType, T.BooleanType):
            found[f.name] = ColumnType("enum", ("false", "true"))
        elif isinstance(f.dataType, T.StringType):
            found[f.name] = ColumnType("text")
        else:
            found[f.name] = ColumnType("unknown")
    return found
