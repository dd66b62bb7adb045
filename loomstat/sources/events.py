"""Monitoring events: their schema, from JSON lines, and their parts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.numbers import parse_float
from loomstat.schema import ColumnType, typed

#: A line holds either kind of event; fields of the other kind are null.  Outputs are told apart by the field that is there.
EVENT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("model_id", T.StringType()), T.StructField("date", T.StringType()), T.StructField("identifier", T.StringType()),
    T.StructField("input", T.StringType()), T.StructField("true_value", T.StringType()), T.StructField("trueValue", T.StringType()), T.StructField("modelId", T.StringType()),
    T.StructField("options", T.StructType([T.StructField("threshold", T.DoubleType()), T.StructField("compute_feature_contributions", T.BooleanType())])),
    T.StructField("output", T.StructType([T.StructField("value", T.DoubleType()), T.StructField("class_name", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType()))])),
])


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """(kind, model_id, date, identifier, input, output_kind, value, class_name, probability, probabilities, true_value, line) of JSON lines.

    A line that isn't an event has kind null; `line` is what was read.
    """
    x = lines.select(F.col(column).alias("line"), F.from_json(F.col(column), EVENT).alias("e")).select("line", "e.*")
    kind = F.when(F.col("type") == "prediction", "prediction").when(F.col("type").isin("true_value", "trueValue"), "true_value")
    out = F.when(F.col("output.value").isNotNull(), "regression").when(F.col("output.probability").isNotNull(), "binary").when(F.col("output.probabilities").isNotNull(), "multiclass")
    model = F.coalesce("model_id", "modelId")
    good = kind.isNotNull() & model.isNotNull() & F.col("identifier").isNotNull() & F.col("date").try_cast("timestamp_ntz").isNotNull()
    return x.select(
        F.when(good, kind).alias("kind"), model.alias("model_id"), F.col("date").try_cast("timestamp_ntz").alias("date"), "identifier", "input", out.alias("output_kind"),
        F.col("output.value").alias("value"), F.col("output.class_name").alias("class_name"), F.col("output.probability").alias("probability"), F.col("output.probabilities").alias("probabilities"), F.coalesce("true_value", "trueValue").alias("true_value"), "line",
    )


def json_kind(json: Column, field: str) -> Column:
    """What a field of a JSON object is: absent (missing or null), number, string, boolean, array, object; null for text that isn't JSON."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    return (
        F.when(v.isNull(), None).when(kind.isNull() | (kind == "VOID"), "absent").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )


def json_text(json: Column, field: str) -> Column:
    return F.get_json_object(json, f"$.{field}")


def request_rows(df: DataFrame, json: str, columns: dict[str, ColumnType]) -> DataFrame:
    """df's JSON objects of named values as a typed table, as predictions take it; its other columns stay before.

    Numbers are numbers, or strings that spell finite ones; enums and texts are strings.  All other values, and
    missing ones, are null numbers, the code 0 and empty texts.  The JSON is parsed once.
    """
    rows = df.withColumn("__request", F.try_parse_json(F.col(json)))
    out = []
    for name, t in columns.items():
        quote = '"' if "'" in name else "'"
        path = f"$[{quote}{name}{quote}]"
        kind = F.schema_of_variant(F.try_variant_get("__request", path, "variant"))
        text = F.when(kind == "STRING", F.try_variant_get("__request", path, "string"))
        if t.kind == "number":
            number = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get("__request", path, "double").try_cast("float"))
            value = F.coalesce(F.when(F.abs(number) < float("inf"), number), parse_float(text))
        else:
            value = text
        out.append(typed(value, name, t))
    return rows.select(*(F.col(f"`{c}`") for c in df.columns if c != json), *out)
