"""Streaming ingest of events: late data is always accepted.

Each micro-batch appends to logs under one folder, and overwrites only what a failed attempt of the
same batch left, so a batch can be run again.  Hourly states are appended as partial states and
merged by `hourly`; nothing is read, changed and written back, so no hour is ever closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from loomstat.functions.numbers import hour_start
from loomstat.operators.monitoring import distinct_events, hourly_numbers, matched_true_values, merge_numbers


def _earlier(spark: SparkSession, path: str, like: DataFrame, batch: int) -> DataFrame:
    """What batches before this one have written; an empty table before there is any."""
    if not batch:
        return like.limit(0)
    return spark.read.schema(like.withColumn("batch", F.lit(0)).schema).option("basePath", path).parquet(path).where(F.col("batch") < batch).drop("batch")


def ingest(folder: str):
    """A foreachBatch function for (model_id, identifier, date, value): first event of an identifier to
    `predictions`, others to `rejected`, partial states per hour to `hourly`."""

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        df = df.select("model_id", "identifier", "date", "value").persist()
        try:
            first, again = distinct_events(df, ["model_id", "identifier"], ["date", "value"])
            known = _earlier(spark, f"{folder}/predictions", df, batch).select("model_id", "identifier")
            new = first.join(known, ["model_id", "identifier"], "left_anti").persist()
            new.write.mode("overwrite").parquet(f"{folder}/predictions/batch={batch}")
            repeated = first.join(known, ["model_id", "identifier"], "left_semi")
            again.unionByName(repeated).write.mode("overwrite").parquet(f"{folder}/rejected/batch={batch}")
            hourly_numbers(new, ["model_id"], "date", "value").write.mode("overwrite").parquet(f"{folder}/hourly/batch={batch}")
            new.unpersist()
        finally:
            df.unpersist()

    return run


PREDICTION = ("model_id", "identifier", "date", "input", "output_kind", "value", "class_name", "probability", "probabilities")


def _log(spark: SparkSession, path: str, batch: int, schema: StructType) -> DataFrame:
    """A log as far as batches before this one have written it."""
    if not batch:
        return spark.createDataFrame([], schema)
    every = StructType([*schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(every).option("basePath", path).parquet(path).where(F.col("batch") < batch).select(*schema.names)


def ingest_events(folder: str):
    """A foreachBatch function for parsed events of both kinds, with everything they carry.

    Appends to `predictions` (by batch, model and day), `true_values`, `matched` (true values beside their
    predictions, whichever came first), and to partial states per hour: `hourly` of numbers, `classes` of
    predicted classes, `confusion` of matched pairs.  Later events of an identifier go to `rejected`, lines that
    are no events to `bad`.
    """

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        df = df.persist()
        held: list[DataFrame] = [df]

        def put(rows: DataFrame, name: str, *by: str) -> None:
            w = rows.write.mode("overwrite")
            (w.partitionBy(*by) if by else w).parquet(f"{folder}/{name}/batch={batch}")

        def new_of(kind: str, columns: tuple[str, ...], log: str) -> tuple[DataFrame, DataFrame, DataFrame]:
            """(new events, those of earlier batches, events rejected) of a kind."""
            rows = df.where(F.col("kind") == kind).select(*columns)
            first, again = distinct_events(rows, ["model_id", "identifier"], ["date"])
            earlier = _log(spark, f"{folder}/{log}", batch, rows.schema)
            keys = earlier.select("model_id", "identifier")
            new = first.join(keys, ["model_id", "identifier"], "left_anti").select(*columns).persist()
            held.append(new)
            return new, earlier, again.unionByName(first.join(keys, ["model_id", "identifier"], "left_semi"))

        try:
            p, p_before, p_bad = new_of("prediction", PREDICTION, "predictions")
            t, t_before, t_bad = new_of("true_value", ("model_id", "identifier", "date", "true_value"), "true_values")
            put(p.withColumn("day", F.to_date("date")), "predictions", "model_id", "day")
            put(t, "true_values")
            rejected = (x.select("model_id", "identifier", "date", F.lit(kind).alias("kind")) for x, kind in ((p_bad, "prediction"), (t_bad, "true_value")))
            put(next(rejected).unionByName(next(rejected)), "rejected")
            put(df.where("kind is null").select("line"), "bad")
            said = lambda x: x.select("model_id", "identifier", "date", F.coalesce("class_name", F.col("value").cast("string")).alias("prediction"))
            pairs = matched_true_values(said(p_before.unionByName(p)), t).unionByName(matched_true_values(said(p), t_before)).persist()
            held.append(pairs)
            put(pairs, "matched")
            put(hourly_numbers(p.where("value is not null"), ["model_id"], "date", "value"), "hourly")
            put(p.where("class_name is not null").groupBy("model_id", hour_start(F.col("date")).alias("hour"), "class_name").agg(F.count(F.lit(1)).alias("n")), "classes")
            put(pairs.groupBy("model_id", "hour", "prediction", F.col("true_value").alias("label")).agg(F.count(F.lit(1)).alias("n")), "confusion")
        finally:
            for x in held:
                x.unpersist()

    return run


def track_events(events: DataFrame, folder: str) -> StreamingQuery:
    """Runs `ingest_events` over what is there now and ends; progress is kept in the folder."""
    return events.writeStream.foreachBatch(ingest_events(folder)).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def hourly_counts(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """The states `classes` or `confusion` merged over all batches."""
    x = spark.read.parquet(f"{folder}/{state}").drop("batch")
    return x.groupBy(*(c for c in x.columns if c != "n")).agg(F.sum("n").alias("n"))


def start(events: DataFrame, folder: str) -> StreamingQuery:
    """Runs `ingest` over what is there now and ends; progress is kept in the folder."""
    return events.writeStream.foreachBatch(ingest(folder)).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """(model_id, hour, state) merged over all batches."""
    return merge_numbers(spark.read.parquet(f"{folder}/hourly").drop("batch"), ["model_id", "hour"])


def compact(spark: SparkSession, folder: str, to: str) -> None:
    """Writes the merged states of `folder` as one table."""
    hourly(spark, folder).write.parquet(f"{to}/hourly/batch=0")


def hourly_low_latency(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Hourly states kept in memory by Spark; events later than `delay` are lost.  events.date: a time stamp."""
    return events.withWatermark("date", delay).groupBy("model_id", F.window("date", "1 hour")).agg(F.count("value").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
