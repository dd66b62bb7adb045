"""Streaming with keyed state: what is known of an identifier lives in Spark's state store, not in logs.

`track` keeps, for each (model, identifier), whether its prediction and its true value have come, and
the part of each that the other needs.  A micro-batch reads its own events and their keys' state; how long the
stream has run makes no difference.  Late events of any age are accepted, as state is kept until `ttl` if
one is given, else for good.  The store is RocksDB's: state is on the executors' disks, its changes in the
checkpoint folder, so a restarted stream or a lost executor goes on where it was.

State that is kept for good is a streaming aggregate (`met`, `found`), all of it DataFrame functions.  Only state that
expires needs a processor of its own (`match_events`), which asks the store from Python, key by key.

`joined_with_true_values` is the same match as a join of two streams, for true values that come within a known
delay: state older than that is dropped by watermarks, and true values without a prediction come out, with
nulls, when the delay has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomstat.functions.numbers import hour_start
from loomstat.operators.monitoring import hourly_numbers, merge_numbers
from loomstat.operators.states import hourly_quantiles

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: kind: prediction, true_value (each once an identifier), rejected (later ones), matched (in the prediction's hour).
FOUND = "kind string, model_id string, identifier string, micros long, prediction string, value double, true_value string, line string"
TURN = ("micros", "start", "hash")
FOUND_ROW = Row(*(c.split()[0] for c in FOUND.split(", ")))


class Matcher(StatefulProcessor):
    """First prediction and first true value of an identifier, in order of their dates, and the pair when both are there."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getValueState("prediction", "micros long, prediction string", self.ttl_ms)
        self.true = handle.getValueState("true_value", "true_value string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        said, true = self.said.get(), self.true.get()
        had = said is not None, true is not None
        for r in sorted(rows, key=lambda r: (r.micros, r.start, r.hash)):
            known = said if r.kind == "prediction" else true
            yield FOUND_ROW("rejected" if known is not None else r.kind, *key, r.micros, r.prediction, r.value, r.true_value, r.line)
            if known is None and r.kind == "prediction":
                said = (r.micros, r.prediction)
            elif known is None:
                true = (r.true_value,)
        if not had[0] and said is not None:
            self.said.update(tuple(said))
        if not had[1] and true is not None:
            self.true.update(tuple(true))
        if said is not None and true is not None and had != (True, True):
            yield FOUND_ROW("matched", *key, said[0], said[1], None, true[0], None)

    def close(self) -> None:
        pass


def _rows(events: DataFrame) -> DataFrame:
    """Parsed events (kind, model_id, identifier, date, class_name, value, true_value, line) as columns FOUND, and
    those in which order an identifier's count: by date, then by line (a start of it and its hash, as state holds them)."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("date").cast("timestamp_ntz"))
    prediction = F.coalesce("class_name", F.col("value").cast("string"))
    rows = events.where("kind is not null").select("kind", "model_id", "identifier", micros.alias("micros"), F.when(F.col("kind") == "prediction", prediction).alias("prediction"), "value", "true_value", "line")
    line = F.coalesce("line", F.lit(""))
    return rows.withColumns({"start": F.left(line, F.lit(64)), "hash": F.xxhash64(line)})


def match_events(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Columns FOUND of a stream of parsed events.

    One identifier's events of a micro-batch meet in one call, however many; other identifiers of its model elsewhere.
    The session that starts the stream is to name RocksDB's state store, as `track` does.
    """
    return _rows(events).groupBy("model_id", "identifier").transformWithState(Matcher(ttl_ms), FOUND, "Append", "ProcessingTime" if ttl_ms else "None")


def met(events: DataFrame) -> DataFrame:
    """A stream, for output mode update, of a micro-batch's events and, of kind `known`, a row for each of their identifiers:
    how many predictions and true values have come since the stream began, and the first of each.

    The first is that of the earliest batch, by the batches' time stamps, so the clock of the driver is not to be set back.
    """
    rows = _rows(events)
    first = lambda kind, value: F.min(F.when(F.col("kind") == kind, F.struct("batch", *TURN, value)))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    known = rows.withColumn("batch", F.current_timestamp()).groupBy("model_id", "identifier").agg(
        count("prediction").alias("predictions"), first("prediction", "prediction").alias("said"), count("true_value").alias("true_values"), first("true_value", "true_value").alias("truth"),
    )
    return rows.unionByName(known.withColumn("kind", F.lit("known")), allowMissingColumns=True)


def found(batch: DataFrame) -> DataFrame:
    """Columns FOUND of a micro-batch of `met`, after one shuffle of its rows by identifier."""
    of = Window.partitionBy("model_id", "identifier")
    place = F.row_number().over(Window.partitionBy("model_id", "identifier", "kind").orderBy(*TURN, "prediction", "true_value"))
    new = lambda kind, total: F.count_if(F.col("kind") == kind).over(of) == F.max(total).over(of)
    rows = batch.withColumn("place", place).withColumns({"new_prediction": new("prediction", "predictions"), "new_true_value": new("true_value", "true_values")})
    rows = rows.where("kind <> 'known' or (said is not null and truth is not null and (new_prediction or new_true_value))")
    first = F.expr("place = 1 and if(kind = 'prediction', new_prediction, new_true_value)")
    known = lambda there, other: F.when(F.col("kind") == "known", F.col(there)).otherwise(F.col(other)).alias(other)
    kind = F.when(F.col("kind") == "known", "matched").when(first, F.col("kind")).otherwise("rejected").alias("kind")
    return rows.select(kind, "model_id", "identifier", known("said.micros", "micros"), known("said.prediction", "prediction"), "value", known("truth.true_value", "true_value"), "line")


def _date() -> F.Column:
    return F.timestamp_add("SECOND", F.expr("micros div 1000000"), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def states_of(folder: str):
    """A foreachBatch function for FOUND: appends `found` (by kind), and partial states per hour: `hourly`, `quantiles`
    of numbers, `confusion` of matched pairs.  A batch that is run again overwrites what it wrote."""

    def run(df: DataFrame, batch: int) -> None:
        put = lambda rows, name, *by: rows.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}/batch={batch}")
        put(df, "found", "kind")
        df = df.sparkSession.read.schema(FOUND).parquet(f"{folder}/found/batch={batch}")  # the stream's state is read once
        numbers = df.where("kind = 'prediction' and value is not null").select("model_id", "value", _date().alias("date"))
        put(hourly_numbers(numbers, ["model_id"], "date", "value"), "hourly")
        put(hourly_quantiles(numbers, ["model_id"], "date", "value"), "quantiles")
        pairs = df.where("kind = 'matched'").groupBy("model_id", hour_start(_date()).alias("hour"), "prediction", F.col("true_value").alias("label"))
        put(pairs.agg(F.count(F.lit(1)).alias("n")), "confusion")

    return run


def track(events: DataFrame, folder: str, ttl_ms: int | None = None) -> StreamingQuery:
    """Matches what is there now and ends; state and progress are kept in the folder, so the next call goes on.

    A folder's state has the form it began with: it goes on only with a ttl if it had one, and without if it had none.
    """
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before, run = conf.get(name), states_of(folder)
    stream = match_events(events, ttl_ms).writeStream.outputMode("append") if ttl_ms else met(events).writeStream.outputMode("update")
    each = run if ttl_ms else lambda df, batch: run(found(df), batch)
    conf.set(name, ROCKSDB)  # read when the query starts
    try:
        return stream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def batches(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}").drop("batch")


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return merge_numbers(batches(spark, folder, "hourly"), ["model_id", "hour"])


def joined_with_true_values(predictions: DataFrame, true_values: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream (model_id, identifier, hour, prediction, true_value, true_date) of true values beside their predictions.

    predictions (model_id, identifier, date, prediction) and true_values (model_id, identifier, date, true_value) are
    streams with time stamps.  A true value without a prediction up to `delay` before or after it comes out with a null
    hour and prediction once both streams have gone past that.
    """
    p = predictions.select(F.col("model_id").alias("p_model"), F.col("identifier").alias("p_identifier"), F.col("date").alias("p_date"), "prediction").withWatermark("p_date", delay)
    t = true_values.select("model_id", "identifier", F.col("date").alias("true_date"), "true_value").withWatermark("true_date", delay)
    near = F.expr(f"p_date between true_date - interval {delay} and true_date + interval {delay}")
    j = t.join(p, (F.col("model_id") == F.col("p_model")) & (F.col("identifier") == F.col("p_identifier")) & near, "leftOuter")
    return j.select("model_id", "identifier", hour_start(F.col("p_date")).alias("hour"), "prediction", "true_value", "true_date")
