"""Roll-ups in other zones, streaming with late and repeated events, monitors, paging."""

from pyspark.sql import functions as F

from loomstat.operators import monitoring
from loomstat.plans import train as t
from loomstat.sources import events as source
from loomstat.streaming import track


def hours(spark, times):
    d = spark.createDataFrame([("m", x, 1.0) for x in times], "model_id string, date string, value double").withColumn("date", F.col("date").cast("timestamp_ntz"))
    return monitoring.hourly_numbers(d, ["model_id"], "date", "value")


def test_calendar_shows_empty_days(spark):
    out = monitoring.rolled_up(hours(spark, ["2024-02-01 00:30:00", "2024-02-29 23:59:59", "2024-03-01 00:00:00"]), "2024-02-01 00:00:00", "2024-03-01 00:00:00", "day").orderBy("interval_start").collect()
    assert len(out) == 29 and sum(r.n for r in out) == 2 and out[1].n == 0 and out[1]["mean"] is None


def test_zones_and_summer_time(spark):
    h = hours(spark, ["2024-03-31 00:30:00", "2024-03-31 01:30:00", "2024-03-30 23:30:00"])
    out = {str(r.interval_start): r.n for r in monitoring.rolled_up(h, "2024-03-31 00:00:00", "2024-04-01 00:00:00", "hour", "Europe/Berlin").collect()}
    assert len(out) == 24 and out["2024-03-31 01:00:00"] == 1 and out["2024-03-31 02:00:00"] == 0 and out["2024-03-31 03:00:00"] == 1 and out["2024-03-31 00:00:00"] == 1


def test_stream_takes_late_events_and_rejects_repeated(spark, tmp_path):
    queue = t.EventQueue(spark, str(tmp_path / "in"))
    event = lambda i, date, v: t.monitored(i, "m", date, input={}, output={"value": v})
    folder = str(tmp_path / "out")

    def run():
        lines = spark.readStream.schema("value string").text(str(tmp_path / "in"))
        e = source.parse_events(lines).where("kind = 'prediction'")
        track.start(e, folder).awaitTermination()
        return {r.hour: (r.n, r.sum) for r in track.hourly(spark, folder).collect()}

    queue.enqueue(event("1", "2024-01-01T10:10:00", 1.0))
    queue.enqueue(event("2", "2024-01-01T12:10:00", 2.0))
    queue.enqueue(event("2", "2024-01-01T12:20:00", 9.0))
    queue.flush()
    first = run()
    queue.log(event("3", "2024-01-01T10:50:00", 4.0))  # late
    queue.log(event("1", "2024-01-01T10:55:00", 7.0))  # an identifier of an earlier batch
    second = run()
    ten = min(first)
    assert first == {ten: (1, 1.0), ten + 7200: (1, 2.0)} and second == {ten: (2, 5.0), ten + 7200: (1, 2.0)}
    assert spark.read.parquet(f"{folder}/rejected").count() == 2
    track.compact(spark, folder, str(tmp_path / "small"))
    assert {r.hour: r.n for r in track.hourly(spark, str(tmp_path / "small")).collect()} == {ten: 2, ten + 7200: 1}


def test_monitors(spark):
    monitors = spark.createDataFrame([(1, "a", "absolute", 0.1, 0.1), (2, "a", "percentage", 20.0, None), (3, "a", "absolute", None, 0.5), (4, "b", "absolute", 0.1, 0.1)], "monitor_id int, model_id string, mode string, lower double, upper double")
    now = spark.createDataFrame([("a", 0.5, 100), ("b", 0.1, 99)], "model_id string, metric double, hours int")
    trained = spark.createDataFrame([("a", 0.8), ("b", 0.8)], "model_id string, training_metric double")
    assert {r.monitor_id: r.alert for r in monitoring.check_monitors(monitors, now, trained).collect()} == {1: True, 2: True, 3: False}


def test_new_monitors(spark):
    s = "model_id string, cadence string, metric string, mode string, lower double, upper double"
    held = spark.createDataFrame([("a", "daily", "accuracy", "absolute", None, 0.1)], s)
    asked = spark.createDataFrame([("a", "daily", "accuracy", "absolute", None, 0.1), ("a", "daily", "accuracy", "absolute", 0.2, 0.1)], s)
    assert [r.lower for r in monitoring.new_monitors(asked, held).collect()] == [0.2]


def test_month_ends(spark):
    d = spark.createDataFrame([("monthly", "2024-01-31 00:00:00")], "c string, t string")
    assert str(d.select(monitoring.next_check(F.col("t").cast("timestamp_ntz"), F.col("c")).alias("n")).first().n) == "2024-02-29 00:00:00"


def test_stream_of_both_kinds_of_events(spark, tmp_path):
    queue, folder = t.EventQueue(spark, str(tmp_path / "in")), str(tmp_path / "out")
    said = lambda i, date, name: t.monitored(i, "m", date, input={"a": 1}, output={"class_name": name, "probability": 0.7})
    true = lambda i, date, v: t.monitored(i, "m", date, true_value=v)

    def run():
        lines = spark.readStream.schema("value string").text(str(tmp_path / "in"))
        track.track_events(source.parse_events(lines), folder).awaitTermination()
        return {(r.hour, r.prediction, r.label): r.n for r in track.hourly_counts(spark, folder, "confusion").collect()}

    for e in (said("1", "2024-01-01T10:10:00", "x"), said("2", "2024-01-01T10:20:00", "y"), true("1", "2024-01-02T00:00:00", "x"), true("3", "2024-01-02T00:00:00", "x")):
        queue.enqueue(e)
    queue.held.append("not an event")
    queue.flush()
    first = run()
    for e in (said("3", "2024-01-01T10:50:00", "y"), true("2", "2024-01-03T00:00:00", "x"), true("1", "2024-01-03T00:00:00", "z"), said("2", "2024-01-04T10:20:00", "x")):
        queue.enqueue(e)
    queue.flush()
    second = run()
    (ten,) = {h for h, _, _ in second}
    assert first == {(ten, "x", "x"): 1} and second == {(ten, "x", "x"): 1, (ten, "y", "x"): 2}
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    assert read("bad").first().line == "not an event" and {(r.identifier, r.kind) for r in read("rejected").collect()} == {("1", "true_value"), ("2", "prediction")}
    assert {(r["class_name"], r.n) for r in track.hourly_counts(spark, folder, "classes").collect()} == {("x", 1), ("y", 2)}
    p = read("predictions").collect()
    assert {(r.model_id, str(r.day)) for r in p} == {("m", "2024-01-01")} and {r.probability for r in p} == {0.7} and all(r.input for r in p)


def test_merged_quartiles_are_exact(spark):
    d = spark.createDataFrame([("m", f"2024-01-01 {i % 24:02d}:00:00", float(i * i % 101)) for i in range(200)], "model_id string, date string, value double").withColumn("date", F.col("date").cast("timestamp_ntz"))
    got = {r["at"]: r["quantile"] for r in monitoring.merged_quantiles(monitoring.hourly_value_counts(d, ["model_id"], "date", "value"), ["model_id"]).collect()}
    import numpy as np

    assert got == {q: np.quantile([i * i % 101 for i in range(200)], q) for q in (0.25, 0.5, 0.75)}
