"""Mergeable states of fixed size, and streams with keyed state."""

import json

import numpy as np
from pyspark.sql import functions as F

from loomstat.operators import monitoring, states
from loomstat.plans import train as t
from loomstat.sources import events as source
from loomstat.streaming import keyed


def dated(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("date", F.col("date").cast("timestamp_ntz"))


def test_variance_does_not_depend_on_the_offset(spark):
    d = dated(spark, [("m", f"2024-01-01 0{i}:00:00", 1.7e9 + i) for i in range(3)] + [(None, "2024-01-01 00:00:00", -1e12), (None, "2024-01-01 03:00:00", -1e12 + 4)], "model_id string, date string, value double")
    got = {r.model_id: (r["n"], r["mean"], r.variance) for r in monitoring.overall(monitoring.hourly_numbers(d, ["model_id"], "date", "value"), ["model_id"]).collect()}
    assert got["m"][1] == 1.7e9 + 1 and abs(got["m"][2] - 2 / 3) < 1e-9 and got[None] == (2, -1e12 + 2, 4.0)
    every = monitoring.overall(monitoring.hourly_numbers(d.where("model_id = 'm'"), [], "date", "value")).first()
    assert abs(every.variance - 2 / 3) < 1e-9


def test_states_without_numbers(spark):
    d = dated(spark, [("m", "2024-01-01 00:00:00", None)], "model_id string, date string, value double")
    r = monitoring.overall(monitoring.hourly_numbers(d, ["model_id"], "date", "value"), ["model_id"]).first()
    assert (r.row_count, r.n, r["mean"], r.variance) == (1, 0, None, None)
    assert states.hourly_quantiles(d, ["model_id"], "date", "value").count() == 0


def test_sketches_stay_small_and_near(spark):
    """As large for a million distinct values as for ten thousand, merged from hours, within the stated rank error."""
    d = spark.range(1_000_000).select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id % 50 as int))").alias("date"), (F.rand(3) * 1e6).alias("value"))
    s = states.hourly_quantiles(d, [], "date", "value").cache()
    assert s.count() == 50 and s.agg(F.max(F.octet_length("quantiles"))).first()[0] < 20_000
    m = states.merged_quantiles(s, [])
    assert m.select(F.octet_length("quantiles").alias("k")).first().k < 20_000
    for r in states.quantile_rows(m, [], (0.01, 0.25, 0.5, 0.9)).collect():
        assert abs(r.quantile / 1e6 - r["at"]) < states.rank_error() + 0.003
    s.unpersist()


def test_few_values_are_exact(spark):
    d = dated(spark, [(f"2024-01-01 {i % 24:02d}:00:00", float(i * i % 101)) for i in range(200)] + [("2024-01-01 00:00:00", float("nan")), ("2024-01-01 00:00:00", None)], "date string, value double")
    got = {r["at"]: r.quantile for r in states.quantile_rows(states.merged_quantiles(states.hourly_quantiles(d, [], "date", "value"), []), []).collect()}
    values = sorted(float(i * i % 101) for i in range(200))
    assert got == {q: np.quantile(values, q, method="inverted_cdf") for q in (0.25, 0.5, 0.75)}


def inputs(spark):
    rows = [
        ("m", "2024-01-01 00:10:00", "x", "number", "valid", "1.5"), ("m", "2024-01-01 01:00:00", "x", "number", "valid", "3"), ("m", "2024-01-01 00:00:00", "x", "number", "invalid", "inf"), ("m", "2024-01-01 00:00:00", "x", "number", "absent", None),
        ("m", "2024-01-01 00:00:00", "e", "enum", "valid", "a"), ("m", "2024-01-02 00:00:00", "e", "enum", "valid", "a"), ("m", "2024-01-02 00:00:00", "e", "enum", "invalid", "zz"),
        ("m", "2024-01-02 00:00:00", "t", "text", "valid", "Red red ring"), ("m", "2024-01-01 00:00:00", "t", "text", "valid", "red blue"), ("m", "2024-01-01 00:00:00", "u", "unknown", "invalid", "q"),
    ]
    return dated(spark, rows, "model_id string, date string, column_name string, kind string, validity string, value string")


def test_one_state_for_all_kinds(spark):
    hours = states.column_states(inputs(spark), ["model_id"], "date", sizes=(1,))
    assert hours.count() == 7
    for by in (["model_id"], []):
        m = states.merged_columns(hours, by).cache()
        got = {r.column_name: (r.kind, r.row_count, r.absent_count, r.invalid_count, r.valid_count, r.n, r.sum) for r in m.collect()}
        assert got == {"x": ("number", 4, 1, 1, 2, 2, 4.5), "e": ("enum", 3, 0, 1, 2, 0, None), "t": ("text", 2, 0, 0, 2, 0, None), "u": ("unknown", 1, 0, 1, 0, 0, None)}
        items = {k: {(r.column_name, r["item"]): r.n for r in states.frequent(m, ["column_name"], k).collect()} for k in states.ITEMS}
        assert items == {"variants": {("e", "a"): 2}, "invalid_values": {("x", "inf"): 1, ("e", "zz"): 1, ("u", "q"): 1}, "ngrams": {("t", "red"): 3, ("t", "blue"): 1, ("t", "ring"): 1}, "ngram_rows": {("t", "red"): 2, ("t", "blue"): 1, ("t", "ring"): 1}}
        m.unpersist()


def test_only_the_vocabulary_is_tracked(spark):
    v = spark.createDataFrame([("t", "red"), ("t", "red blue"), ("e", "ring")], "column_name string, ngram string")
    m = states.merged_columns(states.column_states(inputs(spark), ["model_id"], "date", v), []).where("column_name = 't'").cache()
    assert {r["item"]: r.n for r in states.frequent(m, [], "ngrams").collect()} == {"red": 3, "red blue": 1} and m.first().other_ngrams == 4
    m.unpersist()


def test_free_text_cannot_grow_a_state(spark):
    """Words that come once each pass by; frequent ones stay with their counts nearly right."""
    d = spark.range(40_000).select(F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("date"), F.lit("t").alias("column_name"), F.lit("text").alias("kind"), F.lit("valid").alias("validity"), F.expr("concat('often w', id)").alias("value"))
    m = states.merged_columns(states.column_states(d, [], "date", sizes=(1,), tracked=64), [], 64)
    assert m.select(F.octet_length("ngrams.sketch").alias("k")).first().k < 5000
    top = states.frequent(m, [], "ngrams", 1).first()
    assert top["item"] == "often" and abs(top.n - 40_000) < 4000


def said(i, date, name, model="m"):
    return json.dumps(t.monitored(i, model, date, input={}, output={"class_name": name, "probability": 0.7}))


def true(i, date, v, model="m"):
    return json.dumps(t.monitored(i, model, date, true_value=v))


def run(spark, tmp_path, lines, ttl_ms=None):
    """Adds a file of lines and lets the stream go on from where it was."""
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{len(list((tmp_path / 'in').iterdir()))}.jsonl").write_text("\n".join(lines) + "\n")
    e = source.parse_events(spark.readStream.schema("value string").text(str(tmp_path / "in")))
    keyed.track(e, str(tmp_path / "out"), ttl_ms).awaitTermination()
    return sorted(((r.kind, r.model_id, r.identifier, r.prediction, r.true_value) for r in keyed.batches(spark, str(tmp_path / "out"), "found").where("kind in ('matched', 'rejected')").collect()), key=str)


def test_keyed_stream_goes_on_after_a_restart(spark, tmp_path):
    first = run(spark, tmp_path, [said("1", "2024-01-01T10:10:00", "x"), said("1", "2024-01-01T10:20:00", "z"), said("2", "2024-01-01T10:20:00", "y"), true("1", "2024-01-02T00:00:00", "x"), true("3", "2024-01-02T00:00:00", "x"), said("1", "2024-01-01T10:10:00", "other", "n")])
    assert first == [("matched", "m", "1", "x", "x"), ("rejected", "m", "1", "z", None)]
    second = run(spark, tmp_path, [said("3", "2020-01-01T10:50:00", "y"), true("2", "2024-01-03T00:00:00", "x"), true("1", "2024-01-03T00:00:00", "z"), said("2", "2024-01-04T10:20:00", "x")])
    assert second == sorted([*first, ("matched", "m", "3", "y", "x"), ("matched", "m", "2", "y", "x"), ("rejected", "m", "1", None, "z"), ("rejected", "m", "2", "x", None)], key=str)
    c = {(r.hour % 86400, r.prediction, r.label): r.n for r in keyed.batches(spark, str(tmp_path / "out"), "confusion").collect()}
    assert c == {(36000, "x", "x"): 1, (36000, "y", "x"): 1} and sum(r.n for r in keyed.batches(spark, str(tmp_path / "out"), "confusion").collect()) == 3


def test_keyed_stream_of_numbers(spark, tmp_path):
    number = lambda i, hour, v: json.dumps(t.monitored(i, "m", f"2024-01-01T{hour}:10:00", input={}, output={"value": v}))
    run(spark, tmp_path, [number("1", 10, 1.0), number("2", 12, 2.0), number("2", 12, 9.0)])
    run(spark, tmp_path, [number("3", 10, 4.0), number("1", 10, 7.0)])
    folder = str(tmp_path / "out")
    assert sorted((r.n, r.sum) for r in keyed.hourly(spark, folder).collect()) == [(1, 2.0), (2, 5.0)]
    q = states.merged_quantiles(keyed.batches(spark, folder, "quantiles"), ["model_id"])
    assert {r["at"]: r.quantile for r in states.quantile_rows(q, ["model_id"]).collect()} == {0.25: 1.0, 0.5: 2.0, 0.75: 4.0}


def test_keyed_stream_is_an_aggregate_that_finds_what_the_processor_finds(spark, tmp_path):
    rng = np.random.default_rng(3)
    out = {}
    batches = [
        [(said if rng.random() < 0.5 else true)(str(rng.integers(40)), f"2024-01-01T{rng.integers(3) + 10}:00:00", "xyz"[rng.integers(3)], "mn"[rng.integers(2)]) for _ in range(120)]
        for _ in range(3)
    ]
    for lines in batches:  # dates come again, and earlier ones in later batches
        lines += lines[:5]  # the same lines twice

    def processed(e, folder):  # as state that expires would be, but without end
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.ROCKSDB)
        try:
            return keyed.match_events(e).writeStream.foreachBatch(keyed.states_of(folder)).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        finally:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")

    for name, track in (("kept", keyed.track), ("processed", processed)):
        folder = tmp_path / name
        (folder / "in").mkdir(parents=True)
        e = source.parse_events(spark.readStream.schema("value string").text(str(folder / "in")))
        for i, lines in enumerate(batches):
            (folder / "in" / f"{i}.jsonl").write_text("\n".join([*lines, "no event"]) + "\n")
            q = track(e, str(folder / "out"))
            assert q.awaitTermination(120)
        out[name] = sorted((tuple(r) for r in spark.read.parquet(str(folder / "out" / "found")).select("batch", *keyed.FOUND_ROW).collect()), key=str)
        names = [o.operatorName for o in q.lastProgress.stateOperators]
        assert name == "processed" or names == ["stateStoreSave"]  # no state that Python asks for key by key
    assert out["kept"] == out["processed"] and {r[0] for r in out["kept"]} == {0, 1, 2}
    kinds = [r[1] for r in out["kept"]]
    assert len(kinds) - kinds.count("matched") == 375 and min(kinds.count(k) for k in ("prediction", "true_value", "rejected", "matched")) > 30


def test_keyed_stream_runs_a_failed_batch_again(spark, tmp_path, monkeypatch):
    import pytest

    lines = [said("1", "2024-01-01T10:10:00", "x"), true("1", "2024-01-02T00:00:00", "x"), said("2", "2024-01-01T10:10:00", "y")]
    first = run(spark, tmp_path, lines)
    with monkeypatch.context() as m:
        m.setattr(keyed, "hourly_quantiles", lambda *a: 1 / 0)  # after what was found is written
        with pytest.raises(Exception, match="division by zero"):
            run(spark, tmp_path, [said("1", "2020-01-01T10:10:00", "z"), true("2", "2024-01-02T00:00:00", "x")])
    second = run(spark, tmp_path, [true("2", "2020-01-02T00:00:00", "y")])
    assert first == [("matched", "m", "1", "x", "x")]
    assert second == sorted([*first, ("rejected", "m", "1", "z", None), ("matched", "m", "2", "y", "x"), ("rejected", "m", "2", None, "y")], key=str)


def test_joined_streams_show_true_values_without_a_prediction(spark, tmp_path):
    for name in ("p", "t"):
        (tmp_path / name).mkdir()

    def add(name, k, rows):
        (tmp_path / name / f"{k}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))

    def go():
        p = spark.readStream.schema("model_id string, identifier string, date timestamp, prediction string").json(str(tmp_path / "p"))
        v = spark.readStream.schema("model_id string, identifier string, date timestamp, true_value string").json(str(tmp_path / "t"))
        j = keyed.joined_with_true_values(p, v, "1 day")
        j.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
        return sorted(((r.identifier, r.prediction, r.true_value, r.hour is None) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)

    say = lambda i, date, v: {"model_id": "m", "identifier": i, "date": date, "prediction": v}
    tell = lambda i, date, v: {"model_id": "m", "identifier": i, "date": date, "true_value": v}
    add("p", 0, [say("1", "2024-01-01T10:00:00Z", "x"), say("2", "2024-01-01T11:00:00Z", "y")])
    add("t", 0, [tell("1", "2024-01-01T20:00:00Z", "x"), tell("9", "2024-01-01T20:00:00Z", "x")])
    assert go() == [("1", "x", "x", False)]
    add("t", 1, [tell("2", "2024-01-02T09:00:00Z", "z")])  # a prediction of an earlier batch
    add("p", 1, [say("5", "2024-01-20T10:00:00Z", "x")])
    assert go() == [("1", "x", "x", False), ("2", "y", "z", False)]
    for k in range(2, 4):  # both streams go on past the delay
        add("t", k, [tell(f"t{k}", f"2024-01-{18 + 3 * k}T09:00:00Z", "z")])
        add("p", k, [say(f"p{k}", f"2024-01-{18 + 3 * k}T10:00:00Z", "x")])
        out = go()
    assert ("9", None, "x", True) in out and [x for x in out if x[3]][0][0] == "9"


def test_quantiles_of_few_values_are_the_same_in_one_job(spark):
    from loomstat.operators import ranks

    rows = [(g, float(v), n) for g in ("a", "b", None) for v, n in ((-3, 2), (0.5, 1), (7, 4), (7.25, 1))] + [("c", 1.0, 1)]
    c = spark.createDataFrame(rows, "g string, value double, n long").where("g is not null")
    at = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    one, two = ({(r.g, r["at"]): r.quantile for r in ranks.quantiles(c, ["g"], "value", at, k).collect()} for k in (None, 9))
    assert one == two and len(one) == 18 and one["a", 0.5] == np.quantile([-3, -3, 0.5, 7, 7, 7, 7, 7.25], 0.5)
    every = [ranks.quantiles(c, [], "value", at, k).orderBy("at").collect() for k in (None, 9)]
    assert every[0] == every[1] and len(every[0]) == 6
