"""Fixtures with known results: inference, tokens, metrics, features, missing values."""

import math

from pyspark.sql import functions as F

from loomstat.functions import text
from loomstat.functions.numbers import parse_float, softmax
from loomstat.operators import features, metrics, monitoring, profile
from loomstat.operators.ranks import quantiles, value_counts
from loomstat.schema import ColumnType, infer_types, typed_load
from loomstat.sources import events as source


def test_infer_types(spark):
    df = spark.createDataFrame([("1", "test", "hello"), ("2", "test", "world")], "number string, enum string, text string")
    assert infer_types(df, max_variants=1) == {"number": ColumnType("number"), "enum": ColumnType("enum", ("test",)), "text": ColumnType("text")}
    both = infer_types(df, max_variants=2, configured={"text": ColumnType("text"), "enum": ColumnType("enum", ("hello", "test"))})
    assert [r.enum for r in typed_load(df, both).collect()] == [2, 2]


def test_infer_edge_cases(spark):
    rows = [("NA", "0", "1e40", "x"), ("?", "1", "2", None), (None, "0", "", "1")]
    t = infer_types(spark.createDataFrame(rows, "a string, b string, c string, d string"))
    assert (t["a"].kind, t["b"], t["d"]) == ("unknown", ColumnType("enum", ("0", "1")), ColumnType("enum", ("1", "x")))
    assert t["c"].kind == "enum"  # a number too large for a float is no number
    assert infer_types(spark.createDataFrame([], "a string"))["a"].kind == "unknown"


def test_parse_float(spark):
    vs = ["1", "1.5", ".5", "1.", "1e3", "-2", "+3", "inf", "NaN", " 7 ", "1d", "0x1", "1e40", None]
    got = [r.x for r in spark.createDataFrame([(v,) for v in vs], "v string").select(parse_float(F.col("v")).alias("x")).collect()]
    assert got == [1.0, 1.5, 0.5, 1.0, 1000.0, -2.0, 3.0] + [None] * 7


def test_tokens(spark):
    texts = ["", "   ", " &*! ", "Founder/CEO", "iOS Developer", None]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string").select(text.tokens("x").alias("t")).collect()]
    assert got == [[], [], ["&", "*", "!"], ["founder", "/", "ceo"], ["ios", "developer"], []]


def test_auc(spark):
    df = spark.createDataFrame([(0.9, True), (0.4, True), (0.4, False), (0.2, False)], "p double, y boolean")
    assert metrics.auc_exact(df, "p", "y").first().auc == 0.875
    assert metrics.auc_exact(df.where("y"), "p", "y").first().auc is None


def test_three_thresholds(spark):
    df = spark.createDataFrame([(0.9, True), (0.2, False), (0.7, True), (0.2, False), (0.1, True)], "p double, y boolean")
    t = metrics.threshold_metrics(df, "p", "y", 3)
    rows = {r.threshold: r for r in t.collect()}
    for at in (0.25, 0.5):
        r = rows[at]
        assert (r.tp, r.fp, r.tn, r.fn) == (2, 0, 2, 1) and math.isclose(r.f1, 0.8) and math.isclose(r.accuracy, 0.8) and math.isclose(r.recall, 2 / 3)
    assert (rows[0.75].tp, rows[0.75].fn) == (1, 2) and math.isclose(rows[0.75].f1, 0.5)
    assert math.isclose(metrics.auc_from_thresholds(t).first().auc, 0.8333334, rel_tol=1e-6)


def test_two_class_confusion(spark):
    pairs = [("Cat", "Cat")] * 3 + [("Cat", "Dog")] * 3 + [("Dog", "Dog")] * 5 + [("Dog", "Cat")] * 2
    df = spark.createDataFrame(pairs, "prediction string, true_value string")
    r = monitoring.binary_production(df.withColumn("m", F.lit(1)), ["m"], "Cat").first()
    assert (r.tp, r.fp, r.tn, r.fn) == (3, 3, 5, 2) and math.isclose(r.accuracy, 0.61538464, rel_tol=1e-6) and math.isclose(r.f1, 0.54545456, rel_tol=1e-6)
    o = metrics.overall_class_metrics(metrics.class_metrics(metrics.confusion(df, "prediction", "true_value"))).first()
    assert math.isclose(o.precision_weighted, 0.6318681, rel_tol=1e-6) and math.isclose(o.recall_unweighted, 0.6125, rel_tol=1e-6)


def test_bag_of_words(spark):
    v = spark.createDataFrame([("test", 1.0), ("hello", 1.0)], "ngram string, idf double")
    d = spark.createDataFrame([(1, "hello"), (2, "hello test")], "id long, x string")
    got = {(r.row_id, r.ngram): r.value for r in features.bag_of_words(d, "id", "x", v, "present", normalise=True).collect()}
    assert got[1, "hello"] == 1.0 and math.isclose(got[2, "test"], 1 / math.sqrt(2)) and len(got) == 3


def test_cosine(spark):
    v = spark.createDataFrame([(w, 1.0) for w in ("test", "ben", "bitdiddle")], "ngram string, idf double")
    d = spark.createDataFrame([(1, "Ben Bitdiddle", "Little Ben Bitdiddle")], "id long, a string, b string")
    sides = [features.bag_of_words(d, "id", c, v, "present", normalise=True) for c in "ab"]
    assert math.isclose(features.cosine_similarity(*sides).first().similarity, 1.0)


def test_null_is_absent(spark):
    d = spark.createDataFrame([('{"x": null}',), ("{}",), ('{"x": "7"}',), ('{"x": [1]}',), ("not json",)], "j string")
    for kind, third in (("number", "valid"), ("enum", "invalid"), ("text", "valid"), ("unknown", "invalid")):
        got = [r.v for r in d.select(monitoring.validity(source.json_kind(F.col("j"), "x"), source.json_text(F.col("j"), "x"), kind, ["a"]).alias("v")).collect()]
        assert got == ["absent", "absent", third, "invalid", "absent"]


def test_all_invalid_number_column(spark):
    d = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "a double, b double")
    r = {x.column_name: x for x in profile.number_stats(d, ["a", "b"]).collect()}
    assert r["a"].invalid_count == 2 and r["a"].mean is None and r["a"].unique_count == 0 and r["b"].p50 == 1.5


def test_quantiles_of_many_ties(spark):
    d = spark.range(1000).select(F.lit("c").alias("k"), F.when(F.col("id") < 700, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = {r["at"]: r.quantile for r in quantiles(value_counts(d, ["k"], "v"), ["k"], "v", (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
    assert got == {0.0: 5.0, 0.25: 5.0, 0.5: 5.0, 0.75: 749.25, 1.0: 999.0}


def test_merge_is_associative(spark):
    d = spark.range(100).select(F.lit("k").alias("k"), (F.col("id") % 7).alias("p"), (F.col("id") * F.col("id")).cast("double").alias("v"))
    m = profile.merge_moments(profile.moments(d, ["k", "p"], "v"), ["k"]).first()
    w = d.agg(F.avg("v").alias("m"), F.var_pop("v").alias("v")).first()
    assert math.isclose(m["mean"], w.m) and math.isclose(m.variance, w.v) and m.n == 100


def test_softmax(spark):
    r = spark.range(1).select(softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("p")).first()
    assert r.p == [0.5, 0.5]


def test_events(spark):
    lines = [
        '{"type":"prediction","model_id":"a","date":"2024-01-01T10:30:00","identifier":1,"input":{"x":1},"output":{"class_name":"p","probability":0.7,"probabilities":{"p":0.7}}}',
        '{"type":"trueValue","modelId":"a","date":"2024-01-02T10:30:00","identifier":"1","trueValue":"p"}', "nonsense",
    ]
    e = source.parse_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [x.kind for x in e] == ["prediction", "true_value", None] and e[0].output_kind == "binary" and e[0].identifier == "1" and e[1].true_value == "p"
