"""Queries over states and streams of production, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.operators import monitoring, profile, states
from loomstat.plans.queries import _GRAMS, _GUESS, _HOUR, _JOINED, _predictions, query, r
from loomstat.sources.tables import shared_folder, table
from loomstat.streaming import keyed

FAR = 1.7e9


def off_tie(c: str, places: int) -> Column:
    """Rounded a step off the ties that numbers with two decimals run into, as the SQL does."""
    return F.round(F.col(c) + 1e-7, places).alias(c)


@query(f"SELECT 'm' || (user_id % 3) AS model_id, date_trunc('month', ts) AS month, count(value) AS n, round(avg(value + {FAR}) - {FAR} + 1e-5, 3) AS mean, round(var_pop(value) + 1e-5, 2) AS variance FROM events GROUP BY ALL")
def variance_far_from_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of numbers as large as times in seconds, from hourly states merged by month."""
    p = _predictions(spark, sf_dir).withColumn("value", F.col("value") + FAR)
    h = monitoring.hourly_numbers(p, ["model_id"], "date", "value").withColumn("month", monitoring.interval_start(F.col("hour"), "month"))
    m = monitoring.finished_numbers(monitoring.merge_numbers(h, ["model_id", "month"]))
    return m.select("model_id", F.col("month").cast("timestamp_ntz").alias("month"), "n", F.round(F.col("mean") - FAR + 1e-5, 3).alias("mean"), F.round(F.col("variance") + 1e-5, 2).alias("variance"))


@query("SELECT 'm' || (user_id % 3) AS model_id, q AS \"at\", count(value) AS n, true AS within_bound FROM events, (VALUES (0.05::DOUBLE), (0.25), (0.5), (0.75), (0.99)) a(q) GROUP BY ALL")
def production_quantiles_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of all hours from merged sketches, held against the exact ranks of the values they name."""
    p = _predictions(spark, sf_dir).select("model_id", "date", "value")
    merged = states.merged_quantiles(states.hourly_quantiles(p, ["model_id"], "date", "value"), ["model_id"])
    q = states.quantile_rows(merged, ["model_id"], (0.05, 0.25, 0.5, 0.75, 0.99))
    j = p.where("value is not null").join(F.broadcast(q), "model_id")  # five rows a model
    exact = j.groupBy("model_id", "at", "n", "quantile").agg(F.count_if(F.col("value") < F.col("quantile")).alias("below"), F.count_if(F.col("value") <= F.col("quantile")).alias("upto"))
    e = F.lit(states.rank_error())
    return exact.select("model_id", "at", "n", ((F.col("at") >= F.col("below") / F.col("n") - e) & (F.col("at") <= F.col("upto") / F.col("n") + e)).alias("within_bound"))


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, date, column_name, kind, validity, value) of three input columns: a number, an enum and a text."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    e = table(spark, sf_dir, "events").join(part, F.col("event_id") % part.count() == F.col("p_partkey"), "left")
    cell = lambda name, kind, validity, value: F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("kind"), validity.alias("validity"), value.alias("value"))
    number = F.when(F.col("event_id") % 7 == 0, "absent").when(F.col("event_id") % 11 == 0, "invalid").otherwise("valid")
    enum = F.when(F.col("event_type").isin("view", "click", "error"), "valid").otherwise("invalid")
    cells = F.array(
        cell("value", "number", number, F.when(number == "invalid", "inf").when(number == "valid", F.col("value").cast("string"))),
        cell("event_type", "enum", enum, F.col("event_type")), cell("p_name", "text", F.when(F.col("p_name").isNull(), "absent").otherwise("valid"), F.col("p_name")),
    )
    return e.select(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_id"), F.col("ts").alias("date"), F.inline(cells))


def _by_day(spark: SparkSession, sf_dir: str, vocabulary: DataFrame | None = None) -> DataFrame:
    s = states.column_states(_inputs(spark, sf_dir), ["model_id"], "date", vocabulary)
    return states.merged_columns(s.withColumn("day", monitoring.interval_start(F.col("hour"), "day")), ["model_id", "day"])


_INPUTS = """WITH e AS (SELECT 'm' || (user_id % 3) AS model_id, date_trunc('day', ts) AS day, event_id, event_type, value, p_name, string_split(lower(p_name), ' ') AS t
FROM events JOIN part ON event_id % (SELECT count(*) FROM part) = p_partkey)"""


@query(_INPUTS + """, c AS (SELECT model_id, day, 'value' AS column_name, CASE WHEN event_id % 7 = 0 THEN 'a' WHEN event_id % 11 = 0 THEN 'i' ELSE 'v' END AS s, value FROM e
  UNION ALL SELECT model_id, day, 'event_type', CASE WHEN event_type IN ('view', 'click', 'error') THEN 'v' ELSE 'i' END, NULL FROM e UNION ALL SELECT model_id, day, 'p_name', 'v', NULL FROM e)
SELECT model_id, day, column_name, count(*) AS row_count, count_if(s = 'a') AS absent_count, count_if(s = 'i') AS invalid_count, count_if(s = 'v') AS valid_count,
round(avg(value) FILTER (s = 'v') + 1e-7, 4) AS mean, round(var_pop(value) FILTER (s = 'v') + 1e-7, 4) AS variance FROM c GROUP BY ALL""")  # fmt: skip
def column_states_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and moments of columns of all kinds, from one state a column and hour."""
    s = monitoring.finished_numbers(_by_day(spark, sf_dir))
    return s.select("model_id", "day", "column_name", "row_count", "absent_count", "invalid_count", "valid_count", off_tie("mean", 4), off_tie("variance", 4))


@query(_INPUTS + """SELECT model_id, day, 'event_type' AS column_name, 'variants' AS state, event_type AS item, count(*) AS n FROM e WHERE event_type IN ('view', 'click', 'error') GROUP BY ALL
UNION ALL SELECT model_id, day, 'event_type', 'invalid_values', event_type, count(*) FROM e WHERE event_type NOT IN ('view', 'click', 'error') GROUP BY ALL
UNION ALL SELECT model_id, day, 'value', 'invalid_values', 'inf', count(*) FROM e WHERE event_id % 7 > 0 AND event_id % 11 = 0 GROUP BY ALL""")  # fmt: skip
def enum_states_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants and invalid values with their counts, from frequent-item sketches (exact here, as they are few)."""
    s = _by_day(spark, sf_dir)
    by = ["model_id", "day", "column_name"]
    each = [states.frequent(s, by, k).withColumn("state", F.lit(k)) for k in ("variants", "invalid_values")]
    return each[0].unionByName(each[1])


@query(_INPUTS + """, g AS (SELECT model_id, day, event_id, unnest(t) AS item FROM e UNION ALL SELECT model_id, day, event_id, unnest([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) FROM e)
SELECT model_id, day, item, count(*) AS n, count(DISTINCT event_id) AS n_rows FROM g GROUP BY ALL""")
def hourly_text_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-grams of a text column by day, occurrences and rows, from merged hourly sketches."""
    s, by = _by_day(spark, sf_dir), ["model_id", "day"]
    n, rows = (states.frequent(s.where("column_name = 'p_name'"), by, k, states.TRACKED) for k in ("ngrams", "ngram_rows"))
    return n.join(rows.withColumnRenamed("n", "n_rows"), [*by, "item"])


@query(_INPUTS + """, v AS (SELECT w FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY w ORDER BY count(*) DESC, w LIMIT 3),
g AS (SELECT model_id, day, unnest(t) AS item FROM e UNION ALL SELECT model_id, day, unnest([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) FROM e)
SELECT model_id, day, w AS item, count(*) AS n FROM g LEFT JOIN v ON w = item GROUP BY ALL""")
def tracked_text_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only n-grams that training kept are tracked; all others are one number, under null."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = words.orderBy(F.desc("n"), "ngram").limit(3).select(F.lit("p_name").alias("column_name"), "ngram")
    s = _by_day(spark, sf_dir, vocabulary).where("column_name = 'p_name'")
    others = s.where("other_ngrams > 0").select("model_id", "day", F.lit(None).cast("string").alias("item"), F.col("other_ngrams").alias("n"))
    return states.frequent(s, ["model_id", "day"], "ngrams").unionByName(others)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table replayed as a stream of files."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("model_id", F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")))


@query(f"""WITH e AS (SELECT 'm' || (user_id % 3) AS model_id, event_id // 2 AS identifier, {_HOUR} AS hour, ts, event_id, value, event_type, {_GUESS} AS prediction FROM events),
p AS (SELECT * FROM e WHERE identifier % 4 < 3 QUALIFY row_number() OVER (PARTITION BY model_id, identifier ORDER BY ts, event_id) = 1),
t AS (SELECT * FROM e WHERE identifier % 4 > 0 QUALIFY row_number() OVER (PARTITION BY model_id, identifier ORDER BY ts, event_id) = 1)
SELECT model_id, p.hour, p.prediction, t.event_type AS label, count(*) AS n FROM p JOIN t USING (model_id, identifier) GROUP BY ALL""")
def streaming_keyed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion by hour of a stream in which identifiers come again, matched by keyed state."""
    folder = f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}"
    e = _stream(spark, sf_dir).withColumn("identifier", F.expr("event_id div 2"))
    shared = ["model_id", F.col("identifier").cast("string").alias("identifier"), F.col("ts").cast("timestamp_ntz").alias("date"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("line")]
    none = F.lit(None).cast("string")
    p = e.where("identifier % 4 < 3").select(F.lit("prediction").alias("kind"), *shared, F.expr(_GUESS).alias("class_name"), "value", none.alias("true_value"))
    t = e.where("identifier % 4 > 0").select(F.lit("true_value").alias("kind"), *shared, none.alias("class_name"), F.lit(None).cast("double").alias("value"), F.col("event_type").alias("true_value"))
    keyed.track(p.unionByName(t), folder).awaitTermination()
    return keyed.batches(spark, folder, "confusion").groupBy("model_id", "hour", "prediction", "label").agg(F.sum("n").alias("n"))


@query(_JOINED + "SELECT model_id, hour, prediction, true_value AS label, count(*) AS n FROM j GROUP BY ALL")
def streaming_joined_true_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True values of every second event joined, as a stream, with the stream of predictions."""
    folder = f"{shared_folder(spark)}/joined-{uuid.uuid4().hex}"
    e = _stream(spark, sf_dir).select("model_id", F.col("event_id").cast("string").alias("identifier"), F.col("ts").cast("timestamp").alias("date"), F.expr(_GUESS).alias("prediction"), F.col("event_type").alias("true_value"), "event_id")
    j = keyed.joined_with_true_values(e, e.where("event_id % 2 = 0"), "7 days").where("hour is not null")
    j.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("model_id", "hour", "prediction", F.col("true_value").alias("label")).agg(F.count(F.lit(1)).alias("n"))


_REQUEST = """CASE event_id % 9 WHEN 0 THEN '{}' WHEN 1 THEN '{"a number": null, "e": null, "t": null}' WHEN 2 THEN '{"a number": " 7.5", "e": "VIEW", "t": 12}' WHEN 3 THEN '{"a number": "inf", "e": true, "t": true}'
WHEN 4 THEN '{"a number": true, "e": 1, "t": ["x"]}' WHEN 5 THEN concat('{"a number": "', event_id, '.5", "e": "', event_type, '", "t": "It''s ', event_type, '"}') WHEN 6 THEN 'not json' WHEN 7 THEN '{"a number": {"x": 1}, "e": ["view"], "t": {}}'
ELSE concat('{"a number": ', event_id, '.25, "e": "', event_type, '", "t": "\u00e9", "more": 1}') END"""


@query("""SELECT event_id, CASE event_id % 9 WHEN 5 THEN event_id + 0.5 WHEN 8 THEN event_id + 0.25 END::DOUBLE AS a, CASE WHEN event_id % 9 IN (5, 8) THEN list_position(['click', 'view'], event_type) ELSE 0 END::INTEGER AS e,
CASE event_id % 9 WHEN 5 THEN 'It''s ' || event_type WHEN 8 THEN 'é' ELSE '' END AS t, event_id % 9 = 99 AS other FROM events""".replace("list_position(['click', 'view'], event_type)", "coalesce(list_position(['click', 'view'], event_type), 0)"))
def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects of mixed values as the typed rows that predictions take."""
    from loomstat.schema import ColumnType
    from loomstat.sources.events import request_rows as rows

    e = table(spark, sf_dir, "events").select("event_id", F.expr(_REQUEST).alias("input"))
    d = rows(e, "input", {"a number": ColumnType("number"), "e": ColumnType("enum", ("click", "view")), "t": ColumnType("text"), "u": ColumnType("unknown")})
    return d.select("event_id", F.col("`a number`").cast("double").alias("a"), "e", "t", F.col("u").isNotNull().alias("other"))


_WINDOW = ("2024-01-05 00:00:00", "2024-01-12 00:00:00", "day")


@query("""WITH i AS (SELECT i FROM range(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-12', INTERVAL 1 day) r(i)),
l AS (SELECT date_trunc('day', ts) AS i, value FROM events WHERE user_id % 3 = 0 AND ts >= '2024-01-05' AND ts < '2024-01-12'),
g AS (SELECT i, grouping(i) AS o, count(value) AS n, round(avg(value) + 1e-7, 4) AS mean, round(var_pop(value) + 1e-7, 3) AS variance FROM l GROUP BY GROUPING SETS ((i), ()))
SELECT strftime(i.i, '%Y-%m-%d') AS interval_start, coalesce(n, 0) AS n, mean, variance, t.* FROM i LEFT JOIN g ON g.i = i.i, (SELECT round(avg(value) + 1e-7, 4) AS training_mean, max(value) AS training_max FROM events WHERE user_id % 3 = 1) t
UNION ALL SELECT NULL, n, mean, variance, t.* FROM g, (SELECT round(avg(value) + 1e-7, 4), max(value) FROM events WHERE user_id % 3 = 1) t WHERE o = 1""")
def production_numbers_both_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted numbers by day and in the whole window, from one pass over hourly states, beside training's."""
    p = _predictions(spark, sf_dir)
    training = p.where("model_id = 'm1'").agg(F.avg("value").alias("training_mean"), F.max("value").alias("training_max"))
    h = monitoring.hourly_numbers(p.where("model_id = 'm0'"), [], "date", "value")
    out = monitoring.number_levels(h, training, *_WINDOW)
    return out.select(F.date_format("interval_start", "yyyy-MM-dd").alias("interval_start"), "n", off_tie("mean", 4), off_tie("variance", 3), off_tie("training_mean", 4), "training_max")


@query("""WITH i AS (SELECT i FROM range(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-12', INTERVAL 1 day) r(i) UNION ALL SELECT NULL),
t AS (SELECT event_type AS class, count(*) AS training_n FROM events WHERE user_id % 3 = 1 AND event_type <> 'error' GROUP BY 1),
l AS (SELECT date_trunc('day', ts) AS i, event_type AS class FROM events WHERE user_id % 3 = 0 AND event_type <> 'error' AND ts >= '2024-01-05' AND ts < '2024-01-12'),
g AS (SELECT i, class, count(*) AS n FROM l GROUP BY GROUPING SETS ((i, class), (class))),
e AS (SELECT i.i, t.class, coalesce(n, 0) AS n, training_n FROM i CROSS JOIN t LEFT JOIN g ON g.i IS NOT DISTINCT FROM i.i AND g.class = t.class)
SELECT strftime(i, '%Y-%m-%d') AS interval_start, class, n, round(n / nullif(sum(n) OVER (PARTITION BY i), 0), 6) AS fraction, training_n, round(training_n / sum(training_n) OVER (PARTITION BY i), 6) AS training_fraction FROM e""")
def production_classes_both_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted classes by day and in the whole window, beside training's; the class error is unknown to training."""
    p = _predictions(spark, sf_dir).withColumnRenamed("event_type", "class")
    training = p.where("model_id = 'm1' and class <> 'error'").groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    h = p.where("model_id = 'm0'").groupBy(monitoring.hour_start(F.col("date")).alias("hour"), "class").agg(F.count(F.lit(1)).alias("n"))
    out = monitoring.class_levels(h, training, *_WINDOW)
    return out.select(F.date_format("interval_start", "yyyy-MM-dd").alias("interval_start"), "class", "n", r("fraction"), "training_n", r("training_fraction"))


@query(_JOINED + """, c AS (SELECT model_id, hour, count_if(prediction = 'view' AND true_value = 'view') AS tp, count_if(prediction = 'view' AND true_value <> 'view') AS fp, count_if(prediction <> 'view' AND true_value = 'view') AS fn, count_if(prediction <> 'view' AND true_value <> 'view') AS tn FROM j GROUP BY ALL),
l AS (SELECT model_id, (tp + tn) / (tp + fp + tn + fn) AS accuracy, tp / nullif(tp + fn, 0) AS recall, count(*) OVER (PARTITION BY model_id) AS hours FROM c QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY hour DESC) = 1)
SELECT model_id, metric_name, round(metric, 6) AS metric, round(metric - 0.5, 6) AS difference, coalesce(abs(metric - 0.5) > bound, false) AS alert
FROM (SELECT model_id, hours, 'accuracy' AS metric_name, accuracy AS metric, 0.1 AS bound FROM l UNION ALL SELECT model_id, hours, 'recall', recall, 0.4 FROM l) WHERE hours >= 10""")
def monitors_of_several_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitors that watch the latest hour of a metric each."""
    m = monitoring.matched_true_values(_predictions(spark, sf_dir), table(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_id"), F.col("event_id").cast("string").alias("identifier"), F.col("event_type").alias("true_value")))
    hours = monitoring.binary_production(m, ["model_id", "hour"], "view")
    last = hours.groupBy("model_id").agg(F.max_by(F.struct("accuracy", "recall"), "hour").alias("l"), F.count(F.lit(1)).alias("hours")).select("model_id", "l.*", "hours")
    current = monitoring.named_metrics(last, ["model_id", "hours"], ["accuracy", "recall"])
    models = last.select("model_id", F.lit(0.5).alias("accuracy"), F.lit(0.5).alias("recall"))
    monitors = spark.createDataFrame([("accuracy", 0.1), ("recall", 0.4)], "metric_name string, bound double").crossJoin(F.broadcast(models.select("model_id")))
    monitors = monitors.select(F.concat("model_id", "metric_name").alias("monitor_id"), "model_id", "metric_name", F.lit("absolute").alias("mode"), F.col("bound").alias("lower"), F.col("bound").alias("upper"))
    out = monitoring.check_monitors(monitors, current, monitoring.named_metrics(models, ["model_id"], ["accuracy", "recall"], "training_metric"), 10)
    return out.select("model_id", "metric_name", r("metric"), r("difference"), "alert")


@query(_GRAMS + """, s AS (SELECT ngram, count(*) AS training_occurrences FROM u WHERE doc_id % 2 = 0 GROUP BY 1), p AS (SELECT ngram, count(*) AS production_occurrences FROM u WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT ngram, training_occurrences, production_occurrences FROM p JOIN s USING (ngram) ORDER BY production_occurrences DESC, ngram LIMIT 100""")
def drift_text_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return monitoring.drift_text(*(profile.ngram_counts(d.where(f"doc_id % 2 = {k}"), "text", (1,)) for k in (0, 1)), by="occurrence_count")


_PROFILE = """SELECT '{c}' AS column_name, 'number' AS kind, count(*) AS row_count, count({c}) AS valid_count, count(*) - count({c}) AS invalid_count, count(DISTINCT {c}) AS unique_count,
min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}) + 1e-7, 4) AS mean, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, CASE WHEN count(DISTINCT {c}) > 100 THEN 0 ELSE count(DISTINCT {c}) END AS n_items, NULL AS top FROM part"""
_NONE = "NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"


@query(_PROFILE.format(c="p_size") + " UNION ALL " + _PROFILE.format(c="p_retailprice") + f""" UNION ALL SELECT 'p_type', 'enum', count(*), count_if(p_type IN ('ECONOMY', 'SMALL')), count_if(p_type NOT IN ('ECONOMY', 'SMALL')), {_NONE}, count(DISTINCT p_type) FILTER (p_type IN ('ECONOMY', 'SMALL')),
(SELECT p_type || ' ' || count(*) FROM part WHERE p_type IN ('ECONOMY', 'SMALL') GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1) FROM part
UNION ALL SELECT 'p_name', 'text', count(*), count(*), 0, {_NONE}, (SELECT least(100, count(DISTINCT w)) FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part)),
(SELECT w || ' ' || count(DISTINCT p_partkey) FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY w ORDER BY count(DISTINCT p_partkey) DESC, w LIMIT 1) FROM part
UNION ALL SELECT 'p_brand', 'unknown', count(*), 0, count(*), {_NONE}, 0, NULL FROM part""")
def table_profile_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of columns of all kinds: counts, moments, quartiles, and values or n-grams with their counts."""
    from loomstat.schema import ColumnType, typed_load

    types = {"p_size": ColumnType("number"), "p_retailprice": ColumnType("number"), "p_type": ColumnType("enum", ("ECONOMY", "SMALL")), "p_name": ColumnType("text"), "p_brand": ColumnType("unknown")}
    raw = table(spark, sf_dir, "part")
    d = typed_load(raw, types)
    top = F.when(F.col("kind").isin("enum", "text"), F.concat(F.get("items", F.lit(0))["item"], F.lit(" "), F.get("items", F.lit(0))["n"].cast("string")))
    out = profile.table_profile(d, types, sizes=(1,))
    return out.select("column_name", "kind", "row_count", "valid_count", "invalid_count", "unique_count", "min", "max", off_tie("mean", 4), r("p25", 4), r("p50", 4), r("p75", 4), F.size("items").cast("long").alias("n_items"), top.alias("top"))
