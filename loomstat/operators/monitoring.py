"""Production monitoring: states per model and hour, their roll-ups, true values, drift, and monitors.

States per hour are mergeable columns, so that hours add up to days, months and years.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.numbers import difference, hour_start, parse_float
from loomstat.operators.metrics import class_metrics, confusion, rates, regression_sums
from loomstat.operators.profile import ngram_counts
from loomstat.operators.ranks import quantiles, value_counts

ABSENT_WARNING = INVALID_WARNING = 0.1
MIN_HOURS = 100


def validity(kind: Column, text: Column, column_kind: str, variants: list[str] | None = None) -> Column:
    """absent, invalid or valid: a value of a JSON input against its column's type.

    kind: as json_kind gives it.  Numbers may come as strings that spell finite ones; enums as strings or
    booleans; text as strings; a column of unknown type has no valid value.
    """
    if column_kind == "number":
        good = (kind == "number") | ((kind == "string") & parse_float(text).isNotNull())
    elif column_kind == "enum":
        good = kind.isin("string", "boolean") & text.isin(*(variants or []))
    elif column_kind == "text":
        good = kind == "string"
    else:
        good = F.lit(False)
    return F.when(kind.isNull() | (kind == "absent"), "absent").when(good, "valid").otherwise("invalid")


def validity_counts(df: DataFrame, by: list[str], state: str = "validity") -> DataFrame:
    each = (F.count_if(F.col(state) == k).alias(f"{k}_count") for k in ("absent", "invalid", "valid"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), *each)


def invalid_histogram(df: DataFrame, value: str, state: str = "validity") -> DataFrame:
    return df.where(F.col(state) == "invalid").groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def alert_message(absent: Column, invalid: Column, rows: Column) -> Column:
    """What to warn of when more than a tenth of a column's values are absent or invalid."""
    a, i = F.try_divide(absent, rows) > ABSENT_WARNING, F.try_divide(invalid, rows) > INVALID_WARNING
    return F.when(a & i, "High Absent and Invalid Count").when(i, "High Invalid Count").when(a, "High Absent Count")


def number_state(value: Column) -> list[Column]:
    """The mergeable state of a number column; m2: squared distances from the mean, added up."""
    v = value.cast("double")
    return [F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), (F.var_pop(v) * F.count(v)).alias("m2")]


def hourly_numbers(df: DataFrame, by: list[str], date: str, value: str) -> DataFrame:
    return df.groupBy(*by, hour_start(F.col(date)).alias("hour")).agg(F.count(F.lit(1)).alias("row_count"), *number_state(F.col(value)))


def merge_states(states: DataFrame, by: list[str], *others: Column) -> DataFrame:
    """Number states merged, beside other aggregates of the same groups.

    The parts' squared distances are carried from their own means to the mean of all, which is joined first, so a
    variance is as exact far from 0 as near it.
    """
    keys = [f"__by{i}" for i in range(len(by))]
    mean = states.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True))).agg(F.try_divide(F.sum("sum"), F.sum("n")).alias("__mean"))
    if by:
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)))
        states = states.join(mean, same)
    else:
        states = states.crossJoin(F.broadcast(mean))  # one row
    own = F.try_divide("sum", "n")
    return states.groupBy(*by).agg(
        *(F.sum(c).alias(c) for c in ("row_count", "n")), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"),
        F.sum(F.col("m2") + F.col("n") * F.pow(own - F.col("__mean"), 2)).alias("m2"), *others,
    )


def merge_numbers(states: DataFrame, by: list[str]) -> DataFrame:
    return merge_states(states, by)


def finished_numbers(states: DataFrame) -> DataFrame:
    """mean and population variance from the state."""
    return states.withColumn("mean", F.try_divide("sum", "n")).withColumn("variance", F.try_divide("m2", "n")).drop("sum", "m2")


def local_time(hour: Column, zone: str) -> Column:
    """The wall-clock time in a zone of epoch seconds."""
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("SECOND", hour, utc))


def interval_start(hour: Column, unit: str, zone: str = "UTC") -> Column:
    """Start of the local hour, day or month, as a time stamp without zone."""
    t = local_time(hour, zone)
    if unit == "hour":
        return F.timestamp_add("HOUR", F.hour(t), t.cast("date").cast("timestamp_ntz"))
    day = t.cast("date")
    return (F.trunc(day, "month") if unit == "month" else day).cast("timestamp_ntz")


WINDOWS = {"today": "hour", "this_month": "day", "this_year": "month"}


def calendar(df: DataFrame, start: str, end: str, unit: str) -> DataFrame:
    """(interval_start) of every interval from start up to, not including, end."""
    step = {"hour": "interval 1 hour", "day": "interval 1 day", "month": "interval 1 month"}[unit]
    q = f"explode(sequence(timestamp_ntz'{start}', timestamp_ntz'{end}' - {step}, {step})) as interval_start"
    return df.sparkSession.range(1).select(F.expr(q))


def rolled_up(states: DataFrame, start: str, end: str, unit: str, zone: str = "UTC") -> DataFrame:
    """Hourly states merged per interval of a window; intervals without events are there, with count 0."""
    i = interval_start(F.col("hour"), unit, zone)
    s = states.withColumn("interval_start", i).where(F.col("interval_start").between(F.expr(f"timestamp_ntz'{start}'"), F.expr(f"timestamp_ntz'{end}' - interval 1 second")))
    merged = merge_numbers(s, ["interval_start"])
    out = F.broadcast(calendar(states, start, end, unit)).join(merged, "interval_start", "left")
    return finished_numbers(out.na.fill(0, ["row_count", "n"]))


def rolled_up_metrics(hourly: DataFrame, start: str, end: str, unit: str, zone: str = "UTC") -> DataFrame:
    """Hourly confusion counts (hour, tp, fp, tn, fn) added up per interval of a window, with rates; intervals without any are there."""
    s = hourly.withColumn("interval_start", interval_start(F.col("hour"), unit, zone))
    merged = s.groupBy("interval_start").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")))
    out = F.broadcast(calendar(hourly, start, end, unit)).join(merged, "interval_start", "left").na.fill(0, ["tp", "fp", "tn", "fn"])
    return out.select("*", *rates()[:4])


def levels(states: DataFrame, start: str, end: str, unit: str, zone: str = "UTC") -> DataFrame:
    """Hourly states of a window, each under its interval and under null, the whole window: what is grouped by
    interval_start then has both levels from one pass."""
    s = states.withColumn("interval_start", interval_start(F.col("hour"), unit, zone))
    s = s.where(F.col("interval_start").between(F.expr(f"timestamp_ntz'{start}'"), F.expr(f"timestamp_ntz'{end}' - interval 1 second")))
    return s.withColumn("interval_start", F.explode(F.array("interval_start", F.lit(None).cast("timestamp_ntz"))))


def number_levels(states: DataFrame, training: DataFrame, start: str, end: str, unit: str, zone: str = "UTC") -> DataFrame:
    """Moments of predicted numbers in each interval and (under null) in the whole window, beside the one row of training."""
    merged = merge_states(levels(states, start, end, unit, zone), ["interval_start"])
    every = calendar(states, start, end, unit).unionByName(states.sparkSession.range(1).select(F.lit(None).cast("timestamp_ntz").alias("interval_start")))
    out = every.alias("e").join(merged.alias("m"), F.expr("e.interval_start <=> m.interval_start"), "left").select("e.interval_start", *(F.col(f"m.{c}") for c in ("row_count", "n", "min", "max", "sum", "m2")))
    return finished_numbers(out.na.fill(0, ["row_count", "n"])).crossJoin(F.broadcast(training))  # one row


def class_levels(hourly: DataFrame, training: DataFrame, start: str, end: str, unit: str, zone: str = "UTC") -> DataFrame:
    """(interval_start, class, n, fraction, training_n, training_fraction) of hourly counts (hour, class, n) beside training
    counts (class, n): classes of training, in each interval and (under null) in the whole window."""
    merged = levels(hourly, start, end, unit, zone).join(F.broadcast(training.select("class")), "class").groupBy("interval_start", "class").agg(F.sum("n").alias("n"))
    share = lambda n, by: F.try_divide(n, F.sum(n).over(Window.partitionBy(*by)))  # noqa: E731  (a row a class)
    t = training.select("class", F.col("n").alias("training_n")).withColumn("training_fraction", share(F.col("training_n"), []))
    every = calendar(hourly, start, end, unit).unionByName(hourly.sparkSession.range(1).select(F.lit(None).cast("timestamp_ntz").alias("interval_start")))
    grid = every.crossJoin(F.broadcast(t))  # intervals of a window by classes
    out = grid.alias("g").join(merged.alias("m"), F.expr("g.interval_start <=> m.interval_start and g.class = m.class"), "left")
    out = out.select("g.interval_start", "g.class", F.coalesce("m.n", F.lit(0)).alias("n"), "training_n", "training_fraction")
    return out.withColumn("fraction", share(F.col("n"), ["interval_start"]))


def hourly_value_counts(df: DataFrame, by: list[str], date: str, value: str) -> DataFrame:
    """(by, hour, value, n): a state of a number column whose merged quantiles are exact."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, hour_start(F.col(date)).alias("hour"), v.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merged_quantiles(states: DataFrame, by: list[str], at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(by, at, quantile) of hourly value counts merged."""
    return quantiles(states.groupBy(*by, "value").agg(F.sum("n").alias("n")), by, "value", at)


def hourly_columns(df: DataFrame, by: list[str], date: str) -> DataFrame:
    """One mergeable state per column and hour of (by, date, column_name, validity, value): counts by validity, and number sums of what is valid."""
    v = F.when(F.col("validity") == "valid", F.col("value").try_cast("double"))
    each = (F.count_if(F.col("validity") == k).alias(f"{k}_count") for k in ("absent", "invalid", "valid"))
    return df.groupBy(*by, "column_name", hour_start(F.col(date)).alias("hour")).agg(F.count(F.lit(1)).alias("row_count"), *each, *number_state(v))


def overall(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    return finished_numbers(merge_numbers(states, by or []))


def distinct_events(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first event of each key, the others): later events of a key are rejected."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    r = df.withColumn("__n", n)
    return r.where("__n = 1").drop("__n"), r.where("__n > 1").drop("__n")


def matched_true_values(predictions: DataFrame, true_values: DataFrame) -> DataFrame:
    """(model_id, identifier, hour, prediction, true_value): each true value in the hour of its prediction."""
    p = predictions.select("model_id", "identifier", hour_start(F.col("date")).alias("hour"), "prediction")
    return p.join(true_values.select("model_id", "identifier", "true_value"), ["model_id", "identifier"])


def unmatched_true_values(predictions: DataFrame, true_values: DataFrame) -> DataFrame:
    return true_values.join(predictions, ["model_id", "identifier"], "left_anti")


def binary_production(df: DataFrame, by: list[str], positive: str) -> DataFrame:
    """Confusion counts and rates of pairs of class names; rows with null in either are skipped."""
    p, t = F.col("prediction") == positive, F.col("true_value") == positive
    c = df.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & ~t).alias("tn"), F.count_if(~p & t).alias("fn"))
    return c.where("tp + fp + tn + fn > 0").select("*", *rates()[:4])


def multiclass_production(df: DataFrame, classes: list[str]) -> DataFrame:
    """Class metrics of pairs of known classes, with the share of the largest class as baseline_accuracy."""
    c = confusion(df.where(F.col("prediction").isin(*classes) & F.col("true_value").isin(*classes)), "prediction", "true_value")
    per = class_metrics(c)
    base = c.groupBy("label").agg(F.sum("n").alias("k")).agg(F.try_divide(F.max("k"), F.sum("k")).alias("baseline_accuracy"))
    return per.crossJoin(F.broadcast(base))


def regression_production(df: DataFrame, by: list[str]) -> DataFrame:
    """Regression metrics; baseline_mse is the variance of the labels."""
    p, t = F.col("prediction").cast("double"), F.col("true_value").cast("double")
    return df.groupBy(*by).agg(*regression_sums(p, t), F.var_pop(F.when(p.isNotNull(), t)).alias("baseline_mse"))


def drift_numbers(training: DataFrame, production: DataFrame, value: str) -> DataFrame:
    """One row: moments and exact quartiles of a column in training and in production."""

    def side(df, name):
        v = F.col(value).cast("double")
        counts = value_counts(df.select(v.alias("value")).where("not isnan(value)"), [], "value")
        q = quantiles(counts, [], "value", (0.25, 0.5, 0.75)).agg(*(F.max(F.when(F.col("at") == k, F.col("quantile"))).alias(f"{name}_p{round(100 * k)}") for k in (0.25, 0.5, 0.75)))
        return df.agg(F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"), F.avg(v).alias(f"{name}_mean"), F.stddev_pop(v).alias(f"{name}_std")).crossJoin(F.broadcast(q))  # one row each

    return side(training, "training").crossJoin(F.broadcast(side(production, "production")))


def drift_invalid(training: DataFrame, production: DataFrame) -> DataFrame:
    """(column_name, absent and invalid counts and shares in training and production) of validity counts."""

    def side(df, name):
        each = (x for k in ("absent", "invalid") for x in (F.col(f"{k}_count").alias(f"{name}_{k}_count"), F.try_divide(f"{k}_count", "row_count").alias(f"{name}_{k}_fraction")))
        return df.select("column_name", F.col("row_count").alias(f"{name}_count"), *each)

    return side(training, "training").join(side(production, "production"), "column_name", "left").na.fill(0)


def drift_classes(training: DataFrame, production: DataFrame, names: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """(class, each metric in training and production, and their difference) of class metrics; classes of either."""
    t, q = (df.select("class", *(F.col(n).alias(f"{side}_{n}") for n in names)) for df, side in ((training, "training"), (production, "production")))
    return t.join(q, "class", "full").select("*", *((F.col(f"production_{n}") - F.col(f"training_{n}")).alias(f"difference_{n}") for n in names))


def drift_enum(training: DataFrame, production: DataFrame, column: str) -> DataFrame:
    """(variant, counts and fractions in training and production) of the variants seen in training."""

    def side(df, name):
        c = df.groupBy(F.col(column).alias("variant")).agg(F.count(F.lit(1)).alias(f"{name}_count"))
        every = df.agg(F.count(F.lit(1)).alias("every"))
        return c.crossJoin(F.broadcast(every)).select("variant", f"{name}_count", F.try_divide(f"{name}_count", "every").alias(f"{name}_fraction"))

    return side(training, "training").join(side(production, "production"), "variant", "left").na.fill(0)


def drift_text(training: DataFrame, production: DataFrame, most: int = 100, by: str = "row_count") -> DataFrame:
    """(ngram, training_rows, production_rows) of the n-grams most frequent in production; both are n-gram counts.

    by: "occurrence_count" takes and orders by how often n-grams occur (training_occurrences, production_occurrences).
    """
    what = {"row_count": "rows", "occurrence_count": "occurrences"}[by]
    p = production.select("ngram", F.col(by).alias(f"production_{what}"))
    t = training.select("ngram", F.col(by).alias(f"training_{what}"))
    return p.join(t, "ngram", "inner").orderBy(F.desc(f"production_{what}"), "ngram").limit(most).select("ngram", f"training_{what}", f"production_{what}")


def tracked_ngrams(df: DataFrame, text: str, vocabulary: DataFrame, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(ngram, rows, n): rows that hold each of the vocabulary's n-grams and their occurrences, and under null those of all others."""
    counts = ngram_counts(df, text, sizes)
    known = vocabulary.select("ngram", F.lit(True).alias("known"))
    by = F.when(F.col("known"), F.col("ngram")).alias("ngram")
    return counts.join(known, "ngram", "left").groupBy(by).agg(F.sum(F.when(F.col("known"), F.col("row_count"))).alias("rows"), F.sum("occurrence_count").alias("n"))


def latest(metrics: DataFrame, by: list[str], metric: str, hour: str = "hour") -> DataFrame:
    return metrics.groupBy(*by).agg(F.max_by(metric, hour).alias(metric), F.max(hour).alias(hour), F.count(F.lit(1)).alias("hours"))


def check_monitors(monitors: DataFrame, current: DataFrame, training: DataFrame, min_hours: int = MIN_HOURS) -> DataFrame:
    """Monitors whose metric differs from training's beyond a bound.

    monitors (monitor_id, model_id, mode, lower, upper), current (model_id, metric, hours), training
    (model_id, training_metric); bounds may be null.  A model needs `min_hours` hours of metrics.  Monitors with a
    metric_name watch the metrics of that name in the other two tables (see named_metrics).
    """
    by = ["model_id", *(["metric_name"] if "metric_name" in monitors.columns else [])]
    j = monitors.join(current.where(F.col("hours") >= min_hours), by).join(training, by)
    diff = F.when(F.col("mode") == "absolute", difference(F.col("metric"), F.col("training_metric"), "absolute")).otherwise(difference(F.col("metric"), F.col("training_metric"), "percentage"))
    j = j.withColumn("difference", diff)
    high, low = F.coalesce(F.col("difference") > F.col("upper"), F.lit(False)), F.coalesce(F.col("difference") < -F.col("lower"), F.lit(False))
    return j.withColumn("alert", high | low)


def named_metrics(df: DataFrame, by: list[str], names: list[str], value: str = "metric") -> DataFrame:
    """(by, metric_name, value): a row for each of the metrics that df has as columns."""
    return df.select(*by, F.inline(F.array(*(F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("double").alias(value)) for n in names))))


def next_check(last: Column, cadence: Column) -> Column:
    """When a monitor is due again: an hour, day, week or month after its last check."""
    return (
        F.when(cadence == "hourly", F.timestamp_add("HOUR", F.lit(1), last)).when(cadence == "daily", F.timestamp_add("DAY", F.lit(1), last))
        .when(cadence == "weekly", F.timestamp_add("WEEK", F.lit(1), last)).otherwise(F.timestamp_add("MONTH", F.lit(1), last))
    )


def overdue(monitors: DataFrame, now: str) -> DataFrame:
    """Monitors never checked or due at `now`."""
    return monitors.where(F.col("last_checked").isNull() | (F.expr(f"timestamp_ntz'{now}'") >= next_check(F.col("last_checked"), F.col("cadence"))))


def new_monitors(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Monitors that no held one equals in model, cadence, metric, mode and bounds."""
    same = " and ".join(f"a.{c} <=> h.{c}" for c in ("model_id", "cadence", "metric", "mode", "lower", "upper"))
    return asked.alias("a").join(held.alias("h"), F.expr(same), "left_anti")


def alert_sends(alerts: DataFrame) -> DataFrame:
    """A row per alert and method, to be sent."""
    return alerts.select("alert_id", F.explode("methods").alias("method"), F.lit("unsent").alias("status"), F.lit(0).alias("attempt_count"))


#: Attempts before a send is given up, seconds before the second one (doubled each time), and of a heartbeat.
MOST_ATTEMPTS, FIRST_WAIT, HEARTBEAT = 10, 60, 10


def sends_due(sends: DataFrame, now: str) -> DataFrame:
    """Rows of sends (attempt_count, status, last_attempt, ...) to be tried at `now`: unsent ones whose wait of
    FIRST_WAIT * 2^(attempts - 1) seconds is over, and those left `sending` for more than a heartbeat."""
    at = F.expr(f"timestamp_ntz'{now}'")
    after = lambda seconds: F.timestamp_add("SECOND", F.coalesce(seconds, F.lit(0)).cast("int"), F.col("last_attempt"))
    waited = F.col("last_attempt").isNull() | (after(FIRST_WAIT * F.pow(F.lit(2.0), F.col("attempt_count") - 1)) <= at)
    stale = (F.col("status") == "sending") & (after(F.lit(HEARTBEAT)) < at)
    return sends.where((F.col("attempt_count") < MOST_ATTEMPTS) & ((F.col("status") == "unsent") & waited | stale))


def after_attempts(sends: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """sends after the attempts of outcomes (alert_id, method, ok): sent, unsent again, or failed after MOST_ATTEMPTS."""
    j = sends.join(outcomes.select("alert_id", "method", "ok"), ["alert_id", "method"], "left")
    tried, n = F.col("ok").isNotNull(), F.col("attempt_count") + F.col("ok").isNotNull().cast("int")
    status = F.when(~tried, F.col("status")).when(F.col("ok"), "sent").when(n >= MOST_ATTEMPTS, "failed").otherwise("unsent")
    return j.select(*(c for c in sends.columns if c not in ("status", "attempt_count", "last_attempt")), status.alias("status"), n.alias("attempt_count"), F.when(tried, F.expr(f"timestamp_ntz'{now}'")).otherwise(F.col("last_attempt")).alias("last_attempt"))


def alert_history(monitors: DataFrame, alerts: DataFrame, model_id: str | None = None) -> DataFrame:
    """Alerts beside their monitors, of one model or of all."""
    m = monitors if model_id is None else monitors.where(F.col("model_id") == model_id)
    return alerts.join(m, "monitor_id")


def upsert(held: DataFrame, new: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """held with the rows of new; where both have a key, new's row (update) or held's stays."""
    keep, add = (held.join(new.select(*keys).distinct(), keys, "left_anti"), new) if update else (held, new.join(held.select(*keys).distinct(), keys, "left_anti"))
    return keep.unionByName(add)


def page(df: DataFrame, date: str, key: str, size: int = 10, before: str | None = None, after: str | None = None) -> DataFrame:
    """The newest rows, or the newest before a time, or the next after one; newest first."""
    if after is not None:
        d = df.where(F.col(date) > F.expr(f"timestamp_ntz'{after}'")).orderBy(F.asc(date), F.asc(key)).limit(size)
        return d.orderBy(F.desc(date), F.desc(key))
    d = df if before is None else df.where(F.col(date) < F.expr(f"timestamp_ntz'{before}'"))
    return d.orderBy(F.desc(date), F.desc(key)).limit(size)



def metrics_report(production: DataFrame, training: DataFrame, names: list[str]) -> DataFrame:
    """(model_id, metric, training, production, difference) of metrics held in columns of both tables."""

    def long(df, side):
        return df.select("model_id", F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(side)) for n in names))))

    j = long(training, "training").join(long(production, "production"), ["model_id", "metric"], "left")
    return j.withColumn("difference", F.col("production") - F.col("training"))


def class_shares(df: DataFrame, by: list[str], classes: list[str]) -> DataFrame:
    """(by, class, n, fraction) of predicted classes; classes that aren't known count for nothing, those not seen are 0."""
    known = df.where(F.col("prediction").isin(*classes))
    counts = known.groupBy(*by).agg(*(F.count_if(F.col("prediction") == c).alias(f"n{i}") for i, c in enumerate(classes)), F.count(F.lit(1)).alias("every"))
    each = F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"n{i}").alias("n")) for i, c in enumerate(classes)))
    return counts.select(*by, "every", F.inline(each)).select(*by, "class", "n", F.try_divide("n", "every").alias("fraction"))


def defaults(df: DataFrame, numbers: list[str], enums: list[str]) -> DataFrame:
    """One row of typical values to begin a form with: means of numbers, most frequent values of enums."""
    means = df.agg(*(F.avg(n).alias(n) for n in numbers)) if numbers else df.sparkSession.range(1).select()
    for e in enums:
        counts = df.where(F.col(e).isNotNull()).groupBy(e).agg(F.count(F.lit(1)).alias("n"))
        means = means.crossJoin(F.broadcast(counts.agg(F.max_by(e, F.struct("n", e)).alias(e))))  # one row each
    return means


def existing(df: DataFrame, date: str, key: str, first: str, last: str) -> DataFrame:
    """(newer, older): whether there are rows beyond the times a page shows."""
    beyond = lambda op, at, name: df.where(F.expr(f"{date} {op} timestamp_ntz'{at}'")).select(key).limit(1).agg((F.count(F.lit(1)) > 0).alias(name))
    return beyond(">", last, "newer").crossJoin(beyond("<", first, "older"))
