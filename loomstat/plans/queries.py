"""Named queries over the driver's tables, each with the DuckDB SQL that gives the same rows.

Queries only put tables and parameters into the operators.  Floats are rounded on both sides,
since sums run in different orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions import numbers, text
from loomstat.operators import binning, features, metrics, monitoring, profile, split
from loomstat.operators.ranks import value_counts
from loomstat.schema import ColumnType, infer_types, typed_load
from loomstat.sources import events as source
from loomstat.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def r(c: str | Column, places: int = 6, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, places)
    return out.alias(name or c) if name or isinstance(c, str) else out


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(r(f.name, places) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


def off_ties(df: DataFrame) -> DataFrame:
    """Rounded; variances of few values with two decimals often end in a 5 just past the places kept, so both sides step off it."""
    exact = df.select(*(F.round(F.col(c) + 1e-7, 4).alias(c) if c == "variance" else F.col(c) for c in df.columns))
    return rounded(exact)


# ---- types, profiles -------------------------------------------------------------------------

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_INFER = """SELECT '{c}' AS column_name, CASE WHEN count(v) = 0 THEN 'unknown' WHEN count(v) FILTER (v SIMILAR TO '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') = count(v)
  THEN 'number' WHEN count(DISTINCT v) <= 100 THEN 'enum' ELSE 'text' END AS ltype,
  CASE WHEN count(v) FILTER (NOT v SIMILAR TO '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') > 0 AND count(DISTINCT v) <= 100 THEN count(DISTINCT v) ELSE 0 END AS n_variants
  FROM (SELECT {c}::VARCHAR AS v FROM orders)"""


@query(" UNION ALL ".join(_INFER.format(c=c) for c in ORDER_COLUMNS))
def infer_types_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(*(F.col(c).cast("string").alias(c) for c in ORDER_COLUMNS))
    return spark.createDataFrame([(c, t.kind, len(t.variants)) for c, t in infer_types(o).items()], "column_name string, ltype string, n_variants long")


_DIRTY = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'n/a' WHEN event_id % 13 = 0 THEN 'inf' ELSE CAST(value AS {s}) END"
DIRTY, DIRTY_SQL = _DIRTY.format(s="STRING"), _DIRTY.format(s="VARCHAR")


@query(f"""SELECT event_id, round(CASE WHEN v SIMILAR TO '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?' THEN try_cast(v AS FLOAT) END::DOUBLE, 3) AS value
FROM (SELECT event_id, {DIRTY_SQL} AS v FROM events)""")
def typed_load_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.expr(DIRTY).alias("value"))
    t = typed_load(e.select(F.col("event_id").cast("string").alias("id"), "value"), {"id": ColumnType("text"), "value": ColumnType("number")})
    return t.select(F.col("id").cast("long").alias("event_id"), F.round(F.col("value").cast("double"), 3).alias("value"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS code FROM orders")
def typed_load_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", features.enum_code(F.col("o_orderstatus"), ["O", "F"]).alias("code"))


LINEITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_STATS = """SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS valid_count, count(*) - count({c}) AS invalid_count, round(min({c}), 4) AS min, round(max({c}), 4) AS max,
 round(avg({c}), 4) AS mean, round(var_pop({c}), 2) AS variance, round(stddev_pop({c}), 4) AS std, count(DISTINCT {c}) AS unique_count,
 round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75 FROM lineitem"""


@query(" UNION ALL ".join(_STATS.format(c=c) for c in LINEITEM_NUMBERS))
def number_stats_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = profile.number_stats(table(spark, sf_dir, "lineitem"), LINEITEM_NUMBERS)
    return rounded(s, 4).withColumn("variance", F.round("variance", 2))


@query("""SELECT 'value' AS column_name, 'number' AS kind, count(*) AS row_count, count(value) AS valid_count, count(*) - count(value) AS invalid_count FROM events UNION ALL
SELECT 'event_type', 'enum', count(*), count_if(event_type IN ('view', 'click')), count_if(event_type NOT IN ('view', 'click')) FROM events UNION ALL SELECT 'user_id', 'text', count(*), count(user_id), 0 FROM events UNION ALL SELECT 'ts', 'unknown', count(*), 0, count(*) FROM events""")
def table_stats_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("value", features.enum_code(F.col("event_type"), ["view", "click"]).alias("event_type"), F.col("user_id").cast("string").alias("user_id"), "ts")
    return profile.table_stats(e, {"value": ColumnType("number"), "event_type": ColumnType("enum", ("view", "click")), "user_id": ColumnType("text"), "ts": ColumnType("unknown")})


@query("SELECT 'l_quantity' AS column_name, l_quantity AS value, count(*) AS n FROM lineitem GROUP BY l_quantity")
def number_histogram_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.number_histogram(table(spark, sf_dir, "lineitem"), ["l_quantity"])


@query("""WITH h AS (SELECT 'l_discount' AS column_name, l_discount AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_extendedprice', l_extendedprice, count(*) FROM lineitem GROUP BY 2)
SELECT * FROM h WHERE column_name IN (SELECT column_name FROM h GROUP BY 1 HAVING count(*) <= 100)""")
def kept_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.kept_histogram(table(spark, sf_dir, "lineitem"), ["l_discount", "l_extendedprice"])


@query("SELECT v.variant, (SELECT count(*) FROM orders WHERE o_orderstatus = v.variant) AS n FROM (VALUES ('F'), ('O'), ('X')) v(variant) UNION ALL SELECT NULL, count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'X')")
def enum_histogram_orderstatus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.enum_histogram(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "X"])


@query("SELECT v.variant, (SELECT count(*) FROM events WHERE event_type = v.variant) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) v(variant) UNION ALL SELECT NULL, 0")
def enum_histogram_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.enum_histogram(table(spark, sf_dir, "events"), "event_type", ["click", "error", "purchase", "signup", "view"])


@query("SELECT 'l_quantity' AS column_name, l_quantity AS value, count(*) AS n FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY l_quantity")
def stats_merge_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of different parts of a table, merged: comparison rows (key % 10 = 0) belong to neither."""
    li = table(spark, sf_dir, "lineitem")
    parts = [profile.number_histogram(li.where(w), ["l_quantity"]) for w in ("l_orderkey % 10 between 1 and 7", "l_orderkey % 10 > 7")]
    return profile.merge_counts(parts, ["column_name", "value"], ["n"])


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value) + 1e-7, 4) AS variance FROM events GROUP BY event_type")
def mean_variance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = profile.moments(table(spark, sf_dir, "events").withColumn("part", F.col("user_id") % 5), ["event_type", "part"], "value")
    return off_ties(profile.merge_moments(states, ["event_type"]))


@query("SELECT event_type AS mode, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, mode DESC LIMIT 1")
def mode_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.mode(table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_type, count(*) AS n, count_if(value > 50) AS high, sum(count(*)) OVER ()::BIGINT AS every FROM events WHERE event_type <> 'error' GROUP BY event_type HAVING count(*) > 0")
def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    g = table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"))
    return g.withColumn("every", F.sum("n").over(Window.partitionBy(F.lit(1))))  # a row per type


# ---- text --------------------------------------------------------------------------------------

TOKENS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nl}\p{N}]+|[^\s\x{85}\p{Z}\p{L}\p{N}]')"
_GRAMS = f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS k FROM documents),
u AS (SELECT doc_id, unnest(k) AS ngram FROM t), b AS (SELECT doc_id, unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS ngram FROM t)"""


@query(f"SELECT doc_id, len({TOKENS_SQL})::BIGINT AS n_tokens, md5(array_to_string({TOKENS_SQL}, ' ')) AS tokens_md5 FROM documents")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens("text").alias("k"))
    return d.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.md5(F.array_join("k", " ").cast("binary")).alias("tokens_md5"))


@query(_GRAMS + "SELECT ngram, count(DISTINCT doc_id) AS row_count, count(*) AS occurrence_count FROM u GROUP BY ngram")
def unigram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.ngram_counts(table(spark, sf_dir, "documents"), "text", (1,))


@query(_GRAMS + "SELECT ngram, count(DISTINCT doc_id) AS row_count, count(*) AS occurrence_count FROM b GROUP BY ngram")
def bigram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.ngram_counts(table(spark, sf_dir, "documents"), "text", (2,))


@query(_GRAMS + """, g AS (SELECT ngram, count(DISTINCT doc_id) AS row_count, count(*) AS occurrence_count FROM (SELECT * FROM u UNION ALL SELECT * FROM b) GROUP BY ngram)
SELECT *, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + row_count)) + 1, 6) AS idf FROM g ORDER BY row_count DESC, ngram LIMIT 20000""")
def top_ngrams_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return rounded(profile.top_ngrams(profile.ngram_counts(d, "text"), d.count()))


# ---- features ----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - m) / s, 6) AS quantity, round((l_extendedprice - pm) / ps, 6) AS price FROM lineitem, (SELECT avg(l_quantity) m, stddev_pop(l_quantity) s, avg(l_extendedprice) pm, stddev_pop(l_extendedprice) ps FROM lineitem)")
def normalized_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    types = {c: ColumnType("number") for c in ("l_quantity", "l_extendedprice")}
    q, p = features.fit(li, [("normalized", c) for c in types], types)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", r(features.dense(q)[0], 6, "quantity"), r(features.dense(p)[0], 6, "price"))


@query("SELECT o_orderkey, (o_orderstatus NOT IN ('F', 'O'))::INT::DOUBLE AS invalid, (o_orderstatus = 'F')::INT::DOUBLE AS f, (o_orderstatus = 'O')::INT::DOUBLE AS o FROM orders")
def one_hot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = features.one_hot(features.enum_code(F.col("o_orderstatus"), ["F", "O"]), 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", x[0].alias("invalid"), x[1].alias("f"), x[2].alias("o"))


@query("SELECT o_orderkey, o_totalprice AS price, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 ELSE 0 END::DOUBLE AS status FROM orders")
def identity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("status", features.enum_code(F.col("o_orderstatus"), ["F", "O", "P"]))
    f = features.with_features(o, [features.Group("identity", "o_totalprice"), features.Group("identity", "status")])
    return f.select("o_orderkey", F.col("features")[0].alias("price"), F.col("features")[1].alias("status"))


_VOCABULARY = _GRAMS + """, g AS (SELECT ngram, count(DISTINCT doc_id) AS row_count FROM (SELECT * FROM u UNION ALL SELECT * FROM b) GROUP BY ngram),
v AS (SELECT ngram, ln((1 + (SELECT count(*) FROM documents)) / (1 + row_count)) + 1 AS idf FROM g ORDER BY row_count DESC, ngram LIMIT 20000),
w AS (SELECT doc_id AS row_id, ngram, count(*)::DOUBLE AS n, any_value(idf) AS idf FROM (SELECT * FROM u UNION ALL SELECT * FROM b) JOIN v USING (ngram) GROUP BY ALL)"""


def _words(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    v = profile.top_ngrams(profile.ngram_counts(d, "text"), d.count())
    return rounded(features.bag_of_words(d, "doc_id", "text", v, strategy))


@query(_VOCABULARY + "SELECT row_id, ngram, 1.0::DOUBLE AS value FROM w")
def bag_of_words_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, "present")


@query(_VOCABULARY + "SELECT row_id, ngram, n AS value FROM w")
def bag_of_words_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, "count")


@query(_VOCABULARY + "SELECT row_id, ngram, round(n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY row_id)), 6) AS value FROM w")
def bag_of_words_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, "tfidf")


_PAIR_SQL = rf"""WITH p AS (SELECT d.doc_id, d.text AS a, b.text AS b FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
ka AS (SELECT doc_id, {TOKENS_SQL.replace('text', 'a')} AS k FROM p), kb AS (SELECT doc_id, {TOKENS_SQL.replace('text', 'b')} AS k FROM p),
ua AS (SELECT doc_id, unnest(k || list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS ngram FROM ka),
ub AS (SELECT doc_id, unnest(k || list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS ngram FROM kb),
c AS (SELECT ngram, sum(r)::BIGINT AS row_count FROM (SELECT ngram, count(DISTINCT doc_id) AS r FROM ua GROUP BY 1 UNION ALL SELECT ngram, count(DISTINCT doc_id) FROM ub GROUP BY 1) GROUP BY 1),
v AS (SELECT ngram, ln((1 + 2 * (SELECT count(*) FROM p)) / (1 + row_count)) + 1 AS idf FROM c ORDER BY row_count DESC, ngram LIMIT 20000),
wa AS (SELECT doc_id, ngram, count(*) * any_value(idf) AS x FROM ua JOIN v USING (ngram) GROUP BY ALL), wb AS (SELECT doc_id, ngram, count(*) * any_value(idf) AS x FROM ub JOIN v USING (ngram) GROUP BY ALL),
na AS (SELECT doc_id, sqrt(sum(x * x)) AS l FROM wa GROUP BY 1), nb AS (SELECT doc_id, sqrt(sum(x * x)) AS l FROM wb GROUP BY 1),
s AS (SELECT wa.doc_id, sum(wa.x * wb.x) / (any_value(na.l) * any_value(nb.l)) AS similarity FROM wa JOIN wb USING (doc_id, ngram) JOIN na USING (doc_id) JOIN nb USING (doc_id) GROUP BY wa.doc_id)
SELECT p.doc_id AS row_id, round(coalesce(similarity, 0), 6) AS similarity FROM p LEFT JOIN s USING (doc_id)"""


@query(_PAIR_SQL)
def bow_cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document beside one item, all items in turn."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    p = d.join(b.select("item_id", F.col("text").alias("b")), F.col("item_id") == F.col("doc_id") % b.count()).select("doc_id", F.col("text").alias("a"), "b")
    groups = features.fit(p, [features.Group("bag_of_words_cosine", "a", other="b", strategy="tfidf")], {c: ColumnType("text") for c in "ab"})
    return features.with_features(p, groups).select(F.col("doc_id").alias("row_id"), r(F.col("features")[0], 6, "similarity"))


@query("SELECT label, i - 1 AS i, round(avg(embedding[i]::DOUBLE), 5) AS x FROM embeddings, range(1, 65) t(i) WHERE len(embedding) >= i GROUP BY ALL")
def embedding_mean_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.expr("transform(embedding, x -> cast(x as double))"))
    m = features.mean_vectors(e, ["label"], "v")
    return m.select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


# ---- metrics -----------------------------------------------------------------------------------


@query("SELECT count(*) AS n, round(avg(e * e), 2) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - avg(e * e) / var_pop(y), 6) AS r2 FROM (SELECT l_extendedprice AS y, l_extendedprice - 1500 * l_quantity AS e FROM lineitem)")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("guess", 1500 * F.col("l_quantity"))
    return metrics.regression_metrics(li, "guess", "l_extendedprice").select("n", r("mse", 2), r("rmse", 4), r("mae", 4), r("r2"))


@query("SELECT count(*) AS n, round(avg(e * e), 2) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae FROM (SELECT l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem WHERE l_orderkey % 5 > 0) AS e FROM lineitem WHERE l_orderkey % 5 = 0)")
def baseline_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    b = metrics.baseline(li.where("l_orderkey % 5 > 0"), li.where("l_orderkey % 5 = 0"), "l_extendedprice", "number")
    return b.select("n", r("mse", 2), r("rmse", 4), r("mae", 4))


@query("WITH g AS (SELECT event_type FROM events WHERE event_id % 5 > 0 GROUP BY 1 ORDER BY count(*) DESC, event_type DESC LIMIT 1) SELECT round(avg((event_type = (FROM g))::INT), 6) AS accuracy FROM events WHERE event_id % 5 = 0")
def baseline_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return metrics.baseline(e.where("event_id % 5 > 0"), e.where("event_id % 5 = 0"), "event_type", "enum").select(r("accuracy"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 2000)).alias("p"), (F.col("quality") == 1).alias("y"), F.col("toxic"))


_SCORED = "WITH s AS (SELECT doc_id, n_chars / (n_chars + 2000) AS p, quality = 1 AS y, toxic FROM labels JOIN documents USING (doc_id))"
_THRESHOLDS = _SCORED + """, c AS (SELECT i / 100 AS threshold, count_if(p >= i / 100 AND y) AS tp, count_if(p >= i / 100 AND NOT y) AS fp, count_if(p < i / 100 AND NOT y) AS tn, count_if(p < i / 100 AND y) AS fn FROM s, range(1, 100) t(i) GROUP BY i)"""


@query(_THRESHOLDS + "SELECT round(threshold, 6) AS threshold, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tp / nullif(tp + fn, 0), 6) AS tpr, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM c")
def binary_metrics_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.threshold_metrics(_scored(spark, sf_dir), "p", "y"))


@query(_THRESHOLDS + "SELECT round(threshold, 6) AS threshold, round(tp / nullif(tp + fn, 0), 6) AS tpr, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM c")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_points(metrics.threshold_metrics(_scored(spark, sf_dir), "p", "y")))


@query(_THRESHOLDS + "SELECT round(threshold, 6) AS threshold, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c")
def precision_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.precision_recall_points(metrics.threshold_metrics(_scored(spark, sf_dir), "p", "y")))


@query(_THRESHOLDS + """, x AS (SELECT threshold, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr FROM c UNION ALL SELECT 2, 0, 0 UNION ALL SELECT -1, 1, 1),
w AS (SELECT (lag(fpr) OVER o - fpr) * (lag(tpr) OVER o + tpr) / 2 AS a FROM x WINDOW o AS (ORDER BY threshold)) SELECT round(sum(a), 6) AS auc FROM w""")
def auc_roc_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc_from_thresholds(metrics.threshold_metrics(_scored(spark, sf_dir), "p", "y")))


@query(_SCORED + "SELECT round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END), 6) AS auc FROM s a JOIN s b ON a.y AND NOT b.y")
def auc_roc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc_exact(_scored(spark, sf_dir), "p", "y"))


@query(_SCORED + "SELECT round(avg(-CASE WHEN y THEN ln(greatest(p, 1.1920928955078125e-7)) ELSE ln(1 - least(p, 1 - 1.1920928955078125e-7)) END), 6) AS loss FROM s")
def binary_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a probability of 0 or 1 is kept a step away from it
    return _scored(spark, sf_dir).agg(r(metrics.binary_cross_entropy(F.col("p"), F.col("y")), 6, "loss"))


@query("SELECT round(avg(-ln(greatest([value / 200, (200 - value) / 400, (200 - value) / 400][1 + event_id % 3], 1.1920928955078125e-7))), 6) AS loss FROM events WHERE value BETWEEN 0 AND 200")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    p = F.array(v / 200, (200 - v) / 400, (200 - v) / 400)
    return table(spark, sf_dir, "events").where("value between 0 and 200").agg(r(metrics.cross_entropy(p, (F.col("event_id") % 3).cast("int")), 6, "loss"))


_GUESS = "CASE WHEN value > 60 THEN 'purchase' WHEN value > 30 THEN 'click' ELSE 'view' END"


@query(f"SELECT round(avg((event_type = {_GUESS})::INT), 6) AS accuracy FROM events")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(r(metrics.accuracy(F.expr(_GUESS), F.col("event_type")), 6, "accuracy"))


@query("SELECT round(avg((value - 50) * (value - 50)), 4) AS mse FROM events")
def mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.regression_metrics(table(spark, sf_dir, "events").withColumn("guess", F.lit(50.0)), "guess", "value")
    return m.select(r("mse", 4))


@query(f"SELECT {_GUESS} AS prediction, event_type AS label, count(*) AS n FROM events GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(table(spark, sf_dir, "events").withColumn("guess", F.expr(_GUESS)), "guess", "event_type")


_CLASSES = f"""WITH e AS (SELECT {_GUESS} AS p, event_type AS y FROM events), k AS (SELECT p AS class FROM e UNION SELECT y FROM e),
c AS (SELECT class, count_if(p = class AND y = class) AS tp, count_if(p = class AND y <> class) AS fp, count_if(p <> class AND y <> class) AS tn, count_if(p <> class AND y = class) AS fn FROM e, k GROUP BY class)"""


@query(_CLASSES + "SELECT class, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_metrics(confusion_matrix(spark, sf_dir)))


@query(_CLASSES + "SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 6) AS precision_unweighted, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 6) AS recall_unweighted, round(sum(coalesce(tp / nullif(tp + fp, 0), 0) * (tp + fn)) / sum(tp + fn), 6) AS precision_weighted, round(sum(coalesce(tp / nullif(tp + fn, 0), 0) * (tp + fn)) / sum(tp + fn), 6) AS recall_weighted FROM c")
def overall_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.overall_class_metrics(metrics.class_metrics(confusion_matrix(spark, sf_dir))))


# ---- splits, bins, gradients -------------------------------------------------------------------


@query("WITH n AS (SELECT count(*) AS n FROM lineitem) SELECT 'train' AS part, (n - floor(n * 0.2) - floor(n * 0.1))::BIGINT AS n FROM n UNION ALL SELECT 'comparison', floor(n * 0.1)::BIGINT FROM n UNION ALL SELECT 'test', floor(n * 0.2)::BIGINT FROM n")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split(table(spark, sf_dir, "lineitem")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def drop_invalid_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return split.drop_invalid_target(d, "quality").select("doc_id", "quality")


@query("SELECT 'l_quantity' AS column_name, (v + lead(v) OVER (ORDER BY v)) / 2 AS threshold FROM (SELECT DISTINCT l_quantity AS v FROM lineitem) QUALIFY threshold IS NOT NULL")
def bin_thresholds_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.bin_thresholds(profile.number_histogram(table(spark, sf_dir, "lineitem"), ["l_quantity"]), ["column_name"], "value")


@query(" UNION ".join(f"SELECT 'l_extendedprice' AS column_name, round(quantile_cont(l_extendedprice, {i / 16}), 4) AS threshold FROM lineitem" for i in range(1, 16)))
def bin_thresholds_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = binning.bin_thresholds(profile.number_histogram(table(spark, sf_dir, "lineitem"), ["l_extendedprice"]), ["column_name"], "value", 16)
    return t.select("column_name", r("threshold", 4)).distinct()


STEPS = [5.0, 10.0, 20.0, 40.0]


@query("SELECT l_orderkey, l_partkey, l_linenumber, 1 + (l_quantity > 5)::INT + (l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 40)::INT AS bin FROM lineitem")
def binned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", binning.bin_of(F.col("l_quantity"), STEPS).alias("bin"))


def _gradient_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id").where("quality is not null")
    g, h = binning.gradients("binary", F.col("n_chars") / 5000 - 1, F.col("quality").cast("double"))
    bins = F.array(binning.bin_of(F.col("n_chars").cast("double"), [500.0, 1000.0, 2000.0, 4000.0, 8000.0]), F.expr(_SOURCE_CODE))
    return d.select("doc_id", (F.col("doc_id") % 2).alias("node"), bins.alias("bins"), g.alias("g"), h.alias("h"))


_GRADIENTS = """WITH s AS (SELECT doc_id, doc_id % 2 AS node, n_chars, source, quality, 1 / (1 + exp(-(n_chars / 5000 - 1))) AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"""


@query(_GRADIENTS + "SELECT doc_id, round(p - quality, 6) AS g, round(p * (1 - p), 6) AS h FROM s")
def gradients_hessians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gradient_rows(spark, sf_dir).select("doc_id", r("g"), r("h"))


_SOURCE_CODE = "coalesce(1 + cast(substr(source, 4) AS int) % 5, 0)"
_BINS = _GRADIENTS + f""", b AS (SELECT node, 0 AS feature, 1 + (n_chars > 500)::INT + (n_chars > 1000)::INT + (n_chars > 2000)::INT + (n_chars > 4000)::INT + (n_chars > 8000)::INT AS bin, p - quality AS g, p * (1 - p) AS h FROM s
UNION ALL SELECT node, 1, {_SOURCE_CODE}, p - quality, p * (1 - p) FROM s),
q AS (SELECT node, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM b GROUP BY ALL)"""


@query(_BINS + "SELECT node, feature, bin, round(g, 5) AS g, round(h, 5) AS h, n FROM q")
def bin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(binning.bin_sums(_gradient_rows(spark, sf_dir), "node", "bins", "g", "h"), 5)


@query(_BINS + """, p AS (SELECT *, CASE feature WHEN 1 THEN g / (h + 10) ELSE bin END AS place, feature * 10.0 AS l2 FROM q),
c AS (SELECT node, feature, bin, l2, sum(g) OVER u AS lg, sum(h) OVER u AS lh, sum(n) OVER u AS ln, sum(g) OVER w AS tg, sum(h) OVER w AS th, sum(n) OVER w AS tn FROM p WINDOW w AS (PARTITION BY node, feature), u AS (PARTITION BY node, feature ORDER BY place, bin)),
x AS (SELECT *, lg * lg / (lh + l2) + (tg - lg) * (tg - lg) / nullif(th - lh + l2, 0) - tg * tg / (th + l2) AS gain FROM c WHERE least(ln, tn - ln) >= 20 AND least(lh, th - lh) >= 0.001)
SELECT node, feature, bin, CASE feature WHEN 1 THEN 'enum' ELSE 'number' END AS kind, round(gain, 5) AS gain, ln::BIGINT AS ln FROM x QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) = 1""")
def best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = binning.bin_sums(_gradient_rows(spark, sf_dir), "node", "bins", "g", "h")
    return binning.best_splits(binning.splits(s, [1])).select("node", "feature", "bin", "kind", r("gain", 5), "ln")


# ---- monitoring --------------------------------------------------------------------------------


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as predictions of three models."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_id"), F.col("ts").alias("date"), F.col("event_id").cast("string").alias("identifier"), "event_type", "value", F.expr(_GUESS).alias("prediction"))


_HOUR = "(epoch_us(ts) // 3600000000 * 3600)::BIGINT"


@query(f"SELECT 'm' || (user_id % 3) AS model_id, {_HOUR} AS hour, count(*) AS row_count, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(var_pop(value) + 1e-7, 4) AS variance FROM events GROUP BY 1, 2")
def hourly_production_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = monitoring.hourly_numbers(_predictions(spark, sf_dir), ["model_id"], "date", "value")
    return off_ties(monitoring.finished_numbers(h))


def _rollup(spark: SparkSession, sf_dir: str, start: str, end: str, unit: str, zone: str = "UTC") -> DataFrame:
    h = monitoring.hourly_numbers(_predictions(spark, sf_dir).where("model_id = 'm0'"), ["model_id"], "date", "value")
    out = monitoring.rolled_up(h, start, end, unit, zone)
    return out.select(F.date_format("interval_start", "yyyy-MM-dd HH:mm").alias("interval_start"), "row_count", "n", "min", "max", r("mean"), F.round(F.col("variance") + 1e-7, 4).alias("variance"))


_ROLLUP = """SELECT strftime(i, '%Y-%m-%d %H:%M') AS interval_start, count(ts) AS row_count, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(var_pop(value) + 1e-7, 4) AS variance
FROM range(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL 1 {unit}) r(i) LEFT JOIN (SELECT * FROM events WHERE user_id % 3 = 0) ON date_trunc('{unit}', ts) = i GROUP BY i"""


@query(_ROLLUP.format(start="2024-01-15 00:00:00", end="2024-01-16 00:00:00", unit="hour"))
def hourly_window_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, "2024-01-15 00:00:00", "2024-01-16 00:00:00", "hour")


@query(_ROLLUP.format(start="2024-01-01 00:00:00", end="2024-02-01 00:00:00", unit="day"))
def daily_window_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, "2024-01-01 00:00:00", "2024-02-01 00:00:00", "day")


@query(_ROLLUP.format(start="2024-01-01 00:00:00", end="2024-02-01 00:00:00", unit="day").replace("date_trunc('day', ts)", "date_trunc('day', ts + INTERVAL 9 HOUR)"))
def daily_window_tokyo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, "2024-01-01 00:00:00", "2024-02-01 00:00:00", "day", "Asia/Tokyo")


@query(_ROLLUP.format(start="2024-01-01 00:00:00", end="2025-01-01 00:00:00", unit="month"))
def monthly_window_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, "2024-01-01 00:00:00", "2025-01-01 00:00:00", "month")


@query("SELECT 'm' || (user_id % 3) AS model_id, count(*) AS row_count, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(var_pop(value) + 1e-7, 4) AS variance FROM events GROUP BY 1")
def overall_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = monitoring.hourly_numbers(_predictions(spark, sf_dir), ["model_id"], "date", "value")
    return off_ties(monitoring.overall(h, ["model_id"]))


_JSON = "CASE event_id % 8 WHEN 0 THEN '{}' WHEN 1 THEN '{\"x\": null}' WHEN 2 THEN '{\"x\": \"7.5\"}' WHEN 3 THEN '{\"x\": \"inf\"}' WHEN 4 THEN '{\"x\": true}' WHEN 5 THEN '{\"x\": [1]}' WHEN 6 THEN concat('{\"x\": \"', event_type, '\"}') ELSE concat('{\"x\": ', event_id, '}') END"


def _validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(_JSON).alias("input"))
    kind, value = source.json_kind(F.col("input"), "x"), source.json_text(F.col("input"), "x")
    kinds = {"number": None, "enum": ["view", "click", "true"], "text": None, "unknown": None}
    states = F.array(*(F.struct(F.lit(k).alias("column_kind"), monitoring.validity(kind, value, k, v).alias("validity")) for k, v in kinds.items()))
    return e.select(value.alias("value"), F.inline(states))


_VALIDITY_SQL = """WITH e AS (SELECT event_id % 8 AS k, event_type FROM events), v AS (
SELECT 'number' AS column_kind, k, event_type, CASE WHEN k < 2 THEN 'absent' WHEN k IN (2, 7) THEN 'valid' ELSE 'invalid' END AS s FROM e UNION ALL
SELECT 'enum', k, event_type, CASE WHEN k < 2 THEN 'absent' WHEN k = 4 OR k = 6 AND event_type IN ('view', 'click') THEN 'valid' ELSE 'invalid' END FROM e UNION ALL
SELECT 'text', k, event_type, CASE WHEN k < 2 THEN 'absent' WHEN k IN (2, 3, 6) THEN 'valid' ELSE 'invalid' END FROM e UNION ALL
SELECT 'unknown', k, event_type, CASE WHEN k < 2 THEN 'absent' ELSE 'invalid' END FROM e)"""
_COUNTS_SQL = _VALIDITY_SQL + ", c AS (SELECT column_kind, count(*) AS row_count, count_if(s = 'absent') AS absent_count, count_if(s = 'invalid') AS invalid_count, count_if(s = 'valid') AS valid_count FROM v GROUP BY 1)"


@query(_COUNTS_SQL + "SELECT * FROM c")
def absent_invalid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.validity_counts(_validity(spark, sf_dir), ["column_kind"])


@query("SELECT CASE k WHEN 2 THEN '7.5' WHEN 3 THEN 'inf' WHEN 6 THEN event_type END AS value, count(*) AS n FROM (SELECT event_id % 8 AS k, event_type FROM events) WHERE k IN (2, 3) OR k = 6 AND event_type NOT IN ('view', 'click') GROUP BY 1")
def invalid_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _validity(spark, sf_dir).where("column_kind = 'enum' and (value = 'inf' or value = '7.5' or value rlike '^[a-z]+$')")
    return monitoring.invalid_histogram(v, "value")


@query(_COUNTS_SQL + "SELECT column_kind, CASE WHEN absent_count > 0.1 * row_count AND invalid_count > 0.1 * row_count THEN 'High Absent and Invalid Count' WHEN invalid_count > 0.1 * row_count THEN 'High Invalid Count' WHEN absent_count > 0.1 * row_count THEN 'High Absent Count' END AS message FROM c")
def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = monitoring.validity_counts(_validity(spark, sf_dir), ["column_kind"])
    return c.select("column_kind", monitoring.alert_message(F.col("absent_count"), F.col("invalid_count"), F.col("row_count")).alias("message"))


@query(_GRAMS + """, g AS (SELECT ngram, count(DISTINCT doc_id) AS n FROM u WHERE doc_id % 2 = 0 GROUP BY 1 ORDER BY n DESC, ngram LIMIT 20000)
SELECT CASE WHEN g.ngram IS NOT NULL THEN u.ngram END AS ngram, CASE WHEN any_value(g.ngram) IS NOT NULL THEN count(DISTINCT doc_id) END AS rows, count(*) AS n FROM u LEFT JOIN g ON g.ngram = u.ngram WHERE doc_id % 2 = 1 GROUP BY 1""")
def tracked_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    seen = d.where("doc_id % 2 = 0")
    v = profile.top_ngrams(profile.ngram_counts(seen, "text", (1,)), 1)
    return monitoring.tracked_ngrams(d.where("doc_id % 2 = 1"), "text", v, (1,))


_HALF = "2024-01-16 00:00:00"


_DRIFT = ", ".join(f"{f} FILTER (ts {op} '{_HALF}'), 4) AS {side}_{name}" for side, op in (("training", "<"), ("production", ">=")) for name, f in (
    ("min", "round(min(value)"), ("max", "round(max(value)"), ("mean", "round(avg(value)"), ("std", "round(stddev_pop(value)"), ("p25", "round(quantile_cont(value, 0.25)"), ("p50", "round(quantile_cont(value, 0.5)"), ("p75", "round(quantile_cont(value, 0.75)")))


@query(f"SELECT {_DRIFT} FROM events")
def drift_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    half = F.expr(f"timestamp_ntz'{_HALF}'")
    return rounded(monitoring.drift_numbers(e.where(F.col("ts") < half), e.where(F.col("ts") >= half), "value"), 4)


@query(f"""WITH t AS (SELECT event_type AS variant, count(*) AS n FROM events WHERE ts < '{_HALF}' GROUP BY 1), p AS (SELECT event_type AS variant, count(*) AS n FROM events WHERE ts >= '{_HALF}' GROUP BY 1)
SELECT t.variant, t.n AS training_count, round(t.n / (SELECT sum(n) FROM t), 6) AS training_fraction, coalesce(p.n, 0) AS production_count, round(coalesce(p.n, 0) / (SELECT sum(n) FROM p), 6) AS production_fraction FROM t LEFT JOIN p USING (variant)""")
def drift_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    half = F.expr(f"timestamp_ntz'{_HALF}'")
    return rounded(monitoring.drift_enum(e.where(F.col("ts") < half), e.where(F.col("ts") >= half), "event_type"))


@query(_GRAMS + """, s AS (SELECT ngram, count(DISTINCT doc_id) AS training_rows FROM u WHERE doc_id % 2 = 0 GROUP BY 1), p AS (SELECT ngram, count(DISTINCT doc_id) AS production_rows FROM u WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT ngram, training_rows, production_rows FROM p JOIN s USING (ngram) ORDER BY production_rows DESC, ngram LIMIT 100""")
def drift_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return monitoring.drift_text(*(profile.ngram_counts(d.where(f"doc_id % 2 = {k}"), "text", (1,)) for k in (0, 1)))


def _true_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir).where("cast(identifier as long) % 2 = 0")
    return p.select("model_id", "identifier", F.col("event_type").alias("true_value"))


_JOINED = f"WITH j AS (SELECT 'm' || (user_id % 3) AS model_id, event_id::VARCHAR AS identifier, {_HOUR} AS hour, {_GUESS} AS prediction, event_type AS true_value FROM events WHERE event_id % 2 = 0)"


@query(_JOINED + "SELECT * FROM j")
def true_value_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = monitoring.matched_true_values(_predictions(spark, sf_dir), _true_values(spark, sf_dir))
    return m.select("model_id", "identifier", "hour", "prediction", "true_value")


@query("SELECT 'm' || (user_id % 3) AS model_id, (event_id // 3)::VARCHAR AS identifier, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 3, event_id // 3 ORDER BY ts, event_id) > 1")
def duplicate_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_id"), F.floor(F.col("event_id") / 3).cast("string").alias("identifier"), "ts", "event_id")
    return monitoring.distinct_events(p, ["model_id", "identifier"], ["ts", "event_id"])[1].select("model_id", "identifier", "event_id")


@query("SELECT event_id::VARCHAR AS identifier FROM events WHERE event_id % 2 = 1")
def predictions_without_true_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.unmatched_true_values(_true_values(spark, sf_dir), _predictions(spark, sf_dir)).select("identifier")


_BINARY = _JOINED + """, c AS (SELECT model_id, hour, count_if(prediction = 'view' AND true_value = 'view') AS tp, count_if(prediction = 'view' AND true_value <> 'view') AS fp, count_if(prediction <> 'view' AND true_value <> 'view') AS tn, count_if(prediction <> 'view' AND true_value = 'view') AS fn FROM j GROUP BY ALL)"""


@query(_BINARY + "SELECT model_id, hour, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def production_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitoring.binary_production(true_value_join(spark, sf_dir), ["model_id", "hour"], "view"))


@query(_JOINED + """, e AS (SELECT * FROM j WHERE true_value IN ('view', 'click', 'purchase')), c AS (SELECT class, count_if(prediction = class AND true_value = class) AS tp, count_if(prediction = class AND true_value <> class) AS fp, count_if(prediction <> class AND true_value <> class) AS tn, count_if(prediction <> class AND true_value = class) AS fn FROM e, (VALUES ('view'), ('click'), ('purchase')) k(class) GROUP BY class)
SELECT class, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM e GROUP BY true_value)), 6) AS baseline_accuracy FROM c""")
def production_multiclass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitoring.multiclass_production(true_value_join(spark, sf_dir), ["view", "click", "purchase"]))


@query("SELECT 'm' || (user_id % 3) AS model_id, count(*) AS n, round(avg(pow(value - 50, 2)), 4) AS mse, round(sqrt(avg(pow(value - 50, 2))), 4) AS rmse, round(avg(abs(value - 50)), 4) AS mae, round(1 - avg(pow(value - 50, 2)) / var_pop(value), 6) AS r2, round(var_pop(value), 4) AS baseline_mse FROM events GROUP BY 1")
def production_regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir).select("model_id", F.lit(50.0).alias("prediction"), F.col("value").alias("true_value"))
    m = monitoring.regression_production(p, ["model_id"])
    return m.select("model_id", "n", r("mse", 4), r("rmse", 4), r("mae", 4), r("r2"), r("baseline_mse", 4))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.latest(monitoring.binary_production(true_value_join(spark, sf_dir), ["model_id", "hour"], "view"), ["model_id"], "accuracy")


_LATEST = _BINARY + ", l AS (SELECT model_id, arg_max((tp + tn) / (tp + fp + tn + fn), hour) AS accuracy, max(hour) AS hour, count(*) AS hours FROM c GROUP BY 1)"


@query(_LATEST + "SELECT model_id, round(accuracy, 6) AS accuracy, hour, hours FROM l")
def latest_hour_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_latest(spark, sf_dir))


MONITORS = [(f"{mode[0]}{i}", f"m{i}", mode, lo, hi) for mode, lo, hi in (("absolute", 0.1, 0.1), ("percentage", 20.0, None)) for i in range(3)]


def _checked(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    m = spark.createDataFrame(MONITORS, "monitor_id string, model_id string, mode string, lower double, upper double").where(F.col("mode") == mode)
    trained = spark.createDataFrame([(f"m{i}", 0.55) for i in range(3)], "model_id string, training_metric double")
    now = _latest(spark, sf_dir).withColumnRenamed("accuracy", "metric")
    return rounded(monitoring.check_monitors(m, now, trained, 10).select("monitor_id", "model_id", "metric", "difference", "alert"))


@query(_LATEST + "SELECT 'a' || model_id[2:] AS monitor_id, model_id, round(accuracy, 6) AS metric, round(accuracy - 0.55, 6) AS difference, abs(accuracy - 0.55) > 0.1 AS alert FROM l WHERE hours >= 10")
def monitor_check_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, "absolute")


@query(_LATEST + "SELECT 'p' || model_id[2:] AS monitor_id, model_id, round(accuracy, 6) AS metric, round((accuracy - 0.55) / 0.55 * 100, 6) AS difference, (accuracy - 0.55) / 0.55 * 100 < -20 AS alert FROM l WHERE hours >= 10")
def monitor_check_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, "percentage")


_CADENCES = [("hourly", "2024-01-30 23:30:00"), ("daily", "2024-01-30 00:00:00"), ("weekly", "2024-01-25 00:00:00"), ("monthly", "2023-12-31 00:00:00"), ("monthly", None)]


@query("SELECT v.monitor_id FROM (VALUES (0, TIMESTAMP '2024-01-30 23:30:00' + INTERVAL 1 HOUR), (1, TIMESTAMP '2024-01-30' + INTERVAL 1 DAY), (2, TIMESTAMP '2024-01-25' + INTERVAL 7 DAY), (3, TIMESTAMP '2023-12-31' + INTERVAL 1 MONTH), (4, TIMESTAMP '1970-01-01')) v(monitor_id, due) WHERE v.due <= TIMESTAMP '2024-01-31 00:00:00'")
def monitors_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(_CADENCES)], "monitor_id int, cadence string, last string").withColumn("last_checked", F.col("last").cast("timestamp_ntz"))
    return monitoring.overdue(m, "2024-01-31 00:00:00").select("monitor_id")


@query(_LATEST + "SELECT 'a' || model_id[2:] AS alert_id, m.method, 'unsent' AS status, 0 AS attempt_count FROM l, (VALUES ('stdout'), ('webhook')) m(method) WHERE hours >= 10 AND abs(accuracy - 0.55) > 0.1")
def alerts_to_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _checked(spark, sf_dir, "absolute").where("alert").select(F.col("monitor_id").alias("alert_id"), F.array(F.lit("stdout"), F.lit("webhook")).alias("methods"))
    return monitoring.alert_sends(a)


@query("SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def predictions_page_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.page(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE ts > '2024-01-15 12:00:00' ORDER BY ts, event_id LIMIT 10")
def predictions_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.page(table(spark, sf_dir, "events"), "ts", "event_id", after="2024-01-15 12:00:00").select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE ts < '2024-01-15 12:00:00' ORDER BY ts DESC, event_id DESC LIMIT 10")
def predictions_page_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.page(table(spark, sf_dir, "events"), "ts", "event_id", before="2024-01-15 12:00:00").select("event_id", "value")


@query(_JOINED + """, m AS (SELECT model_id, avg((prediction = true_value)::INT) AS accuracy, count_if(prediction = 'view') / count(*) AS positive FROM j GROUP BY 1)
SELECT model_id, k AS metric, t AS training, round(CASE k WHEN 'accuracy' THEN accuracy ELSE positive END, 6) AS production, round(CASE k WHEN 'accuracy' THEN accuracy ELSE positive END - t, 6) AS difference FROM m, (VALUES ('accuracy', 0.5::DOUBLE), ('positive', 0.3::DOUBLE)) v(k, t)""")
def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = true_value_join(spark, sf_dir)
    now = j.groupBy("model_id").agg(metrics.accuracy(F.col("prediction"), F.col("true_value")).alias("accuracy"), F.avg((F.col("prediction") == "view").cast("double")).alias("positive"))
    trained = spark.createDataFrame([(f"m{i}", 0.5, 0.3) for i in range(3)], "model_id string, accuracy double, positive double")
    return rounded(monitoring.metrics_report(now, trained, ["accuracy", "positive"]))


@query(f"""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, {_GUESS} AS p FROM events), k AS (SELECT * FROM e WHERE p IN ('view', 'click'))
SELECT day, class, count_if(p = class) AS n, round(count_if(p = class) / count(*), 6) AS fraction FROM k, (VALUES ('view'), ('click'), ('never')) c(class) GROUP BY ALL""")
def prediction_shares_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir).withColumn("day", F.date_format("date", "yyyy-MM-dd"))
    return rounded(monitoring.class_shares(p, ["day"], ["view", "click", "never"]))


@query("SELECT round(avg(value), 4) AS value, (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1) AS event_type FROM events")
def playground_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monitoring.defaults(table(spark, sf_dir, "events"), ["value"], ["event_type"]), 4)


@query("SELECT EXISTS (SELECT 1 FROM events WHERE ts > '2024-01-20') AS newer, EXISTS (SELECT 1 FROM events WHERE ts < '2023-01-01') AS older")
def predictions_page_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.existing(table(spark, sf_dir, "events"), "ts", "event_id", "2023-01-01", "2024-01-20")


@query(_BINARY + """, d AS (SELECT date_trunc('day', epoch_ms(hour * 1000)) AS interval_start, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM c GROUP BY 1),
k AS (SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-11', INTERVAL 1 DAY)) AS interval_start), z AS (SELECT interval_start, coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp, coalesce(tn, 0)::BIGINT AS tn, coalesce(fn, 0)::BIGINT AS fn FROM k LEFT JOIN d USING (interval_start))
SELECT *, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM z""")
def production_metrics_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = monitoring.binary_production(true_value_join(spark, sf_dir), ["model_id", "hour"], "view")
    return rounded(monitoring.rolled_up_metrics(hourly, "2024-01-01 00:00:00", "2024-02-11 00:00:00", "day"))


@query("SELECT 'm' || (user_id % 3) AS model_id, k / 4 AS at, round(quantile_cont(value, k / 4), 4) AS quantile FROM events, (VALUES (1), (2), (3)) q(k) GROUP BY 1, k".replace("quantile_cont(value, k / 4)", "CASE k WHEN 1 THEN quantile_cont(value, 0.25) WHEN 2 THEN quantile_cont(value, 0.5) ELSE quantile_cont(value, 0.75) END"))
def production_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of all hours, from hourly states."""
    return rounded(monitoring.merged_quantiles(monitoring.hourly_value_counts(_predictions(spark, sf_dir), ["model_id"], "date", "value"), ["model_id"]), 4)


@query(f"SELECT 'm' || (user_id % 3) AS model_id, 'value' AS column_name, {_HOUR} AS hour, count(*) AS row_count, count_if(event_id % 7 = 0) AS absent_count, count_if(event_id % 7 > 0 AND event_id % 11 = 0) AS invalid_count, count_if(event_id % 7 > 0 AND event_id % 11 > 0) AS valid_count, round(sum(value) FILTER (event_id % 7 > 0 AND event_id % 11 > 0), 4) AS sum FROM events GROUP BY ALL")
def hourly_column_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _predictions(spark, sf_dir).withColumn("id", F.col("identifier").cast("long"))
    state = F.when(F.col("id") % 7 == 0, "absent").when(F.col("id") % 11 == 0, "invalid").otherwise("valid")
    h = monitoring.hourly_columns(e.select("model_id", "date", F.lit("value").alias("column_name"), state.alias("validity"), F.col("value").cast("string").alias("value")), ["model_id"], "date")
    return h.select("model_id", "column_name", "hour", "row_count", "absent_count", "invalid_count", "valid_count", r("sum", 4))


_HALVES = "SELECT event_id % 2 AS half, count(*) AS n, count_if(event_id % 7 = 0) AS a, count_if(event_id % 7 > 0 AND event_id % 11 = 0) AS i FROM events GROUP BY 1"


@query(f"WITH h AS ({_HALVES}) SELECT 'value' AS column_name, t.n AS training_count, t.a AS training_absent_count, round(t.a / t.n, 6) AS training_absent_fraction, t.i AS training_invalid_count, round(t.i / t.n, 6) AS training_invalid_fraction, p.n AS production_count, p.a AS production_absent_count, round(p.a / p.n, 6) AS production_absent_fraction, p.i AS production_invalid_count, round(p.i / p.n, 6) AS production_invalid_fraction FROM h t, h p WHERE t.half = 0 AND p.half = 1")
def drift_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events as training, odd ones as production."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 2).alias("half"), F.lit("value").alias("column_name"), F.when(F.col("event_id") % 7 == 0, "absent").when(F.col("event_id") % 11 == 0, "invalid").otherwise("valid").alias("validity"))
    t, p = (monitoring.validity_counts(e.where(F.col("half") == k), ["column_name"]) for k in (0, 1))
    return rounded(monitoring.drift_invalid(t, p))


_BY_HALF = f"""WITH e AS (SELECT event_id % 2 AS half, {_GUESS} AS p, event_type AS y FROM events), k AS (SELECT half, p AS class FROM e UNION SELECT half, y FROM e),
c AS (SELECT k.half, class, count_if(p = class AND y = class) AS tp, count_if(p = class AND y <> class) AS fp, count_if(p <> class AND y = class) AS fn FROM e JOIN k ON e.half = k.half GROUP BY ALL),
m AS (SELECT half, class, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c)"""


@query(_BY_HALF + "SELECT coalesce(t.class, q.class) AS class, " + ", ".join(f"round(t.{n}, 6) AS training_{n}, round(q.{n}, 6) AS production_{n}, round(q.{n} - t.{n}, 6) AS difference_{n}" for n in ("precision", "recall", "f1")) + " FROM (SELECT * FROM m WHERE half = 0) t FULL JOIN (SELECT * FROM m WHERE half = 1) q ON t.class = q.class")
def drift_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("guess", F.expr(_GUESS))
    t, p = (metrics.class_metrics(metrics.confusion(e.where(F.col("event_id") % 2 == k), "guess", "event_type")) for k in (0, 1))
    return rounded(monitoring.drift_classes(t, p))


@query("SELECT event_id AS alert_id, user_id % 9 AS monitor_id, 'm' || (user_id % 3) AS model_id, CASE WHEN user_id % 9 < 3 THEN 'daily' ELSE 'weekly' END AS cadence, value FROM events WHERE event_type = 'error' AND user_id % 3 = 1")
def alerts_of_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as alerts of nine monitors of three models."""
    m = spark.range(9).select(F.col("id").alias("monitor_id"), F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model_id"), F.when(F.col("id") < 3, "daily").otherwise("weekly").alias("cadence"))
    a = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("alert_id"), (F.col("user_id") % 9).alias("monitor_id"), "value")
    return monitoring.alert_history(m, a, "m1").select("alert_id", "monitor_id", "model_id", "cadence", "value")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'held' END AS status FROM orders")
def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders held (but for every sixth), and new rows of every third."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    held, new = o.where("o_orderkey % 6 <> 0").withColumn("status", F.lit("held")), o.where("o_orderkey % 3 = 0").withColumn("status", F.lit("new"))
    return monitoring.upsert(held, new, ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'new' ELSE 'held' END AS status FROM orders")
def insert_missing_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    held, new = o.where("o_orderkey % 6 <> 0").withColumn("status", F.lit("held")), o.where("o_orderkey % 3 = 0").withColumn("status", F.lit("new"))
    return monitoring.upsert(held, new, ["o_orderkey"], update=False)


_SENDS = "SELECT event_id AS alert_id, 'webhook' AS method, CASE WHEN event_id % 5 = 0 THEN 'sending' WHEN event_id % 7 = 0 THEN 'sent' ELSE 'unsent' END AS status, (event_id % 12)::INT AS attempt_count, CASE WHEN event_id % 12 > 0 THEN ts END AS last_attempt FROM events"
_SENDS_NOW = "2024-01-15 12:00:00"


def _sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i.alias("alert_id"), F.lit("webhook").alias("method"), F.when(i % 5 == 0, "sending").when(i % 7 == 0, "sent").otherwise("unsent").alias("status"), (i % 12).cast("int").alias("attempt_count"), F.when(i % 12 > 0, F.col("ts").cast("timestamp_ntz")).alias("last_attempt"))


@query(f"""WITH s AS ({_SENDS}) SELECT alert_id, attempt_count FROM s WHERE attempt_count < 10 AND (status = 'unsent' AND (last_attempt IS NULL OR last_attempt + to_seconds((60 * pow(2, attempt_count - 1))::INT) <= TIMESTAMP '{_SENDS_NOW}')
OR status = 'sending' AND last_attempt + INTERVAL 10 SECOND < TIMESTAMP '{_SENDS_NOW}')""")
def alert_sends_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.sends_due(_sends(spark, sf_dir), _SENDS_NOW).select("alert_id", "attempt_count")


@query(f"""WITH s AS ({_SENDS}) SELECT alert_id, CASE WHEN alert_id % 4 > 1 THEN status WHEN alert_id % 4 = 0 THEN 'sent' WHEN attempt_count + 1 >= 10 THEN 'failed' ELSE 'unsent' END AS status, attempt_count + (alert_id % 4 < 2)::INT AS attempt_count FROM s""")
def alert_sends_after_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sends(spark, sf_dir)
    outcomes = s.where("alert_id % 4 < 2").select("alert_id", "method", (F.col("alert_id") % 4 == 0).alias("ok"))
    return monitoring.after_attempts(s, outcomes, _SENDS_NOW).select("alert_id", "status", "attempt_count")


# ---- joins -------------------------------------------------------------------------------------


@query("SELECT c_custkey, n_name, r_name, count(o_orderkey) AS n_orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY ALL")
def owners_with_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner joins and a left join with a further condition, as repositories, their owners and models have."""
    c, n, g = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey")).join(done, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("c_custkey", "n_name", "r_name", F.coalesce("k", F.lit(0)).alias("n_orders"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def members_with_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


# ---- models ------------------------------------------------------------------------------------

WEIGHTS, BIAS, MEANS = [2.0, -30.0, 400.0], 10.0, [25.0, 0.05, 0.04]
_FIXED = "10 + 2 * l_quantity - 30 * l_discount + 400 * l_tax"


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, round({_FIXED}, 6) AS value, round(1 / (1 + exp(-({_FIXED}) / 50)), 6) AS probability FROM lineitem")
def linear_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = numbers.dot(F.array("l_quantity", "l_discount", "l_tax"), WEIGHTS) + BIAS
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", r(s, 6, "value"), r(numbers.sigmoid(s / 50), 6, "probability"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, round(2 * (l_quantity - 25), 6) AS quantity, round(30 * (0.05 - l_discount), 6) AS discount, round(400 * (l_tax - 0.04), 6) AS tax FROM lineitem")
def linear_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstat.operators.linear import LinearModel

    c = LinearModel("regression", [WEIGHTS], [BIAS], MEANS).contributions(F.array("l_quantity", "l_discount", "l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", *(r(c[i], 6, n) for i, n in enumerate(("quantity", "discount", "tax"))))


def _labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null").select("vec_id", F.expr("transform(embedding, x -> cast(x as double))").alias("features"), (F.col("label") < 5).cast("int").alias("label"))


@query()
def linear_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, probability) of logistic regression on embeddings."""
    from loomstat.operators.linear import train_linear

    d = _labelled_vectors(spark, sf_dir)
    m = train_linear(d, "features", "label", "binary", epochs=10)
    return d.select("vec_id", "label", m.output(F.col("features")).alias("probability"))


def _trees(spark: SparkSession, sf_dir: str):
    from loomstat.operators.trees import TreeOptions, train_trees

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_extendedprice").alias("y"), F.array(F.col("l_quantity"), F.col("l_discount"), features.enum_code(F.col("l_returnflag"), ["A", "N", "R"]).cast("double")).alias("features"))
    return li, train_trees(li, "features", "y", "regression", enums=[2], options=TreeOptions(rounds=3, max_leaves=8))


@query()
def tree_train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keys, y, value) of boosted trees of price by quantity, discount and return flag."""
    from loomstat.operators.trees import with_scores

    li, m = _trees(spark, sf_dir)
    return with_scores(li, m, "features").select("l_orderkey", "l_partkey", "l_linenumber", "y", F.col("score")[0].alias("value"))


_STUMP = """WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount, l_extendedprice - avg(l_extendedprice) OVER () AS e, avg(l_extendedprice) OVER () AS bias FROM lineitem),
v AS (SELECT 0 AS f, l_quantity AS x, sum(e) AS s, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 1, l_discount, sum(e), count(*) FROM t GROUP BY 2),
c AS (SELECT f, x, lead(x) OVER (PARTITION BY f ORDER BY x) AS y, sum(s) OVER u AS ls, sum(n) OVER u AS ln, sum(s) OVER (PARTITION BY f) AS s, sum(n) OVER (PARTITION BY f) AS n FROM v WINDOW u AS (PARTITION BY f ORDER BY x)),
b AS (SELECT f, (x + y) / 2 AS cut_at, 0.1 * ls / ln AS low, 0.1 * (s - ls) / (n - ln) AS high, ln / n AS share FROM c WHERE least(ln, n - ln) >= 20 ORDER BY ls * ls / ln + (s - ls) * (s - ls) / (n - ln) DESC, f, x LIMIT 1),
p AS (SELECT t.*, b.*, CASE WHEN (CASE f WHEN 0 THEN l_quantity ELSE l_discount END) <= cut_at THEN low ELSE high END AS leaf, share * low + (1 - share) * high AS mean FROM t, b)
SELECT l_orderkey, l_partkey, l_linenumber, round(bias + leaf, 4) AS value, round(CASE f WHEN 0 THEN leaf - mean ELSE 0 END, 4) AS quantity, round(CASE f WHEN 1 THEN leaf - mean ELSE 0 END, 4) AS discount, round(bias + mean, 4) AS baseline FROM p"""


@query(_STUMP)
def tree_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and contributions of one tree of one split, which SQL can find by itself."""
    from loomstat.operators.trees import TreeOptions, train_trees, with_contributions, with_scores

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_extendedprice").alias("y"), F.array("l_quantity", "l_discount").alias("features"))
    m = train_trees(li, "features", "y", "regression", options=TreeOptions(rounds=1, max_leaves=2))
    d = with_contributions(with_scores(li, m, "features"), m, "features")
    c = F.col("contributions")
    return d.select("l_orderkey", "l_partkey", "l_linenumber", r(F.col("score")[0], 4, "value"), r(c[0] + 0.0, 4, "quantity"), r(c[1] + 0.0, 4, "discount"), r("baseline", 4))


def _level(name: str, source: str) -> str:
    """The best split of each node of a table (node, l_quantity, l_discount, e), as CTE {name}."""
    return f"""{name}v AS (SELECT node, 0 AS f, l_quantity AS x, sum(e) AS s, count(*) AS n FROM {source} GROUP BY ALL UNION ALL SELECT node, 1, l_discount, sum(e), count(*) FROM {source} GROUP BY ALL),
{name}c AS (SELECT node, f, x, sum(s) OVER u AS ls, sum(n) OVER u AS ln, sum(s) OVER (PARTITION BY node, f) AS s, sum(n) OVER (PARTITION BY node, f) AS n FROM {name}v WINDOW u AS (PARTITION BY node, f ORDER BY x)),
{name} AS (SELECT *, ls * ls / ln + (s - ls) * (s - ls) / (n - ln) - s * s / n AS gain FROM {name}c WHERE least(ln, n - ln) >= 20 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, x) = 1)"""


def _round(k: int, source: str) -> str:
    """One tree of three leaves on the table `source`, whose residuals and scores it moves: CTE r{k}."""
    keys, goes = "l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount", "(CASE f WHEN 0 THEN l_quantity ELSE l_discount END) <= x"
    return f"""a{k} AS (SELECT {keys}, e, score, 0 AS node FROM {source}),
{_level(f"s{k}", f"a{k}")},
b{k} AS (SELECT {keys}, e, score, CASE WHEN {goes} THEN 1 ELSE 2 END AS node FROM a{k}, (SELECT f, x FROM s{k})),
{_level(f"t{k}", f"b{k}")},
c{k} AS (SELECT {keys}, e, score, CASE WHEN node <> wide THEN node WHEN {goes} THEN 3 ELSE 4 END AS leaf FROM b{k}, (SELECT node AS wide, f, x FROM t{k} ORDER BY gain DESC LIMIT 1)),
r{k} AS (SELECT {keys}, e - 0.1 * avg(e) OVER w AS e, score + 0.1 * avg(e) OVER w AS score FROM c{k} WINDOW w AS (PARTITION BY leaf))"""


@query(f"""WITH r0 AS MATERIALIZED (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount, l_extendedprice - avg(l_extendedprice) OVER () AS e, avg(l_extendedprice) OVER () AS score FROM lineitem),
{_round(1, "r0")}, {_round(2, "r1")} SELECT l_orderkey, l_partkey, l_linenumber, round(score, 3) AS value FROM r2""")
def tree_two_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of two boosted trees grown best first to three leaves, which SQL can find by itself."""
    from loomstat.operators.trees import TreeOptions, train_trees, with_scores

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_extendedprice").alias("y"), F.array("l_quantity", "l_discount").alias("features"))
    m = train_trees(li, "features", "y", "regression", options=TreeOptions(rounds=2, max_leaves=3))
    return with_scores(li, m, "features").select("l_orderkey", "l_partkey", "l_linenumber", r(F.col("score")[0], 3, "value"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, true AS adds_up FROM lineitem")
def tree_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the contributions of all features and the baseline add up to the value of each row."""
    from loomstat.operators.trees import with_contributions, with_scores

    li, m = _trees(spark, sf_dir)
    d = with_contributions(with_scores(li, m, "features"), m, "features")
    sum_ = F.aggregate("contributions", F.col("baseline"), lambda a, b: a + b)
    return d.select("l_orderkey", "l_partkey", "l_linenumber", (F.abs(sum_ - F.col("score")[0]) < 1e-6 * (1 + F.abs(F.col("score")[0]))).alias("adds_up"))


@query(f"SELECT 'm' || (user_id % 3) AS model_id, {_HOUR} AS hour, count(*) AS n, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def streaming_hourly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table replayed as a stream of files through foreachBatch."""
    import uuid

    from loomstat.sources.tables import shared_folder
    from loomstat.streaming import track

    folder = f"{shared_folder(spark)}/track-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    e = e.select(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_id"), F.col("event_id").cast("string").alias("identifier"), F.col("ts").alias("date"), "value")
    track.start(e, folder).awaitTermination()
    return track.hourly(spark, folder).select("model_id", "hour", "n", r("sum", 4), "min", "max")


@query(_JOINED + "SELECT model_id, hour, prediction, true_value AS label, count(*) AS n FROM j GROUP BY ALL")
def streaming_true_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table replayed as a stream of predictions, and of true values of every second one."""
    import uuid

    from loomstat.sources.tables import shared_folder
    from loomstat.streaming import track

    folder = f"{shared_folder(spark)}/track-{uuid.uuid4().hex}"
    e = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    none = lambda kind: F.lit(None).cast(kind)
    common = [F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_id"), F.col("event_id").cast("string").alias("identifier"), F.col("ts").cast("timestamp_ntz").alias("date"), none("string").alias("input"), F.lit("multiclass").alias("output_kind"), none("double").alias("value")]
    rest = [none("double").alias("probability"), none("map<string,double>").alias("probabilities")]
    p = e.select(F.lit("prediction").alias("kind"), *common, F.expr(_GUESS).alias("class_name"), *rest, none("string").alias("true_value"), none("string").alias("line"))
    t = e.where("event_id % 2 = 0").select(F.lit("true_value").alias("kind"), *common, none("string").alias("class_name"), *rest, F.col("event_type").alias("true_value"), none("string").alias("line"))
    track.track_events(p.unionByName(t), folder).awaitTermination()
    return track.hourly_counts(spark, folder, "confusion").select("model_id", "hour", "prediction", "label", "n")
