"""Mixing sources to target weights by Poisson replication.

A source of weight w and n rows gets the mean repetition rate  w * (rows wanted) / n.  Each
document draws its count by inverting the Poisson distribution with that mean at a uniform
number hashed from the seed and its id (its text where the id is null), so the draw is the same
wherever and whenever it runs.
Documents are exploded by their counts and dealt to partitions, and ordered there, by another hash:
a global shuffle without a sort of all rows.

Only DataFrame functions; the cumulative distribution of a source is an array whose length
follows its rate (up to 12 standard deviations above the mean, where it is 1 in doubles).  The
distributions are broadcast if they are ``MOST_NUMBERS`` numbers at most; beyond that they are joined
by source and salt, each source ``SALTS`` times, so that no task gets all rows of a hot source.

Defined results: a null source is a source of its own; sources that are not in `weights` get
weight 0; without `weights` all sources weigh the same; equal ids draw equal counts, and so do equal
texts without ids; null text is kept; texts of any length go along as they are; all columns are kept,
and where one already has the name of the copy's column, that gets underscores; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SEED, MOST_NUMBERS, SALTS = 20240, 1 << 20, 64


def uniform(seed: int, *keys: Column) -> Column:
    """Uniform in [0, 1) with 52 bits, from the MD5 of the seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def document_key() -> Column:
    """What a document's draw is hashed from: its id, or the digest of its text where it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))


def distributions(rated: DataFrame) -> DataFrame:
    """rated with cdf, P(count <= k) for k = 0, 1, ... of each row's rate, as an array of doubles.

    A window a source adds up ln k, and then the probabilities: work grows with the rate, not its square.
    """
    k = F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")))
    upto = Window.partitionBy("mix_source", "mix_null").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    terms = rated.withColumn("k", k).withColumn("log_factorial", F.sum(F.log(F.greatest(F.col("k"), F.lit(1)).cast("double"))).over(upto))
    summed = terms.withColumn("c", F.sum(F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("log_factorial"))).over(upto))
    return summed.groupBy("mix_source", "mix_null").agg(F.first("rate").alias("rate"), F.sort_array(F.collect_list("c")).alias("cdf"))


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many underscores behind as make it differ from all that are taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total_rows: int | None = None) -> DataFrame:
    """(mix_source, mix_null, rate) of each source of weight over 0."""
    n = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source"), F.col("source").isNull().alias("mix_null")).agg(F.count(F.lit(1)).alias("n"))
    spark = docs.sparkSession
    if weights is None:
        w = n.withColumn("w", F.lit(1.0))
    else:
        given = spark.createDataFrame([(k or "", k is None, float(v)) for k, v in weights.items() if v > 0], "mix_source string, mix_null boolean, w double")
        w = n.join(given, ["mix_source", "mix_null"])
    sums = w.agg(F.sum("w").alias("w_all")).crossJoin(n.agg(F.sum("n").alias("n_all")))  # one row
    wanted = F.lit(float(total_rows)) if total_rows is not None else F.col("n_all").cast("double")
    rate = F.col("w") / F.col("w_all") * wanted / F.col("n")
    return w.crossJoin(F.broadcast(sums)).select("mix_source", "mix_null", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total_rows: int | None = None, seed: int = SEED, copy: str = "copy", most_numbers: int = MOST_NUMBERS) -> DataFrame:
    """All columns of docs and the number of the copy (0, 1, ...) as `copy`, each document by its count, shuffled globally."""
    own = list(docs.columns)
    copy = free_name(copy, own)
    source, null, rate, cdf, salt, to, n = names = [free_name(f"mix_{x}", [*own, copy]) for x in ("source", "null", "rate", "cdf", "salt", "to", "n")]
    r = cut(distributions(rates(docs, weights, total_rows)).select(*(F.col(x).alias(y) for x, y in zip(("mix_source", "mix_null", "rate", "cdf"), names, strict=False))))
    match = (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col(source)) & (F.col("source").isNull() == F.col(null))
    if (r.agg(F.sum(F.size(cdf))).first()[0] or 0) <= most_numbers:
        joined = docs.join(F.broadcast(r), match)
    else:
        salted = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
        joined = salted.join(r.withColumn(to, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), match & (F.col(salt) == F.col(to)))
    u = uniform(seed, document_key())
    counted = joined.withColumn(n, F.size(F.filter(cdf, lambda c: c <= u))).where(F.col(n) > 0)
    copies = counted.select(*(F.col(f"`{c}`") for c in own), F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(copy))
    place = F.xxhash64(F.lit(seed), document_key(), F.col(f"`{copy}`"))
    return copies.repartition(place).sortWithinPartitions(place)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


OP10_SQL = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (1.0 / (SELECT count(*) FROM n)) * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM n),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 21)::BIGINT)) AS k FROM r),
p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
d AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
c AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.u, count(*) AS n FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND p.cdf <= d.u
      GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INTEGER AS copy FROM c
"""
