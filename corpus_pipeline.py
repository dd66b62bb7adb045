"""The corpus pipeline: quality, toxicity, near duplicates, source mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a runner writes it as Parquet and
reads it again as the next stage's docs.  All stages but the last return the columns of docs.

Defined results: null text is judged as empty text and stays null; rows without an id are kept or
dropped like others and told apart by their text; empty docs give empty docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import jaccard_join, piece_codec, quality_rank, source_mix, toxicity
from loomstat.llm.common import cut, ensure_checkpoint_dir, table, texts_of

SCORE = "__llm_score"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.5 stay."""
    ranker = quality_rank.train(texts_of(docs), table(spark, sf_dir, "labels"))
    return quality_rank.score_texts(docs, ranker, docs.columns, SCORE).where(F.col(SCORE) >= 0.5).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.7 go."""
    model = toxicity.train(texts_of(docs), table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model, docs.columns, SCORE).where(F.col(SCORE) < 0.7).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    classes = cut(jaccard_join.jaccard_classes(texts_of(docs)))
    rows = classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("__first"))
    stay = cut(rows.where("__first").select(F.col("doc_id").alias("__id"), "__rows"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    out = docs.join(stay.where("__rows = 1"), same, "left_semi")
    if stay.where("__rows > 1").isEmpty():
        return out
    # an id on several rows: rows of equal text are one document
    return out.unionByName(docs.join(stay.where("__rows > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal parts, documents repeated or left out by their Poisson counts."""
    return source_mix.mix_sources(docs, copy="__llm_copy").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_sha256): token ids with the end id, and the digest of their decoding."""
    import public_tokenizers

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    e = piece_codec.encode_texts(d, public_tokenizers.path("piece_bpe_32k.model"), decoded=False)
    return e.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_sha256")


STAGES = [("quality", quality), ("toxicity", clean), ("near_duplicates", one_of_each), ("source_mix", mix), ("encode", encode)]

#: Trained classifiers and an exact tokenizer can't be put as SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
