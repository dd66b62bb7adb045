"""train --file x.csv --target y --output folder | predict --file x.csv --model folder --output folder; --file - is standard input"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.plans import train as t
from loomstat.schema import ColumnType
from loomstat.sources.tables import csv_from_lines, read_config, read_csv


def read(spark: SparkSession, file: str, types: dict[str, ColumnType]) -> DataFrame:
    return csv_from_lines(spark, sys.stdin.read().splitlines(), types) if file == "-" else read_csv(spark, file, types)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomstat", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    tr, pr = sub.add_parser("train"), sub.add_parser("predict")
    for s in (tr, pr):
        s.add_argument("--file", required=True)
        s.add_argument("--output", required=True)
    tr.add_argument("--target", required=True)
    tr.add_argument("--config")
    pr.add_argument("--model", required=True)
    pr.add_argument("--threshold", type=float, default=0.5)
    pr.add_argument("--probabilities", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "train":
        doc = read_config(spark, a.config) if a.config else {}
        model = t.train(read(spark, a.file, t.configured_types(doc)), a.target, t.Config.of(doc))
        t.save(spark, model, a.output)
        return
    model = t.load(spark, a.model)
    known = {}
    for g in model.groups:
        for c in filter(None, (g.column, g.other)):
            known[c] = ColumnType("enum", g.variants) if g.variants else ColumnType("text") if g.kind in ("bag_of_words", "bag_of_words_cosine", "word_embedding") else ColumnType("number")
    out = t.predict(read(spark, a.file, known), model, a.threshold)
    if model.task == "regression":
        out = out.select(F.col("prediction").alias(model.target))
    else:
        each = [F.col("prediction.probabilities")[c].alias(c) for c in model.classes] if a.probabilities else []
        out = out.select(F.col("prediction.class_name").alias(model.target), *each)
    out.write.csv(a.output, header=True)


if __name__ == "__main__":
    main()
