"""Quality rules as a short-circuit cascade.

Each rule rejects texts from a few counts.  Two base rules run on all texts, as their counts are
reported.  The cost (seconds a text) and selectivity (share rejected) of the others are measured on a
bounded sample of texts that pass the base rules; they then run in order of rejection per cost, each
only on texts that none before it rejected.  A text is kept when no rule rejects it, so the order
changes the work and never the verdict.

Defined results: null or empty texts have no words and are rejected by ``few_words``; a value equal to
a limit passes; equal rows are judged each; a text of any length is counted whole, by the task that
holds its row; columns besides doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, slices, table, texts_of
from .text_stats import Texts


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


def few_words(t: Texts) -> np.ndarray:
    return t.n_words < 50


def repeated_words(t: Texts) -> np.ndarray:
    return 100 * t.n_repeat_words > 50 * t.n_words


def many_symbols(t: Texts) -> np.ndarray:
    return 100 * t.n_symbols > 30 * t.n_words


def repeated_lines(t: Texts) -> np.ndarray:
    return 100 * t.n_dup_lines > 50 * t.n_lines


def word_length(t: Texts) -> np.ndarray:
    return (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words)


def few_letter_words(t: Texts) -> np.ndarray:
    return 100 * t.n_letter_words < 70 * t.n_words


def mostly_digits(t: Texts) -> np.ndarray:
    return 100 * t.n_digits > 30 * t.word_chars


#: The base rules come first whatever they cost: their counts are part of the result.
BASE = (few_words, repeated_words)
RULES = tuple(Rule(f.__name__, f) for f in (many_symbols, repeated_lines, word_length, few_letter_words, mostly_digits))


def base_failed(t: Texts) -> np.ndarray:
    return np.logical_or.reduce([f(t) for f in BASE])


def plan_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1024) -> list[str]:
    """Names of the rules by rejection per cost, measured on about `sample_rows` texts chosen by hash.

    Texts are measured where they lie and only sums of seconds and rejections come back.  The sample is
    of texts that pass the base rules, as the cascade is given only those.  Rules share counts, so a
    rule costs what it takes on texts of which nothing but the base counts is known yet.
    """
    share = sample_rows / max(docs.count(), 1)
    some = docs.where((F.xxhash64("doc_id", "text").bitwiseAND((1 << 31) - 1)) < F.lit(share * (1 << 31)))

    def run(batches):
        cost, rejected = [0.0] * len(rules), [0] * len(rules)
        for b in batches:
            for _, _, raw, offsets in slices(column(b, "text")):
                t = Texts(raw, offsets)
                t = t.subset(~base_failed(t))
                for k, r in enumerate(rules):
                    fresh = t.subset(np.ones(t.n, bool), copy=True)
                    began = time.perf_counter()
                    rejected[k] += int(r.rejects(fresh).sum())
                    cost[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array(cost), pa.array(rejected, pa.int64())], names=["rule", "cost", "rejected"])

    rows = some.select("text").mapInArrow(run, "rule string, cost double, rejected long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected")).collect()  # a row a rule
    measured = {r["rule"]: (r["cost"] + 1e-9, r["rejected"]) for r in rows}
    of = {r.name: measured.get(r.name, (1e-9, 0)) for r in rules}
    return sorted(of, key=lambda k: (-of[k][1] / of[k][0], of[k][0], k))


def run_cascade(t: Texts, rules: list[Rule], alive: np.ndarray) -> np.ndarray:
    """Of the texts alive at first, those that no rule rejects."""
    left = np.flatnonzero(alive)
    t = t.subset(alive)
    for r in rules:
        if not len(left):
            break
        stays = ~r.rejects(t)
        left, t = left[stays], t.subset(stays)
    kept = np.zeros(len(alive), bool)
    kept[left] = True
    return kept


def judge(docs: DataFrame, order: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    by_name = {r.name: r for r in rules}
    ordered = [by_name[k] for k in order]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for _, _, raw, offsets in slices(column(b, "text")):
                t = Texts(raw, offsets)
                failed = base_failed(t)
                kept = run_cascade(t, ordered, ~failed)
                for x, v in zip(out, (*(getattr(t, k) for k in names), failed, kept), strict=True):
                    x.append(v)
            flat = [np.concatenate(x) if x else np.zeros(0) for x in out]
            arrays = [pa.array(x.astype(np.int64)) for x in flat[:5]] + [pa.array(x.astype(bool)) for x in flat[5:]]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *arrays], names=["doc_id", *names, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts_of(table(spark, sf_dir, "documents"))
    return judge(docs, plan_order(docs))


#: The verdict doesn't depend on the order of the rules.
OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
g AS (SELECT row, i, w[i:i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) u(i)),
q AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
c AS (SELECT row, count(DISTINCT i + k) AS n FROM q, unnest([0, 1, 2]) v(k) GROUP BY row),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len([x FOR x IN w IF regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')]) AS n_lettered, length(t) - length(translate(t, '0123456789', '')) AS n_digits FROM d LEFT JOIN c USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * n_lettered < 70 * n_words OR 100 * n_digits > 30 * word_chars) AS kept FROM m
"""
