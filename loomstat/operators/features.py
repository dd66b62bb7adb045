"""Feature groups: plans of what to derive from each column, and their columns.

Dense features end in one array column; bag-of-words features stay sparse, a row per entry.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.text import tokens
from loomstat.operators.grams import Lookup, pieces, scaled
from loomstat.operators.profile import TOP_NGRAMS, merge_counts, ngram_counts, top_ngrams
from loomstat.operators.sparse import TYPE as SPARSE
from loomstat.operators.sparse import Rows, column_of
from loomstat.schema import ColumnType
from loomstat.sources.tables import spread

#: Bytes of dense features that a task makes at a time.
BATCH_BYTES = 32 << 20


@dataclass(frozen=True)
class Group:
    """kind: identity, normalized, one_hot, bag_of_words, bag_of_words_cosine or word_embedding.

    mean and variance belong to normalized; vocabulary (n-gram, idf), sizes of n-grams and strategy to words;
    other is the second column of a cosine similarity; vectors (word, numbers) belong to word_embedding.
    """

    kind: str
    column: str
    mean: float = 0.0
    variance: float = 0.0
    variants: tuple[str, ...] = ()
    vocabulary: tuple[tuple[str, float], ...] = ()
    strategy: str = "present"
    other: str = ""
    sizes: tuple[int, ...] = (1, 2)
    vectors: tuple[tuple[str, tuple[float, ...]], ...] = ()

    @property
    def names(self) -> list[str]:
        if self.kind == "one_hot":
            return [f"{self.column} = {v}" for v in ("(invalid)", *self.variants)]
        if self.kind == "bag_of_words":
            return [f"{self.column}: {g}" for g, _ in self.vocabulary]
        if self.kind == "word_embedding":
            return [f"{self.column}[{i}]" for i in range(len(self.vectors[0][1]) if self.vectors else 0)]
        return [self.column if not self.other else f"{self.column} ~ {self.other}"]


def plan(types: dict[str, ColumnType], target: str, linear: bool, exclude: tuple[str, ...] = ()) -> list[Group]:
    """Groups that haven't learned anything yet: linear models get numbers normalised and enums one-hot, trees both as they are."""
    out = []
    for name, t in types.items():
        if name == target or name in exclude or t.kind == "unknown":
            continue
        kind = {"number": "normalized" if linear else "identity", "enum": "one_hot" if linear else "identity", "text": "bag_of_words"}[t.kind]
        out.append(Group(kind, name))
    return out


def included(groups: list[dict]) -> list[Group]:
    """Groups of a configuration: type, source_column (or source_column_a and _b), and for words strategy and ngram sizes."""
    out = []
    for g in groups:
        kind = {"one_hot_encoded": "one_hot", "bag_of_words_cosine_similarity": "bag_of_words_cosine"}.get(g["type"], g["type"])
        if kind not in NEEDS or set(g) - {"type", "source_column", "source_column_a", "source_column_b", "strategy", "ngrams"}:
            raise ValueError(f"no such feature group: {g}")
        cosine = kind == "bag_of_words_cosine"
        strategy = g.get("strategy", "tfidf" if cosine else "present")
        if strategy not in ("present", "count", "tfidf"):
            raise ValueError(f"no such strategy: {strategy}")
        out.append(Group(kind, g["source_column_a" if cosine else "source_column"], other=g["source_column_b"] if cosine else "", strategy=strategy, sizes=tuple(g.get("ngrams", (1, 2)))))
    return out


#: Types of columns that each kind can be made of.
NEEDS = {"identity": ("number", "enum"), "normalized": ("number", "enum"), "one_hot": ("enum",), "bag_of_words": ("text",), "bag_of_words_cosine": ("text",)}


def fit(df: DataFrame, groups: list[Group | tuple[str, str]], types: dict[str, ColumnType], max_vocabulary: int = TOP_NGRAMS) -> list[Group]:
    """Groups with what they learn from df: one aggregate for all moments, one job per text column or pair."""
    groups = [g if isinstance(g, Group) else Group(*g) for g in groups]
    for g in groups:
        for name in filter(None, (g.column, g.other)):
            if name not in types or types[name].kind not in NEEDS[g.kind]:
                raise ValueError(f"{g.kind} can't be made of the {types[name].kind if name in types else 'missing'} column {name}")
    numbers = [g.column for g in groups if g.kind == "normalized"]
    seen = df.agg(*(f(F.col(f"`{n}`").cast("double")).alias(f"{a}{i}") for i, n in enumerate(numbers) for a, f in (("m", F.avg), ("v", F.var_pop)))).first() if numbers else {}
    out = []
    for g in groups:
        if g.kind == "normalized":
            i = numbers.index(g.column)
            out.append(replace(g, mean=seen[f"m{i}"] or 0.0, variance=seen[f"v{i}"] or 0.0))
        elif g.kind in ("bag_of_words", "bag_of_words_cosine"):
            sides = [ngram_counts(df, c, g.sizes) for c in filter(None, (g.column, g.other))]
            counts = sides[0] if len(sides) == 1 else merge_counts(sides, ["ngram"], ["row_count", "occurrence_count"])
            top = top_ngrams(counts, len(sides) * df.count(), max_vocabulary).collect()  # at most max_vocabulary rows
            out.append(replace(g, vocabulary=tuple((r.ngram, r.idf) for r in top)))
        else:
            out.append(replace(g, variants=types[g.column].variants))
    return out


def normalized(c: Column, mean: float | Column, variance: float | Column) -> Column:
    """(x - mean) / sqrt(variance); 0 for invalid values and where nothing varies."""
    m, v = (F.lit(x) if isinstance(x, (int, float)) else x for x in (mean, variance))
    return F.when(c.isNull() | F.isnan(c.cast("double")) | (v == 0) | v.isNull(), 0.0).otherwise((c.cast("double") - m) / F.sqrt(v))


def one_hot(code: Column, n_variants: int) -> Column:
    """n + 1 slots, the first for invalid values; code is 0 for those."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_variants)), lambda i: (i == F.coalesce(code, F.lit(0))).cast("double"))


def enum_code(value: Column, variants: list[str]) -> Column:
    return F.coalesce(F.array_position(F.array(*(F.lit(v) for v in variants)), value), F.lit(0)).cast("int")


def dense(g: Group) -> Column:
    """The group's features as an array of doubles; invalid numbers of identity groups are NaN."""
    c = F.col(f"`{g.column}`")
    if g.kind == "identity":
        return F.array(F.coalesce(c.cast("double"), F.lit(float("nan"))))
    if g.kind == "normalized":
        return F.array(normalized(c, g.mean, g.variance))
    if g.kind == "one_hot":
        return one_hot(c, len(g.variants))
    raise ValueError(g.kind)


def _values(g: Group, entries: tuple[np.ndarray, np.ndarray, np.ndarray], weight: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the texts' n-grams in the vocabulary."""
    row, at, n = entries
    v = np.ones(len(at)) if g.strategy == "present" else n.astype(float) if g.strategy == "count" else n * weight[at]
    if g.strategy == "tfidf" or g.kind == "bag_of_words_cosine":
        v = scaled(row, v, rows)[0]
    return row, at, v


def with_features(df: DataFrame, groups: list[Group], name: str = "features", sparse: bool = False) -> DataFrame:
    """df with the groups' features, in their order, as an array of doubles, or as the places and values of those that aren't 0.

    Numbers and enums are column expressions.  Texts are cut to tokens once each, and one pass over the rows looks
    their n-grams up in the vocabularies, whatever their size, many rows at once; dense, BATCH_BYTES of features at a time.
    """
    words = [g for g in groups if g.kind in ("bag_of_words", "bag_of_words_cosine", "word_embedding")]
    if not words and not sparse:
        return df.withColumn(name, F.concat(*(dense(g) for g in groups)) if groups else F.array().cast("array<double>"))
    texts = list(dict.fromkeys(c for g in words for c in filter(None, (g.column, g.other))))
    plain = [g for g in groups if g not in words]
    packed = spread(df).select("*", *(tokens(F.col(f"`{c}`")).alias(f"__text_{i}") for i, c in enumerate(texts)), (F.concat(*(dense(g) for g in plain)) if plain else F.array().cast("array<double>")).alias("__plain"))
    n, last, width = len(df.columns), len(df.columns) + len(texts), sum(len(g.names) for g in groups)
    first, starts, i = {}, [], 0
    for k, g in enumerate(groups):
        first[k] = i
        starts += list(range(i, i + len(g.names))) if g in plain else []
        i += len(g.names)
    out_schema = df.withColumn(name, F.lit(None).cast(SPARSE if sparse else "array<double>")).schema

    def run(batches):
        look = {k: Lookup([w for w, _ in (g.vectors if g.kind == "word_embedding" else g.vocabulary)], (1,) if g.kind == "word_embedding" else g.sizes) for k, g in enumerate(groups) if g in words}
        weight = {k: np.array([x for _, x in g.vocabulary]) for k, g in enumerate(groups) if g in words}
        vectors = {k: np.array([v for _, v in g.vectors], float) for k, g in enumerate(groups) if g.kind == "word_embedding"}
        step = max(1, BATCH_BYTES // (8 * max(width, 1)))

        def of_texts(b, k, g):
            """(row, place within the group, value) of the rows' texts."""
            sides = [look[k].entries(b.column(n + texts.index(c))) for c in filter(None, (g.column, g.other))]
            if g.kind == "bag_of_words":
                return _values(g, sides[0], weight[k], b.num_rows)
            if g.kind == "bag_of_words_cosine":
                (row, a, va), (other, c, vc) = (_values(g, x, weight[k], b.num_rows) for x in sides)
                size = len(g.vocabulary)
                _, ia, ic = np.intersect1d(row * size + a, other * size + c, assume_unique=True, return_indices=True)
                every = np.arange(b.num_rows)
                return every, np.zeros_like(every), np.bincount(row[ia], va[ia] * vc[ic], b.num_rows)
            row, at, times = sides[0]
            found = np.flatnonzero(np.diff(row, prepend=-1))
            means = [np.average(vectors[k][a], axis=0, weights=t) for a, t in zip(np.split(at, found[1:]), np.split(times, found[1:]), strict=True)] if len(row) else []
            return np.repeat(row[found], len(g.names)), np.tile(np.arange(len(g.names)), len(found)), np.concatenate([np.zeros(0), *means])

        def entries(b, plain_part):
            row, at = np.nonzero(plain_part)
            parts = [(row, np.array(starts, np.int64)[at], plain_part[row, at])]
            for k, g in enumerate(groups):
                if g in words:
                    row, at, v = of_texts(b, k, g)
                    kept = v != 0
                    parts.append((row[kept], first[k] + at[kept], v[kept]))
            row, index, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(row, kind="stable")
            return Rows(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b.num_rows)))).astype(np.int64), index[order], value[order], width)

        for whole in batches:
            for b in pieces(whole, list(range(n, last)), whole.num_rows if sparse else step):
                plain_part = np.asarray(b.column(last).flatten(), float).reshape(b.num_rows, len(starts))
                if sparse:
                    made = column_of(entries(b, plain_part))
                else:
                    x = np.zeros((b.num_rows, width))
                    x[:, starts] = plain_part
                    for k, g in enumerate(groups):
                        if g in words:
                            row, at, v = of_texts(b, k, g)
                            x[row, first[k] + at] = v
                    made = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * width, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:n], made], names=[*b.schema.names[:n], name])

    return packed.mapInArrow(run, out_schema)


def bag_of_words(df: DataFrame, row_id: str, text: str, vocabulary: DataFrame, strategy: str = "present", normalise: bool | None = None) -> DataFrame:
    """Sparse (row_id, ngram, value) over the n-grams of vocabulary (ngram, idf), in one pass over the rows without a shuffle.

    present: 1; count: occurrences; tfidf: occurrences * idf, scaled to length 1 per row unless
    normalise is False.  vocabulary is a bounded table, as top_ngrams makes it; every task gets it.
    """
    known = vocabulary.select("ngram", "idf").collect()  # as many as top_ngrams was asked for
    names, weights = [r["ngram"] for r in known], np.array([r["idf"] for r in known], float)
    to_one = strategy == "tfidf" if normalise is None else normalise

    def run(batches):
        look, grams = Lookup(names), pa.array(names, pa.string())
        for b in batches:
            for part in pieces(b, [1]):
                row, at, n = look.entries(part.column(1))
                v = np.ones(len(at)) if strategy == "present" else n.astype(float) if strategy == "count" else n * weights[at]
                none = None
                if to_one:
                    v, length = scaled(row, v, part.num_rows)
                    none = length == 0
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), grams.take(pa.array(at)), pa.array(v, pa.float64(), mask=none)], names=["row_id", "ngram", "value"])

    rows = spread(df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))).select("row_id", tokens("text").alias("t"))
    return rows.mapInArrow(run, f"row_id {dict(rows.dtypes)['row_id']}, ngram string, value double")


def unit_rows(sparse: DataFrame) -> DataFrame:
    norm = sparse.groupBy("row_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return sparse.join(norm, "row_id").select("row_id", "ngram", F.try_divide("value", "norm").alias("value"))


def cosine_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row_id, similarity) of two sparse tables with unit rows; rows without a common n-gram (similarity 0) are left out."""
    both = a.select("row_id", "ngram", F.col("value").alias("x")).join(b.select("row_id", "ngram", F.col("value").alias("y")), ["row_id", "ngram"])
    return both.groupBy("row_id").agg(F.sum(F.col("x") * F.col("y")).alias("similarity"))


def shared_vocabulary(a: DataFrame, text_a: str, b: DataFrame, text_b: str, most: int = 20_000) -> DataFrame:
    """The vocabulary of two text columns: counts added per n-gram, idf over the rows of both."""
    counts = merge_counts([ngram_counts(a, text_a), ngram_counts(b, text_b)], ["ngram"], ["row_count", "occurrence_count"])
    return top_ngrams(counts, a.count() + b.count(), most)


def word_embedding(df: DataFrame, row_id: str, text: str, vectors: DataFrame) -> DataFrame:
    """(row_id, embedding): the mean of the vectors (word, vector) of a text's tokens; rows without any have none."""
    t = df.select(F.col(row_id).alias("row_id"), F.explode(tokens(text)).alias("word"))
    return mean_vectors(t.join(vectors, "word"), ["row_id"], "vector")


def mean_vectors(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(by, embedding): element-wise means."""
    x = df.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))
    return x.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))

