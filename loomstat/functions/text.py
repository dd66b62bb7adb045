"""Text functions as Column expressions: tokens, n-grams, inverse document frequency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters and digits is a token; any other character but white space is one by itself.
TOKEN = r"[\p{IsAlphabetic}\p{N}]+|[^\p{IsWhite_Space}\p{IsAlphabetic}\p{N}]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    """Lower-case tokens in order; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def bigrams(toks: str | Column) -> Column:
    """Adjacent tokens, shown with a space between; fewer than two tokens have none."""
    t = _col(toks)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def ngrams(text: str | Column, sizes: tuple[int, ...] = (1, 2)) -> Column:
    """The n-grams of the sizes asked for (1, 2), as one array."""
    t = tokens(text)
    parts = {1: t, 2: bigrams(t)}
    return F.concat(*(parts[n] for n in sizes))


def row_ngrams(toks: list[str], sizes: tuple[int, ...] = (1, 2)) -> list[str]:
    """The same of one row's tokens, inside a task."""
    parts = {1: lambda: toks, 2: lambda: [f"{a} {b}" for a, b in zip(toks, toks[1:], strict=False)]}
    return [g for n in sizes for g in parts[n]()]


def idf(n_rows: Column, n_with: Column) -> Column:
    """ln((1 + rows) / (1 + rows that hold it)) + 1."""
    return F.ln((1 + n_rows) / (1 + n_with)) + 1
