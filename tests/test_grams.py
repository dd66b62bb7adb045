"""Counting and looking up n-grams many rows at once, held against plain counting."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomstat.operators import grams

ROWS = [["a", "b", "a", "b"], [], None, ["b"], ["é", "a", "b", "a"], ["a"] * 5, ["x"]]


def plain(row, sizes):
    row = row or []
    return [g for n in sizes for g in (row if n == 1 else [f"{a} {b}" for a, b in zip(row, row[1:], strict=False)])]


@pytest.mark.parametrize("kind", [pa.list_(pa.string()), pa.large_list(pa.large_string())])
@pytest.mark.parametrize("size", [1, 2])
def test_counts(kind, size):
    col = pa.array([["lead"], *ROWS], kind).slice(1)
    got = {r["ngram"]: (r["r"], r["o"]) for r in grams.counted(col, size).to_pylist()}
    every = [plain(r, (size,)) for r in ROWS]
    rows, occurrences = Counter(g for e in every for g in set(e)), Counter(g for e in every for g in e)
    assert got == {g: (rows[g], n) for g, n in occurrences.items()}
    assert grams.counted(pa.array([[], None], kind), size).num_rows == 0


@pytest.mark.parametrize("sizes", [(1,), (2,), (1, 2)])
def test_look_up(sizes):
    vocabulary = ["b", "a b", "none", "a", "a", "a a", "a b a", "", "é a", "none a"]
    place = {w: j for j, w in enumerate(vocabulary)}
    row, at, n = grams.Lookup(vocabulary, sizes).entries(pa.array(ROWS, pa.list_(pa.string())))
    got = [Counter() for _ in ROWS]
    for r, a, k in zip(row.tolist(), at.tolist(), n.tolist(), strict=True):
        got[r][a] += k
    assert got == [Counter(place[g] for g in plain(r, sizes) if g in place) for r in ROWS]
    assert all(len(x) == 0 for x in grams.Lookup([], sizes).entries(pa.array(ROWS, pa.list_(pa.string()))))


def test_a_task_holds_a_bounded_number_of_tokens(monkeypatch):
    monkeypatch.setattr(grams, "MOST_TOKENS", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ROWS))), pa.array(ROWS, pa.list_(pa.string()))], names=["id", "t"])
    parts = list(grams.pieces(batch, [1]))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or len(p.column(1).flatten()) <= 4 for p in parts)
    assert [p.num_rows for p in grams.pieces(batch, [], 3)] == [3, 3, 1]


def test_scaled():
    v, length = grams.scaled(np.array([0, 0, 2]), np.array([3.0, 4.0, 0.0]), 3)
    assert v.tolist() == [0.6, 0.8, 0.0] and length.tolist() == [5.0, 5.0, 0.0]
