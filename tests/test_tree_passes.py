"""Passes of trees over rows: no object a row, and equal rows explained once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from loomstat.operators import trees


@pytest.mark.parametrize("kind", ["uint8", "uint16", "float64"])
def test_packed_rows_come_back(kind):
    rows = np.arange(12).reshape(4, 3).astype(kind)
    packed = trees._packed(rows)
    assert packed.to_pylist() == [x.tobytes() for x in rows]
    for col in (packed, packed.cast(pa.large_binary())):
        assert (trees._unpacked(col.slice(1, 2), kind, 3) == rows[1:3]).all()
    assert trees._unpacked(trees._packed(rows[:, :0]), kind, 0).shape == (4, 0)
    assert trees._packed(np.asfortranarray(rows)).to_pylist() == packed.to_pylist()


def test_lists():
    assert trees._lists(np.array([[1.0, 2.0], [3.0, 4.0]])).to_pylist() == [[1.0, 2.0], [3.0, 4.0]]
    assert trees._lists(np.zeros((0, 2))).to_pylist() == []


def test_equal_rows_are_explained_once():
    bins = np.random.default_rng(1).integers(0, 5, (1000, 4)).astype(np.int32)
    kept, same = trees._distinct(bins, [0, 2, 3])
    assert len(kept) == 125 and (kept[same][:, [0, 2, 3]] == bins[:, [0, 2, 3]]).all()
    leaf = lambda v, s: trees.Node(v, s)
    nodes = [trees.Node(0, 1.0, 2, bin=1, children=(1, 2)), leaf(1.0, 0.5), trees.Node(0, 0.5, 0, left_bins=[1, 3], children=(3, 4)), leaf(2.0, 0.2), leaf(5.0, 0.3)]
    every, few = np.zeros((1000, 4)), np.zeros((len(kept), 4))
    assert trees.tree_contributions(nodes, bins, every) == trees.tree_contributions(nodes, kept, few)
    assert np.array_equal(every, few[same])
    assert trees._distinct(bins[:20], [0, 1, 2, 3])[1] is None and trees._distinct(bins, [])[1] is None
