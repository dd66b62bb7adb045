"""Rows of wide features, stored as the places and values of what isn't 0.

A column of such rows is a struct (i array<int>, v array<double>).  Memory and time of a pass follow what is
stored, not how many features there are: a text of 200 n-grams takes 200 entries of a vocabulary of 20,000.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

TYPE = "struct<i:array<int>,v:array<double>>"


def is_sparse(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name].startswith("struct")


@dataclass
class Rows:
    """Entries of rows end to end; row r has those from start[r] to start[r + 1]."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.start) - 1

    @property
    def row(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def slice(self, a: int, b: int) -> Rows:
        a, b = min(a, len(self)), min(b, len(self))
        return Rows(self.start[a : b + 1] - self.start[a], self.index[self.start[a] : self.start[b]], self.value[self.start[a] : self.start[b]], self.width)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """Products with each row of weights (outputs x width): rows x outputs."""
        row = self.row
        return np.stack([np.bincount(row, w[self.index] * self.value, len(self)) for w in weights], axis=1)

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self), self.width))
        out[self.row, self.index] = self.value
        return out


def rows_of(col: pa.Array, width: int) -> Rows:
    """A struct column of an Arrow batch; arrays of doubles are taken too, zeros left out."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_struct(col.type):
        i, v = pc.struct_field(col, "i"), pc.struct_field(col, "v")
        n = pc.list_value_length(i).to_numpy(zero_copy_only=False).astype(np.int64)
        return Rows(np.concatenate(([0], np.cumsum(n))), np.asarray(i.flatten()).astype(np.int64), np.asarray(v.flatten(), float), width)
    x = np.asarray(col.flatten(), float).reshape(-1, width) if len(col) else np.zeros((0, width))
    row, index = np.nonzero(x)  # NaN isn't 0
    return Rows(np.searchsorted(row, np.arange(len(x) + 1)), index, x[row, index], width)


def column_of(rows: Rows) -> pa.Array:
    start = pa.array(rows.start, pa.int32())
    i = pa.ListArray.from_arrays(start, pa.array(rows.index, pa.int32()))
    v = pa.ListArray.from_arrays(start, pa.array(rows.value, pa.float64()))
    return pa.StructArray.from_arrays([i, v], ["i", "v"])


class SparseBins:
    """Bins of rows: a default bin for each feature, and those that differ."""

    def __init__(self, start: np.ndarray, index: np.ndarray, bins: np.ndarray, default: np.ndarray):
        self.start, self.index, self.bins, self.default = start, index, bins, default
        self.row = np.repeat(np.arange(len(start) - 1), np.diff(start))
        self._order = None

    def __len__(self) -> int:
        return len(self.start) - 1

    def column(self, feature: int) -> np.ndarray:
        """The bin of every row in one feature; entries are put in order of features once."""
        if self._order is None:
            self._order = np.argsort(self.index, kind="stable")
            self._sorted = self.index[self._order]
        at = self._order[np.searchsorted(self._sorted, feature) : np.searchsorted(self._sorted, feature, "right")]
        out = np.full(len(self), self.default[feature], np.int64)
        out[self.row[at]] = self.bins[at]
        return out


def bins_of(rows: Rows, thresholds: list[list[float]], enums: list[int], default: np.ndarray, kept: np.ndarray | None = None) -> SparseBins:
    """kept: the place of each feature among those that are kept, -1 for others, whose entries go; the default bins are those of the kept."""
    order = np.argsort(rows.index, kind="stable")
    index, value, bins = rows.index[order], rows.value[order], np.zeros(len(order), np.int64)
    edges = np.flatnonzero(np.diff(index, prepend=-1)) if len(index) else np.zeros(0, np.int64)
    for a, b in zip(edges, [*edges[1:], len(index)], strict=True):  # the features that these rows hold
        f, v = int(index[a]), value[a:b]
        bins[a:b] = np.nan_to_num(v, nan=0.0) if f in enums else np.where(np.isnan(v), 0, 1 + np.searchsorted(thresholds[f], v))
    row = rows.row[order]
    place = index if kept is None else kept[index]
    keep = place >= 0
    keep[keep] = bins[keep] != default[place[keep]]
    row, place, bins = row[keep], place[keep], bins[keep]
    back = np.argsort(row, kind="stable")
    return SparseBins(np.searchsorted(row[back], np.arange(len(rows) + 1)), place[back], bins[back], default)


def pack(b: SparseBins) -> list[bytes]:
    """A row's entries as bytes: places (4 each), then bins (2 each)."""
    index, bins = b.index.astype(np.uint32), b.bins.astype(np.uint16)
    return [index[s:e].tobytes() + bins[s:e].tobytes() for s, e in zip(b.start[:-1], b.start[1:], strict=True)]


def unpack(rows: list[bytes], default: np.ndarray) -> SparseBins:
    n = np.array([len(x) // 6 for x in rows], np.int64)
    start = np.concatenate(([0], np.cumsum(n)))
    index = np.frombuffer(b"".join(x[: 4 * k] for x, k in zip(rows, n, strict=True)), np.uint32).astype(np.int64)
    bins = np.frombuffer(b"".join(x[4 * k :] for x, k in zip(rows, n, strict=True)), np.uint16).astype(np.int64)
    return SparseBins(start, index, bins, default)
