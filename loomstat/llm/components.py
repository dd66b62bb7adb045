"""Connected components of an edge table, by rounds of union inside tasks and one shuffle.

Each task reduces its edges to stars: rows (id, root) for every vertex it has seen, the root of a
star being its smallest vertex and having a row of its own.  Rows are dealt by id, so that all roots
an id was given meet, and are united there again.  A root that met a smaller one is torn; rows that
still name it are then pointed at what it met.  When no id is torn, the stars are the components.  A
vertex has at most one row a task after the first round, however many edges it has, so no task gets
a hot vertex's edges; torn roots are few, and joined by size as Spark decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

#: Rows that a task unites: as many tasks are made as they need, so a small graph needs one and no shuffle.
ROWS_A_TASK = 1 << 18
STARS = "id long, root long, own boolean, torn boolean"


def union(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of the component of each of n vertices, of edges (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
        a, b = a[apart], b[apart]


def _stars(batches):
    """own: the vertex was the first column of a row here; torn: it was there with different roots."""
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    root = union(ia, ib, len(names))
    low, high = np.full(len(names), len(names)), np.full(len(names), -1)
    np.minimum.at(low, ia, ib)
    np.maximum.at(high, ia, ib)
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root]), pa.array(high >= 0), pa.array((high >= 0) & (low != high))], names=["id", "root", "own", "torn"])


def components(edges: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """(id, component): the smallest id of its component, for each id in edges (a, b) between different ids."""
    stars = edges.where("a <> b").select(F.col("a").cast("long").alias("id"), F.col("b").cast("long").alias("root"))
    tasks = math.ceil(stars.count() / rows_a_task)
    if tasks > 1:
        stars = stars.mapInArrow(_stars, STARS).select("id", "root")
    before: tuple[DataFrame, ...] = ()
    while True:
        met = cut((stars.repartition("id") if tasks > 1 else stars).coalesce(max(1, tasks)).mapInArrow(_stars, STARS))
        torn = cut(met.where("torn").select(F.col("id").alias("old"), F.col("root").alias("new"))) if tasks > 1 else None
        forget(*before)
        if torn is None or torn.isEmpty():
            return met.where("own" if tasks > 1 else "true").select("id", F.col("root").alias("component"))
        before = (met, torn)
        stars = met.join(torn, met.root == torn.old, "left").select("id", F.coalesce("new", "root").alias("root"))
