"""Gradient boosted trees on Spark.

Rows are binned once, into a table of packed bins, labels and scores.  Bin sums of many tree nodes come
from one pass: tasks walk their rows through the trees since the scores were written and the tree so
far (numpy), add up a dense array by node and bin of each feature, and send it in rows of CHUNK bins;
those are added up by node and chunk.  Only the smaller child of each split is summed: the larger one is its
parent less that.  Split search over the sums (nodes * features * bins numbers) is numpy on the driver.
Of sparse rows (see sparse) only bins that aren't a feature's default bin, that of 0, are stored and summed; the
default bin has what the node has in all less the others.  Features that no split of min_rows could divide
are left out before training.
Trees grow best first.  The sums of all children that could be popped next come from one job, and pops
are then replayed in order of gain, so trees equal those grown one split at a time.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Generator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.operators.binning import bin_thresholds, leaf_value
from loomstat.operators.linear import EarlyStopping
from loomstat.operators.ranks import value_counts
from loomstat.operators.sparse import SparseBins, bins_of, is_sparse, pack, rows_of, unpack
from loomstat.sources.tables import dropped, spread, written

#: Scores are written anew after so many rounds; between, tasks apply the trees since.
ROUNDS_A_TABLE = 10
#: Bytes of bin sums that a task holds; nodes beyond are summed in further passes.
SUM_BYTES = 256 << 20
#: Bins that one row of sums holds.
CHUNK = 4096


@dataclass(frozen=True)
class TreeOptions:
    learning_rate: float = 0.1
    max_leaves: int = 31
    max_depth: int = 50
    rounds: int = 100
    min_rows: int = 20
    min_hessian: float = 1e-3
    max_bins: int = 255
    l2_number: float = 0.0
    l2_enum: float = 10.0
    smoothing: float = 10.0
    min_gain: float = 0.0


@dataclass
class Node:
    """A leaf until it has a feature.  left: bins that go left (enum) or the last bin that does (number)."""

    value: float
    share: float
    feature: int = -1
    split: float = 0.0
    left_bins: list[int] | None = None
    bin: int = -1
    children: tuple[int, int] = (-1, -1)


@dataclass
class Trees:
    """kind: regression, binary, multiclass; trees[round][output] is a list of nodes, the first its root."""

    kind: str
    biases: list[float]
    thresholds: list[list[float]]
    enums: list[int]
    trees: list[list[list[Node]]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of rows of features (numbers as they are, enum codes, NaN for invalid): 0 for invalid numbers, which so go left."""
        out = np.empty(x.shape, np.int32)
        for i, t in enumerate(self.thresholds):
            v = x[:, i]
            out[:, i] = np.nan_to_num(v, nan=0.0) if i in self.enums else np.where(np.isnan(v), 0, 1 + np.searchsorted(t, v))
        return out

    @property
    def defaults(self) -> np.ndarray:
        """The bin of 0 of each feature."""
        enums = set(self.enums)
        return np.array([0 if i in enums else 1 + int(np.searchsorted(t, 0.0)) for i, t in enumerate(self.thresholds)], np.int64)

    def bins(self, col: pa.Array) -> np.ndarray | SparseBins:
        """Bins of a batch's column of features, arrays or sparse rows."""
        width = len(self.thresholds)
        if pa.types.is_struct(col.type):
            return bins_of(rows_of(col, width), self.thresholds, set(self.enums), self.defaults)
        return self.binned(_matrix(col, width))

    @property
    def importances(self) -> list[float]:
        """Shares of splits by feature."""
        n = np.zeros(len(self.thresholds))
        for r in self.trees:
            for nodes in r:
                for x in nodes:
                    if x.feature >= 0:
                        n[x.feature] += 1
        return list(n / n.sum()) if n.sum() else list(n)


def _column(bins: np.ndarray | SparseBins, feature: int) -> np.ndarray:
    return bins[:, feature] if isinstance(bins, np.ndarray) else bins.column(feature)


def walk(nodes: list[Node], bins: np.ndarray | SparseBins) -> np.ndarray:
    """The index of the leaf that each row of bins ends in."""
    at = np.zeros(len(bins), np.int64)
    for i, x in enumerate(nodes):  # children come after their parents
        if x.feature >= 0:
            here = np.flatnonzero(at == i)
            b = _column(bins, x.feature)[here]
            left = np.isin(b, x.left_bins) if x.left_bins is not None else b <= x.bin
            at[here] = np.where(left, *x.children)
    return at


def scores(model: Trees, bins: np.ndarray) -> np.ndarray:
    out = np.tile(np.array(model.biases), (len(bins), 1))
    for r in model.trees:
        for k, nodes in enumerate(r):
            out[:, k] += np.array([x.value for x in nodes])[walk(nodes, bins)]
    return out


def _gradients(kind: str, s: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if kind == "regression":
        return s[:, 0] - y, np.ones(len(y))
    if kind == "binary":
        p = 1 / (1 + np.exp(-s[:, 0]))
        return p - y, p * (1 - p)
    e = np.exp(s - s.max(axis=1, keepdims=True))
    p = e[:, k] / e.sum(axis=1)
    return p - (y == k), p * (1 - p)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten(), float).reshape(-1, width) if len(col) else np.zeros((0, width))


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as a binary value, without an object a row."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.itemsize * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(col: pa.Array, kind: str, width: int = -1) -> np.ndarray:
    """The rows that _packed made."""
    col = col.cast(pa.large_binary())
    _, ends, data = col.buffers()
    ends = np.frombuffer(ends, np.int64)[col.offset : col.offset + len(col) + 1]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(values, kind).reshape(len(col), width)


def _lists(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as arrays."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


@dataclass
class _Reader:
    """Reads packed rows inside tasks; since: trees that the stored scores don't hold yet."""

    kind: str
    width: int
    bin_type: str
    default: np.ndarray | None = None  # of sparse rows
    since: list = field(default_factory=list)

    def __call__(self, batches):
        """(bins, scores, labels) of each batch that has rows."""
        for b in batches:
            if b.num_rows:
                bins = _unpacked(b.column(0), self.bin_type, self.width) if self.default is None else unpack(b.column(0).to_pylist(), self.default)
                s = _unpacked(b.column(1), "float64").copy()
                for made in self.since:
                    for k, nodes in enumerate(made):
                        s[:, k] += np.array([x.value for x in nodes])[walk(nodes, bins)]
                yield bins, s, np.asarray(b.column(2), float)

    def losses(self, s: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.kind == "regression":
            return (s[:, 0] - y) ** 2
        if self.kind == "binary":
            return np.logaddexp(0, s[:, 0]) - s[:, 0] * y
        return np.logaddexp.reduce(s, axis=1) - s[np.arange(len(y)), y.astype(int)]


class _Rows:
    """The rows that a model learns from or is watched by, as a table of packed bins, scores and labels."""

    SCHEMA = "bins binary, score binary, y double"

    def __init__(self, rows: DataFrame, model: Trees, kept: list[int]):
        """model: of all features, without trees yet; kept: those that trees may split on, in order."""
        start, wide = np.array(model.biases), is_sparse(rows, "x")
        longest = max((len(model.thresholds[f]) for f in kept), default=0)
        self.read = _Reader(model.kind, len(kept), "uint16" if model.enums or longest > 253 else "uint8", model.defaults[kept] if wide else None)
        kind, default, width = self.read.bin_type, self.read.default, len(model.thresholds)
        place = np.full(width, -1)
        place[kept] = np.arange(len(kept))

        def run(batches):
            for b in batches:
                if wide:
                    packed = pa.array(pack(bins_of(rows_of(b.column(0), width), model.thresholds, set(model.enums), default, place)), pa.binary())
                else:
                    packed = _packed(model.binned(_matrix(b.column(0), width))[:, kept].astype(kind))
                yield pa.RecordBatch.from_arrays([packed, _packed(np.tile(start, (b.num_rows, 1))), b.column(1)], names=["bins", "score", "y"])

        self.data = written(spread(rows).mapInArrow(run, self.SCHEMA), "boosting")

    def advance(self, made: list[list[Node]]) -> None:
        self.read.since.append(made)
        if len(self.read.since) >= ROUNDS_A_TABLE:
            read = self.read

            def run(batches):
                for bins, s, y in read(batches):
                    packed = _packed(bins) if read.default is None else pa.array(pack(bins), pa.binary())
                    yield pa.RecordBatch.from_arrays([packed, _packed(s), pa.array(y)], names=["bins", "score", "y"])

            before, self.data = self.data, written(self.data.mapInArrow(run, self.SCHEMA), "boosting")
            self.read = _Reader(read.kind, read.width, read.bin_type, read.default)
            dropped(before)

    def loss(self) -> float:
        """The mean loss of the scores so far."""
        read = self.read

        def run(batches):
            total, n = 0.0, 0
            for _, s, y in read(batches):
                total, n = total + float(read.losses(s, y).sum()), n + len(y)
            yield pa.RecordBatch.from_pydict({"loss": [total], "n": [n]})

        r = self.data.mapInArrow(run, "loss double, n long").agg(F.sum("loss").alias("a"), F.sum("n").alias("n")).first()
        return r.a / r.n if r.n else 0.0

    def sums(self, requests: list[tuple], first: np.ndarray) -> list[dict[int, np.ndarray]]:
        """For each request (output, nodes, wanted, virtual) the bin sums [g, h, n; bin] of its wanted nodes, all features'
        bins end to end, first[f] being the first of feature f.  All requests are served by the same pass.

        virtual: splits tried on leaves (leaf: (split, left id, right id)).
        """
        every = [(r, node) for r, (_, _, wanted, _) in enumerate(requests) for node in wanted]
        room, out = max(1, SUM_BYTES // (24 * int(first[-1]))), [{} for _ in requests]
        for i in range(0, len(every), room):
            for (r, node), found in self._sums(requests, every[i : i + room], first).items():
                out[r][node] = found
        return out

    def _sums(self, requests: list[tuple], wanted: list[tuple[int, int]], first: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        read, width, n_bins = self.read, self.read.width, int(first[-1])
        places: dict[int, list[tuple[int, int]]] = {}
        for i, (r, node) in enumerate(wanted):
            places.setdefault(r, []).append((i, node))
        size = n_bins + (read.default is not None)  # of sparse rows, what a node has in all comes last

        def run(batches):
            total = np.zeros((3, len(wanted), size))
            for bins, s, y in read(batches):
                for r, own in places.items():
                    k, nodes, _, virtual = requests[r]
                    g, h = _gradients(read.kind, s, y, k)
                    at, slot = walk(nodes, bins), np.full(len(y), -1)
                    for leaf, (x, left, right) in virtual.items():
                        here = np.flatnonzero(at == leaf)
                        v = _column(bins, x["feature"])[here]
                        at[here] = np.where(np.isin(v, x["left"]) if x["left"] is not None else v <= x["bin"], left, right)
                    for i, node in own:
                        slot[at == node] = i
                    here = np.flatnonzero(slot >= 0)
                    if read.default is None:
                        flat, row = (slot[here, None] * size + first[:-1] + bins[here]).ravel(), np.repeat(here, width)
                    else:
                        e = np.flatnonzero(slot[bins.row] >= 0)
                        row = np.concatenate((bins.row[e], here))
                        flat = np.concatenate((slot[bins.row[e]] * size + first[bins.index[e]] + bins.bins[e], slot[here] * size + n_bins))
                    for part, v in zip(total, (g[row], h[row], None), strict=True):
                        part += np.bincount(flat, v, part.size).reshape(part.shape)
            for i in np.flatnonzero(total[2].any(axis=1)):
                for c in range(0, size, CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([c]), pa.array([total[:, i, c : c + CHUNK].tobytes()], pa.binary())], names=["node", "chunk", "sums"])

        def add(t: pa.Table) -> pa.Table:
            s = np.sum([np.frombuffer(x.as_buffer()) for x in t["sums"]], axis=0)
            return pa.table([t["node"].slice(0, 1), t["chunk"].slice(0, 1), pa.array([s.tobytes()], pa.binary())], names=["node", "chunk", "sums"])

        kind = "node long, chunk long, sums binary"
        out: dict[int, np.ndarray] = {}
        for r in self.data.mapInArrow(run, kind).groupBy("node", "chunk").applyInArrow(add, kind).collect():  # SUM_BYTES at most
            out.setdefault(r["node"], np.zeros((3, size)))[:, r["chunk"] : r["chunk"] + CHUNK] = np.frombuffer(r["sums"]).reshape(3, -1)
        if read.default is not None:
            for node, s in out.items():
                out[node] = s[:, :n_bins]
                rest = s[:, n_bins:] - np.add.reduceat(out[node], first[:-1], axis=1)
                rest[:, rest[2] == 0] = 0.0  # no rows there: what is left is rounding
                out[node][:, first[:-1] + read.default] += rest
        return {wanted[i]: found for i, found in out.items()}


def best_split_of(sums: np.ndarray, first: np.ndarray, enums: list[int], o: TreeOptions) -> dict | None:
    """The split of the largest gain by a node's bin sums [g, h, n; bin]; ties by the smallest feature and bin.

    Numbers split after a bin.  Enum bins are put in the order of g / (h + smoothing), and those of a prefix go left.
    """
    best = None

    def gains(left: np.ndarray, l2: float) -> np.ndarray:
        """Of sums of what goes left, along the last axis; -inf where a split isn't allowed."""
        right = left[..., -1:] - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - left[0, ..., -1:] ** 2 / (left[1, ..., -1:] + l2)
        allowed = (np.minimum(left[2], right[2]) >= max(o.min_rows, 1)) & (np.minimum(left[1], right[1]) >= o.min_hessian) & np.isfinite(gain)
        return np.where(allowed, gain, -np.inf)

    def take(f: int, bin_: int, gain: float, left: np.ndarray, whole: np.ndarray, left_bins: list[int] | None) -> None:
        nonlocal best
        if np.isfinite(gain) and (best is None or (gain, -f) > (best["gain"], -best["feature"])):
            best = {"feature": f, "bin": int(bin_), "left": left_bins, "gain": float(gain), **{f"{side}{c}": float(v[j]) for side, v in (("l", left), ("r", whole - left)) for j, c in enumerate("ghn")}}

    size = np.diff(first)
    numbers = np.setdiff1d(np.arange(len(size)), enums)
    for n_bins in np.unique(size[numbers]):  # features of as many bins are searched at once
        fs = numbers[size[numbers] == n_bins]
        own = sums[:, first[fs][:, None] + np.arange(n_bins)]
        left = np.cumsum(own, axis=2)
        gain = np.where(own[2] > 0, gains(left, o.l2_number), -np.inf)
        i, j = np.unravel_index(np.argmax(gain), gain.shape)
        take(int(fs[i]), j, gain[i, j], left[:, i, j], left[:, i, -1], None)
    for f in enums:
        own = sums[:, first[f] : first[f + 1]]
        g, h, n = own
        bins = np.flatnonzero(n)
        bins = bins[np.lexsort((bins, g[bins] / (h[bins] + o.smoothing)))]
        if len(bins) >= 2:
            left = np.cumsum(own[:, bins], axis=1)
            gain = gains(left, o.l2_enum)
            i = min(np.flatnonzero(gain == gain.max()), key=lambda j: bins[j])
            take(f, bins[i], gain[i], left[:, i], left[:, -1], sorted(bins[: i + 1].tolist()))
    return best


def grow(enums: list[int], thresholds: list[list[float]], o: TreeOptions, first: np.ndarray) -> Generator[tuple, dict[int, np.ndarray], list[Node]]:
    """One tree, as a generator that asks for bin sums (nodes, wanted, virtual) and is sent them."""
    found: dict[int, dict] = {}
    sums = yield [Node(0.0, 1.0)], [0], {}  # of leaves whose children aren't known yet
    g, h, _ = sums[0][:, : first[1]].sum(axis=1)
    nodes, depth = [Node(leaf_value(g, h, o.learning_rate, o.l2_number), 1.0)], {0: 0}
    heap: list[tuple] = []

    def push(i: int) -> None:
        x = best_split_of(sums[i], first, enums, o)
        if x is not None and x["gain"] > o.min_gain and depth[i] < o.max_depth:
            heapq.heappush(heap, (-x["gain"], i))
            found[i] = x

    push(0)
    leaves = 1
    ahead: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # leaf: the sums of its two children
    while heap and leaves < o.max_leaves:
        if heap[0][1] not in ahead and leaves + 1 < o.max_leaves:
            # all leaves that may be popped within the leaves left; of each the smaller child is summed
            next_up = [i for _, i in heapq.nsmallest(o.max_leaves - leaves - 1, heap) if i not in ahead]
            ids = {i: (-2 * j - 1, -2 * j - 2) for j, i in enumerate(next_up)}
            small = {i: ids[i][0] if found[i]["ln"] <= found[i]["rn"] else ids[i][1] for i in next_up}
            got = yield nodes, list(small.values()), {i: (found[i], *p) for i, p in ids.items()}
            for i in next_up:
                less = got[small[i]]
                ahead[i] = (less, sums[i] - less) if small[i] == ids[i][0] else (sums[i] - less, less)
        _, i = heapq.heappop(heap)
        x, a = found[i], len(nodes)
        n, p = x["ln"] + x["rn"], nodes[i]
        enum = x["left"] is not None
        nodes[i] = Node(p.value, p.share, x["feature"], 0.0 if enum else thresholds[x["feature"]][min(max(x["bin"] - 1, 0), len(thresholds[x["feature"]]) - 1)], x["left"], -1 if enum else x["bin"], (a, a + 1))
        for side in "lr":
            nodes.append(Node(leaf_value(x[f"{side}g"], x[f"{side}h"], o.learning_rate, o.l2_number), p.share * x[f"{side}n"] / n))
        leaves += 1
        del sums[i]
        depth[a] = depth[a + 1] = depth[i] + 1
        if i in ahead:
            sums[a], sums[a + 1] = ahead.pop(i)
            push(a)
            push(a + 1)
    return nodes


def grow_together(rows: _Rows, outputs: int, enums: list[int], thresholds: list[list[float]], o: TreeOptions, first: np.ndarray) -> list[list[Node]]:
    """A tree for each output.  What all of them ask for next comes from one pass over the rows, so a round takes as
    many passes as the tree that needs most, however many classes there are."""
    growing = {k: grow(enums, thresholds, o, first) for k in range(outputs)}
    asked, done = {k: next(g) for k, g in growing.items()}, {}
    while asked:
        got = rows.sums([(k, *request) for k, request in asked.items()], first)
        before, asked = asked, {}
        for k, found in zip(before, got, strict=True):
            try:
                asked[k] = growing[k].send(found)
            except StopIteration as e:
                done[k] = e.value
    return [done[k] for k in range(outputs)]


def train_trees(
    df: DataFrame, features: str, label: str, kind: str, n_classes: int = 1, enums: list[int] | None = None, options: TreeOptions | None = None, stopping: EarlyStopping | None = None, watch: DataFrame | None = None, deadline: float | None = None,
    width: int | None = None,
) -> Trees:
    """features: array column; label: a number, 0/1, or a class index from 0; enums: features that hold codes.

    watch: rows whose loss decides on stopping, those of df if there are none; deadline: a time of
    time.monotonic() after which no further round begins; width: how many features sparse rows have.
    """
    o, enums = options or TreeOptions(), enums or []
    outputs = n_classes if kind == "multiclass" else 1
    src = df.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y")).where("y is not null")
    wide = is_sparse(src, "x")
    n_rows = src.count()
    if not n_rows:
        raise ValueError("no rows to train on")
    if wide:
        n_features = width if width is not None else (src.select(F.max(F.array_max("x.i")).alias("m")).first()["m"] or 0) + 1
        long = src.select(F.inline(F.arrays_zip("x.i", "x.v"))).toDF("feature", "value")
    else:
        n_features = len(src.first()["x"])
        long = src.select(F.posexplode("x").alias("feature", "value"))
    codes = {r["feature"]: r["top"] for r in long.where(F.col("feature").isin(*enums)).groupBy("feature").agg(F.max(F.when(~F.isnan("value"), F.col("value"))).cast("int").alias("top")).collect()} if enums else {}  # a row an enum
    long = long.where(~F.col("feature").isin(*enums) if enums else F.lit(True)).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    if wide:
        stored = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        zeros = long.groupBy("feature").agg((F.lit(n_rows) - F.count(F.lit(1))).alias("n")).where("n > 0").select("feature", F.lit(0.0).alias("value"), "n")
        counts = stored.where("value is not null").unionByName(zeros)
    else:
        counts = value_counts(long, ["feature"], "value")
    counts = written(counts, "counts")
    # a split needs min_rows on either side of what most rows have, be it a value or none
    most = F.greatest(F.max("n"), F.lit(n_rows) - F.sum("n"))
    useful = counts.groupBy("feature").agg((F.lit(n_rows) - most).alias("others")).where(F.col("others") >= max(o.min_rows, 1)).select("feature")
    useful = written(useful, "useful")
    thresholds: list[list[float]] = [[] for _ in range(n_features)]
    for r in bin_thresholds(counts.join(useful, "feature"), ["feature"], "value", o.max_bins).orderBy("feature", "threshold").collect():  # max_bins a feature
        thresholds[r["feature"]].append(r["threshold"])
    kept = sorted({r["feature"] for r in useful.collect()} | set(enums))  # a row a feature
    dropped(counts)
    dropped(useful)
    model = Trees(kind, [0.0] * outputs, thresholds, enums)
    if kind == "multiclass":
        share = {int(r["y"]): r["n"] for r in src.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per class
        n = sum(share.values())
        model.biases = [float(np.log(max(share.get(c, 0) / n, 1e-7))) for c in range(outputs)]
    else:
        mean = src.agg(F.avg("y").alias("m")).first()["m"]
        mean = min(max(mean, 1e-7), 1 - 1e-7) if kind == "binary" else mean
        model.biases = [float(np.log(mean / (1 - mean))) if kind == "binary" else float(mean)]
    bins_first = np.cumsum([0, *(int(codes.get(f) or 0) + 1 if f in enums else len(thresholds[f]) + 2 for f in kept)])
    own_enums, own_thresholds = [kept.index(f) for f in enums], [thresholds[f] for f in kept]
    rows = _Rows(src, model, kept)
    watched = _Rows(watch.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y")).where("y is not null"), model, kept) if watch is not None else rows
    for _ in range(o.rounds if kept else 0):
        if deadline is not None and time.monotonic() > deadline:
            break
        made = grow_together(rows, outputs, own_enums, own_thresholds, o, bins_first)
        if all(len(nodes) == 1 for nodes in made):
            break
        model.trees.append([[replace(x, feature=kept[x.feature]) if x.feature >= 0 else x for x in nodes] for nodes in made])
        rows.advance(made)
        if watched is not rows:
            watched.advance(made)
        if stopping:
            model.losses.append(watched.loss())
            if stopping.stop(model.losses[-1]):
                break
    dropped(rows.data)
    if watched is not rows:
        dropped(watched.data)
    return model


def with_scores(df: DataFrame, model: Trees, features: str, name: str = "score") -> DataFrame:
    """df with the summed tree values per output, before any link function.  Invalid numbers go left, as in training."""
    n, at = len(df.columns), df.columns.index(features)
    schema = df.withColumn(name, F.lit(None).cast("array<double>")).schema

    def run(batches):
        for b in batches:
            s = scores(model, model.bins(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], _lists(s)], names=[*b.schema.names[:n], name])

    return df.mapInArrow(run, schema)


def _longer(weights: np.ndarray, zero: float, one: np.ndarray) -> np.ndarray:
    """The subset weights of a path (by size of subset, of each row) with one more feature on it.

    zero: the share of training rows that take this path whatever the feature is; one: 1 for rows that meet its tests.
    """
    n = len(weights)
    k = np.arange(1, n + 1)[:, None]
    out = np.zeros((n + 1, weights.shape[1]))
    out[1:] = one * weights * k / (n + 1)
    out[:-1] += zero * weights * (n + 1 - k) / (n + 1)
    return out


def _shorter(weights: np.ndarray, zero: float, one: np.ndarray) -> np.ndarray:
    """The weights without a feature that is on the path: what `_longer` did, undone from the largest subset down."""
    n = len(weights)
    met, rest, out = one != 0, weights[-1], np.empty((n - 1, weights.shape[1]))
    for j in range(n - 2, -1, -1):
        out[j] = np.where(met, rest * n / (j + 1), weights[j] * n / (zero * (n - 1 - j)))
        rest = weights[j] - out[j] * zero * (n - 1 - j) / n
    return out


def tree_contributions(nodes: list[Node], bins: np.ndarray | SparseBins, out: np.ndarray) -> float:
    """Adds each feature's contribution to out (rows, features); returns the tree's expected value.

    Path-dependent Shapley values (Lundberg et al., 2018), of all rows at once: going down, a path keeps the
    weights of all subsets of its features by size, and a leaf owes each feature what is left without it.
    A leaf costs the square of the number of features on its path.
    """
    rows, expected = len(bins), 0.0
    stack = [(0, (), np.ones((1, rows)))]
    while stack:
        i, path, weights = stack.pop()
        x = nodes[i]
        if x.feature < 0:
            expected += x.value * x.share
            for feature, zero, one in path:
                out[:, feature] += x.value * (one - zero) * _shorter(weights, zero, one).sum(axis=0)
            continue
        b = _column(bins, x.feature)
        left = (np.isin(b, x.left_bins) if x.left_bins is not None else b <= x.bin).astype(float)
        zero, one = 1.0, np.ones(rows)
        for k, (feature, z, o) in enumerate(path):
            if feature == x.feature:  # a feature that is met again counts once
                zero, one, weights, path = z, o, _shorter(weights, z, o), path[:k] + path[k + 1 :]
                break
        for child, meets in zip(x.children, (left, 1 - left), strict=True):
            share = nodes[child].share / x.share
            stack.append((child, (*path, (x.feature, zero * share, one * meets)), _longer(weights, zero * share, one * meets)))
    return expected


def _distinct(bins: np.ndarray | SparseBins, used: list[int]) -> tuple[np.ndarray | SparseBins, np.ndarray | None]:
    """Rows of bins that differ in the features used, and which of them each row equals; all rows and None where few are equal."""
    if not isinstance(bins, np.ndarray) or not len(bins) or not used:
        return bins, None
    own = bins[:, used].astype(np.int64)
    sizes = own.max(axis=0) + 1
    if np.prod(sizes.astype(float)) >= 2**62:
        return bins, None
    _, at, same = np.unique(own @ np.concatenate((np.cumprod(sizes[:0:-1])[::-1], [1])), return_index=True, return_inverse=True)
    return (bins[at], same) if 2 * len(at) <= len(bins) else (bins, None)


def with_contributions(df: DataFrame, model: Trees, features: str, output: int = 0) -> DataFrame:
    """df with `contributions` (per feature) and `baseline`: they add up to the score of that output."""
    split_on = sorted({x.feature for r in model.trees for x in r[output] if x.feature >= 0})
    n, at = len(df.columns), df.columns.index(features)
    schema = df.withColumn("contributions", F.lit(None).cast("array<double>")).withColumn("baseline", F.lit(None).cast("double")).schema

    def run(batches):
        for b in batches:
            bins, same = _distinct(model.bins(b.column(at)), split_on)
            out, base = np.zeros((len(bins), len(model.thresholds))), model.biases[output]
            for r in model.trees if b.num_rows else []:
                base += tree_contributions(r[output], bins, out)
            out = out if same is None else out[same]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], _lists(out), pa.array(np.full(b.num_rows, base))], names=[*b.schema.names[:n], "contributions", "baseline"])

    return df.mapInArrow(run, schema)
