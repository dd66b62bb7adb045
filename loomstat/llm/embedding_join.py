"""Near-duplicate vectors by an epsilon grid order join.

Vectors of length 1 with cosine >= t lie within eps = sqrt(2 - 2 t) of each other.  They are
turned to principal axes; the grid cells of width eps on the leading ``DIMS`` axes order them
(epsilon grid order).  Each label's ordered vectors are dealt to blocks of up to ``BLOCK`` rows.  Two
blocks are joined only if the boxes around them on all those axes are within eps of each other, and
inside a join both sequences are halved again and again, halves whose boxes are more than eps apart
being skipped, until small intervals are compared by one matrix product in double precision.

Equal vectors of a label are one vector with a multiplicity.  Within a block join, links are counted
per vector and reduced to a spanning forest, so what leaves a task is as long as its blocks however
many links there are.

Defined results: null labels, null vectors, vectors with null or non-finite components and zero
vectors have no links and are their own component; vectors of different lengths are never linked;
rows with equal vec_id count as different rows of one component; columns besides vec_id, embedding and
label are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, joined, table
from .components import components

THRESHOLD, DIMS, BLOCK, LEAF = 0.98, 12, 512, 64
#: Room for rounding when distances of boxes are compared with eps.
SLACK = 1e-6


def marked(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, e, ok, digest): whether the vector may have links, and the same digest for equal vectors of a label."""
    v = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("e"))  # -0.0 and 0.0 are one value
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    v = v.withColumn("ok", F.coalesce(F.col("label").isNotNull() & F.col("e").isNotNull() & finite, F.lit(False)))
    return v.withColumn("digest", F.struct(F.xxhash64("label", "e").alias("a"), F.xxhash64(F.lit(1), "label", "e").alias("b")))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(label, e, rep, copies, digest, size): the distinct usable vectors of each label, as arrays of doubles."""
    return marked(vectors).where("ok").groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("digest").alias("digest")).withColumn("size", F.size("e"))


def _matrix(col: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), np.float64).reshape(-1, width)


def principal_axes(units: DataFrame, dims: int = DIMS) -> dict[int, np.ndarray]:
    """For each vector length, its leading principal axes (of normalised vectors, about 0)."""

    def gather(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            sizes = b.column(0).to_numpy()
            for n in np.unique(sizes):
                m = _matrix(b.column(1).filter(pa.array(sizes == n)), int(n))
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
                sums[int(n)] = sums.get(int(n), 0) + m.T @ m
        for n, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([n] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(list(s))], names=["size", "i", "s"])

    parts = units.select("size", "e").mapInArrow(gather, "size int, i int, s array<double>")
    rows = parts.select("size", "i", F.posexplode("s").alias("j", "x")).groupBy("size", "i", "j").agg(F.sum("x").alias("x")).collect()  # size * size values
    out = {}
    for n in {r["size"] for r in rows}:
        c = np.zeros((n, n))
        for r in rows:
            if r["size"] == n:
                c[r["i"], r["j"]] = r["x"]
        out[n] = np.linalg.eigh(c)[1][:, ::-1][:, :dims]
    return out


def grid(units: DataFrame, axes: dict[int, np.ndarray], eps: float, dims: int = DIMS) -> DataFrame:
    """Adds the cells on the leading axes (g0, g1, ...), and as bytes the places there and the vector normalised."""

    def run(batches):
        for b in batches:
            sizes = b.column(1).to_numpy()
            places = np.zeros((b.num_rows, dims))
            packed: list[bytes] = [b""] * b.num_rows
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                m = _matrix(b.column(2).filter(pa.array(sizes == n)), int(n))
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
                p = m @ axes[int(n)]
                places[at, : p.shape[1]] = p
                for i, row in zip(at, m, strict=True):
                    packed[i] = row.tobytes()
            cells = np.floor(places / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), b.column(4), *(pa.array(cells[:, k]) for k in range(dims)), pa.array([x.tobytes() for x in places], pa.binary()), pa.array(packed, pa.binary())],
                names=["label", "size", "rep", "copies", *(f"g{k}" for k in range(dims)), "p", "v"],
            )

    kind = dict(units.dtypes)
    schema = f"label {kind['label']}, size int, rep {kind['rep']}, copies long, " + ", ".join(f"g{k} int" for k in range(dims)) + ", p binary, v binary"
    return units.select("label", "size", "e", "rep", "copies").mapInArrow(run, schema)


def blocks(gridded: DataFrame, dims: int = DIMS, block: int = BLOCK) -> DataFrame:
    """One row for each run of up to `block` vectors of a label in grid order, with the box around it."""
    order = ["label", "size", *(f"g{k}" for k in range(dims)), "rep"]
    label_kind, rep_kind = dict(gridded.dtypes)["label"], dict(gridded.dtypes)["rep"]

    def pack(batches):
        held: list[pa.RecordBatch] = []

        def full(t: pa.Table, last: bool):
            """Blocks of whole (label, size) runs; what may go on is kept unless it is the last."""
            key = np.rec.fromarrays([t["label"].to_numpy(), t["size"].to_numpy()])
            edges = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            done = 0
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                for i in range(a, z, block):
                    j = min(i + block, z)
                    if j == len(key) and not last and j - i < block:
                        return done
                    s = t.slice(i, j - i)
                    places = b"".join(s["p"].to_pylist())
                    p = np.frombuffer(places).reshape(-1, dims)
                    out.append((s["label"][0].as_py(), s["size"][0].as_py(), s["rep"].to_numpy().min(), p.min(0).tolist(), p.max(0).tolist(), j - i, np.asarray(s["rep"].to_numpy(), np.int64).tobytes(), np.asarray(s["copies"].to_numpy(), np.int64).tobytes(), places, b"".join(s["v"].to_pylist())))
                    done = j
            return done

        def emit():
            cols = list(zip(*out, strict=True))
            kinds = [None, pa.int32(), None, pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), *[pa.binary()] * 4]
            types = [schema_label, *kinds[1:2], pa.int64(), *kinds[3:]]
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=names)
            out.clear()
            return b

        out: list[tuple] = []
        schema_label = None
        for b in batches:
            schema_label = b.schema.field("label").type
            held.append(b)
            if sum(x.num_rows for x in held) >= 4 * block:
                t = pa.Table.from_batches(held)
                done = full(t, False)
                held = t.slice(done).combine_chunks().to_batches()
                if out:
                    yield emit()
        if held:
            t = pa.Table.from_batches(held)
            if t.num_rows:
                full(t, True)
            if out:
                yield emit()

    names = ["label", "size", "block", "low", "high", "n", "reps", "copies", "p", "v"]
    ranged = gridded.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(pack, f"label {label_kind}, size int, block long, low array<double>, high array<double>, n int, reps binary, copies binary, p binary, v binary")


def _compare(a: dict, b: dict, same: bool, threshold: float, eps: float):
    """Links between two sequences: counts on both sides, and a spanning forest of the links."""
    na, nb = len(a["reps"]), len(b["reps"])
    count_a, count_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    root = list(range(na + (0 if same else nb)))
    shift = 0 if same else na

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def interval(i0: int, i1: int, j0: int, j1: int) -> None:
        if same and j1 <= i0:
            return
        p, q = a["p"][i0:i1], b["p"][j0:j1]
        apart = np.maximum(np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)), 0)
        if apart @ apart > (eps + SLACK) ** 2:
            return
        if max(i1 - i0, j1 - j0) > LEAF:
            if i1 - i0 >= j1 - j0:
                mid = (i0 + i1) // 2
                interval(i0, mid, j0, j1)
                interval(mid, i1, j0, j1)
            else:
                mid = (j0 + j1) // 2
                interval(i0, i1, j0, mid)
                interval(i0, i1, mid, j1)
            return
        hit = a["v"][i0:i1] @ b["v"][j0:j1].T >= threshold
        if same:
            hit &= np.arange(i0, i1)[:, None] < np.arange(j0, j1)[None, :]
        i, j = np.nonzero(hit)
        if not len(i):
            return
        i, j = i + i0, j + j0
        np.add.at(count_a, i, b["copies"][j])
        np.add.at(count_b, j, a["copies"][i])
        for x, y in zip(i.tolist(), (j + shift).tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)

    interval(0, na, 0, nb)
    reps = a["reps"] if same else np.concatenate((a["reps"], b["reps"]))
    counts = count_a + count_b if same else np.concatenate((count_a, count_b))
    at = np.flatnonzero(counts)
    return reps[at], reps[[find(int(x)) for x in at]], counts[at]


def join_blocks(blocks_: DataFrame, threshold: float, eps: float) -> DataFrame:
    """(rep, other, n): links of rep to vectors of block joins, and one vector they join it to."""
    meta = blocks_.select("label", "size", "block", "low", "high")
    cell = lambda x: F.floor(x / F.lit(eps)).cast("int")
    low = meta.select("label", "size", F.col("block").alias("b1"), F.col("low").alias("low1"), F.col("high").alias("high1"), F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]))).alias("c"))
    high = meta.select("label", "size", F.col("block").alias("b2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(F.sequence(cell(F.col("low")[0]) - 1, cell(F.col("high")[0]) + 1)).alias("c"))
    gap = lambda x: F.greatest(x["low1"] - x["high2"], x["low2"] - x["high1"], F.lit(0.0))
    apart = F.aggregate(F.arrays_zip("low1", "high1", "low2", "high2"), F.lit(0.0), lambda s, x: s + gap(x) * gap(x))
    pairs = low.join(high, ["label", "size", "c"]).where((F.col("b1") <= F.col("b2")) & (apart <= (eps + SLACK) ** 2)).select("label", "size", "b1", "b2").distinct()
    side = lambda k: blocks_.select("label", "size", F.col("block").alias(f"b{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("reps", "copies", "p", "v")))
    both = pairs.join(side(1), ["label", "size", "b1"]).join(side(2), ["label", "size", "b2"])
    cols = ["size", "b1", "b2", *(f"{c}{k}" for k in (1, 2) for c in ("reps", "copies", "p", "v"))]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(i)[r].as_py() for i, c in enumerate(cols)}
                s = [{"reps": np.frombuffer(x[f"reps{k}"], np.int64), "copies": np.frombuffer(x[f"copies{k}"], np.int64), "p": np.frombuffer(x[f"p{k}"]).reshape(-1, DIMS), "v": np.frombuffer(x[f"v{k}"], np.float64).reshape(-1, x["size"])} for k in (1, 2)]
                rep, other, n = _compare(s[0], s[1], x["b1"] == x["b2"], threshold, eps)
                if len(rep):
                    yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(other), pa.array(n)], names=["rep", "other", "n"])

    return both.select(*cols).mapInArrow(run, "rep long, other long, n long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id) of each row of (vec_id, embedding, label)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    units = cut(unit_vectors(v))
    eps = float(np.sqrt(2 - 2 * threshold)) * (1 + 1e-9)
    links = cut(join_blocks(cut(blocks(grid(units, principal_axes(units), eps))), threshold, eps))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    # copies of one vector are linked with each other
    comp = components(links.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    of = cut(units.join(counts, "rep", "left").join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "digest", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    m = marked(v).select("vec_id", "ok", "digest")
    alone = m.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined(m.where("ok").drop("ok"), "digest", of, "copies").select("vec_id", "n_links", "component_id").unionAll(alone)


def op8_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return r.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS to_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.to_id = l.a),
c AS (SELECT id, min(to_id) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON vec_id = id LEFT JOIN n ON vec_id = a
"""
