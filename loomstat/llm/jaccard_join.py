"""Exact Jaccard similarity join of word-shingle sets, in the metric space of Jaccard distance.

d = 1 - J is a metric, and texts without a common shingle are at distance exactly 1.  In a corpus
nearly all pairs are, so pivots alone would see every text as equally far.  Regions therefore begin
as the sets that share a rare shingle, and pivots divide those:

1. *Anchors.*  Shingles are ordered from rare to frequent over the whole corpus.  Sets with
   J >= t share one of the first  n - ceil(t n) + 1  shingles of either, so each set is a member
   of the regions of those only, and a set that has so many shingles of its own that none of these
   is shared has no link at all.  Of regions with the same members only the first in order stays.
2. *Pivots.*  Each region's first pivot is its smallest member, later ones are chosen among the
   members outside the region's largest component.  A pivot is compared with all members of its region
   that sketches, sizes and the place of the common anchor allow to be within r = 1 - t.
3. *Voronoi regions and windows.*  A member within r of pivots that isn't in the region's largest
   component by then goes from its region to that of the nearest.  Whatever is within r of such a member is within 2 r of the pivot (triangle inequality), so
   all members that may be that near are replicated to the pivot's region as its boundary; only pairs
   with a member that isn't boundary are compared there.  The others stay in the region they are in.
4. *Recursion.*  Pivots, which have met every member, go; regions whose members are all in one
   component are done; the others get new pivots.  In regions of up to WORK comparisons (eight times as
   many each round) all members outside the largest component are pivots at once, which ends them.

Only connections matter, so pairs already connected are not compared; no link between different
components is skipped.  Near copies share many regions: a pair is compared in the first one a round where either is a
pivot.  Equal sets are one class from the start.

Rare-to-frequent order needs the number of sets that hold each shingle.  Blocks of texts send their
shingles (hash ranges, as packed arrays) to the tasks that own the ranges and get back those that
others have too, with the power of two of their frequency.  A shingle that several texts of a block
share is sent once, with its count, so frequent shingles cost a row a block.  Ranges are as many as
the corpus needs for BUCKET_BYTES each.  Only shared shingles come back, so that of the others a block keeps
no more than their number.  The files of these exchanges are given up before links are sought.

Defined results: null text is empty; a text without words has no shingles, no links and is its own
component; a text of fewer words than a shingle is one shingle; equal rows are linked; rows with
equal ids count as rows of one component each; columns besides doc_id and text are not read; a text of
any length is shingled whole, in the block that holds it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, column, cut, forget, joined, mix, release, slices, table, texts_of, windows, word_hashes, words
from .components import components

SHINGLE, PERCENT, WORK = 5, 75, 1 << 14
BLOCK_BYTES, BLOCK_SETS, BUCKET_BYTES = 8 << 20, 0x7FFF, 16 << 20
MANY = 0x8000
SKETCH_BITS = 512
#: Regions of a set, in order, by which it is seen that a pair meets elsewhere too.
KEYS = 64


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, first = words(raw, offsets)
    h = word_hashes(raw, starts, ends)
    s, at = windows(h, first, size)
    bounds = np.searchsorted(at, first)
    out = []
    for i in range(len(first) - 1):
        if first[i + 1] - first[i] >= size:
            out.append(np.unique(s[bounds[i] : bounds[i + 1]]))
        elif first[i + 1] > first[i]:  # the whole sequence is the one shingle
            out.append(windows(h[first[i] : first[i + 1]], np.array([0, first[i + 1] - first[i]]), int(first[i + 1] - first[i]))[0])
        else:
            out.append(np.zeros(0, U64))
    return out


def fingerprint(s: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s + U64(len(s))).sum(dtype=U64)]))[0].view(np.int64)) if len(s) else 0


PARTS = "abcdef"
PACKED = "block long, bucket long, " + ", ".join(f"{p} binary" for p in PARTS)


def _row(block: int, bucket: int, *parts: np.ndarray) -> tuple:
    return (block, bucket, *(p.tobytes() for p in parts), *[None] * (len(PARTS) - len(parts)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * len(PARTS)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=["block", "bucket", *PARTS])


def _planes(keys: np.ndarray, bits: int) -> np.ndarray:
    """What the range of `bits` doesn't tell of each key, all keys' first bytes, then all second ones: the high bytes
    of ascending keys repeat, and so compress."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, : (64 - bits + 7) // 8].T)


def _keys(planes, bucket: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(planes, np.uint8).reshape((64 - bits + 7) // 8, -1)
    full = np.zeros((raw.shape[1], 8), np.uint8)
    full[:, : len(raw)] = raw.T
    return full.view(U64).ravel() & U64((1 << (64 - bits)) - 1) | U64(bucket << (64 - bits))


def _block_rows(block: int, docs: list[tuple[int | None, int, int]], sets: dict[int, np.ndarray], bits: int) -> list[tuple]:
    """What a block of texts sends: its own row (bucket < 0), and its shingles by hash range."""
    ids = np.array([0 if d is None else d for d, _, _ in docs], np.int64)
    rest = np.array([(d is None, n, fp) for d, n, fp in docs], np.int64)
    fps = np.fromiter(sets, np.int64, len(sets))
    sizes = np.fromiter((len(s) for s in sets.values()), np.int64, len(sets))
    full = np.concatenate([*sets.values(), np.zeros(0, U64)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(full, kind="stable")
    full, owner = full[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], full[1:] != full[:-1]))) if len(full) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(full)))
    many = count > 1
    inside = np.repeat(many, count)
    full = full[first]
    value = np.where(many, MANY | np.minimum(count, MANY - 1), owner[first]).astype(np.uint16)
    home = _row(block, -1 - block, ids, rest, fps, sizes, count[many].astype(np.int32), owner[inside].astype(np.uint16))
    bucket = (full >> U64(64 - bits)).astype(np.int64)
    cuts = np.concatenate((np.flatnonzero(np.diff(bucket, prepend=-1)), [len(full)]))
    return [home] + [_row(block, int(bucket[i]), _planes(full[i:j], bits), value[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def shingle_blocks(docs: DataFrame, bits: int, size: int = SHINGLE) -> DataFrame:
    def run(batches):
        part, number, held, ids, sets = TaskContext.get().partitionId(), 0, 0, [], {}
        for b in batches:
            doc_id = column(b, "doc_id").to_pylist()
            for first, last, raw, offsets in slices(column(b, "text")):
                for d, s in zip(doc_id[first:last], shingle_sets(raw, offsets, size), strict=True):
                    fp = fingerprint(s)
                    ids.append((d, len(s), fp))
                    if len(s):
                        sets[fp] = s
                    if len(ids) >= BLOCK_SETS:
                        yield _batch(_block_rows(part << 24 | number, ids, sets, bits))
                        number, held, ids, sets = number + 1, 0, [], {}
                held += len(raw)
                if held >= BLOCK_BYTES and ids:
                    yield _batch(_block_rows(part << 24 | number, ids, sets, bits))
                    number, held, ids, sets = number + 1, 0, [], {}
        if ids:
            yield _batch(_block_rows(part << 24 | number, ids, sets, bits))

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def _shared(bits: int):
    def run(t: pa.Table) -> pa.Table:
        """Of one hash range: for each block its shingles that more than one set holds, with log2 of how many."""
        if t["bucket"][0].as_py() < 0:
            return t.select(["block", "bucket", *PARTS])
        blocks, bucket = t["block"].to_pylist(), t["bucket"][0].as_py()
        keys = [_keys(x.as_buffer(), bucket, bits) for x in t["a"]]
        values = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in t["b"]])
        row = np.repeat(np.arange(len(blocks), dtype=np.int32), [len(k) for k in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        keys, values, row = keys[order], values[order], row[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        held = np.add.reduceat(np.where(values & MANY, values & (MANY - 1), 1).astype(np.int64), first)
        total = np.repeat(held, np.diff(np.append(first, len(keys))))
        keep = total > 1
        keys, values, row = keys[keep], values[keep], row[keep]
        level = np.log2(total[keep]).astype(np.uint8)
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(len(blocks) + 1))
        rows = [_row(b, bucket, _planes(keys[o], bits), values[o], level[o]) for b, i, j in zip(blocks, cuts[:-1], cuts[1:], strict=True) if j > i and (o := order[i:j]) is not None]
        return pa.Table.from_batches([_batch(rows)])

    return run


SETS = "doc_id long, n_shingles long, fp long, own int, anchors array<long>, sketch array<long>, keys binary"


def _candidates(percent: int, bits: int):
    def home(t: pa.Table) -> pa.Table:
        """Rows (doc_id, n_shingles, fp) of a block's texts, and with no doc_id but the other columns those of
        its sets that may have links: anchors from rare to frequent, and all shared shingles."""
        own = next(r for r in t.to_pylist() if r["bucket"] < 0)
        ids, rest = np.frombuffer(own["a"], np.int64), np.frombuffer(own["b"], np.int64).reshape(-1, 3)
        out = {"fp": [], "n_shingles": [], "own": [], "anchors": [], "sketch": [], "keys": []}
        back = [r for r in t.to_pylist() if r["bucket"] >= 0]
        if back:
            fps, sizes, m_count, m_owner = (np.frombuffer(own[k], kind) for k, kind in (("c", np.int64), ("d", np.int64), ("e", np.int32), ("f", np.uint16)))
            keys = np.concatenate([_keys(r["a"], r["bucket"], bits) for r in back])
            values = np.concatenate([np.frombuffer(r["b"], np.uint16) for r in back])
            level = np.concatenate([np.frombuffer(r["c"], np.uint8) for r in back])
            # a shingle of several sets of the block comes back to all of them; home has counted those in order of their hashes
            many = np.flatnonzero(values & MANY)
            spread = np.concatenate(([0], np.cumsum(m_count)))
            rank = np.argsort(np.argsort(keys[many]))
            if len(many) != len(m_count):
                raise RuntimeError("shared shingles of a block are missing")
            n = m_count[rank]
            where = np.repeat(spread[rank] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
            one = np.flatnonzero(values & MANY == 0)
            owner = np.concatenate((values[one].astype(np.int64), m_owner[where].astype(np.int64)))
            level = np.concatenate((level[one], np.repeat(level[many], n)))
            keys = np.concatenate((keys[one], np.repeat(keys[many], n)))
            order = np.lexsort((mix(keys), level, owner))
            owner, keys = owner[order], keys[order]
            cuts = np.searchsorted(owner, np.arange(len(fps) + 1))
            shared = np.diff(cuts)
            need = (percent * sizes + 99) // 100
            anchors = np.minimum(sizes - need + 1 - (sizes - shared), shared)
            for i in np.flatnonzero((anchors > 0) & (100 * shared >= percent * sizes)):
                k = keys[cuts[i] : cuts[i + 1]]
                out["fp"].append(int(fps[i]))
                out["n_shingles"].append(int(sizes[i]))
                out["own"].append(int(sizes[i] - shared[i]))
                out["anchors"].append(k[: anchors[i]].astype(np.int64))
                odd = np.bincount((mix(k) & U64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
                out["sketch"].append(np.packbits(odd.astype(bool)).view(np.int64))
                out["keys"].append(np.sort(k).tobytes())
        none = [None] * len(ids)
        return pa.table({
            "doc_id": pa.array(np.concatenate((ids, np.zeros(len(out["fp"]), np.int64))), mask=np.concatenate((rest[:, 0] == 1, np.zeros(len(out["fp"]), bool)))),
            "n_shingles": pa.array([*rest[:, 1].tolist(), *out["n_shingles"]], pa.int64()), "fp": pa.array([*rest[:, 2].tolist(), *out["fp"]], pa.int64()), "own": pa.array([*none, *out["own"]], pa.int32()),
            "anchors": pa.array([*none, *out["anchors"]], pa.list_(pa.int64())), "sketch": pa.array([*none, *out["sketch"]], pa.list_(pa.int64())), "keys": pa.array([*none, *out["keys"]], pa.binary()),
        })

    return home


def texts_and_sets(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """A table of columns SETS.  A row of each text: doc_id, n_shingles and fp.  And rows with keys, of sets that may have links:
    own, shingles that no other set holds; keys, all others, packed and sorted; sketch, their parities by hash."""
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, min(24, math.ceil(math.log2(text_bytes / BUCKET_BYTES + 1))))  # a shingle takes about as many bytes as its word
    shared = cut(shingle_blocks(docs, bits, size).groupBy("bucket").applyInArrow(_shared(bits), PACKED))
    release(docs.sparkSession)  # all that blocks have sent, before what came back moves on
    every = cut(shared.groupBy("block").applyInArrow(_candidates(percent, bits), SETS))
    forget(shared)
    release(docs.sparkSession)
    return every


def measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The columns of pairs (a, b and others, all long), and na, nb and overlap, of distinct pairs of sets."""
    extra = [c for c in pairs.columns if c not in ("a", "b")]

    def run(batches):
        for b in batches:
            both = zip(column(b, "ka"), column(b, "kb"), strict=True)
            n = []
            for x, y in both:
                k = np.concatenate((np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)))
                k.sort()
                n.append(int((k[1:] == k[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("a", "b", *extra, "na", "nb")), pa.array(n, pa.int64())], names=["a", "b", *extra, "na", "nb", "overlap"])

    side = lambda k: sets.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("keys").alias(f"k{k}"))
    return pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a").select("a", "b", *extra, "na", "nb", "ka", "kb").mapInArrow(run, "a long, b long, " + "".join(f"{c} long, " for c in extra) + "na int, nb int, overlap long")


def _possible(n1, p1, n2, p2, percent: int):
    """Whether sizes, and the places of the first common shingle, allow a link."""
    most = F.least(n1 - p1, n2 - p2)
    return (100 * most >= percent * (n1 + n2 - most)) & (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))


def _within(percent: int, times: int = 1):
    """Whether what is known of two sets allows a distance of `times` (1 or 2) r: the parities that differ, and the
    shingles that each has alone, are a lower bound of the size of their symmetric difference."""
    differ = " + ".join(f"bit_count(sketch1[{i}] ^ sketch2[{i}])" for i in range(SKETCH_BITS // 64))
    return F.expr(f"{100 + percent if times == 1 else percent} * (own1 + own2 + {differ}) <= {100 - percent} * (n1 + n2)")


def _still_open(m: DataFrame, turn: int) -> DataFrame:
    """The regions whose members aren't all in one component c yet; main: their largest component.  One in `every`
    member outside it is to be a pivot: all of them if that takes up to `work` comparisons, else about work / size or
    sqrt(size), whichever is more.  First rounds connect most members with few comparisons; the rest need one with
    each other member, so later rounds do more."""
    each = m.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"))
    left = each.groupBy("key").agg(F.max(F.struct("k", "c")).alias("most"), F.sum("k").alias("size"))
    left = left.where("most.k < size").select("key", "size", F.col("most.c").alias("main"), F.expr("size - most.k").alias("others"))
    every = f"greatest(1L, cast(ceil(others / greatest(sqrt(size), {WORK * 8 ** min(turn, 4)} / size)) as long))"
    return m.join(left.withColumn("every", F.expr(every)), "key")


def link_classes(sets: DataFrame, percent: int = PERCENT) -> list[DataFrame]:
    """Tables (id, component), to be applied to fp one after the other: each names what a component is part of."""
    cell = sets.select("fp", "n", F.posexplode("anchors").alias("i", "key"), "own").select("key", "fp", "n", (F.col("own") + F.col("i")).alias("at"))
    # regions with the same members are one, and of their anchors the first in order counts: all members have it at the least place
    same = (F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("size"))
    keyed = cell.groupBy("key").agg(F.min(F.struct("fp", "n", "at")).alias("p"), F.sum("at").alias("places"), *same).where("size > 1")
    pivot = keyed.groupBy("x", "y", "size").agg(F.min_by(F.struct("key", "p"), F.struct("places", "key")).alias("k")).select("k.key", "k.p")
    member = cut(cell.join(pivot.hint("merge"), "key"))
    side = lambda k: sets.select(F.col("fp").alias(f"fp{k}"), F.col("own").alias(f"own{k}"), F.col("sketch").alias(f"sketch{k}")).hint("merge")
    first = member.where((F.col("fp") != F.col("p.fp")) & _possible(F.col("n"), F.col("at"), F.col("p.n"), F.col("p.at"), percent))
    first = first.select(F.col("fp").alias("fp1"), F.col("n").alias("n1"), F.col("p.fp").alias("fp2"), F.col("p.n").alias("n2")).distinct()
    first = first.join(side(1), "fp1").join(side(2), "fp2").where(_within(percent))
    is_link = F.expr(f"100 * overlap >= {percent} * (na + nb - overlap)")
    links = cut(measure(first.select(F.col("fp1").alias("a"), F.col("fp2").alias("b")), sets).where(is_link).select("a", "b"))
    steps = [components(links)]
    m = member.select("key", "fp", "n", "at", F.col("p.fp").alias("pivot")).join(steps[0].select(F.col("id").alias("fp"), "component"), "fp", "left")
    m = cut(m.select("key", "fp", "n", "at", "pivot", F.coalesce("component", "fp").alias("c")))
    m = _still_open(m, 0).where("fp <> pivot").drop("pivot").join(sets.select("fp", "own", "sketch").hint("merge"), "fp")  # first pivots have met all members
    opened, turn = cut(m.withColumn("boundary", F.lit(False))), 0
    forget(member, links)
    kept = ("fp", "n", "at", "c", "own", "sketch", "boundary")
    while not opened.isEmpty():
        turn += 1
        is_pivot = f"c <> main and pmod(xxhash64(fp, {turn}), every) = 0"
        sides = lambda x, y, more=(): (x.select("key", *(F.col(c).alias(f"{c}1") for c in (*kept, *more))), y.select(F.col("key").alias("k2"), *(F.col(c).alias(f"{c}2") for c in (*kept, *more))))
        # a pair that shares several regions is compared in the first where one of the two is a pivot, by the smaller if both are
        inside = F.expr(is_pivot)
        first_keys = lambda when: F.slice(F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("at", "key")))), lambda s: s["key"]), 1, KEYS)
        of_set = opened.where("not boundary").groupBy("fp").agg(first_keys(F.lit(True)).alias("member_in"), first_keys(inside).alias("pivot_in"))
        placed = opened.withColumn("pivot", inside).join(of_set, "fp", "left")
        x, y = sides(placed.where("pivot"), placed, ("member_in", "pivot_in", "pivot"))
        shared = F.get(F.array_intersect("pivot_in1", "member_in2"), F.lit(0))
        once = F.col("boundary1") | F.col("boundary2") | ((~F.col("pivot2") | (F.col("fp1") < F.col("fp2"))) & F.coalesce(shared == F.col("key"), F.lit(True)))
        near = _within(percent) & _possible(F.col("n1"), F.col("at1"), F.col("n2"), F.col("at2"), percent) & (F.col("c1") != F.col("c2")) & ~(F.col("boundary1") & F.col("boundary2"))
        met = cut(x.join(y, (F.col("key") == F.col("k2")) & near & once).select("key", "fp1", "fp2", "c1", "c2"))
        up = F.col("fp1") < F.col("fp2")
        ends = met.select(F.least("fp1", "fp2").alias("a"), F.greatest("fp1", "fp2").alias("b"), F.when(up, F.col("c1")).otherwise(F.col("c2")).alias("ca"), F.when(up, F.col("c2")).otherwise(F.col("c1")).alias("cb"))
        # the two components of a pair are the same wherever the pair is met
        links = cut(measure(ends.distinct(), sets).where(is_link))
        steps.append(components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
        # regions all of whose members outside the largest component were pivots are done
        rest = opened.where("every > 1").where(f"not ({is_pivot})")
        if rest.isEmpty():
            forget(opened, met, links)
            break
        now = steps[-1].select(F.col("id").alias("c"), F.col("component").alias("now"))
        rest = rest.join(now, "c", "left").withColumn("c", F.coalesce("now", "c")).drop("now")
        rest = cut(rest.join(now.select(F.col("c").alias("main"), F.col("now").alias("joined")), "main", "left").withColumn("main", F.coalesce("joined", "main")).drop("joined", "size", "others", "every"))
        # Members within r of pivots, if still outside the largest component, go to the nearest one's region, and all that
        # may be within 2 r of it are its boundary.  Boundary members stay: partners that leave take them along as boundary.
        d = links.select("a", "b", (1 - F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).alias("d"))
        paired = met.select("key", "fp1", F.col("fp2").alias("fp"), F.least("fp1", "fp2").alias("a"), F.greatest("fp1", "fp2").alias("b")).join(d, ["a", "b"])
        nearest = paired.join(rest.where("c <> main and not boundary").select("key", "fp"), ["key", "fp"], "left_semi").groupBy("key", "fp").agg(F.min_by("fp1", F.struct("d", "fp1")).alias("to"))
        nearest = cut(nearest)
        after = rest
        if not nearest.isEmpty():
            chosen = nearest.select("key", F.col("to").alias("fp")).distinct()
            x, y = sides(opened.where(is_pivot).join(chosen, ["key", "fp"], "left_semi"), rest)
            inside = x.join(y, (F.col("key") == F.col("k2")) & _within(percent, 2)).select("key", F.col("fp1").alias("to"), *(F.col(f"{c}2").alias(c) for c in kept if c != "boundary"))
            inside = inside.join(nearest.withColumn("own_region", F.lit(True)), ["key", "fp", "to"], "left")
            moved = inside.select(F.xxhash64("key", "to").alias("key"), *(c for c in kept if c != "boundary"), F.col("own_region").isNull().alias("boundary"))
            after = cut(rest.drop("main").join(nearest, ["key", "fp"], "left_anti").unionByName(moved))
        before, opened = opened, cut(_still_open(after.drop("main"), turn))
        forget(before, met, links, nearest, rest)
        release(sets.sparkSession)
    return steps


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text)."""
    every = texts_and_sets(docs, percent, size)
    of = cut(every.where("keys is null").select("doc_id", "n_shingles", "fp"))
    sets = cut(every.where("keys is not null").groupBy("fp").agg(F.first("n_shingles").cast("int").alias("n"), *(F.first(c).alias(c) for c in ("own", "anchors", "sketch", "keys"))))
    forget(every)
    release(docs.sparkSession)
    root = sets.select("fp", F.col("fp").alias("root"))
    for step in link_classes(sets, percent):
        root = root.join(step.select(F.col("id").alias("root"), "component"), "root", "left").select("fp", F.coalesce("component", "root").alias("root"))
    classes = of.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    classes = cut(classes.join(root, "fp", "left").select("fp", "rows", "least", F.coalesce("root", "fp").alias("root")))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut(classes.join(least, "root").select("fp", "rows", "component_id"))
    some = joined(of.where("n_shingles > 0"), "fp", classes, "rows").select("doc_id", "n_shingles", "component_id")
    forget(sets)
    return some.unionAll(of.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(texts_of(table(spark, sf_dir, "documents")))


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT row, array_to_string(CASE WHEN len(w) >= 5 THEN w[i:i + 4] ELSE w END, ' ') AS shingle FROM d, unnest(range(1, greatest(len(w) - 3, 2))) u(i) WHERE len(w) > 0),
n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
p AS (SELECT a.row AS a, b.row AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.row < b.row GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT row AS id, row AS at FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.at = e.a),
c AS (SELECT id, min(doc_id) AS component_id FROM r JOIN d ON d.row = r.at GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN c ON id = d.row LEFT JOIN n ON n.row = d.row
"""
