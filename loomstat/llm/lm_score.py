"""Scores texts with a log-bilinear language model trained by noise-contrastive estimation.

Vocabulary and counts come from all training texts: blocks of texts send their words (hash
ranges, as packed arrays, one entry a word and block) to the tasks that own the ranges, which add
the counts up and send each block its words' totals.

Every word that training texts hold at least ``LEAST`` times is an entry with vectors of its own (only
above ``MOST_WORDS`` such words, what a task holds in memory, those above a higher count); all other
words share one entry, and the end of a text, which also stands before its beginning, is one.  The
entry of rank r by frequency is in class floor(sqrt(r)), so classes grow in number and in size with
the vocabulary.  A context q is the sum of the vectors of the two entries before, a table for each
position.  The probability of an entry is

    softmax over classes of (q . u + a)  *  softmax over the class's entries of (q . t + b)

with vectors u, t and biases a, b: log-bilinear twice, and normalised exactly by batched matrix products
whose cost is as the square root of the vocabulary.  A word of the shared entry has its smoothed share
(c + 1) of it, words that training texts don't hold together counting as one more word.

Vectors are learned by noise-contrastive estimation over all tokens of all training texts, with noise
classes drawn by frequency and noise words drawn from the class, all alike (its words are about equally
frequent).  Tasks that each take about
``SHARD_TOKENS`` tokens go through their texts and send the changes of the entries they touched to the
tasks that average them, weighted by how often each was touched; that ``PASSES`` times.

Defined results: null text is empty; an empty text is its end alone; a null id is held out or not as
the fold of null (never held out, never learned from); without training texts N = V = 0 and the
model is uniform over its two entries; equal rows are scored each; columns besides doc_id, text and
train are not read; a text of any length is scored whole, in the block that holds it.  The table must read
the same twice, as written tables do: a block is the same rows of the same partition.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, column, cut, fold_of, slices, table, texts_of, word_hashes, words

WIDTH, LEAST, MOST_WORDS, PASSES = 16, 5, 1 << 16, 1
BLOCK_BYTES, BUCKET_BYTES, SHARD_TOKENS = 8 << 20, 32 << 20, 1 << 23
#: Tokens of a training step, tokens that share noise classes, their number, noise words of a token, step size.
BATCH, RUN, SAMPLED, DRAWN, RATE = 4096, 64, 16, 2, 0.1
LEVELS = 256
#: Contexts that one matrix product scores: what it makes stays in a core's cache.
ROWS = 512


def _blocks(batches):
    """(block, ids, training flags, word hashes, words of each text) of rows up to the one that makes BLOCK_BYTES full."""
    part, number, held = TaskContext.get().partitionId(), 0, 0
    ids, flags, hashes, counts = [], [], [], []
    for b in batches:
        texts, b_ids, b_flags = column(b, "text"), column(b, "doc_id"), column(b, "train").to_numpy(zero_copy_only=False).astype(bool)
        upto, first = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while first < len(texts):
            begun = upto[first - 1] if first else 0
            stop = min(int(np.searchsorted(upto, begun + BLOCK_BYTES - held)) + 1, len(texts))
            for _, _, raw, offsets in slices(texts.slice(first, stop - first)):
                starts, ends, at = words(raw, offsets)
                hashes.append(word_hashes(raw, starts, ends))
                counts.append(np.diff(at))
            ids += b_ids[first:stop].to_pylist()
            flags.append(b_flags[first:stop])
            held, first = held + upto[stop - 1] - begun, stop
            if held >= BLOCK_BYTES:
                yield part << 24 | number, ids, np.concatenate(flags), np.concatenate(hashes), np.concatenate(counts)
                number, held, ids, flags, hashes, counts = number + 1, 0, [], [], [], []
    if ids:
        yield part << 24 | number, ids, np.concatenate(flags), np.concatenate(hashes), np.concatenate(counts)


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(4 * np.log2(counts), LEVELS - 1).astype(np.int64)


def word_totals(docs: DataFrame, bits: int) -> DataFrame:
    """Rows (block, bucket, totals) for each block and hash range, in order of the block's word hashes;
    and a row of each range (block null): n tokens and v words that training texts hold, its words of
    LEAST tokens (``known`` and ``known_counts``, packed), and how many of them are at each level of counts."""

    def send(batches):
        for block, _, flags, hashes, counts in _blocks(batches):
            distinct, inverse = np.unique(hashes, return_inverse=True)
            train = np.bincount(inverse[np.repeat(flags, counts)], minlength=len(distinct))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff((distinct >> U64(64 - bits)).astype(np.int64))) + 1, [len(distinct)])) if len(distinct) else np.zeros(1, np.int64)
            rows = [(block, int(distinct[i] >> U64(64 - bits)), distinct[i:j].tobytes(), train[i:j].astype(np.uint32).tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "bucket", "words", "counts"])

    def add(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_buffer(), U64) for x in t["words"]]
        sizes = [len(k) for k in keys]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.bincount(inverse, np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t["counts"]]), len(distinct)).astype(np.int64)
        often = c >= LEAST
        back = [x.astype(np.int64).tobytes() for x in np.split(c[inverse], np.cumsum(sizes)[:-1])]
        k = len(back)
        return pa.table({
            "block": pa.array([*t["block"].to_pylist(), None], pa.int64()), "bucket": pa.array([*t["bucket"].to_pylist(), None], pa.int32()), "totals": pa.array([*back, None], pa.binary()),
            "n": pa.array([None] * k + [int(c.sum())], pa.int64()), "v": pa.array([None] * k + [int((c > 0).sum())], pa.int64()),
            "known": pa.array([None] * k + [distinct[often].tobytes()], pa.binary()), "known_counts": pa.array([None] * k + [c[often].tobytes()], pa.binary()),
            "levels": pa.array([None] * k + [np.bincount(_level(c[often]), minlength=LEVELS).tolist()], pa.list_(pa.int64())),
        })

    sent = docs.mapInArrow(send, "block long, bucket int, words binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add, "block long, bucket int, totals binary, n long, v long, known binary, known_counts binary, levels array<long>")


def vocabulary(totals: DataFrame, most: int = MOST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words with vectors, by falling count."""
    ranges = totals.where("block is null")
    by_level = {r["level"]: r["words"] for r in ranges.select(F.posexplode("levels").alias("level", "words")).groupBy("level").agg(F.sum("words").alias("words")).collect()}  # LEVELS rows
    lowest, n = LEVELS, 0
    while lowest > 0 and n + by_level.get(lowest - 1, 0) <= most:
        lowest, n = lowest - 1, n + by_level.get(lowest - 1, 0)

    def often(batches):
        for b in batches:
            for w, c in zip(column(b, "known"), column(b, "known_counts"), strict=True):
                w, c = np.frombuffer(w.as_buffer(), U64), np.frombuffer(c.as_buffer(), np.int64)
                keep = _level(c) >= lowest
                yield pa.RecordBatch.from_arrays([pa.array([w[keep].tobytes()], pa.binary()), pa.array([c[keep].tobytes()], pa.binary())], names=["known", "known_counts"])

    rows = ranges.select("known", "known_counts").mapInArrow(often, "known binary, known_counts binary").collect()  # 16 bytes a word, `most` words at most
    word, count = (np.concatenate([np.frombuffer(r[k], t) for r in rows] or [np.zeros(0, t)]) for k, t in (("known", U64), ("known_counts", np.int64)))
    top = np.lexsort((word, -count))
    return word[top], count[top]


def _with_ends(values: np.ndarray, counts: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """values with `end` after each text's, and the places of the ends."""
    ends = np.cumsum(counts + 1) - 1
    out = np.full(len(values) + len(counts), end, values.dtype)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = values
    return out, ends


def _contexts(classes: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The entry two places before each token, and the one before it; `end` before the first."""
    one, two = np.full(len(classes), end), np.full(len(classes), end)
    one[1:] = classes[:-1]
    two[2:] = classes[:-2]
    starts = np.concatenate(([0], ends[:-1] + 1))
    two[starts] = end
    after = starts[starts + 1 < len(classes)] + 1
    two[after] = end
    return two, one


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -30, 30)))


def _sum_rows(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of `at`, the sum of each one's rows, and their number."""
    order = np.argsort(at, kind="stable")
    s = at[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[first], np.add.reduceat(rows[order], first), np.diff(first, append=len(s))


#: Columns of each part of a row of Model.p: two places before, one place before, as target with its bias.
PARTS = ((0, WIDTH), (WIDTH, 2 * WIDTH), (2 * WIDTH, 3 * WIDTH + 1))


@dataclass
class Model:
    """Entries are words by falling frequency, then all other words, then the end of a text."""

    words: np.ndarray  # sorted hashes
    entry: np.ndarray  # of each of them
    class_of: np.ndarray  # of each entry
    low: np.ndarray  # first entry of each class, and the number of entries behind
    class_below: np.ndarray  # sums of the frequencies of classes up to each
    class_noise: np.ndarray  # log of SAMPLED times each class's frequency
    noise: np.ndarray  # log of DRAWN over each class's number of entries
    p: np.ndarray  # a row for each entry and, behind them, each class (only as target)

    @property
    def other(self) -> int:
        return len(self.class_of) - 2

    @property
    def end(self) -> int:
        return len(self.class_of) - 1

    def entries(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), self.other, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.entry[at], self.other)

    def contexts(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return self.p[two, :WIDTH] + self.p[one, WIDTH : 2 * WIDTH]

    def log_probability(self, two: np.ndarray, one: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised natural log of the probability of each target entry after the two before it."""
        out, w, classes = np.zeros(len(target)), WIDTH, self.p[len(self.class_of) :, 2 * WIDTH :]
        u = np.ascontiguousarray(classes[:, :w].T)
        for i in range(0, len(target), 1 << 16):
            t = target[i : i + (1 << 16)]
            c, q, got = self.class_of[t], self.contexts(two[i : i + len(t)], one[i : i + len(t)]), np.zeros(len(t))
            for k in range(0, len(t), ROWS):
                got[k : k + ROWS] = _log_softmax(q[k : k + ROWS] @ u + classes[:, w], c[k : k + ROWS])
            order = np.argsort(c, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], c[order][1:] != c[order][:-1])))
            for rows in np.split(order, first[1:]):
                a, z = self.low[c[rows[0]]], self.low[c[rows[0]] + 1]
                if z - a > 1:
                    of = self.p[a:z, 2 * w :]
                    for k in range(0, len(rows), ROWS):
                        r = rows[k : k + ROWS]
                        got[r] += _log_softmax(q[r] @ of[:, :w].T + of[:, w], t[r] - a)
            out[i : i + len(t)] = got
        return out


def _log_softmax(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row, the log of the softmax at one place; s is used up."""
    s -= s.max(1, keepdims=True)
    own = s[np.arange(len(s)), at].astype(float)
    return own - np.log(np.exp(s, out=s).sum(1))


def untrained(words: np.ndarray, counts: np.ndarray, others: int, ends: int, seed: int = 5) -> Model:
    """The model whose probabilities are smoothed frequencies, in any context; words come by falling count."""
    order, n = np.argsort(words), len(words)
    class_of = np.append(np.sqrt(np.arange(n)).astype(np.int64), [0, 0])
    class_of[n:] = (class_of[n - 1] if n else -1) + np.array([1, 2])
    low = np.searchsorted(class_of, np.arange(class_of[-1] + 2))
    f = np.concatenate((counts, [others, ends])) + 1.0
    f /= f.sum()
    of_class = np.add.reduceat(f, low[:-1])
    share = f / of_class[class_of]
    p = np.zeros((n + 2 + len(of_class), 3 * WIDTH + 1), np.float32)
    p[: n + 2, : 2 * WIDTH] = np.random.default_rng(seed).normal(0, 0.3, (n + 2, 2 * WIDTH))
    p[:, -1] = np.log(np.concatenate((share, of_class)))
    return Model(words[order], order, class_of, low, np.cumsum(of_class), np.log(SAMPLED * of_class).astype(np.float32), np.log(DRAWN / np.diff(low)).astype(np.float32), p)


def learn(m: Model, p: np.ndarray, square: np.ndarray, touched: np.ndarray, two: np.ndarray, one: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
    """Changes p by one batch; square and touched hold sums of each row's three parts.

    RUN tokens share SAMPLED noise classes, and each token has DRAWN noise words of its class.  Steps are
    scaled by the size of gradients, so noise must not come in much larger portions than occurrences do.
    """
    w, size = WIDTH, min(RUN, len(target))
    if full := len(target) % size:  # a last run that isn't full is a batch of its own
        learn(m, p, square, touched, two[-full:], one[-full:], target[-full:], rng)
        two, one, target = two[:-full], one[:-full], target[:-full]
    qb = np.column_stack((p[two, :w] + p[one, w : 2 * w], np.ones(len(two), np.float32)))
    c, first_class = m.class_of[target], len(m.class_of)
    drawn = np.minimum(np.searchsorted(m.class_below, rng.random((len(target) // size, SAMPLED))), len(m.class_below) - 1)
    t, n = p[first_class + c, 2 * w :], p[first_class + drawn, 2 * w :]
    runs = qb.reshape(-1, size, w + 1)
    e = -_sigmoid(m.class_noise[c] - np.einsum("ij,ij->i", qb, t))
    f = _sigmoid(runs @ n.transpose(0, 2, 1) - m.class_noise[drawn][:, None, :])
    gq = e[:, None] * t[:, :w] + (f @ n[:, :, :w]).reshape(-1, w)
    at, g = [first_class + c, first_class + drawn.ravel()], [e[:, None] * qb, (f.transpose(0, 2, 1) @ runs).reshape(-1, w + 1)]
    some = np.flatnonzero(m.low[c + 1] - m.low[c] > 1)
    if len(some):
        target, qb, c = target[some], qb[some], c[some]
        words_ = m.low[c][:, None] + (rng.random((len(c), DRAWN), np.float32) * (m.low[c + 1] - m.low[c])[:, None]).astype(np.int64)
        t, n = p[target, 2 * w :], p[words_, 2 * w :]
        e = -_sigmoid(m.noise[c] - np.einsum("ij,ij->i", qb, t))
        f = _sigmoid(np.einsum("ikj,ij->ik", n, qb) - m.noise[c][:, None])
        gq[some] += e[:, None] * t[:, :w] + np.einsum("ik,ikj->ij", f, n[:, :, :w])
        at += [target, words_.ravel()]
        g += [e[:, None] * qb, (f[:, :, None] * qb[:, None, :]).reshape(-1, w + 1)]
    for part, rows, change in ((0, two, gq), (1, one, gq), (2, np.concatenate(at), np.concatenate(g))):
        low, high = PARTS[part]
        row, change, k = _sum_rows(rows, change)
        square[row, part] += (change * change).mean(1)
        touched[row, part] += k
        p[row, low:high] -= RATE * change / np.sqrt(square[row, part, None] + 1e-6)


def train_pass(docs: DataFrame, m: Model, shards: int, bits: int, number: int) -> np.ndarray:
    """The vectors after one pass of `shards` tasks over their training texts from m's."""
    shared = docs.sparkSession.sparkContext.broadcast(m)  # 220 bytes an entry, MOST_WORDS entries

    def run(batches):
        m, part = shared.value, TaskContext.get().partitionId()
        rng = np.random.default_rng((number, part))
        p, square, touched = m.p.copy(), np.zeros((len(m.p), 3), np.float32), np.zeros((len(m.p), 3), np.float32)
        for _, _, flags, hashes, counts in _blocks(batches):
            distinct, inverse = np.unique(hashes[np.repeat(flags, counts)], return_inverse=True)
            tokens, ends = _with_ends(m.entries(distinct)[inverse], counts[flags], m.end)
            if not len(tokens):
                continue
            two, one = _contexts(tokens, ends, m.end)
            order = rng.permutation(len(tokens))
            for i in range(0, len(order), BATCH):
                at = order[i : i + BATCH]
                learn(m, p, square, touched, two[at], one[at], tokens[at], rng)
        for kind, (low, high) in enumerate(PARTS):
            hit = np.flatnonzero(touched[:, kind])
            bucket = hit & ((1 << bits) - 1)
            for k in np.unique(bucket):
                at = hit[bucket == k]
                change = (p[at, low:high] - m.p[at, low:high]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (k, pa.int32()), (kind, pa.int32()), (at.astype(np.uint32).tobytes(), pa.binary()), (change.tobytes(), pa.binary()), (touched[at, kind].tobytes(), pa.binary()))], names=["part", "bucket", "kind", "at", "change", "touched"])

    def average(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        at = [np.frombuffer(x.as_buffer(), np.uint32) for x in t["at"]]
        row = np.unique(np.concatenate(at))
        kind = t["kind"][0].as_py()
        total, weight = np.zeros((len(row), PARTS[kind][1] - PARTS[kind][0])), np.zeros((len(row), 1))
        for a, change, touched in zip(at, t["change"], t["touched"], strict=True):
            k, n = np.searchsorted(row, a), np.frombuffer(touched.as_buffer(), np.float32)[:, None]
            total[k] += np.frombuffer(change.as_buffer(), np.float16).reshape(len(a), -1) * n
            weight[k] += n
        return pa.table({"kind": pa.array([kind], pa.int32()), "at": pa.array([row.tobytes()], pa.binary()), "change": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())})

    sent = docs.coalesce(shards).mapInArrow(run, "part int, bucket int, kind int, at binary, change binary, touched binary")
    out = m.p.copy()
    for r in sent.groupBy("bucket", "kind").applyInArrow(average, "kind int, at binary, change binary").collect():  # at most 4 bytes a number of MOST_WORDS entries
        at, (low, high) = np.frombuffer(r["at"], np.uint32), PARTS[r["kind"]]
        out[at, low:high] += np.frombuffer(r["change"], np.float32).reshape(len(at), -1)
    shared.destroy()
    return out


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of (doc_id, text, train)."""
    spark = docs.sparkSession
    d = docs.select("doc_id", "text", "train")
    size = d.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    n_docs = size[1] or 0
    bits = max(5, min(22, math.ceil(math.log2((size[0] or 0) / BUCKET_BYTES + 1))))
    totals = cut(word_totals(d, bits))
    row = totals.where("block is null").agg(F.sum("n"), F.sum("v")).first()
    n, v = (row[0] or 0) + n_docs, (row[1] or 0) + (n_docs > 0)
    word, count = vocabulary(totals)
    others = n - n_docs - int(count.sum())
    # the share of a word in the entry of all other words: (c + 1) / rest, one share left for unknown words
    rest = others + (v - (n_docs > 0) - len(word)) + 1
    log_all, log_rest = math.log10(n + v + 1), math.log10(max(rest, 1))
    m = untrained(word, count, others, n_docs)
    for number in range(PASSES if n else 0):
        m.p = train_pass(d.where("train"), m, math.ceil(n / SHARD_TOKENS), 5, number)
    shared = spark.sparkContext.broadcast(m)  # 220 bytes an entry, MOST_WORDS entries

    def tokens(batches):
        for block, ids, _, hashes, counts in _blocks(batches):
            distinct, inverse = np.unique(hashes, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts.astype(np.int64)], pa.list_(pa.int64())), pa.array([inverse.astype(np.uint32).tobytes()], pa.binary()), pa.array([shared.value.entries(distinct).astype(np.uint32).tobytes()], pa.binary())],
                names=["block", "ids", "counts", "tokens", "entries"],
            )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shared.value
        out = {k: [] for k in ("doc_id", "n_tokens", "n_known", "base_score", "score")}
        right = right.sort_by("bucket")
        total = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in right["totals"]]) if len(right) else np.zeros(0, np.int64)
        for k in range(len(left)):
            ids, counts = left["ids"][k].as_py(), np.asarray(left["counts"][k].values, np.int64)
            of, entries = np.frombuffer(left["tokens"][k].as_buffer(), np.uint32), np.frombuffer(left["entries"][k].as_buffer(), np.uint32).astype(np.int64)
            if len(total) != len(entries):
                raise RuntimeError("the table came in other partitions or another order at its second read; write it before")
            token, ends = _with_ends(entries[of], counts, m.end)
            two, one = _contexts(token, ends, m.end)
            base, _ = _with_ends((np.log10(total + 1) - log_all)[of], counts, math.log10(n_docs + 1) - log_all)
            inner, _ = _with_ends(np.where(entries == m.other, np.log10(total + 1) - log_rest, 0.0)[of], counts, 0.0)
            known, _ = _with_ends((total > 0).astype(np.int64)[of], counts, int(n_docs > 0))
            full = m.log_probability(two, one, token) / math.log(10) + inner
            starts = np.concatenate(([0], ends[:-1] + 1))
            out["doc_id"] += ids
            out["n_tokens"].append(counts + 1)
            for name, x in (("n_known", known), ("base_score", base), ("score", full)):
                out[name].append(np.add.reduceat(x, starts))
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), **{k: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64 if k.startswith("n_") else float)) for k, x in out.items() if k != "doc_id"}})

    blocks = d.mapInArrow(tokens, "block long, ids array<long>, counts array<long>, tokens binary, entries binary")
    back = totals.where("block is not null").select("block", "bucket", "totals")
    s = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return s.withColumn("train_tokens", F.lit(int(n)).cast("long"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts_of(table(spark, sf_dir, "documents")).withColumn("train", F.coalesce(fold_of("doc_id", 7) != 2, F.lit(False)))
    s = score_texts(docs)
    return s.select("doc_id", (fold_of("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
