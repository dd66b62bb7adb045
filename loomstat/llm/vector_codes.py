"""Compression of vectors to codes of a product quantiser, with exact integer arithmetic.

Components become integers floor(scale * x); vectors are cut into equal consecutive parts, and each part is
coded by the nearest entry of its position's codebook (squared Euclidean distance, ties to the lower index).
Codebooks begin as the parts of the vectors of smallest ids and are replaced, `rounds` times, by the
componentwise floor of the mean of the parts assigned to each entry.

*Partial-distance search.*  A part's distances to all entries are added up a dimension at a time, dimensions
of the largest variance within the codebook first.  The entry that looks nearest so far is completed for each
part, which gives the best complete distance known; masks then drop all (part, entry) pairs whose
accumulated distance strictly exceeds it, so later dimensions are only read for what may still win or tie.

Tasks add up parts by entry (parts * entries rows a task leave it), sums are added by Spark, and the driver
holds only the codebooks: entries * length integers.

Defined results: vectors that are null, empty, hold null or non-finite components, or differ in length
from that of the smallest id are dropped, and so are all if that length isn't a multiple of `parts`; rows with
equal ids are rows of their own, in the order of their vectors where ids are taken in order; null ids come last;
rows with a null label share one label_error; codebooks of fewer vectors than entries are shorter; columns
besides vec_id, embedding and label are not read; an empty table gives an empty result.  Integers beyond
2^28 either way are an error, as their distances may not fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, joined, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors compared at once, so that a part's table of distances stays small.
CHUNK = 4096
LARGEST = 1 << 28


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    y = np.floor(np.asarray(x, np.float64) * scale)
    if y.size and np.abs(y).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} / {scale}")
    return y.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of x the index of the nearest entry and its distance; and how many terms were added up."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    row, entry = np.divmod(np.arange(len(x) * len(book)), len(book))
    sums = np.zeros(len(row), np.int64)
    best = np.full(len(x), np.iinfo(np.int64).max)
    terms = 0
    for k, d in enumerate(order):
        sums += np.square(x[row, d] - book[entry, d])
        terms += len(row)
        if k < len(order) - 1:
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))  # pairs stay in the order of rows, and none loses all
            least = np.minimum.reduceat(sums, first)
            at = np.flatnonzero(sums == least[row])
            at = at[np.concatenate(([True], row[at][1:] != row[at][:-1]))]
            best = np.minimum(best, np.square(x - book[entry[at]]).sum(axis=1))
            keep = sums <= best[row]
            row, entry, sums = row[keep], entry[keep], sums[keep]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    least = np.minimum.reduceat(sums, first)
    at = np.flatnonzero(sums == least[row])
    at = at[np.concatenate(([True], row[at][1:] != row[at][:-1]))]
    return entry[at], least, terms


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and distances of integer vectors; books: parts x entries x width."""
    parts, _, width = books.shape
    codes, dist = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
    for i in range(0, len(x), CHUNK):
        for p in range(parts):
            codes[i : i + CHUNK, p], dist[i : i + CHUNK, p], _ = nearest(x[i : i + CHUNK, p * width : (p + 1) * width], books[p])
    return codes, dist


def usable(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has `size` finite components, and those vectors."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False) == size)
    x = np.asarray(col.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)
    good = np.isfinite(x).all(axis=1)
    return at[good], x[good]


def first_vectors(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The vectors of the smallest ids."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    order = (F.asc_nulls_last("vec_id"), "embedding")
    rows = kept.orderBy(*order).limit(entries).collect()
    if not rows or len(rows[0].embedding) % parts:
        return None
    size = len(rows[0].embedding)
    if any(len(r.embedding) != size for r in rows):
        rows = kept.where(F.size("embedding") == size).orderBy(*order).limit(entries).collect()
    return np.array([r.embedding for r in rows], np.float64)


def improved(vectors: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """books with each entry that any part is nearest to replaced by the floor of their mean."""
    parts, entries, width = books.shape

    def gather(batches):
        sums, count = np.zeros_like(books), np.zeros((parts, entries), np.int64)
        for b in batches:
            _, x = usable(b.column(0), parts * width)
            x = integers(x, scale)
            codes, _ = assign(x, books)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], x[:, p * width : (p + 1) * width])
                count[p] += np.bincount(codes[:, p], minlength=entries)
        at = np.argwhere(count > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(count[count > 0]), pa.array(list(sums[count > 0]), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    sent = vectors.select("embedding").mapInArrow(gather, "part long, entry long, n long, s array<long>")
    added = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(width))).alias("s"))
    out = books.copy()
    for r in added.collect():  # parts * entries rows at most
        out[r.part, r.entry] = [s // r.n for s in r.s]
    return out


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Codebooks, parts x entries x width; None where there is nothing to code."""
    if not 0 < entries <= 256:
        raise ValueError("a code is two hex digits: 1 to 256 entries")
    first = first_vectors(vectors, parts, entries)
    if first is None:
        return None
    books = np.ascontiguousarray(integers(first, scale).reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = improved(vectors, books, scale)
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error) of each usable vector."""
    parts, _, width = books.shape

    def run(batches):
        for b in batches:
            at, x = usable(b.column(2), parts * width)
            codes, dist = assign(integers(x, scale), books)
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string()), pa.array(dist.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    kind = dict(vectors.dtypes)
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[p, k] for p, k in enumerate(bytes.fromhex(code))])


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded (a table) with label_error, the errors of equal labels added up."""
    keyed = coded.withColumn("label_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = keyed.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("label_rows"))
    return joined(keyed, "label_key", sums, "label_rows").drop("label_key")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = fit(vectors)
    if books is None:
        return vectors.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = with_label_errors(cut(encode(vectors, books)))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assigned(name: str, book: str) -> str:
    return f"""{name} AS (SELECT vec_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d
  FROM (SELECT p.vec_id, p.part, b.entry, list_sum([(p.x[i] - b.x[i]) * (p.x[i] - b.x[i]) FOR i IN range(1, len(p.x) + 1)])::BIGINT AS d FROM p JOIN {book} b ON p.part = b.part) GROUP BY vec_id, part)"""


def _replaced(name: str, book: str, assigned: str) -> str:
    return f"""{name} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x
  FROM (SELECT p.part, a.entry, i, sum(p.x[i])::BIGINT AS s, count(*) AS n FROM p JOIN {assigned} a ON a.vec_id = p.vec_id AND a.part = p.part, unnest(range(1, len(p.x) + 1)) u(i) GROUP BY p.part, a.entry, i)
  GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)"""


#: For tables whose vectors have one length and whose ids differ.
OP11_SQL = f"""
WITH v AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT vec_id, part, e[part * (len(e) // 16) + 1 : (part + 1) * (len(e) // 16)] AS x FROM v, unnest(range(16)) u(part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 64),
b0 AS (SELECT part, entry, x FROM p JOIN f USING (vec_id)),
{_assigned("a0", "b0")},
{_replaced("b1", "b0", "a0")},
{_assigned("a1", "b1")},
{_replaced("b2", "b1", "a1")},
{_assigned("a2", "b2")},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT c.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), h
"""
