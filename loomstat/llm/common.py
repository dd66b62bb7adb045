"""Shared helpers of the training-data operators: checkpoints, text batches, word hashes.

Every helper works on one Arrow batch inside a task.  Texts are cut into slices of
about ``SLICE_BYTES`` so that numpy temporaries stay small however long the batch is;
a text longer than that is a slice of its own.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
U64 = np.uint64
#: x20 and x09-x0D separate words; every other byte belongs to one.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.  Where none is named, one in /tmp for a local
    master, whose driver and tasks share it; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared checkpoint folder and read again.

    That cuts the lineage, outlives lost executors, and runs df once (an eager checkpoint() runs it twice).
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote, when all that reads them has been written itself."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Gives up the shuffle files of plans that nothing refers to any more.

    Spark deletes them when the driver's JVM has collected those plans as garbage, which it may not do for an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A key that holds more than one in so many rows is hot.
HOT = 1000


def joined(rows: DataFrame, key: str, of: DataFrame, n: str) -> DataFrame:
    """rows, and the columns of `of` (one row a key, its number of rows as `n`, which is left out) where the key is there.

    The rows of a hot key don't meet in one task: what belongs to hot keys, fewer than HOT, is broadcast.
    """
    of = of.withColumnRenamed(key, "__of")
    many = F.broadcast(of.where(F.col(n) > (of.agg(F.sum(n)).first()[0] or 0) / HOT).drop(n))
    first = rows.join(many, F.col(key) == F.col("__of"), "left")
    found = F.col("__of").isNotNull()
    rest = rows.join(many.select("__of"), F.col(key) == F.col("__of"), "left_anti").join(of.drop(n), F.col(key) == F.col("__of"), "left")
    return first.where(found).unionByName(rest).drop("__of")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names, whatever else the table holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fold_of(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo: the fixed folds of the contracts."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the offset of each text in them."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts of about `limit` bytes."""
    raw, offsets = buffers(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of words before it (n + 1 values)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    before, after = np.empty(len(raw), bool), np.empty(len(raw), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, so that every bit of a hash depends on all of its input."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, U64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word; A-Z count as a-z if lower.

    A polynomial over random byte values: one running sum over the slice gives all words.
    """
    if not len(starts):
        return np.zeros(0, U64)
    power, inverse = _powers(len(raw))
    total = np.empty(len(raw) + 1, U64)
    total[0] = 0
    np.cumsum((_LOWER if lower else _BYTE)[raw] * power, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


_PLACE = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words within one text, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = np.zeros(n, U64)
    for k in range(size):
        h += hashes[k : k + n] * _PLACE[k]
    good = np.ones(n, bool)
    for end in first[1:-1]:  # a run must not reach over the end of its text
        good[max(0, end - size + 1) : min(end, n)] = False
    at = np.flatnonzero(good)
    return mix(h[at]), at
