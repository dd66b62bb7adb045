"""Groups of spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

Words are runs of letters with their numbers of occurrences.  A word of length n has n - q + 1 q-grams with their
positions; one edit destroys q of them at most; a replaced letter leaves the others where they are, and a deleted one moves those behind it a
place down.  So words one edit apart, the longer of m letters, are of one length or of two that differ by one,
and share T = m - 2 q + 1 q-grams at equal positions, or at the shorter word's one lower.

* *Regions.*  With all q-grams in order from rare to frequent, two words that share T of them share one of the
  first n - q + 1 - T + 1 of each (n: its own length).  Each word goes to the regions of those q-grams, a region being
  a q-gram and the length m of the longer word, so near words meet in one.  Regions of more than ``REGION`` words are
  cut into blocks by hash, and each pair of blocks is a region: no task gets a hot one.
* *Merging.*  In a region an inverted index maps (length, position, q-gram) to an ascending list of words.  Each word
  of m letters, in turn, merges by a heap the lists of its q-grams at the positions allowed, keeps the words that come up
  T times or more, verifies that they are one edit away, and then enters the index itself, so no pair is merged
  twice.  The region's own q-gram, which all its words hold, has the longest lists: they are left out, and that
  q-gram's places in the word from T, as long as T stays above 0.
* *Once a pair.*  A pair that shares several regions counts in that of its first common q-gram only, so regions
  can send a row a word (the number of near words, and the best of them) and not a row a pair.

The form of a word is its near word of most occurrences, if that has ``TIMES`` times its own; roots follow forms to
the end by doubling.  Occurrences grow at each step, so there are no circles and few steps.

Defined results: null text has no words; a null id is hashed as empty text; equal rows count as often as they are
there; texts of any length are read whole, a stretch at a time; columns besides doc_id and text are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop
from operator import ne
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, forget, table

Q, MIN_CHARS, MIN_COUNT, TIMES, EVERY = 3, 6, 5, 5, 199
REGION, TASK, HELD, STRETCH = 2048, 50_000, 200_000, 1 << 20
RUN = re.compile("[a-zÀ-ÿ]+")
OTHER = re.compile("[^a-zÀ-ÿ]")


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """text in pieces of about `size` characters that end between runs."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            m = OTHER.search(text, end)
            end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def words_of(doc_id: int | None, text: str | None, every: int = EVERY) -> Counter:
    """Occurrences of the words of a text: one in `every` runs, by hash of id and run, loses a letter."""
    found = Counter()
    for part in stretches((text or "").encode().lower().decode()):  # of bytes, only A-Z are lowered
        found.update(RUN.findall(part))
    prefix = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out = Counter()
    for run, n in found.items():
        h = crc32(run.encode(), prefix)
        if h % every == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        out[run] += n
    return out


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n) of (doc_id, text).  Tasks count in tables of HELD words, sent on when full."""

    def run(batches):
        held = Counter()

        def sent():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(column(b, "doc_id").to_pylist(), column(b, "text"), strict=True):
                for w, n in words_of(doc_id, text.as_py(), every).items():
                    if len(w) >= min_chars:
                        held[w] += n
                if len(held) >= HELD:
                    yield sent()
        yield sent()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def grams(word: str, q: int = Q) -> list[str]:
    return [word[i : i + q] for i in range(len(word) - q + 1)]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes one word the other."""
    if len(a) < len(b):
        a, b = b, a
    longer = len(a) - len(b)
    if longer > 1 or a == b:
        return False
    if not longer and len(a) <= 64:
        return sum(map(ne, a, b)) == 1
    i = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        i += 1
    return a[i + 1 :] == (b[i:] if longer else b[i + 1 :])


def gram_ranks(words: DataFrame, q: int = Q) -> dict[str, int]:
    """Place of each q-gram in the order from rare to frequent.  There are 90^q at most, as runs have 90 letters."""

    def run(batches):
        held = Counter()
        for b in batches:
            for w in column(b, "word").to_pylist():
                held.update(grams(w, q))
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["g", "n"])

    rows = words.select("word").mapInArrow(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    return {g: i for i, g in enumerate(rows.sort_values(["n", "g"]).g)}


def ordered(word: str, rank: dict[str, int], q: int = Q) -> list[int]:
    """The q-grams of a word from rare to frequent; those it has again are others (up to 1,024 times)."""
    seen: Counter = Counter()
    out = []
    for g in grams(word, q):
        out.append(rank[g] << 10 | min(seen[g], 1023))
        seen[g] += 1
    return sorted(out)


def least_shared(longer: int, q: int = Q) -> int:
    return longer - 2 * q + 1


def regions(words: DataFrame, rank: dict[str, int], q: int = Q, region: int = REGION) -> DataFrame:
    """(key, i, j, part, word, n): words by region, a key and a pair of its blocks.  part: in a pair of different blocks,
    which of them.  A region's rows lie together, in partitions of about TASK rows."""

    def run(batches):
        for b in batches:
            word, n = column(b, "word").to_pylist(), column(b, "n").to_pylist()
            key, at = [], []
            for i, w in enumerate(word):
                order = ordered(w, rank, q)
                for longer in (len(w), len(w) + 1):
                    for g in order[: len(order) - least_shared(longer, q) + 1]:
                        key.append(min(longer, 0xFFFF) << 40 | g)
                        at.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array([word[i] for i in at], pa.string()), pa.array([n[i] for i in at], pa.int64())], names=["key", "word", "n"])

    each = cut(words.select("word", "n").mapInArrow(run, "key long, word string, n long"))
    size = each.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    few = each.join(size.where(f"k between 2 and {region}").select("key"), "key", "left_semi").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("part"), "word", "n")
    large = size.where(f"k > {region}").withColumn("blocks", F.ceil(2 * F.col("k") / region).cast("int"))
    block = each.join(large, "key").withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    pairs = block.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("part"), "word", "n")
    return few.unionAll(pairs).repartition(math.ceil(each.count() / TASK) + 1, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def counted(lists: list[list[int]], least: int) -> Iterator[int]:
    """What is in `least` of the ascending lists or more, by merging them with a heap; for one, no count is needed."""
    if least == 1 or len(lists) < least:
        yield from set().union(*lists) if least == 1 else ()
        return
    heap = [k for found in lists for k in found]
    heapify(heap)
    last, times = -1, 0
    while heap:
        k = heappop(heap)
        times = times + 1 if k == last else 1
        last = k
        if times == least:
            yield k


def _near(key: int, gram: str, split: bool, rows: list[tuple[int, str, int]], rank: dict[str, int], q: int) -> Iterator[tuple[int, int]]:
    """Pairs of places in rows (part, word, n) that are one edit apart and that this region, of `gram`, is to count."""
    longer, own = key >> 40, key & ((1 << 40) - 1)
    held: dict[int, set[int]] = {}

    def first_grams(i: int) -> set[int]:
        if i not in held:
            held[i] = set(ordered(rows[i][1], rank, q))
        return held[i]

    def merged(index: dict[int, dict[str, list[int]]], i: int) -> Iterator[int]:
        word = rows[i][1]
        own_grams, least = grams(word, q), least_shared(len(word), q)
        others = least - own_grams.count(gram)
        if others > 0:  # all words here hold the region's own q-gram: its lists are the longest, and tell nothing
            least, left = others, gram
        else:
            left = None
        odd = len(word) & 1
        places = ((2 * p + odd, 2 * p + 1 - odd, 2 * p - 1 - odd) for p in range(len(own_grams)))
        lists = [found for near, g in zip(places, own_grams, strict=True) if g != left for at in near if (found := index[at].get(g))]
        for k in counted(lists, least):
            if one_edit(word, rows[k][1]) and min(first_grams(i) & first_grams(k)) == own:
                yield i, k

    def enter(index: dict[int, dict[str, list[int]]], i: int) -> None:
        odd = len(rows[i][1]) & 1  # tells words of one length from those one letter shorter
        for p, g in enumerate(grams(rows[i][1], q)):
            index[2 * p + odd].setdefault(g, []).append(i)

    # words one letter short come first: they are found, but don't look for others
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i][1]), i))
    rows[:] = [rows[i] for i in order]
    full = longer if longer < 0xFFFF else 0
    indexes: list[dict[int, dict[str, list[int]]]] = [defaultdict(dict), defaultdict(dict)]
    for i, (part, word, _) in enumerate(rows):
        if len(word) >= full if full else True:
            yield from merged(indexes[1 - part] if split else indexes[0], i)
        enter(indexes[part if split else 0], i)


NEAR = "word string, n_near long, near_n long, near string"


def near_words(words: DataFrame, q: int = Q, region: int = REGION, rank: dict[str, int] | None = None) -> DataFrame:
    """(word, n_near, near_n, near): how many words are one edit away, and the one of them of most occurrences."""
    rank = gram_ranks(words, q) if rank is None else rank
    gram_of = list(rank)  # in order of rank

    def run(batches):
        at, rows, out = None, [], []

        def finish():
            found: dict[int, list] = {}
            for i, k in _near(at[0], gram_of[(at[0] & (1 << 40) - 1) >> 10], at[1] != at[2], rows, rank, q):
                for x, y in ((i, k), (k, i)):
                    best = (-rows[y][2], rows[y][1])
                    if x in found:
                        found[x][0] += 1
                        found[x][1] = min(found[x][1], best)
                    else:
                        found[x] = [1, best]
            out.extend((rows[x][1], k, -best[0], best[1]) for x, (k, best) in found.items())

        def batch():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["word", "n_near", "near_n", "near"])
            out.clear()
            return b

        for b in batches:
            for *key, part, word, n in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if key != at:
                    if len(rows) > 1:
                        finish()
                    at, rows = key, []
                    if len(out) >= 10_000:
                        yield batch()
                rows.append((part, word, n))
        if len(rows) > 1:
            finish()
        if out:
            yield batch()

    sent = regions(words, rank, q, region).select("key", "i", "j", "part", "word", "n").mapInArrow(run, NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    return sent.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.m")).alias("near_n"), F.col("best.w").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each word's chain of forms.  Chains halve each round."""
    r, old = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open"))), None
    while not r.where("open").isEmpty():
        old = r
        to = old.select(F.col("word").alias("root"), F.col("root").alias("further"))
        r = cut(old.join(to, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open")))
        forget(old)
    return r.select("word", "root")


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, times: int = TIMES, every: int = EVERY, q: int = Q, region: int = REGION) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of (doc_id, text)."""
    if min_chars < 2 * q:
        raise ValueError(f"words of {min_chars} letters may share no {q}-gram after an edit: min_chars is to be {2 * q} at least")
    words = cut(word_counts(docs, min_chars, min_count, every))
    near = near_words(words, q, region)
    other = F.col("near_n") >= F.lit(times) * F.col("n")
    found = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(other, F.col("near")).alias("form"), F.when(other, F.col("near_n")).alias("form_n")))
    forget(words)
    root = roots(found.where("form is not null").select("word", "form"))
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: crc32 a bit at a time (8 a byte), as DuckDB has none; near words share what is left when a letter is deleted.
OP12_SQL = r"""
WITH RECURSIVE t8 AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t8 WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM t8 WHERE k = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS k FROM r GROUP BY doc_id, run),
x AS (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS b FROM d),
h AS (SELECT run, k, xor(list_reduce([('0x' || substr(b, i, 2))::BIGINT FOR i IN range(1, length(b), 2)], lambda c, v: xor(t[xor(c & 255, v) + 1], c >> 8), 4294967295), 4294967295) AS h FROM x, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM w GROUP BY word HAVING length(word) >= 6 AND sum(k) >= 5),
o AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM v, unnest(range(length(word))) u(i)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM o a JOIN o b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM o a JOIN v b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM o a JOIN v b ON a.less = b.word),
g AS (SELECT word, count(*) AS n_near, arg_min({'w': near, 'n': near_n}, {'m': -near_n, 'w': near}) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * v.n THEN best.w END AS form, CASE WHEN best.n >= 5 * v.n THEN best.n END AS form_n FROM v LEFT JOIN g USING (word)),
e AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT e.word, e.next, f.form FROM e JOIN f ON f.word = e.next)
SELECT f.word, f.form, e.at AS root, f.n, f.n_near, f.form_n FROM f JOIN e ON e.word = f.word AND e.next IS NULL
"""
