"""N-grams of batches of token arrays, inside tasks: counted, or looked up in a vocabulary, all rows at once.

Tokens become codes in one Arrow pass and n-grams numbers made of those, so that no Python object is made of a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that are worked on at a time (or one row's, if it has more): about 100 bytes each.
MOST_TOKENS = 1 << 20


def pieces(batch: pa.RecordBatch, places: list[int], most_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most most_rows rows and MOST_TOKENS tokens in the columns at those places; a row is never cut."""
    ends = np.cumsum(sum(_lengths(batch.column(i)) for i in places)) if places else np.zeros(batch.num_rows, np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(max(int(np.searchsorted(ends, before + MOST_TOKENS, "right")), at + 1), at + most_rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _lengths(col: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(col: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code) of each token, and the words that codes stand for."""
    encoded = pc.drop_null(col).flatten().dictionary_encode()
    return np.repeat(np.arange(len(col)), _lengths(col)), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.cast(pa.string())


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of x, ascending, and how often each is there."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))
    return x[at], np.diff(at, append=len(x))


def counted(tokens: pa.Array, size: int) -> pa.RecordBatch:
    """(ngram, r, o): the n-grams of that size (1, 2) with the rows that hold them and their occurrences."""
    row, code, words = _coded(tokens)
    if size == 1:
        grams = words
    else:
        beside = np.flatnonzero(row[1:] == row[:-1])
        pairs = pa.array(code[beside] * len(words) + code[beside + 1]).dictionary_encode()
        row, code, key = row[beside], pairs.indices.to_numpy(zero_copy_only=False).astype(np.int64), pairs.dictionary.to_numpy()
        grams = pc.binary_join_element_wise(*(words.take(pa.array(k)) for k in np.divmod(key, max(len(words), 1))), " ")
    n = max(len(grams), 1)
    found, _ = _runs(row * n + code)
    rows, occurrences = (np.bincount(x, minlength=len(grams)) for x in (found % n, code))
    return pa.RecordBatch.from_arrays([grams, pa.array(rows, pa.int64()), pa.array(occurrences, pa.int64())], names=["ngram", "r", "o"])


class Lookup:
    """The n-grams of the sizes asked for (1, 2) in a vocabulary; of equal ones the last counts."""

    def __init__(self, vocabulary: list[str], sizes: tuple[int, ...] = (1, 2)):
        self.size = len(vocabulary)
        places = [(w.split(" "), j) for w, j in {w: j for j, w in enumerate(vocabulary) if w is not None}.items()]
        places = [(w, j) for w, j in places if len(w) in sizes and len(w) <= 2]
        words = sorted({t for w, _ in places for t in w})
        number = {t: i for i, t in enumerate(words)}
        self.words = pa.array(words, pa.string())
        self.single = np.full(len(words) + 1, -1)  # the last is that of all other words
        for w, j in places:
            if len(w) == 1:
                self.single[number[w[0]]] = j
        pairs = [(number[w[0]] * len(words) + number[w[1]], j) for w, j in places if len(w) == 2]
        self.pairs, self.pair_places = pa.array([k for k, _ in pairs], pa.int64()), np.array([j for _, j in pairs], np.int64)

    def entries(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, occurrences) of what the vocabulary holds, by row and place."""
        row, code, words = _coded(tokens)
        known = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = known[code]
        place = self.single[code]
        one = np.flatnonzero(place >= 0)
        at = [row[one] * self.size + place[one]]
        if len(self.pairs):
            beside = np.flatnonzero((row[1:] == row[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0))
            found = pc.index_in(pa.array(code[beside] * len(self.words) + code[beside + 1]), value_set=self.pairs)
            both = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            at.append(row[beside[both]] * self.size + self.pair_places[found.drop_null().to_numpy()])
        x, n = _runs(np.concatenate(at))
        return *np.divmod(x, max(self.size, 1)), n


def scaled(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The values as shares of their row's length, and those lengths; the values of rows of length 0 stay."""
    length = np.sqrt(np.bincount(row, value * value, rows))[row]
    return value / np.where(length == 0, 1.0, length), length
