"""Exact SentencePiece encoding by backtracking, and decoding.

Merging by score gives one encoding, and a token sequence is that encoding exactly when each
two neighbours, merged again from characters, stay the same two tokens.  An Aho-Corasick automaton
walks the text once and gives the longest vocabulary entry that begins at each place.
``PieceCodec.backtrack`` takes that entry, checks it against its left neighbour, falls back to shorter
entries, and steps back when none fits; a bit field remembers places from which no way leads on, so
no place is tried twice.  Characters outside the vocabulary become byte tokens and part the text.

Entries never hold a space mark after another character, so texts part into units (spaces and the
word after them) that are encoded alone.  A batch's distinct units are found in Arrow, those that
the worker doesn't remember are encoded, and the texts' ids are put together with numpy.

Defined results: null text is empty, an empty text has only the end id and decodes to an empty
text, equal rows are encoded each, null ids are kept, and columns besides doc_id and text are not
read.  A text of any length is encoded whole by the task that holds its row; without spaces it is
one unit, and time stays in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from loomstat.sources.tables import spread

from .common import U64, buffers, column, slices, table, texts_of

MARK = "▁"
#: Bytes of text handled at once, units that a worker remembers (twice), and the longest of them.
RUN_BYTES, MOST_UNITS, LONGEST_UNIT = 4 << 20, 100_000, 48
#: Stretches of up to so many characters are encoded together; pairs that are remembered, as a power of two.
LONGEST_RUN, PAIR_BITS = 256, 20


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)  # only to read the model file's entries
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.piece[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        self.id = {self.piece[i]: i for i in plain if self.merge(self.piece[i]) == [self.piece[i]]}  # merging can reach no others
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.end = sp.eos_id()
        self.by_units = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        self.sizes = [len(p) for p in self.piece]
        self.back = [k - 1 for k in self.sizes]
        #: for each entry, the longest shorter entry that begins it; -1: none
        self.shorter = [-1] * n
        self.match = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.match.add_word(p, i)
            self.shorter[i] = next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), -1)
        self.match.make_automaton()
        self.size_of, self.shorter_of = np.array(self.sizes), np.array(self.shorter)
        self.pairs, self.pair_fits = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, bool)
        #: what each id stands for, and its decimal digits with a space behind, for whole batches
        self.bytes_of = pa.array([bytes([self.value[i]]) if i in self.value else b"" if i in self.control else p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)], pa.large_binary())
        self.digits_of = pa.array([b"%d " % i for i in range(n)], pa.large_binary())

    def merge(self, text: str) -> list[str]:
        """Plain merging: the pair of the best score first, of several the leftmost."""
        parts, none = list(text), float("-inf")
        gains = [self.score.get(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while gains:
            best = max(gains)
            if best == none:
                break
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = self.score.get(parts[i - 1] + parts[i], none)
            if i < len(gains):
                gains[i] = self.score.get(parts[i] + parts[i + 1], none)
        return parts

    def fit(self, left: int, right: int) -> bool:
        """Whether two neighbours, merged again, stay as they are."""
        a, b = self.piece[left], self.piece[right]
        return self.merge(a + b) == [a, b]

    def longest(self, text: str) -> list[int]:
        """The longest entry that begins at each place of a text, -1 for none, by one walk of the automaton."""
        best, back = [-1] * len(text), self.back
        for last, i in self.match.iter(text):  # by their last place: the longest of a place comes last
            best[last - back[i]] = i
        return best

    def backtrack(self, best: list[int], begin: int, stop: int) -> list[int]:
        """The encoding of places begin to stop, all of whose characters are entries."""
        sizes, shorter, fits = self.sizes, self.shorter, {}
        at, token, tokens = begin, best[begin], []
        failed = bytearray((stop - begin >> 3) + 1)
        while True:
            while token >= 0:
                end = at + sizes[token]
                if end <= stop and not failed[end - begin >> 3] >> (end - begin & 7) & 1:
                    if not tokens:
                        break
                    if (ok := fits.get((tokens[-1], token))) is None:
                        ok = fits[tokens[-1], token] = self.fit(tokens[-1], token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at = end
                if at == stop:
                    return tokens
                token = best[at]
                continue
            if not tokens:
                raise ValueError("the vocabulary can't encode this text")
            failed[at - begin >> 3] |= 1 << (at - begin & 7)
            last = tokens.pop()
            at -= sizes[last]
            token = shorter[last]

    def fit_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`fit` of many pairs, through a table in which a pair has one place and drives out what was there."""
        pair = left << 32 | right
        place = (pair.view(U64) * U64(0x9E3779B97F4A7C15) >> U64(64 - PAIR_BITS)).astype(np.int64)
        ok = self.pair_fits[place]
        new = np.flatnonzero(self.pairs[place] != pair)
        if len(new):
            some, one, inverse = np.unique(pair[new], return_index=True, return_inverse=True)
            got = np.array([self.fit(x >> 32, x & 0xFFFFFFFF) for x in some.tolist()])
            ok[new] = got[inverse]
            to, which = np.unique(place[new[one]], return_index=True)
            self.pairs[to], self.pair_fits[to] = some[which], got[which]
        return ok

    def backtrack_all(self, best: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """`backtrack` of many short stretches at once, a step each in turn; gives the token that ends at each place, or -1."""
        size, shorter = self.size_of, self.shorter_of
        last, failed = np.full(len(best) + 1, -1), np.zeros(len(best) // 8 + 1, np.uint8)
        at, first, stop_, token = begin.copy(), begin, stop, best[begin]
        while len(at):
            some = token >= 0
            end = at + np.where(some, size[token], 0)
            ok = some & (end <= stop_)
            ok &= failed[np.minimum(end, len(best)) >> 3] >> (end & 7).astype(np.uint8) & 1 == 0
            ask = np.flatnonzero(ok & (at > first))
            ok[ask] = self.fit_all(last[at[ask]], token[ask])
            back = np.flatnonzero(~some)
            if len(back):
                if (at[back] == first[back]).any():
                    raise ValueError("the vocabulary can't encode this text")
                np.bitwise_or.at(failed, at[back] >> 3, (1 << (at[back] & 7)).astype(np.uint8))
            before = last[at]
            last[end[ok]] = token[ok]
            token = np.where(ok, best[np.minimum(end, len(best) - 1)], shorter[np.where(some, token, before)])
            at = np.where(ok, end, np.where(some, at, at - size[before]))
            left = np.flatnonzero(at < stop_)
            at, first, stop_, token = at[left], first[left], stop_[left], token[left]
        out, at, first = np.full(len(best) + 1, -1), stop, begin
        while len(at):  # only the last way of each stretch counts
            out[at] = last[at]
            at = at - size[last[at]]
            left = np.flatnonzero(at > first)
            at, first = at[left], first[left]
        return out

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit (with space marks), packed as int32."""
        text = "".join(units)
        listed = self.longest(text)
        best = np.array(listed, np.int64)
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))))
        known = best >= 0
        first, last = known.copy(), known.copy()
        parted = np.zeros(len(text) + 1, bool)
        parted[bounds] = True
        first[1:] &= ~known[:-1] | parted[1:-1]
        last[:-1] &= ~known[1:] | parted[1:-1]
        begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        short = stop - begin <= LONGEST_RUN
        ends = self.backtrack_all(best, begin[short], stop[short])
        for a, z in zip(begin[~short].tolist(), stop[~short].tolist(), strict=True):
            tokens = self.backtrack(listed, a, z)
            ends[a + np.cumsum(self.size_of[tokens])] = tokens
        other = np.flatnonzero(~known)
        taken = [text[k].encode() for k in other.tolist()]
        count = (ends >= 0).astype(np.int64)
        count[other + 1] = [len(x) for x in taken]
        before = np.cumsum(count)  # ids that end up to each place
        ids = np.empty(before[-1], np.int32)
        full = np.flatnonzero(ends >= 0)
        ids[before[full] - 1] = ends[full]
        for k, x in zip((before[other + 1]).tolist(), taken, strict=True):
            ids[k - len(x) : k] = [self.byte[c] for c in x]
        packed, cuts = ids.tobytes(), (4 * before[bounds]).tolist()
        return [packed[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, text: str) -> list[int]:
        ids, _ = BatchEncoder(self).ids(pa.array([text]))
        return ids.tolist()

    def decode(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if i in self.value:
                run.append(self.value[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i not in self.control:
                out.append(self.piece[i].replace(MARK, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if text[:1] == " " else text


def _marked(texts: pa.Array) -> pa.Array:
    """Texts with every space mark as a space, and one more space before each text that isn't empty."""
    t = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
    return pc.if_else(pc.equal(t, ""), t, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), t, pa.scalar("", pa.large_string())))


class BatchEncoder:
    """Encodes runs of texts; remembers the ids of short units: MOST_UNITS used lately, and as many used before."""

    def __init__(self, codec: PieceCodec):
        self.codec, self.lately, self.before = codec, {}, {}

    def unit_ids(self, units: list[str]) -> list[bytes]:
        got = [self.lately.get(u) or self.before.get(u) for u in units]
        new = [i for i, g in enumerate(got) if g is None]
        for i, ids in zip(new, self.codec.encode_units([units[i].replace(" ", MARK) for i in new]), strict=True):
            got[i] = ids
        for u, ids in zip(units, got, strict=True):
            if len(u) <= LONGEST_UNIT:
                if len(self.lately) >= MOST_UNITS:
                    self.before, self.lately = self.lately, {}
                self.lately[u] = ids
        return got

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, an end id after each text, and the number of ids before each text (n + 1 values)."""
        raw, offsets = buffers(_marked(texts))
        n = len(offsets) - 1
        if self.codec.by_units and len(raw):
            space = raw == 0x20
            first = space.copy()
            first[1:] &= ~space[:-1]
        else:
            first = np.zeros(len(raw), bool)
        first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(first)
        bounds = np.append(starts, len(raw)).astype(np.int64)
        units = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        packed = self.unit_ids(units.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(packed), np.int32)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
        of = units.indices.to_numpy()
        count, begin = size[of], (np.cumsum(size) - size)[of]
        before = np.concatenate(([0], np.cumsum(count)))
        tokens = flat[np.repeat(begin - before[:-1], count) + np.arange(before[-1])]
        ends = before[np.searchsorted(starts, offsets)] + np.arange(n + 1)  # ids before each text
        out = np.full(len(tokens) + n, self.codec.end, np.int32)
        inside = np.ones(len(out), bool)
        inside[ends[1:] - 1] = False
        out[inside] = tokens
        return out, ends


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """One per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(PieceCodec(path))
    return _ENCODERS[path]


def _parts(values: pa.Array, ids: np.ndarray, ends: np.ndarray):
    """What the values of each text's ids give, put together."""
    got = values.take(pa.array(ids))
    offsets = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1, got.offset * 8)[ends].tolist()
    data = memoryview(got.buffers()[2] or b"")
    return [data[a:z] for a, z in zip(offsets[:-1], offsets[1:], strict=True)]


def _decoded(e: BatchEncoder, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
    """UTF-8 of each decoded text: bytes of byte tokens come whole, as a text's characters were taken apart."""
    return [p[1:] if p[:1] == b" " else p for p in _parts(e.codec.bytes_of, ids, ends)]


def _runs(batches, model: str):
    e = encoder(model)
    for b in batches:
        for i, j, _, _ in slices(column(b, "text"), RUN_BYTES):
            yield column(b, "doc_id").slice(i, j - i), e, *e.ids(column(b, "text").slice(i, j - i))


def encode_texts(docs: DataFrame, model: str, decoded: bool = True) -> DataFrame:
    """(doc_id, ids, decoded) of each row of (doc_id, text): ids with the end id, and their decoding, or its sha256."""

    def run(batches):
        for doc_id, e, ids, ends in _runs(batches, model):
            parts = _decoded(e, ids, ends)
            shown = [bytes(p).decode() if decoded else hashlib.sha256(p).hexdigest() for p in parts]
            listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([doc_id, listed, pa.array(shown, pa.string())], names=["doc_id", "ids", "decoded" if decoded else "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, ids array<int>, {'decoded' if decoded else 'decoded_sha256'} string")


def digest_texts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without moving ids or texts back to the JVM."""

    def run(batches):
        for doc_id, e, ids, ends in _runs(batches, model):
            i_sha = [hashlib.sha256(p[:-1]).hexdigest() for p in _parts(e.codec.digits_of, ids, ends)]
            d_sha = [hashlib.sha256(p).hexdigest() for p in _decoded(e, ids, ends)]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(ends)), pa.array(i_sha), pa.array(d_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_texts(spread(texts_of(table(spark, sf_dir, "documents"))), public_tokenizers.path("piece_bpe_32k.model"))
