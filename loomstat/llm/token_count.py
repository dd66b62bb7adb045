"""Token counts by a compiled finite-state transducer.

``Transducer`` determinises byte-pair encoding: after reading a prefix of a word, all that can
matter later is the longest suffix that still begins a vocabulary entry (an Aho-Corasick node)
and, for each position inside that suffix, the last token of the encoding up to there and the
number of tokens relative to now.  That tuple is the state; each transition carries the change
of the token count.  Transitions are compiled when first met and kept.

A text is cut into chunks.  Every token ends where white space begins, so whatever state a
chunk is entered in, the state after its first white space is the same: its state map is the
triple (text before the first white space, tokens between, text after the last).  ``compose``
is associative, so the maps of a text's chunks compose in any bracketing: by a tree of groups of
``fan`` neighbours, each level in parallel, so that no group grows with the text.

Defined results: null text is empty, an empty text has 0 tokens, equal rows are counted each,
null ids are kept, and columns besides doc_id and text are not read.  Of a text of any length only
the maps of its chunks move; a chunk without white space is its own map, so a text without any is
put together and counted as the one word it is, by one task.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.sources.tables import spread

from .common import column, table, texts_of

#: Unicode white space, and what the pre-tokeniser of the vocabulary file splits on.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_RUN = re.compile(f"[{SPACES}]+")
#: str.split() also splits at these, the tokenizer does not.
NOT_SPACES = re.compile("[\x1c-\x1f]")
END = "\0end"
NO_MOVES: dict = {}


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Transducer:
    """Deterministic token-count transducer of a byte-pair vocabulary with word-end marks."""

    def __init__(self, vocab: dict[str, int], merges: list, word_end: str = "</w>", most_states: int = 200_000):
        split = lambda s: (*(s[: -len(word_end)] if word_end and s.endswith(word_end) else s), *([END] if word_end and s.endswith(word_end) else []))
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {(split(a), split(b)): k for k, (a, b) in enumerate(pairs)}
        self.word_end, self.most_states = word_end, most_states
        # each stands for itself, so that states share one copy of equal parts
        self.tokens = {t: t for t in map(split, vocab) if self._merge(t) == [t]}
        self.prefixes = {t[:k]: t[:k] for t in self.tokens for k in range(len(t) + 1)}
        self.fits: dict[tuple, bool] = {}
        self._reset()

    def _reset(self) -> None:
        """No state but the first is compiled; states are numbered as they are met."""
        first = ((), (None,), (0,))
        self.number = {first: 0}
        self.states = [first]
        self.parts: dict[tuple, tuple] = {}
        self.moves: dict[str, dict[int, tuple[int, int]]] = {}
        if len(self.fits) > self.most_states:
            self.fits.clear()

    def _merge(self, symbols: tuple) -> list[tuple]:
        """Plain merging, used to test single tokens and adjacent pairs."""
        parts: list[tuple] = []
        for s in symbols:
            if s == END and parts:
                parts[-1] += (s,)
            else:
                parts.append((s,))
        never = len(self.rank)
        ranks = [self.rank.get(p, never) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)  # of equal pairs the leftmost
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.rank.get((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = self.rank.get((parts[i], parts[i + 1]), never)
        return parts

    def _fit(self, left: tuple | None, right: tuple) -> bool:
        if left is None:
            return True
        if (got := self.fits.get((left, right))) is None:
            got = self.fits[left, right] = self._merge(left + right) == [left, right]
        return got

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        node, last, count = self.states[state]
        text = (*node, symbol)
        suffix = text
        while suffix not in self.prefixes:
            suffix = suffix[1:]
        for k in range(len(text)):  # the one token that may end here
            token = text[k:]
            if token in self.tokens and (k < len(last)) and last[k] is not False and self._fit(last[k], token := self.tokens[token]):
                emitted = count[k] + 1
                break
        else:  # no encoding ends between a character and its word end
            token, emitted = False, 0
        keep = len(suffix)
        lasts = (*last, token)[len(text) - keep :]
        counts = tuple(c - emitted for c in (*count, emitted)[len(text) - keep :])
        same = self.parts
        to = (self.prefixes[suffix], same.setdefault(lasts, lasts), same.setdefault(counts, counts))
        if (k := self.number.get(to)) is None:
            k = self.number[to] = len(self.states)
            self.states.append(to)
        self.moves.setdefault(symbol, {})[state] = found = (k, emitted)
        return found

    def count(self, word: str) -> int:
        """Tokens of one pre-token, given as byte symbols."""
        if len(self.states) > self.most_states:
            self._reset()
        state, total, moves = 0, 0, self.moves
        for c in (*word, END) if self.word_end else word:
            state, emitted = moves.get(c, NO_MOVES).get(state) or self._compile(state, c)
            total += emitted
        return total


class SegmentCounts(dict):
    """Token count of each run of text without white space; compiled on demand, bounded: about 300 MB a worker."""

    def __init__(self, path: str, most: int = 200_000):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.most = most
        self.pieces = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))) or r"(?!)")
        self.symbols = byte_symbols()
        self.machine = Transducer(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.piece_counts: dict[str, int] = {}

    def _piece(self, piece: str) -> int:
        if (n := self.piece_counts.get(piece)) is None:
            n = self.machine.count("".join([self.symbols[b] for b in piece.encode()]))
            if len(piece) <= 40:
                if len(self.piece_counts) >= self.most:
                    self.piece_counts.clear()
                self.piece_counts[piece] = n
        return n

    def __missing__(self, segment: str) -> int:
        n = 0
        if "<" in segment:
            found = self.special.findall(segment)
            parts = self.special.split(segment) if found else [segment]
            n += len(found)
        else:
            parts = [segment]
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            n += sum(map(self._piece, self.pieces.findall(part.lower())))
        if len(segment) <= 60:
            if len(self) >= self.most:
                self.clear()
            self[segment] = n
        return n

    def state_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(text before the first white space, tokens between, text after the last; None: no white space)."""
        parts = SPACE_RUN.split(chunk) if NOT_SPACES.search(chunk) else (["", *chunk.split()] if chunk[:1].isspace() else chunk.split()) + [""] * chunk[-1:].isspace()
        if len(parts) < 2:
            return chunk, 0, None
        return parts[0], sum(map(self.__getitem__, parts[1:-1])), parts[-1]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[2] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[2] is None:
            return (a[0], a[1], a[2] + b[0])
        return (a[0], a[1] + self[a[2] + b[0]] + b[1], b[2])

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return self.total(self.state_map(text))

    def total(self, m: tuple) -> int:
        return self[m[0]] + m[1] + (self[m[2]] if m[2] is not None else 0)


_COUNTERS: dict[str, SegmentCounts] = {}


def counter(path: str) -> SegmentCounts:
    """One per Python worker, so that later tasks find the compiled transitions."""
    if path not in _COUNTERS:
        _COUNTERS[path] = SegmentCounts(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, chunk_chars: int = 1 << 16, fan: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of (doc_id, text), any length of text.

    `tokenizer` is the path of a vocabulary file, there on every executor.  Texts of one chunk are
    counted where they lie; the state maps of longer texts are composed `fan` neighbours at a time.
    """
    d = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.ceil(F.length("text") / chunk_chars).alias("n_chunks"))

    def whole(batches):
        counts = counter(tokenizer)
        for b in batches:
            n = list(map(counts.count, column(b, "text").to_pylist()))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    names, kinds = ["row", "doc_id", "n_bytes", "chunk", "head", "body", "tail"], "row long, doc_id long, n_bytes long, chunk long, head string, body long, tail string"

    def maps(batches):
        counts = counter(tokenizer)
        for b in batches:
            for row, doc_id, n_bytes, text in zip(*(column(b, c) for c in ("row", "doc_id", "n_bytes", "text")), strict=True):
                text = text.as_py()
                parts = [counts.state_map(text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)]
                head, body, tail = zip(*parts, strict=True)
                same = [pa.repeat(x, len(parts)) for x in (row, doc_id, n_bytes)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(parts)), pa.int64()), pa.array(head, pa.string()), pa.array(body, pa.int64()), pa.array(tail, pa.string())], names=names)

    def composed(t):
        t = t.sort_by("chunk")
        return t.slice(0, 1), reduce(counter(tokenizer).compose, zip(*(t[c].to_pylist() for c in ("head", "body", "tail")), strict=True))

    def compose(t):
        first, m = composed(t)
        return pa.table([*first.select(names[:3]).columns, pa.array([first["chunk"][0].as_py() // fan]), pa.array(m[:1], pa.string()), pa.array(m[1:2], pa.int64()), pa.array(m[2:], pa.string())], names=names)

    def total(t):
        """The last level, which counts too: a task that ran another pass for that would need a second Python worker."""
        first, m = composed(t)
        return pa.table([*first.select(["doc_id", "n_bytes"]).columns, pa.array([counter(tokenizer).total(m)], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = "doc_id long, n_bytes long, n_tokens long"
    m = d.where("n_chunks > 1").withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "n_bytes", "text").mapInArrow(maps, kinds)
    most = math.ceil((1 << 31) / chunk_chars)  # no text is longer
    while most > fan:
        m, most = m.groupBy("row", F.floor(F.col("chunk") / fan)).applyInArrow(compose, kinds), math.ceil(most / fan)
    return d.where("n_chunks <= 1").mapInArrow(whole, counted).unionAll(m.groupBy("row").applyInArrow(total, counted))


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    t = count_tokens(spread(texts_of(table(spark, sf_dir, "documents"))), public_tokenizers.path("word_bpe_49k.json"))
    return t.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
