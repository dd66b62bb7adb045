"""Counts over whole texts, a slice of texts at a time, each computed when first asked for."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from .common import SPACE, U64, mix, windows, word_hashes, words

#: Fixed value: the symbols that quality rules count.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?")] = True
_TEXT_SALT = U64(0xD6E8FEB86659FD93)


class Texts:
    """Texts given as bytes end to end and offsets; every property has a value per text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets, self.n = raw, offsets, len(offsets) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def subset(self, keep: np.ndarray, copy: bool = False) -> Texts:
        """The kept texts, with the counts known of them; `copy`: a new object even if all are kept."""
        if keep.all() and not copy:
            return self
        sizes = np.diff(self.offsets)
        out = Texts(self.raw[np.repeat(keep, sizes)], np.concatenate(([0], np.cumsum(sizes[keep]))))
        for name in COUNTS:
            if name in self.__dict__:
                out.__dict__[name] = self.__dict__[name][keep]
        return out

    @cached_property
    def spans(self):
        return words(self.raw, self.offsets)

    @cached_property
    def hashes(self) -> np.ndarray:
        return word_hashes(self.raw, *self.spans[:2], lower=False)

    @cached_property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.spans[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.per_text(~SPACE[self.raw] & ((self.raw & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.per_text(_SYMBOL[self.raw])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self.per_text(_UPPER[self.raw])

    @cached_property
    def n_digits(self) -> np.ndarray:
        return self.per_text(_DIGIT[self.raw])

    @cached_property
    def n_punct(self) -> np.ndarray:
        return self.per_text(_PUNCT[self.raw])

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Per text: lines with a word, and how many of them differ."""
        breaks = np.flatnonzero(self.raw == 10)
        starts = np.sort(np.concatenate((self.offsets[:-1], breaks + 1)))
        ends = np.sort(np.concatenate((self.offsets[1:], breaks)))
        inside = np.concatenate(([0], np.cumsum(~SPACE[self.raw], dtype=np.int64)))
        owner = np.searchsorted(self.offsets[1:], starts, "right")
        full = (inside[ends] > inside[starts]) & (owner < self.n)
        starts, ends, owner = starts[full], ends[full], owner[full]
        keys = mix(word_hashes(self.raw, starts, ends, lower=False) + owner.astype(U64) * _TEXT_SALT)
        _, first = np.unique(keys, return_index=True)
        return np.bincount(owner, minlength=self.n), np.bincount(owner[first], minlength=self.n)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[0] - self._lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside windows of three words that the text holds twice or more."""
        h, at = windows(self.hashes, self.spans[2], 3)
        keys = h + self.text_of_word[at].astype(U64) * _TEXT_SALT
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        covered = np.zeros(len(self.hashes), bool)
        for k in range(3):
            covered[at[again] + k] = True
        return np.bincount(self.text_of_word[covered], minlength=self.n)

    @cached_property
    def n_distinct_words(self) -> np.ndarray:
        _, first = np.unique(mix(self.hashes + self.text_of_word.astype(U64) * _TEXT_SALT), return_index=True)
        return np.bincount(self.text_of_word[first], minlength=self.n)

    @cached_property
    def n_letter_words(self) -> np.ndarray:
        """Words with a letter (any byte beyond ASCII counts as one)."""
        total = np.concatenate(([0], np.cumsum(_LETTER[self.raw], dtype=np.int64)))
        starts, ends, _ = self.spans
        return np.bincount(self.text_of_word[total[ends] > total[starts]], minlength=self.n)

    @cached_property
    def n_short_words(self) -> np.ndarray:
        starts, ends, _ = self.spans
        return np.bincount(self.text_of_word[ends - starts <= 3], minlength=self.n)


COUNTS = [k for k, v in vars(Texts).items() if isinstance(v, cached_property) and k.startswith("n_")] + ["word_chars"]
