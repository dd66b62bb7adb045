"""Plain versions of the operators, over lists of rows."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(text, size=5):
    w = WORD.findall(lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def classes(ids, linked):
    """Smallest id of each row's component; linked: pairs of positions."""
    root = {i: i for i in range(len(ids))}
    for a, b in linked:
        a, b = find(root, a), find(root, b)
        root[max(a, b, key=lambda k: (ids[k] is None, ids[k], k))] = min(a, b, key=lambda k: (ids[k] is None, ids[k], k))
    return [ids[find(root, i)] for i in range(len(ids))]


def jaccard(rows):
    """Sorted (doc_id, n_shingles, component_id) of (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    comp = classes([d for d, _ in rows], linked)
    return sorted((d, len(s), c) for (d, _), s, c in zip(rows, sets, comp, strict=True))


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def kept(text):
    """The verdict of all rules, each asked of every text."""
    n, chars, symbols, dup, _, failed = rules(text)
    w = WORD.findall(text or "")
    lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    lettered = sum(any(c.isascii() and c.isalpha() or not c.isascii() for c in x) for x in w)
    digits = sum(c in "0123456789" for x in w for c in x)
    bad = [failed, 100 * symbols > 30 * n, 100 * dup > 50 * lines, chars < 2 * n or chars > 20 * n, 100 * lettered < 70 * n, 100 * digits > 30 * chars]
    return not any(bad)


def fold(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def unigram(rows):
    """{doc_id: (held_out, n_tokens, n_known, N, base_score)} of (doc_id, text) with different ids."""
    count = Counter()
    for d, t in rows:
        if fold(d, 7) != 2:
            count.update([*WORD.findall(lower(t or "")), None])
    n, v = sum(count.values()), len(count)
    out = {}
    for d, t in rows:
        k = [*WORD.findall(lower(t or "")), None]
        out[d] = (fold(d, 7) == 2, len(k), sum(count[x] > 0 for x in k), n, sum(log10((count[x] + 1) / (n + v + 1)) for x in k))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
