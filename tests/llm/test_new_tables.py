"""Vector codes, spelling variants and WARC bundles against plain versions, SQL and other readers."""

import base64
import hashlib
import io
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import zstandard
from conftest import same_rows
from pyspark.sql import functions as F

from loomstat.llm import spelling_variants as sv
from loomstat.llm import vector_codes as vc
from loomstat.llm import warc_bundles as wb

# --- vector codes


def plain_codes(rows, parts, entries, rounds, scale=256):
    """{row number: (code, error, label_error)} and codebooks of (vec_id, embedding, label), in Python's integers."""
    good = {i: [int(np.floor(float(np.float32(x)) * scale)) for x in e] for i, (_, e, _) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e)}
    order = sorted(good, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, good[i]))
    if not order or len(good[order[0]]) % parts:
        return {}, None
    size = len(good[order[0]])
    good = {i: e for i, e in good.items() if len(e) == size}
    w = size // parts
    part = {i: [tuple(e[p * w : (p + 1) * w]) for p in range(parts)] for i, e in good.items()}
    books = [[part[i][p] for i in order if i in good][:entries] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    choose = lambda i, p: min(range(len(books[p])), key=lambda k: (dist(part[i][p], books[p][k]), k))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = {}
            for i in good:
                held.setdefault(choose(i, p), []).append(part[i][p])
            new.append([tuple(sum(c) // len(held[k]) for c in zip(*held[k], strict=True)) if k in held else b for k, b in enumerate(books[p])])
        books = new
    code = {i: [choose(i, p) for p in range(parts)] for i in good}
    error = {i: sum(dist(part[i][p], books[p][k]) for p, k in enumerate(code[i])) for i in good}
    label = Counter()
    for i in good:
        label[rows[i][2]] += error[i]
    return {i: ("".join(f"{k:02x}" for k in code[i]), error[i], label[rows[i][2]]) for i in good}, books


def codes(spark, rows, **args):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(0) for c in ("code", "error", "label_key", "label_rows", "size", "n")}).repartition(3)
    books = vc.fit(df, **args)
    return [tuple(r) for r in vc.with_label_errors(vc.encode(df, books)).select("vec_id", "code", "error", "label_error").collect()], books


def test_codes_of_embeddings_by_sql(spark, sf_dir, duck):
    same_rows(vc.op11_vector_codes(spark, sf_dir), duck.sql(vc.OP11_SQL))


@pytest.mark.parametrize("seed", range(3))
def test_codes(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in np.round(rng.normal(size=12), seed)], [None, 1, 2][k % 3]) for k in rng.permutation(90)]
    rows += [(7, rows[0][1], 1), (7, rows[0][1], 1), (None, rows[1][1], None), (200, None, 1), (201, [None] * 12, 1), (202, [float("nan")] * 12, 1), (203, [float("inf")] + [0.0] * 11, 1), (204, [], 1), (205, [1.0] * 6, 1)]
    got, books = codes(spark, rows, parts=4, entries=10, rounds=2)
    want, plain = plain_codes(rows, 4, 10, 2)
    assert [[tuple(e) for e in b] for b in books.tolist()] == plain
    assert sorted(got, key=str) == sorted([(rows[i][0], *v) for i, v in want.items()], key=str)
    at = next(r for r in got if r[0] == 200 - 196)
    assert len(vc.decode(at[1], books)) == 12


def test_few_or_no_vectors(spark):
    assert vc.fit(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")) is None
    assert vc.fit(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], "vec_id long, embedding array<float>, label int"), parts=2) is None
    got, books = codes(spark, [(1, [0.5, -0.25], 1), (2, [0.5, -0.25], None)], parts=2)
    assert books.tolist() == [[[128], [128]], [[-64], [-64]]] and sorted(got) == [(1, "0000", 0, 0), (2, "0000", 0, 0)]


def test_components_too_large_to_be_exact():
    with pytest.raises(ValueError):
        vc.integers(np.array([1e30]))


def test_partial_distances_drop_most_pairs():
    rng = np.random.default_rng(1)
    book = rng.integers(-300, 300, (64, 16))
    x = book[rng.integers(0, 64, 500)] + rng.integers(-60, 60, (500, 16))
    entry, least, terms = vc.nearest(x, book)
    full = np.square(x[:, None, :] - book[None]).sum(-1)
    assert (entry == full.argmin(1)).all() and (least == full.min(1)).all()
    assert terms < full.size * 16 / 2


def test_ties_go_to_the_lower_index():
    book = np.array([[5, 0], [-5, 0], [5, 0], [0, 5]])
    assert vc.nearest(np.array([[0, 0], [5, 0], [0, 9]]), book)[0].tolist() == [0, 0, 3]


# --- spelling variants

LETTERS = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]


def plain_words(docs, min_chars=6, min_count=5, every=199):
    import re

    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}


def edits(w):
    return ({w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in LETTERS} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in LETTERS}) - {w}


def plain_variants(n, times=5):
    form, near = {}, {}
    for w in n:
        found = sorted((e for e in edits(w) if e in n), key=lambda e: (-n[e], e))
        near[w] = len(found)
        form[w] = found[0] if found and n[found[0]] >= times * n[w] else None
    out = []
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        out.append((w, form[w], at, n[w], near[w], n[form[w]] if form[w] else None))
    return sorted(out)


def variants(spark, docs, **args):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("word", "n", "form", "root", "key", "near")}).repartition(3)
    return sorted(tuple(r) for r in sv.spelling_variants(df, **args).collect())


def odd_texts(seed, rows=120):
    rng = random.Random(seed)
    base = ["abcdef", "aaaaaa", "aaaaaaa", "banana", "bananan", "straßen", "étéété", "lengthyword", "mississippi", "abababab", "x" * 30] + ["".join(rng.choice("abc") for _ in range(rng.choice((6, 7, 8)))) for _ in range(60)]
    for _ in range(2):
        base += [rng.choice(sorted(edits(rng.choice(base)))) for _ in range(60)]
    text = lambda: rng.choice((" ", ", ", "1", "\n")).join(rng.choice((w, w.upper(), w)) for w in (base[min(int(rng.expovariate(0.03)), len(base) - 1)] for _ in range(rng.randrange(60))))
    return [(i, text()) for i in range(rows)] + [(3, "abcdef " * 30), (3, "abcdef " * 30), (None, "banana " * 9), (None, None), (5, None), (6, ""), (7, "×÷ 中文 AÉ")]


def test_variants_of_documents_by_sql(spark, sf_dir, duck):
    same_rows(sv.op12_spelling_variants(spark, sf_dir), duck.sql(sv.OP12_SQL))


@pytest.mark.parametrize("seed,region", [(0, 2048), (1, 2048), (2, 7), (3, 2)])
def test_variants(spark, seed, region):
    docs = odd_texts(seed)
    got = variants(spark, docs, region=region)
    assert got == plain_variants(plain_words(docs)) and sum(r[1] is not None for r in got) > 5


def test_bigrams_and_other_bounds(spark):
    docs = odd_texts(8, 60)
    assert variants(spark, docs, min_chars=4, min_count=2, times=2, every=7, q=2) == plain_variants(plain_words(docs, 4, 2, 7), 2)
    with pytest.raises(ValueError):
        variants(spark, docs, min_chars=5, q=3)


def test_no_words(spark):
    assert variants(spark, []) == [] and variants(spark, [(1, "a b c")]) == []


def test_chains_of_forms(spark):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(11)]
    assert {r.word: r.root for r in sv.roots(spark.createDataFrame(rows, "word string, form string")).collect()} == {f"w{i}": "w11" for i in range(11)}


def test_long_texts_are_read_in_stretches():
    text = "abcdef ghijklm" * 1000
    assert "".join(sv.stretches(text, 50)) == text and sum((Counter(sv.RUN.findall(s)) for s in sv.stretches(text, 50)), Counter()) == Counter(sv.RUN.findall(text))
    assert list(sv.stretches("a" * 200, 50)) == ["a" * 200]


def test_one_edit():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(2))
        assert sv.one_edit(a, b) == (b in edits(a))


# --- WARC bundles


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("payload", "payload_key", "first_page", "path", "frame", "refers_to")}).repartition(3)


def archive(spark, tmp_path, rows, least=0, **sizes):
    folder = str(tmp_path / "warc")
    index = wb.write_bundles(wb.deduplicated(pages(spark, rows), least), folder, **sizes)
    return folder, index


def plain_archive(rows, least=0):
    first = {}
    for page_id, _, html in rows:
        p = (html or "").encode()
        if page_id is not None and len(p) >= least:
            first[p] = min(first.get(p, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        p = (html or "").encode()
        to = first.get(p) if len(p) >= least and first.get(p) != page_id else None
        out.append((page_id, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def read(spark, folder):
    return sorted((tuple(r) for r in wb.read_bundles(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ROWS = [(5, "http://a/\r\nX: y", "same"), (3, None, "same"), (9, "http://b/ c", "same"), (1, "u", None), (2, "u", ""), (4, "", "\r\n\r\nWARC/1.1\r\n"), (6, "http://é", "é中\U0001f600"), (7, "u", "x" * 50_000), (8, "u", "y" * 300), (8, "u", "y" * 300), (None, "u", "same"), (None, "u", "alone"), (None, "v", "alone")]


def test_pages_by_sql(spark, sf_dir, duck):
    same_rows(wb.op13_warc_bundles(spark, sf_dir), duck.sql(wb.OP13_SQL))


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    folder, index = archive(spark, tmp_path, ROWS, least, frame_bytes=1000, bundle_bytes=2000)
    assert read(spark, folder) == plain_archive(ROWS, least)
    assert index.count() == len(ROWS) and index.select("path").distinct().count() > 3
    stored = {(r.page_id, bytes(r.payload).decode()) for r in wb.read_bundles(spark, folder).where("record_type = 'response'").collect()}
    assert stored == {(r[0], next(h or "" for i, _, h in ROWS if i == r[0] and len((h or "").encode()) == r[1])) for r in plain_archive(ROWS, least) if r[3] == "response"}


def test_records_are_found_by_id(spark, tmp_path):
    folder, index = archive(spark, tmp_path, ROWS, frame_bytes=400)
    wanted = spark.createDataFrame([(wb.record_id(k),) for k in (6, 9, 8, 77)], "record_id string")
    got = sorted((r.page_id, r.record_type, bytes(r.payload).decode() if r.payload is not None else None) for r in wb.fetch(spark, folder, wanted).collect())
    assert got == [(6, "response", "é中\U0001f600"), (8, "response", "y" * 300), (8, "response", "y" * 300), (9, "revisit", None)]


def test_bundles_are_plain_zstandard(spark, tmp_path):
    folder, index = archive(spark, tmp_path, ROWS, frame_bytes=400)
    for path in {r.path for r in index.collect()}:
        raw = (tmp_path / "warc" / path).read_bytes()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        table = wb.seek_table(io.BytesIO(raw))
        assert whole == b"".join(wb.frame(io.BytesIO(raw), at) for at in table) and sum(at[2] for at in table) == len(whole)
        for r in index.where(F.col("path") == path).collect():
            data = wb.frame(io.BytesIO(raw), table[r.frame])
            assert data[r.offset : r.offset + r.length].startswith(b"WARC/1.1\r\n") and wb.parsed(data, r.offset) == (wb.parsed(data, r.offset)[0], r.offset + r.length)


def test_damage_is_seen():
    good = wb.record(1, "u", b"abc", None)
    with pytest.raises(ValueError):
        wb.parsed(good.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        wb.seek_table(io.BytesIO(b"0" * 40))


def test_no_pages(spark, tmp_path):
    folder, _ = archive(spark, tmp_path, [])
    assert read(spark, folder) == []


def test_many_copies_of_one_payload(spark, tmp_path):
    rows = [(i, "u", "copy" if i % 3 else f"own {i}") for i in range(3000)]
    folder, _ = archive(spark, tmp_path, rows)
    assert read(spark, folder) == plain_archive(rows)
