"""Operators on single texts: chat formatting, counts, encoding, scores, rules, mixing."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from yardsticks import WORD, fold, kept, rules, sha, unigram

from loomstat.llm import chat_format, common, lm_score, piece_codec, quality_rank, quality_rules, queries, source_mix, token_count, toxicity

SCHEMA = "doc_id long, text string"
ODD = ["", None, " ", "  a", "a ", "\n\n", "A-Z<|endoftext|>b", "<|startoftext|><|endoftext|", "naïve café ΟΔΟΣ ΑΣ", "日本語 テキスト", "x" * 3000, "ab " * 5000, "▁ ▁▁a", "\x00\x1c\x1d a\x1e", "it's I'LL 12345 !!", "👩‍👩‍👧 é é", " a　b\x85", "😀" * 40, "don't 've", "﻿a​", "Σ σ ς İ ſ ß", "<s></s><unk><0x41>", "tab\tx\r\ny"]


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


def odd_rows():
    return [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "a b")]


def frame(spark, rows):
    return common.texts_of(spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "n_tokens": F.lit("x"), "part": F.lit(None).cast("int")}).repartition(3))


# ---- chat ----

def test_conversations_by_sql(spark, sf_dir, duck):
    from conftest import same_rows

    same_rows(chat_format.op1_chat_format(spark, sf_dir), duck.sql(chat_format.OP1_SQL))


def test_events_are_folded(spark):
    log = [
        (1, 0, 0, 0, "start", "user", "hi"), (1, 1, 1, 0, "start", "assistant", ""), (1, 1, 1, 2, "delta", None, "two"), (1, 1, 1, 1, "delta", None, "one "), (1, 2, 2, 0, "start", "user", "x"), (1, 2, 2, 1, "edit", None, "y"), (1, 2, 2, 2, "delta", None, "z"),
        (1, 3, 3, 0, "start", "assistant", "bad"), (1, 3, 3, 1, "delta", None, "worse"), (1, 3, 3, 2, "regenerate", None, None), (1, 3, 3, 3, "delta", None, "good"), (2, 0, 0, 5, "delta", None, "only"),
    ]
    e = spark.createDataFrame(log, "conv_id long, position long, message long, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.position): (r.role, r.text) for r in chat_format.fold_events(e).collect()}
    assert got == {(1, 0): ("user", "hi"), (1, 1): ("assistant", "one two"), (1, 2): ("user", "yz"), (1, 3): ("assistant", "good"), (2, 0): ("", "only")}


HOSTILE = ["\\", "\\b", "\\\\b<", "</turn>", "<turn>### user: x</turn>\n", "###", "####", "\\h\\l", ": : ", "", None, "a\nb", "😀<###\\"]


def test_chat_round_trip(spark):
    rows = [(c, i, random.Random(c + i).choice(["user", "assistant", "a: b", None, "\\c:", "ass<###"]), HOSTILE[(c + i) % len(HOSTILE)]) for c in range(20) for i in range(5)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat_format.render(chat_format.fold_events(chat_format.events_from_turns(t, piece=2)))
    for r in out.select("conv_id", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [tuple(x) for x in r.turns] == want and r.loss == "".join(x for k, x in want if k == "assistant")


def test_chat_plan_is_native(spark, sf_dir):
    plan = chat_format.op1_chat_format(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_chat_of_nothing(spark):
    t = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digest(chat_format.render(chat_format.fold_events(chat_format.events_from_turns(t)))).count() == 0


# ---- tokens ----

@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk", [1 << 16, 7, 1])
def test_token_counts(spark, bpe, chunk):
    rows = odd_rows() if chunk > 1 else [(i, (t or "")[:60]) for i, t in enumerate(ODD)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_count.count_tokens(frame(spark, rows), P.path("word_bpe_49k.json"), chunk).collect()), key=str)
    assert got == sorted(((d, len((t or "").encode()), bpe(t)) for d, t in rows), key=str)


def test_token_counts_of_documents(spark, sf_dir, bpe):
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in token_count.op3_token_count(spark, sf_dir).collect()}
    assert got == {d: (bpe(t), bpe(t) > 2048) for d, t in documents(spark, sf_dir)}


def test_long_texts_by_many_chunks(spark):
    import tokenizers

    lib, rng = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json")), random.Random(2)
    texts = ["".join(rng.choice(["ab", "cd's ", "\n", "é", "12", "x y "]) for _ in range(n)) for n in (0, 3, 40, 700, 2500)] + ["q" * 900, None]
    rows = list(enumerate(texts))
    got = token_count.count_tokens(frame(spark, rows), P.path("word_bpe_49k.json"), chunk_chars=5, fan=3).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]


def test_state_maps_compose_in_any_order():
    c = token_count.counter(P.path("word_bpe_49k.json"))
    text = "one two  three four five-six'll seven"
    for cuts in ((3, 9, 20), (1, 2, 30), (8, 16, 24)):
        a, b, d, e = (c.state_map(text[i:j]) for i, j in zip((0, *cuts), (*cuts, len(text)), strict=True))
        assert c.compose(c.compose(a, b), c.compose(d, e)) == c.compose(a, c.compose(c.compose(b, d), e))


# ---- pieces ----

@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_pieces(spark, pieces, sf_dir):
    rows = odd_rows() + [(1000 + d, t) for d, t in documents(spark, sf_dir)]
    out = piece_codec.digest_texts(frame(spark, rows), P.path("piece_bpe_32k.model")).collect()
    want = []
    for d, t in rows:
        ids = pieces.encode(t or "", add_eos=True)
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(pieces.decode(ids))))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out), key=str) == sorted(want, key=str)


def test_pieces_as_ids(spark, pieces):
    out = piece_codec.encode_texts(frame(spark, odd_rows()), P.path("piece_bpe_32k.model")).collect()
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in out), key=str) == sorted(((d, i := pieces.encode(t or "", add_eos=True), pieces.decode(i)) for d, t in odd_rows()), key=str)


def test_random_pieces(pieces):
    rng, codec = random.Random(4), piece_codec.PieceCodec(P.path("piece_bpe_32k.model"))
    for _ in range(400):
        t = "".join(rng.choice("abeénrst ▁xz一😀'") for _ in range(rng.randrange(40)))
        assert codec.encode(t) == pieces.encode(t, add_eos=True)


# ---- language model ----

def test_scores(spark, sf_dir):
    rows = [*((d, t) for d, t in documents(spark, sf_dir)), *((5000 + i, t) for i, t in enumerate(ODD))]
    docs = frame(spark, rows).withColumn("train", F.coalesce(common.fold_of("doc_id", 7) != 2, F.lit(False)))
    want = unigram(rows)
    got = lm_score.score_texts(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        _, n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
    held = [r for r in got if want[r.doc_id][0]]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # on texts that taught nothing


def test_model_is_normalised():
    rng = np.random.default_rng(0)
    m = lm_score.untrained(rng.integers(1, 1 << 60, 40).astype(np.uint64), np.arange(40, 0, -1), 7, 3)
    m.p = rng.normal(0, 1, m.p.shape).astype(np.float32)
    n = len(m.class_of)
    for two, one in ((0, 1), (5, m.end), (m.other, 17)):
        p = np.exp(m.log_probability(np.full(n, two), np.full(n, one), np.arange(n)))
        assert math.isclose(p.sum(), 1, rel_tol=1e-5)
        q = m.p[two, : lm_score.WIDTH] + m.p[one, lm_score.WIDTH : 2 * lm_score.WIDTH]
        for e in (0, 3, 20, m.other):  # the two softmaxes, written out
            value = lambda row: math.exp(float(q @ m.p[row, 2 * lm_score.WIDTH : -1] + m.p[row, -1]))  # noqa: B023, E731
            c = m.class_of[e]
            want = value(n + c) / sum(value(n + k) for k in range(m.class_of[-1] + 1)) * value(e) / sum(value(k) for k in range(n) if m.class_of[k] == c)
            assert math.isclose(p[e], want, rel_tol=1e-4)


def test_untrained_model_is_smoothed_frequencies():
    m = lm_score.untrained(np.arange(1, 31, dtype=np.uint64), np.arange(60, 30, -1), 9, 4)
    p = np.exp(m.log_probability(*(np.full(32, 0) for _ in range(2)), np.arange(32)))
    assert np.allclose(p, (np.append(np.arange(60, 30, -1), [9, 4]) + 1) / (sum(range(31, 61)) + 9 + 4 + 32), rtol=1e-5)


def test_blocks_do_not_depend_on_batches(monkeypatch):
    rng = random.Random(8)
    texts = ["w " * rng.randrange(0, 90) for _ in range(500)] + ["long " * 9000]  # one text longer than a block
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(lm_score.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(501)), "text": texts, "train": [True] * 501})
    shape = lambda size: [(b, ids, n.tolist()) for b, ids, _, _, n in lm_score._blocks(batch.slice(i, size) for i in range(0, 501, size))]
    assert shape(501) == shape(7) == shape(100)
    assert [i for _, ids, _ in shape(7) for i in ids] == list(range(501))


def test_content_words_have_their_own_contexts(spark):
    rng, n = random.Random(6), 200  # y7 only ever follows x7
    often = " ".join(f"f{k}" for k in range(62))  # these alone are the most frequent words
    rows = [(i, often + " " + " ".join(f"x{k} y{k}" for k in rng.choices(range(n), k=40))) for i in range(1500)]
    right, wrong = (" ".join(f"x{k} y{(k + d) % n}" for k in range(n)) for d in (0, 1))
    docs = frame(spark, [*rows, (9001, right), (9002, wrong)]).withColumn("train", F.col("doc_id") < 9000)
    got = {r.doc_id: r for r in lm_score.score_texts(docs).where("doc_id > 9000").collect()}
    assert math.isclose(got[9001].base_score, got[9002].base_score, rel_tol=1e-9)
    assert got[9001].score - got[9002].score > 0.5 * n


def test_scores_without_training_texts(spark):
    docs = frame(spark, [(1, "a b"), (2, "")]).withColumn("train", F.lit(False))
    got = {r.doc_id: r for r in lm_score.score_texts(docs).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == 0.0 and math.isfinite(got[1].score)
    assert lm_score.score_texts(docs.limit(0)).count() == 0


# ---- classifiers ----

@pytest.mark.parametrize("name,label,cut,least", [("op2_quality_rank", "quality", 0.5, 0.8), ("op9_toxicity", "toxic", 0.7, 0.85)])
def test_held_out_accuracy(spark, name, label, cut, least):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) and r.held_out == (fold(d, 3) == 1) for d, r in got.items())
    lab = [(r.doc_id, r[label]) for r in common.table(spark, sf, "labels").collect() if fold(r.doc_id, 3) == 1]
    right = [got[d].predicted == y for d, y in lab]
    assert sum(right) / len(right) >= least


def test_classifiers_on_odd_tables(spark):
    docs = frame(spark, odd_rows())
    for labels in ([], [(1, 1, 1)], [(1, None, None), (99, 1, 1), (2, 0, 0)], [(i, i % 2, i % 2) for i in range(20)]):
        lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        q = quality_rank.score_texts(docs, quality_rank.train(docs, lab), ["doc_id"]).collect()
        t = toxicity.score_texts(docs, toxicity.train(docs, lab), ["doc_id"]).collect()
        for out in (q, t):
            assert len(out) == len(odd_rows()) and all(0 <= r.score <= 1 for r in out)
    empty = docs.limit(0)
    assert quality_rank.score_texts(empty, quality_rank.train(empty, lab), ["doc_id"]).count() == 0
    assert toxicity.score_texts(empty, toxicity.train(empty, lab), ["doc_id"]).count() == 0


def test_toxic_words_of_few_texts_count():
    rng = random.Random(8)  # each toxic text holds one of 40 toxic words, so that a word is in 2.5 % of them
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    plain, toxic = [word() for _ in range(300)], [word() for _ in range(40)]
    text = lambda extra: " ".join([*rng.choices(plain, k=20), *extra])
    texts = [text([toxic[i % 40]] if i < 400 else []) for i in range(800)]
    found = [np.unique(np.concatenate([toxicity.grams([t], s)[0] for s in toxicity.SIZES])) for t in texts]
    model = toxicity.fit(found, np.array([1] * 400 + [0] * 400), 0.5)
    bad, good = model.score([text([t]) for t in toxic]), model.score([text([]) for _ in range(40)])
    assert (bad >= 0.7).mean() >= 0.9 and (good < 0.7).mean() >= 0.9


def test_pairwise_loss_orders_scores():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, 3)) + np.outer(y, [1.5, 0, 0])
    r = quality_rank.fit_pairs(x, y)
    s = r.score(x)
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.8 and r.weights[0] > 3 * abs(r.weights[1])


# ---- rules ----

def test_rules(spark, sf_dir):
    extra = ["same line here\n" * 60, " ".join(f"w{i}" for i in range(80)), "a b c\x1c " * 30, " ".join(f"{i}" for i in range(80)), " ".join(f"a{i}#" for i in range(80)), " ".join(f"x{i:030d}" for i in range(60)), " ".join(f"w{i}" for i in range(50)), "".join(f"l{i // 2} v w{i // 2}\n" for i in range(90)), "é " + " ".join(f"ö{i}" for i in range(70)), "many words " * 200_000]
    rows = odd_rows() + [(1000 + d, t) for d, t in documents(spark, sf_dir)] + list(enumerate(extra, 5000))
    docs = frame(spark, rows)
    order = quality_rules.plan_order(docs)
    assert sorted(order) == sorted(r.name for r in quality_rules.RULES)
    for names in (order, order[::-1]):  # the order changes no verdict
        out = quality_rules.judge(docs, names).collect()
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out), key=str)
        assert got == sorted(((d, *rules(t), kept(t)) for d, t in rows), key=str)


def test_rules_of_nothing(spark):
    docs = frame(spark, [])
    assert quality_rules.judge(docs, quality_rules.plan_order(docs)).count() == 0


# ---- mixing ----

def test_mix_by_sql(spark, sf_dir, duck):
    from conftest import same_rows

    same_rows(source_mix.op10_source_mix(spark, sf_dir), duck.sql(source_mix.OP10_SQL))


def test_weights(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 4000, "a").when(F.col("id") < 5000, "b").when(F.col("id") < 5900, None).otherwise("d").alias("source"), F.lit(1).alias("rate"), F.lit(2).alias("cdf"))
    out = source_mix.mix_sources(d, {"a": 1.0, "b": 2.0, None: 1.0, "zero": 0.0}, total_rows=8000)
    n = Counter(r.source for r in out.select("source").collect())
    assert set(n) == {"a", "b", None} and abs(n["a"] - 2000) < 200 and abs(n["b"] - 4000) < 300 and abs(n[None] - 2000) < 200
    assert out.columns == [*d.columns, "copy"]
    again = source_mix.mix_sources(d.repartition(7), {"a": 1.0, "b": 2.0, None: 1.0}, total_rows=8000)
    salted = source_mix.mix_sources(d, {"a": 1.0, "b": 2.0, None: 1.0}, total_rows=8000, most_numbers=0)
    rows = lambda x: sorted((r.doc_id, r["copy"]) for r in x.collect())
    assert rows(out) == rows(again) == rows(salted)


def test_mix_edge_cases(spark):
    d = spark.createDataFrame([(1, None, None), (1, None, None), (None, "x", "s")], "doc_id long, text string, source string")
    assert source_mix.mix_sources(d.limit(0)).count() == 0
    got = source_mix.mix_sources(d, total_rows=60).groupBy("source").count().collect()
    assert {r.source for r in got} == {None, "s"} and all(r["count"] > 5 for r in got)


def test_distributions(spark):
    rated = spark.createDataFrame([("a", False, 3.5), ("", True, 0.01), ("big", False, 20000.0)], "mix_source string, mix_null boolean, rate double")
    got = {r.mix_source: r.cdf for r in source_mix.distributions(rated).collect()}
    for name, rate in (("a", 3.5), ("", 0.01)):
        total = 0.0
        for k in range(12):
            total += math.exp(-rate) * rate**k / math.factorial(k)
            assert math.isclose(got[name][k], total, rel_tol=1e-9)
        assert math.isclose(got[name][-1], 1.0, rel_tol=1e-9)
    big = np.array(got["big"])
    assert (np.diff(big) >= 0).all() and abs(big[20000] - 0.5) < 0.01 and math.isclose(big[-1], 1.0, rel_tol=1e-6)


def test_rows_without_ids_are_drawn_one_by_one(spark):
    d = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("s").alias("source"), F.lit(7).alias("copy"), F.lit(8).alias("mix_n"), F.lit(9).alias("mix_rate"))
    out = source_mix.mix_sources(d)
    assert out.columns == [*d.columns, "copy_"]
    rows = out.collect()
    assert 300 < len(rows) < 500 and 0.5 < len({r.text for r in rows}) / 400 < 0.75 and {(r["copy"], r.mix_n, r.mix_rate) for r in rows} == {(7, 8, 9)}


def test_word_hashes_agree_with_words():
    import pyarrow as pa

    texts = ["a b", "", "A b", "b\ta", "\x1ca b", None]
    raw, offsets = common.buffers(pa.array([t or "" for t in texts]))
    s, e, first = common.words(raw, offsets)
    h = common.word_hashes(raw, s, e)
    flat = [w.lower() for t in texts for w in WORD.findall(t or "")]
    assert len(h) == len(flat) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(h)) for j in range(i))
    assert list(np.diff(first)) == [len(WORD.findall(t or "")) for t in texts]
    assert hashlib.sha256(b"").hexdigest() == sha("")


def test_texts_longer_than_a_slice(spark, pieces):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["alpha", "beta", "γ", "delta9", "x\ny", "#"], k=1_000_000)), "q" * 50_000, "a b"]
    assert len(texts[0].encode()) > piece_codec.RUN_BYTES > common.SLICE_BYTES
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in piece_codec.digest_texts(frame(spark, rows), P.path("piece_bpe_32k.model")).collect()}
    for d, t in rows:
        ids = pieces.encode(t, add_eos=True)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(pieces.decode(ids)))
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    counted = {r.doc_id: r.n_tokens for r in token_count.count_tokens(frame(spark, rows[::2]), P.path("word_bpe_49k.json")).collect()}
    assert counted == {d: len(lib.encode(t, add_special_tokens=False).ids) for d, t in rows[::2]}
    docs = frame(spark, rows + [(i, f"good words {i} here") for i in range(10, 40)])
    lab = spark.createDataFrame([(i, i % 2, i % 2) for i in [0, *range(10, 40)]], "doc_id long, quality int, toxic int")
    for m in (quality_rank, toxicity):
        assert m.score_texts(docs, m.train(docs, lab), ["doc_id"]).count() == 33
    scored = {r.doc_id: r.n_tokens for r in lm_score.score_texts(docs.withColumn("train", F.lit(True))).collect()}
    assert scored[0] == len(WORD.findall(texts[0])) + 1


def test_clashing_names_do_no_harm(spark):
    names = ("formatted", "loss_spans", "event", "position", "message", "seq", "kind", "turns")
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in names})
    out = chat_format.render(chat_format.fold_events(chat_format.events_from_turns(turns)))
    assert out.count() == 1
    docs = common.texts_of(spark.createDataFrame([(1, "a " * 60)], SCHEMA).withColumns({c: F.lit(0) for c in ("n_words", "kept", "base_failed", "h", "rule")}))
    assert [r.n_words for r in quality_rules.judge(docs, quality_rules.plan_order(docs)).collect()] == [60]


def test_op7_quality_rules_by_sql(spark, sf_dir, duck):
    from conftest import same_rows

    from loomstat.llm import quality_rules

    same_rows(quality_rules.op7_quality_rules(spark, sf_dir), duck.sql(quality_rules.OP7_SQL))
