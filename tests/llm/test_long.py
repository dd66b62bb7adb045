"""Long texts take time in proportion, and repeated ids don't grow what teaches."""

import time

import pytest
from pyspark.sql import functions as F
from yardsticks import sha

from loomstat.llm import chat_format, quality_rank, token_count, toxicity


def took(make):
    began = time.perf_counter()
    out = make()
    return time.perf_counter() - began, out


def conversation(spark, text):
    turns = spark.createDataFrame([(1, 0, "user", "go"), (1, 1, "assistant", text), (1, 2, "user", ""), (1, 3, "assistant", ""), (1, 4, "assistant", "end < ###")], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.render(chat_format.fold_events(chat_format.events_from_turns(turns)))).first()


def test_a_long_turn(spark):
    conversation(spark, "warm up")
    times = []
    for k in (1, 4):
        text = "wörd \U0001f600<x> " * (k << 17)
        t, r = took(lambda text=text: conversation(spark, text))
        times.append(t)
        said = text + "end < ###"
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (5, len(said), sha(said))
    assert times[1] < 10 * times[0] + 5


def test_many_turns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(4000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat_format.digest(chat_format.render(chat_format.fold_events(chat_format.events_from_turns(turns)))).first()
    assert r.n_turns == 4000 and r.loss_sha256 == sha("".join(t for _, _, role, t in rows if role == "assistant"))


def test_token_count_of_a_long_text(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    times = []
    for k in (1, 4):
        text = "some words, été \U0001f600 and more " * (k << 15)
        d = spark.createDataFrame([(1, text)], "doc_id long, text string")
        t, r = took(lambda d=d: token_count.count_tokens(d, P.path("word_bpe_49k.json")).first())
        times.append(t)
        assert r.n_tokens == len(bpe.encode(text, add_special_tokens=False).ids) and r.n_bytes == len(text.encode())
    assert times[1] < 10 * times[0] + 5


@pytest.mark.parametrize("of", [quality_rank, toxicity])
def test_rows_of_repeated_ids_are_bounded(spark, of, monkeypatch):
    seen = {}
    monkeypatch.setattr(of, "MOST_ROWS", 50)
    fit = {quality_rank: "fit_pairs", toxicity: "fit"}[of]
    real = getattr(of, fit)
    monkeypatch.setattr(of, fit, lambda x, y, *rest: seen.update(n=len(y)) or real(x, y, *rest))
    ids = [i for i in range(40) if i % 3][:12]
    docs = spark.range(4000).select(F.element_at(F.array(*map(F.lit, ids)), (F.col("id") % 12 + 1).cast("int")).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    of.train(docs, labels)
    assert 0 < seen["n"] <= 100
