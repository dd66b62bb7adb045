"""What a task of a token count holds."""

from __future__ import annotations

import public_tokenizers as P

from loomstat.llm import token_count


def test_a_task_of_a_token_count_runs_one_python_worker(spark):
    d = spark.createDataFrame([(1, "a b " * 10), (2, "c")], "doc_id long, text string")
    t = token_count.count_tokens(d, P.path("word_bpe_49k.json"), chunk_chars=5, fan=3)
    lines = t._jdf.queryExecution().executedPlan().toString().splitlines()
    passes = [("Exchange" if "Exchange" in x else "Python") for x in lines if "Exchange" in x or "InArrow" in x]
    # from the first level down, a shuffle lies between any two passes but for the one that every branch begins with
    assert passes.count("Python") > 3
    assert all("Exchange" in pair for pair in zip(passes[1:], passes[2:], strict=False))
    assert sorted((r.doc_id, r.n_tokens) for r in t.collect()) == [(1, token_count.counter(P.path("word_bpe_49k.json")).count("a b " * 10)), (2, 1)]


def test_states_share_equal_parts():
    c = token_count.SegmentCounts(P.path("word_bpe_49k.json"))
    text = "The transducer shares what is equal in its states, whatever words they come from. Interchangeable counterexamples!"
    c.count(text)
    m = c.machine
    for place in range(3):
        parts = [s[place] for s in m.states[1:]]
        assert len({id(x) for x in parts}) == len(set(parts))
    assert c.most <= 200_000 and m.most_states <= 200_000
