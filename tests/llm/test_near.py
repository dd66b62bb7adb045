"""N-gram Jaccard join, embedding join and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from yardsticks import classes, jaccard

from loomstat.llm import common, components, embedding_join, jaccard_join

SCHEMA = "doc_id long, text string"


def near(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(common.texts_of(df)).collect())


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(9000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, long), (8, long + " end"), (9, "  \x1c"), (10, "  \x1c"), (11, "a b c d e"), (12, "a b c d e")]
    assert near(spark, rows) == jaccard(rows)


def test_repeated_ids_and_ties(spark):
    rows = [(1, "a b c d e f"), (1, "x y z"), (2, "A B C D E F"), (2, "A B C D E F"), (3, "x y z")]
    got = near(spark, rows)
    assert [(d, c) for d, _, c in got] == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 1)]


def test_empty_table(spark):
    assert near(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_chains_groups_and_boilerplate(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the"] * 20
    common_part = [rng.choice(words) for _ in range(12)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((6, 20, 40, 80)))]
        for _ in range(rng.choice((1, 2, 8))):
            text = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                text[rng.randrange(len(text))] = rng.choice(words)
            base = text if rng.random() < 0.5 else base  # chains drift away from their start
            rows.append((len(rows), " ".join(text + (common_part if g % 3 == 0 else []))))
    rng.shuffle(rows)
    assert near(spark, rows) == jaccard(rows)


def test_at_the_threshold(spark):
    a = [f"w{i}" for i in range(84)]  # 80 shingles; a text of its first 64 words has 60: 60 / 80
    rows = [(1, " ".join(a)), (2, " ".join(a[:64])), (3, " ".join(a[:63]))]
    assert near(spark, rows) == jaccard(rows)
    assert [c for _, _, c in jaccard(rows)] == [1, 1, 1]
    assert near(spark, [rows[0], rows[2]]) == [(1, 80, 1), (3, 59, 3)]


def test_documents(spark, sf_dir):
    d = common.table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.op6_jaccard_join(spark, sf_dir).collect()) == jaccard(rows)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(2):
            t[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(t)))
    assert near(spark, rows) == jaccard(rows)


def test_few_pivots_a_round(spark, monkeypatch):
    """Regions of members that share a passage, with clusters of near copies inside, by as few pivots as there can be."""
    monkeypatch.setattr(jaccard_join, "WORK", 1)
    rng, rows = random.Random(9), []
    passage = [f"p{i}" for i in range(30)]
    for g in range(10):
        centre = [f"g{g}x{i}" for i in range(25)]
        for _ in range(rng.choice((1, 3, 9))):
            text = passage + centre
            for _ in range(rng.choice((0, 1, 2, 3))):
                text[rng.randrange(len(text))] = f"r{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    assert near(spark, rows) == jaccard(rows)


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(80)] + [(500, 500 + i) for i in range(1, 60)]
    graph = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got, again = ({r.id: r.component for r in components.components(graph, n).collect()} for n in (1 << 18, 60))
    assert got == again
    ids = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: k for k, x in enumerate(ids)}
    want = classes(ids, [(at[a], at[b]) for a, b in edges if a != b])
    assert got == dict(zip(ids, want, strict=True))


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_join.near_vectors(df).collect())


def brute_vectors(rows, t=0.98):
    e = [np.array([np.nan if x is None else np.float32(x) for x in v], float) if v is not None else None for _, v, _ in rows]
    good = [x is not None and np.isfinite(x).all() and (x != 0).any() for x in e]
    linked = []
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(e[i]) == len(e[j]):
                if e[i] @ e[j] / np.sqrt((e[i] @ e[i]) * (e[j] @ e[j])) >= t:
                    linked.append((i, j))
    n = [0] * len(rows)
    for i, j in linked:
        n[i] += 1
        n[j] += 1
    return sorted(zip([r[0] for r in rows], n, classes([r[0] for r in rows], linked), strict=True))


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16))
    rows = []
    for k in range(260):
        c = centre[k % 12] + rng.normal(size=16) * rng.choice((0, 0.05, 0.12, 0.2))
        rows.append((k, [float(x) for x in np.float32(c)], int(k % 3)))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None), (905, rows[0][1], 0), (906, rows[0][1][:8], 0), (907, [-0.0] * 16, 1), (908, [], 1), (909, [float("inf")] + [0.0] * 15, 1)]
    assert vectors(spark, rows) == brute_vectors(rows)


def test_no_vectors(spark):
    assert vectors(spark, []) == [] and vectors(spark, [(1, None, None)]) == [(1, 0, 1)]


def test_embeddings_by_sql(spark, sf_dir, duck):
    from conftest import same_rows

    same_rows(embedding_join.op8_embedding_join(spark, sf_dir), duck.sql(embedding_join.OP8_SQL))


def test_extra_columns_do_no_harm(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "a b")], SCHEMA).withColumns({c: F.lit(0) for c in ("fp", "n", "component", "component_id", "key", "n_shingles")})
    assert [(r.doc_id, r.component_id) for r in jaccard_join.jaccard_classes(common.texts_of(d)).collect()] in ([(1, 1), (2, 1)], [(2, 1), (1, 1)])


def test_vectors_beside_clashing_names_and_many_copies(spark):
    rows = [(i, [1.0, 0.0, 0.5] if i < 1500 else [float(i), 1.0, 2.0], 1) for i in range(2600)]  # one vector held by most rows, others by one each
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(0) for c in ("e", "rep", "copies", "digest", "size", "ok", "n", "n_links")})
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_join.near_vectors(df).collect()}
    assert len(got) == 2600 and all(got[i] == (1499, 0) for i in range(1500)) and got[2000][0] > 0


def test_op6_jaccard_join_by_sql(spark, sf_dir, duck):
    from conftest import same_rows

    from loomstat.llm import jaccard_join

    same_rows(jaccard_join.op6_jaccard_join(spark, sf_dir), duck.sql(jaccard_join.OP6_SQL))
