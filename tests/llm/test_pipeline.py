"""Each stage of the corpus pipeline against what its operator says, and the whole run."""

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from yardsticks import jaccard, sha

import corpus_pipeline
from loomstat.llm import common, queries, source_mix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "source_mix", "encode"]


@pytest.mark.parametrize("stage,name,keep", [(0, "op2_quality_rank", 1), (1, "op9_toxicity", 0)])
def test_filters(spark, docs, stage, name, keep):
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert out.columns == docs.columns
    assert ids(out) == sorted(r.doc_id for r in queries.QUERIES[name](spark, SF).collect() if r.predicted == keep)


def test_one_of_each_group_stays(spark, docs):
    out = corpus_pipeline.one_of_each(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert out.columns == docs.columns and ids(out) == sorted({c for _, _, c in jaccard(rows)})


def test_mix(spark, docs):
    out = corpus_pipeline.mix(spark, docs, SF)
    assert out.columns == docs.columns and ids(out) == ids(source_mix.op10_source_mix(spark, SF))


def test_encode(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in corpus_pipeline.encode(spark, docs, SF).collect():
        want = sp.encode(text[r.doc_id] or "", add_eos=True)
        assert r.ids == want and r.n_tokens == len(want) and r.decoded_sha256 == sha(sp.decode(want))


def test_odd_documents(spark):
    odd = spark.createDataFrame([(1, None, "en", None, 0), (1, None, "en", None, 0), (None, "x y", None, "s", 3), (2, "", "de", "s", 0), (3, "a b c d e f", "en", "s", 1), (4, "a b c d e f", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.withColumns({"score": F.lit(1.0), "label": F.lit(1), "copy": F.lit(0), "component_id": F.lit("x")})
    for d in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, SF)
            assert name == "encode" or out.columns == odd.columns
            out.count()
    assert ids(corpus_pipeline.one_of_each(spark, odd.where("doc_id is not null"), SF)) == [1, 2, 3]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"]
