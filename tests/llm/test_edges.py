"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and columns of clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lectern.llm import lm_scoring, mixing, near_vectors, ngram_join, packing, pii, quality, token_counts, topk, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def labels(spark):
    return spark.createDataFrame([(k, None if k is None else k % 2, None if k == 3 else int(k in (8, 9)), "t") for k in [*range(12), 3, None]], "doc_id long, quality int, toxic int, text string")


OPERATORS = {
    "mix": mixing.mix_plan,
    "ngram": ngram_join.near_texts,
    "tokens": lambda d: token_counts.token_counts(d, VOCABULARY),
    "lm": lm_scoring.score_texts,
    "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.fitted(d, labels(d.sparkSession))),
    "quality": lambda d: quality.score_quality(d, quality.fitted(d)),
    "pii": pii.find_pii,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(edge_docs, no_docs, name):
    out = OPERATORS[name](edge_docs)
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(map(str, (r["doc_id"] for r in edge_docs.collect())))
    assert OPERATORS[name](no_docs).collect() == []


@pytest.mark.parametrize("stage", [mixing.mixed_documents, ngram_join.one_of_each, pii.redacted, lambda d: toxicity.drop_toxic(d, toxicity.ToxicModel(constant=0.0))])
def test_stages_keep_columns(edge_docs, no_docs, stage):
    out = stage(edge_docs)
    assert out.columns == edge_docs.columns and out.schema.simpleString() == edge_docs.schema.simpleString()
    assert out.count() <= 2 * edge_docs.count()
    assert stage(no_docs).count() == 0


def test_packing_uses_every_id_once(edge_docs, no_docs):
    rows = packing.pack_documents(edge_docs, VOCABULARY).collect()
    total = token_counts.token_counts(edge_docs, VOCABULARY).agg(F.sum(F.col("n_tokens") + 1)).first()[0]
    assert sum(r["length"] for r in rows) == total
    assert packing.pack_documents(no_docs, VOCABULARY).count() == 0


def test_vectors_with_odd_components(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (50, [-1.0, 0.01]), (100, [1e9, 1.0])]
    for kind in ("float", "double"):
        v = spark.createDataFrame([(a, b, 0, 1) for a, b in rows], f"vec_id long, embedding array<{kind}>, label int, node long")
        found = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(v).collect()}
        assert (1, 2, 1, True) in found and (2, 2, 1, False) in found and (100, 2, 1, False) in found
        assert {(3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (None, 0, None, True), (50, 0, 50, True)} <= found
        top = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_inner_products(v, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
        assert top[:5] == [(50, 1, 3, 0), (50, 2, 1, -65536), (50, 3, 1, -65536), (50, 4, 2, -131072), (50, 5, 100, 2 * 256 - 256 * 256 * 10**9)] and [t[0] for t in top[5:]] == [100] * 5
        assert near_vectors.near_vectors(v.limit(0)).count() == 0 and topk.top_inner_products(v.limit(0), F.lit(True)).count() == 0
