"""Adjusting, filtering and cutting ranked chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as T
from lectern.operators.retrieval import top_per_query
from lectern.operators.topics import has_any


def _by_topic(bucket: Column, words: dict[str, list[str]], title: Column) -> Column:
    """Whether title holds one of the words of its topic; false for topics without words."""
    out = F.when(F.lit(False), False)
    for topic, list_ in words.items():
        out = out.when(bucket == topic, has_any(title, list_))
    return F.coalesce(out.otherwise(False), F.lit(False))


def post_rank(hits: DataFrame) -> DataFrame:
    """hits (section_title, content, image_paths, score, is_intro, bucket) with rule-based corrections of score, each kept within 0..1."""
    title, body = T.strip(F.col("section_title")), T.strip(F.col("content"))
    boost, off = _by_topic(F.col("bucket"), vocab.TOPIC_BOOST, title), _by_topic(F.col("bucket"), vocab.TOPIC_OFF, title)
    short = (F.length(body) < vocab.SHORT_BODY) & (F.size(F.coalesce("image_paths", F.array().cast("array<string>"))) == 0) & ~T.has_table(body)
    low = title.isin(vocab.LOW_VALUE_TITLES) | F.startswith(title, F.lit("目录"))
    score = F.col("score")
    for when, by in ((F.coalesce("is_intro", F.lit(False)) & has_any(title, vocab.OVERVIEW_TITLES), 0.30), (boost, 0.25), (off & ~boost, -0.35), (low, -0.40), (short, -0.25)):
        moved = F.least(F.lit(1.0), score + by) if by > 0 else F.greatest(F.lit(0.0), score + by)
        score = F.when(when, moved).otherwise(score)
    return hits.withColumn("score", score)


def topic_filter(hits: DataFrame) -> DataFrame:
    """Without hits whose title is off their query's topic (bucket) and not on it."""
    title = T.strip(F.col("section_title"))
    return hits.filter(~(_by_topic(F.col("bucket"), vocab.TOPIC_OFF, title) & ~_by_topic(F.col("bucket"), vocab.TOPIC_BOOST, title)))


def score_gap(hits: DataFrame, most: int, least: int = vocab.MIN_KEEP, gap: float = vocab.SCORE_GAP) -> DataFrame:
    """The first `least` hits of each query, and up to `most` while they stay within gap of the best."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    rows = hits.withColumns({"rank": F.row_number().over(order), "top": F.max("score").over(W.partitionBy("query_id"))})
    return rows.filter((F.col("rank") <= least) | ((F.col("rank") <= most) & (F.col("top") - F.col("score") <= gap))).drop("top")


def min_score(hits: DataFrame, least: float = vocab.MIN_SCORE) -> DataFrame:
    return hits.filter(F.col("score") >= least)


def rerank(hits: DataFrame, model: Callable[[], Callable[[list[tuple[str, str]]], list[float]]] | None, top: int, candidates: int = vocab.RERANK_CANDIDATES) -> DataFrame:
    """The best `candidates` hits (query_text, section_title, content) of each query scored by model(), of which the best `top` stay.

    Without a model, or where it fails, hits keep their own score.
    """
    rows = top_per_query(hits, candidates).drop("rank")
    if model is not None:
        from lectern.session import ship_package

        ship_package(hits.sparkSession)

        def score(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            try:
                scorer = model()
            except Exception:  # a model that can't be loaded is left out, as the contract says
                scorer = None
            for query, snippet, own in parts:
                try:
                    yield pd.Series(scorer(list(zip(query, snippet, strict=True))), dtype=float) if scorer else own
                except Exception:
                    yield own

        udf = F.pandas_udf(score, "double")
        rows = rows.withColumn("score", udf("query_text", T.rerank_snippet(F.col("section_title"), F.col("content"), vocab.RERANK_CHARS), "score"))
    return top_per_query(rows, top)


def fetch_sizes(top_k: int | None, subqueries: int, reranked: bool) -> tuple[int, int, int]:
    """(results, hits fetched for each sub-query, hits fetched from each leg)."""
    k = top_k or vocab.TOP_K
    fetch = max(4 * k, 20) if reranked else max(3 * k, 12) if subqueries > 1 else max(5 * k, 10)
    return k, fetch, max(1, 5 * fetch)
