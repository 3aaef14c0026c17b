"""Search from questions to ranked chunks and prepared prompts: one plan for all queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as T
from lectern.operators import context, ranking, retrieval, topics
from lectern.operators.frames import broadcast_small
from lectern.providers import Embedder, Reranker, embed


@dataclass
class Engine:
    """A collection to search: chunks (chunk_id, product_id, content, section_title, ...) with their term index; optionally vectors,
    products and a section index, and the models to use."""

    chunks: DataFrame
    index: retrieval.TermIndex
    vectors: DataFrame | None = None
    products: DataFrame | None = None
    sections: DataFrame | None = None
    embedder: Callable[[], Embedder] | None = None
    reranker: Callable[[], Reranker] | None = None

    @classmethod
    def build(cls, chunks: DataFrame, **more) -> Engine:
        return cls(chunks, retrieval.build_index(chunks), **more)

    def hybrid(self, queries: DataFrame, fetch: int) -> DataFrame:
        """queries (query_id, text, product_id) to fused hits (query_id, chunk_id, score), `fetch` from each leg."""
        terms = retrieval.term_leg(self.index, queries, fetch)
        if self.vectors is None or self.embedder is None:
            none = terms.select("query_id", "chunk_id", F.col("bm25_score").alias("emb_score")).filter(F.lit(False))
            return retrieval.fuse(terms, none)
        asked = embed(queries, "query_id", "text", self.embedder, to="vector").join(queries.select("query_id", "product_id"), "query_id")
        vectors = self.vectors.join(self.chunks.select("chunk_id", F.col("product_id").alias("owner")), "chunk_id")
        rows = vectors.join(broadcast_small(asked), (F.coalesce("product_id", F.lit("")) == "") | (F.col("owner") == F.col("product_id")))
        scored = rows.select("query_id", "chunk_id", F.round(retrieval.cosine(F.col("embedding"), F.col("vector")), 9).alias("score"))
        near = retrieval.min_max(retrieval.top_per_query(scored, fetch)).select("query_id", "chunk_id", F.col("score").alias("emb_score"))
        return retrieval.fuse(terms, near)

    def boosted(self, hits: DataFrame, queries: DataFrame) -> DataFrame:
        """hits of products that a query without a product names, raised."""
        rows = hits.join(self.chunks.select("chunk_id", "product_id"), "chunk_id")
        if self.products is None:
            return rows
        named = topics.match_products(queries.filter(F.coalesce("product_id", F.lit("")) == ""), self.products)
        return retrieval.boost_products(rows, named)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """Plain search: fused, boosted, the k best with their texts."""
        hits = retrieval.top_per_query(self.boosted(self.hybrid(queries, max(1, 5 * k)), queries), k)
        return hits.join(self.chunks.drop("product_id"), "chunk_id")

    def retrieve(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """Search with expansion, rules and reranking: ranked hits of each query, with the columns of chunks.

        Sub-queries of all queries are searched together; the texts of chunks are joined only to hits.
        """
        queries = queries.select("query_id", T.text(F.col("text")).alias("text"), "product_id")
        sections = self.sections if self.sections is not None else self.chunks.sparkSession.createDataFrame([], "product_id string, bucket string, titles array<string>")
        subs = topics.expand(queries, sections)
        k, fetch, leg = ranking.fetch_sizes(top_k, 2, self.reranker is not None)
        sub_id = F.struct("query_id", "sub_ord")
        asked = subs.join(queries.select("query_id", "product_id"), "query_id").select(F.to_json(sub_id).alias("query_id"), F.col("query_id").alias("parent"), "sub_ord", "text", "product_id")
        hits = self.boosted(self.hybrid(asked, leg), asked)
        hits = retrieval.top_per_query(hits, fetch).drop("rank").join(broadcast_small(asked.select("query_id", "parent", "sub_ord")), "query_id")
        best = retrieval.best_of_subqueries(hits.select(F.col("parent").alias("query_id"), "sub_ord", "chunk_id", "score"))
        intro = (F.coalesce("product_id", F.lit("")) != "") & T.intro_query(F.col("text"), vocab.INTRO_QUERY)
        facts = queries.join(topics.active_topic(queries), "query_id", "left").select("query_id", F.col("text").alias("query_text"), intro.alias("is_intro"), "bucket")
        rows = best.join(broadcast_small(facts), "query_id").join(self.chunks, "chunk_id")
        rows = ranking.topic_filter(ranking.post_rank(rows))
        rows = ranking.rerank(rows, self.reranker, k) if self.reranker is not None else rows
        return retrieval.top_per_query(ranking.min_score(ranking.score_gap(rows, k)), k)

    def trace(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """What retrieve() returns, as (query_id, rank, score, section_title, chunk_id)."""
        return self.retrieve(queries, top_k).select("query_id", "rank", "score", "section_title", "chunk_id").orderBy("query_id", "rank")

    def prepare(self, questions: DataFrame, subject: str, top_k: int | None = None, images: DataFrame | None = None) -> DataFrame:
        """questions (query_id, text, product_id, history) to state, prompt, sources and images of each."""
        hits = self.retrieve(questions.filter(T.strip(F.col("text")) != ""), top_k)
        if "source" not in hits.columns:
            hits = hits.withColumn("source", T.text(F.col("file_path")))
        shown = hits.select("query_id", F.col("rank").alias("chunk_rank"), "content", "section_title", F.posexplode(F.coalesce("image_paths", F.array().cast("array<string>"))).alias("pos", "rel_path"))
        sizes = images.select("rel_path", "width", "height") if images is not None else None
        shown = shown.join(sizes, "rel_path", "left") if sizes is not None else shown.withColumns({"width": F.lit(None).cast("int"), "height": F.lit(None).cast("int")})
        catalog = context.image_catalog(shown)
        names = self.products.select("product_id", F.col("display_name").alias("name")) if self.products is not None else None
        asked = questions.join(names, "product_id", "left") if names is not None else questions.withColumn("name", F.lit(None).cast("string"))
        ready = context.prepared(asked, context.context(hits, catalog), hits.filter("rank = 1"), subject)
        listed = catalog.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("vision_index", "image_id", "display_url", "caption_hint"))).alias("images"))
        return ready.join(context.sources(hits), "query_id", "left").join(listed, "query_id", "left")
