"""Registered queries: each applies operators of the library to the standard tables or to a small inline table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import fixtures, vocab
from lectern.functions import frames, text as T, urls
from lectern.operators import chunker, context, ranking, retrieval, sync, topics
from lectern.sources import products as product_source
from lectern.streaming.answers import assembled, assembled_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: their source plays the product."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("product_id"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.lit(None).cast("string").alias("product_id"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- identifiers and text ---------------------------------------------------------------------------------------------


@query
def ids_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.doc_id(F.col("source")).alias("full_id"), T.chunk_id(T.doc_id(F.col("source")), F.col("doc_id"), F.col("text")).alias("chunk"), T.content_hash(F.col("text")).alias("hash"))


@query
def token_count_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query
def char_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.bigrams(F.col("text"))).alias("gram"))
    return d.groupBy("doc_id", "gram").agg(F.count("*").alias("n"))


@query
def md_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.sql(fixtures.MANUALS)
    doc = T.doc_id(F.col("md_stem"))
    return m.select("doc_id", F.array_join(T.image_targets(F.col("text")), "|").alias("targets"), F.array_join(T.chunk_images(T.image_targets(F.col("text")), doc), "|").alias("paths"), T.without_images(F.col("text")).alias("clean"))


@query
def chunk_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    once = T.with_prefix(F.col("text"), F.col("source"), F.col("lang"), F.lit(""), F.when(F.col("doc_id") % 2 == 0, "general"))
    return d.select("doc_id", once.alias("content"), T.with_prefix(once, F.col("source"), F.col("lang"), F.lit(""), F.when(F.col("doc_id") % 2 == 0, "general")).alias("again"))


@query
def rerank_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[产品: x]\n"), "text")).otherwise(F.col("text"))
    return d.select("doc_id", T.rerank_snippet(F.when(F.col("doc_id") % 2 == 0, F.col("source")), content, 64).alias("snippet"))


@query
def metadata_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.sql(fixtures.METADATA)
    return m.select("id", F.array_join(T.metadata_list(F.col("raw")), "|").alias("items"), F.array_join(T.image_paths(F.col("raw")), "|").alias("paths"))


@query
def metadata_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), T.flat_list(F.array("event_type", F.col("user_id").cast("string"))).alias("flat"))


@query
def html_table_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.sql(fixtures.TABLES)
    return t.select("id", T.markdown_table(F.array("a", "b", "c")).alias("md"))


@query
def implicit_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql(fixtures.DOCX)
    return d.select("pos", T.heading_level(F.col("style")).cast("bigint").alias("level"), T.implicit_heading(F.col("line")).alias("implicit"))


@query
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(fixtures.MANUALS).select("doc_id", F.array_join(T.captions(F.col("text")), "|").alias("captions"))


@query
def escaped_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query
def kb_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = spark.sql(fixtures.URLS)
    return u.select("id", urls.image_url(F.col("raw")).alias("url"), urls.relative_path(F.col("raw")).alias("rel"), urls.public_url(F.col("raw"), "https://kb.example/").alias("public"), urls.display_url(F.col("raw")).alias("display"))


@query
def answer_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.sql(fixtures.ANSWERS)
    images = F.array(F.struct("image_id", "display_url", "caption_hint"))
    return a.select("id", urls.cited_images(F.col("answer"), images).alias("cited"), urls.public_answer(F.col("answer"), images).alias("public"))


# --- retrieval --------------------------------------------------------------------------------------------------------


@query
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.build_index(corpus(spark, sf_dir)).terms.select("term", "df", "cf", "idf"), "idf")


@query
def bm25_han(spark: SparkSession, sf_dir: str) -> DataFrame:
    manuals = spark.sql(fixtures.MANUALS).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("product_id"))
    hits = retrieval.bm25_scores(retrieval.build_index(manuals), spark.sql(fixtures.QUERIES).select("query_id", "text"))
    return rounded(hits.select("query_id", F.col("chunk_id").alias("doc_id"), "score"), "score")


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.bm25_scores(retrieval.build_index(corpus(spark, sf_dir)), benchmark_queries(spark, sf_dir)).filter("score > 0")
    top = retrieval.top_per_query(retrieval.min_max(hits), 10)
    return rounded(top.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"), "score"), "score")


@query
def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", F.col("n_chars").cast("double").alias("score"))
    return rounded(retrieval.min_max(d), "score")


@query
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))  # the search set, against all rows
    hits = retrieval.vector_hits(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), asked, 10)
    return rounded(hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "score"), "score")


def _legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both legs of every benchmark item; the vector of the same number plays its embedding."""
    asked = benchmark_queries(spark, sf_dir)
    terms = retrieval.term_leg(retrieval.build_index(corpus(spark, sf_dir)), asked, 50)
    e = table(spark, sf_dir, "embeddings")
    vectors = e.join(asked, F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("vector"))
    return terms, retrieval.vector_leg(e.select(F.col("vec_id").alias("chunk_id"), "embedding"), vectors, 50)


@query
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.fuse(*_legs(spark, sf_dir)), "score")


@query
def hybrid_degrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As if only the longer texts had been embedded."""
    terms, vectors = _legs(spark, sf_dir)
    long = benchmark_queries(spark, sf_dir).filter(F.length("text") >= 200).select("query_id")
    return rounded(retrieval.fuse(terms, vectors.join(long, "query_id", "left_semi")), "score")


@query
def alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.match_products(spark.sql(fixtures.QUERIES), spark.sql(fixtures.PRODUCTS))


@query
def alias_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    hits = d.select((F.col("doc_id") % 3).alias("query_id"), F.col("source").alias("product_id"), "doc_id", ((F.col("doc_id") % 100) / 100.0).cast("double").alias("score"))
    marks = d.filter("n_chars > 6000").select((F.col("doc_id") % 3).alias("query_id"), F.col("source").alias("product_id"))
    return rounded(retrieval.boost_products(hits, marks), "score")


@query
def subquery_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    hits = d.select((F.col("doc_id") % 5).alias("query_id"), (F.col("doc_id") % 7).alias("sub_ord"), (F.col("doc_id") % 40).alias("chunk_id"), ((F.col("n_chars") % 50) / 50.0).cast("double").alias("score"))
    return rounded(retrieval.best_of_subqueries(hits), "score")


# --- topics -----------------------------------------------------------------------------------------------------------


@query
def topic_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.sql(fixtures.QUERIES)
    return topics.triggered(q).select("query_id", "bucket", F.col("ord").cast("bigint").alias("ord")).join(topics.active_topic(q).withColumnRenamed("bucket", "active"), "query_id")


@query
def section_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.section_index(spark.sql(fixtures.SECTIONS)).select("product_id", "bucket", F.array_join("titles", "|").alias("titles"))


@query
def topic_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.expand(spark.sql(fixtures.QUERIES), topics.section_index(spark.sql(fixtures.SECTIONS)))


@query
def product_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = spark.sql(fixtures.PRODUCTS)
    p = F.struct(F.col("product_id").alias("id"), "display_name", "manual_pdf", "md_stem", "aliases")
    series = flat.groupBy("series_id", "series_name").agg(F.collect_list(p).alias("products"))
    tree = series.agg(F.collect_list(F.struct(F.col("series_id").alias("id"), F.col("series_name").alias("name"), "products")).alias("series"))
    return product_source.flatten_products(tree).withColumn("aliases", F.array_join("aliases", "|"))


@query
def product_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.sql(fixtures.PRODUCTS)
    found = [("id", product_source.by_id(p, "p2")), ("stem", product_source.by_stem(p, " 手册甲 ")), ("pdf", product_source.by_pdf(p, "戊.pdf")), ("none", product_source.by_id(p, "p9"))]
    out = [df.select(F.lit(how).alias("how"), "product_id") for how, df in found]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query
def product_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_source.choices(spark.sql(fixtures.PRODUCTS))


# --- chunks -----------------------------------------------------------------------------------------------------------


@query
def numbered_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, clean = chunker.parse_numbered(F.col("title"))
    return spark.sql(fixtures.TITLES).select("id", number.alias("number"), clean.alias("clean"))


@query
def classify_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(fixtures.TITLES).select("id", chunker.classify_title(F.col("title"), fixtures.PAGE_HEADERS).alias("kind"))


@query
def split_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunker.split_blocks(spark.sql(fixtures.MANUALS), fixtures.PAGE_HEADERS)


@query
def split_h1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), (F.col("doc_id") % 9).cast("string"), F.lit(" "), F.replace("text", F.lit(". "), F.lit(".\n# "))).alias("text"))
    return chunker.split_blocks(d).groupBy("doc_id", "block_type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query
def merge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunker.merge_blocks(chunker.split_blocks(spark.sql(fixtures.MANUALS), fixtures.PAGE_HEADERS))
    return rows.withColumn("block_types", F.array_join("block_types", ","))


@query
def step_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(fixtures.OVERSIZE).select("chunk_id", F.array_join(chunker.step_parts(F.col("content")), "|").alias("parts"))


@query
def paragraph_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(fixtures.OVERSIZE).select("chunk_id", F.array_join(chunker.packed_paragraphs(F.col("content"), 6), "|").alias("parts"))


@query
def paragraph_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunker.packed_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")), 120)).alias("part"))
    return d.groupBy("doc_id").agg(F.count("*").alias("parts"), F.max(T.token_count(F.col("part"))).alias("longest"), F.sum(F.length("part")).alias("chars"))


@query
def chunk_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.sql(fixtures.MANUALS).withColumn("file_path", F.concat("md_stem", F.lit(".md")))
    rows = chunker.document_chunks(m.select("md_stem", "file_path", "text"), spark.sql(fixtures.PRODUCTS), 1700000000, 20, fixtures.PAGE_HEADERS)
    return rows.withColumn("image_paths", F.array_join("image_paths", "|"))


# --- ranking and context ----------------------------------------------------------------------------------------------


@query
def postrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.post_rank(spark.sql(fixtures.RANKED)).select("query_id", "chunk_id", "score"), "score")


@query
def topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.topic_filter(spark.sql(fixtures.RANKED)).select("query_id", "chunk_id")


def _document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select((F.col("doc_id") % 50).alias("query_id"), F.col("doc_id").alias("chunk_id"), (1.0 / (1.0 + F.col("n_chars") / 1000.0)).cast("double").alias("score"))


@query
def score_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ranking.score_gap(_document_scores(spark, sf_dir), vocab.TOP_K)
    return rounded(kept.withColumn("rank", F.col("rank").cast("long")), "score")


@query
def min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.min_score(_document_scores(spark, sf_dir)), "score")


@query
def image_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.image_catalog(spark.sql(fixtures.IMAGES))


def _ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")  # ten hits a query
    rows = d.select(F.floor(F.col("doc_id") / 10).alias("query_id"), (F.col("doc_id") % 10 + 1).cast("int").alias("rank"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("display_name"), F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("section_title"), F.col("source"), F.col("text").alias("content"), (F.lit(1.0) - (F.col("doc_id") % 10) / 64.0).cast("double").alias("score"))
    return rows.withColumn("image_paths", F.when(F.col("rank") == 1, F.array(F.lit("images/d/a.png"), F.lit("images/d/c.png"))))


@query
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.context(_ranked_documents(spark, sf_dir), context.image_catalog(spark.sql(fixtures.IMAGES)))


@query
def sources_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = context.sources(_ranked_documents(spark, sf_dir)).select("query_id", F.posexplode("sources").alias("pos", "s"))
    return rounded(s.select("query_id", F.col("pos").cast("long").alias("pos"), "s.display_name", "s.section_title", "s.snippet", "s.score"), "score")


@query
def search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _ranked_documents(spark, sf_dir).withColumns({"file_path": F.concat(F.lit("a/b/"), F.col("chunk_id").cast("string"), F.lit(".md")), "title": F.lit(None).cast("string"), "source": F.when(F.col("chunk_id") % 2 == 0, F.col("source"))})
    return rounded(context.search_response(hits).withColumn("rank", F.col("rank").cast("long")), "score")


@query
def history_last6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.history(table(spark, sf_dir, "conversations"))


# --- synchronisation --------------------------------------------------------------------------------------------------


@query
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.sql(fixtures.SNAPSHOTS)
    manifest = s.filter("old_sha IS NOT NULL").select("product_id", F.col("old_sha").alias("pdf_sha256"), F.col("old_mtime").alias("pdf_mtime"), F.col("old_doc").alias("full_doc_id"))
    return sync.detect_changes(s.filter("configured"), s.filter("sha256 IS NOT NULL"), manifest)


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A collection before one source was added; its rows that are new or changed (long ones with a note); rows that are too short and go."""
    d = corpus(spark, sf_dir)
    new = d.withColumn("content", F.when(F.length("content") > 1000, F.concat(F.lit("new "), "content")).otherwise(F.col("content")))
    return d.filter("product_id <> 'src1'"), new.filter("length(content) > 1000 OR product_id = 'src1'"), d.filter("length(content) < 200").select("chunk_id")


@query
def sync_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.upsert(*_versions(spark, sf_dir))


@query
def sync_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_payload(corpus(spark, sf_dir), _versions(spark, sf_dir)[1].select("chunk_id")).select("chunk_id")


@query
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = corpus(spark, sf_dir).groupBy("product_id").agg(F.collect_list(F.col("chunk_id").cast("string")).alias("chunk_ids"))
    changes = ids.select("product_id", F.when(F.length("product_id") == 4, "changed").otherwise("unchanged").alias("status"))
    return sync.tombstones(ids, changes)


@query
def remove_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir).withColumn("full_doc_id", T.doc_id(F.col("product_id")))
    return sync.without_documents(d, d.filter("product_id < 'src1'")).select("chunk_id", "full_doc_id")


@query
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir).select("product_id", F.lit("x.pdf").alias("source_pdf"), T.doc_id(F.col("product_id")).alias("full_doc_id"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("chunk_id").alias("chunk_order_index"))
    files = d.select("product_id").distinct().filter("product_id <> 'src0'").select("product_id", F.sha2("product_id", 256).alias("sha256"), F.lit(1.5).cast("double").alias("mtime"))
    return sync.manifest_entries(d, files).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


# --- message frames ---------------------------------------------------------------------------------------------------


@query
def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assembled(spark.sql(fixtures.SSE))
    return rows.select("request_id", F.array_join(F.transform("events", lambda e: F.concat_ws("=", e["event"], e["data"])), "|").alias("events"), "rest")


@query
def llm_stream_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(fixtures.STREAM).withColumn("text", frames.payload_text(F.col("line")))
    return assembled_text(lines)
