"""Topics and products that queries name, and the queries these add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as T
from lectern.operators.frames import broadcast_small, constants


def keyword_table(spark: SparkSession) -> DataFrame:
    return constants(spark, [(k, b, ws) for k, (b, ws) in enumerate(vocab.TOPIC_BUCKETS.items())], "ord int, bucket string, keywords array<string>")


def trigger_table(spark: SparkSession) -> DataFrame:
    return constants(spark, [(k, b, p, vocab.TOPIC_FALLBACK[b]) for k, (b, p) in enumerate(vocab.TOPIC_TRIGGERS.items())], "ord int, bucket string, pattern string, fallback array<string>")


def has_any(title: Column, keywords: list[str]) -> Column:
    return F.rlike(title, F.lit("|".join(keywords))) if keywords else F.lit(False)


def match_products(queries: DataFrame, products: DataFrame) -> DataFrame:
    """(query_id, product_id) where a query's text holds the product's id, name or an alias, in any case."""
    names = products.select("product_id", F.explode(F.concat(F.array("display_name", "product_id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    names = names.select("product_id", F.lower(T.strip(F.col("name"))).alias("name")).filter("name <> ''").distinct()
    asked = queries.select("query_id", F.lower(T.text(F.col("text"))).alias("asked"))
    return asked.join(broadcast_small(names), F.contains("asked", "name")).select("query_id", "product_id").distinct()


def section_index(chunks: DataFrame) -> DataFrame:
    """(product_id, bucket, titles): a product's section titles under each topic, in the order of their first chunk (pos)."""
    rows = chunks.select("product_id", "pos", T.strip(F.col("section_title")).alias("title"), T.strip(F.col("section_path")).alias("path"), T.strip(F.col("chunk_type")).alias("kind"))
    rows = rows.filter((F.coalesce("product_id", F.lit("")) != "") & (F.col("title") != "") & ~F.col("kind").isin("toc", "meta") & ~F.rlike("title", F.lit(vocab.SKIPPED_TITLES)))
    both = F.concat_ws(" ", "path", "title")
    hits = rows.join(F.broadcast(keyword_table(chunks.sparkSession)), F.exists("keywords", lambda k: F.contains(both, k)))
    first = hits.groupBy("product_id", "bucket", "title").agg(F.min("pos").alias("pos"))
    titles = F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"])
    return first.groupBy("product_id", "bucket").agg(titles.alias("titles"))


def triggered(queries: DataFrame) -> DataFrame:
    """(query_id, ord, bucket, fallback) for every topic that a query asks for; the one of least ord is its active topic."""
    return queries.join(F.broadcast(trigger_table(queries.sparkSession)), F.rlike(T.text(F.col("text")), F.col("pattern"))).select("query_id", "ord", "bucket", "fallback")


def active_topic(queries: DataFrame) -> DataFrame:
    """(query_id, bucket): the first topic of each query that has one."""
    return triggered(queries).groupBy("query_id").agg(F.min_by("bucket", "ord").alias("bucket"))


def topic_queries(queries: DataFrame, index: DataFrame, most: int = vocab.TOPIC_TITLES) -> DataFrame:
    """(query_id, extras): for each topic the first titles of the query's product, or of the only product there is, else the fallback."""
    only = index.select("product_id").distinct()
    only = only.agg(F.when(F.count("*") == 1, F.min("product_id")).alias("only_product"))
    asked = triggered(queries).join(queries.select("query_id", "product_id"), "query_id").join(F.broadcast(only))  # one row
    asked = asked.withColumn("product_id", F.coalesce(F.nullif("product_id", F.lit("")), "only_product"))
    found = asked.join(index, ["product_id", "bucket"], "left")
    texts = F.when(F.size(F.coalesce("titles", F.array().cast("array<string>"))) > 0, F.slice("titles", 1, most)).otherwise(F.col("fallback"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", texts.alias("texts"))))
    return found.groupBy("query_id").agg(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["texts"]))).alias("extras"))


def expand(queries: DataFrame, index: DataFrame) -> DataFrame:
    """queries (query_id, text, product_id) to (query_id, sub_ord, text): the query, introductory ones for a product, topic ones; each once."""
    rows = queries.join(topic_queries(queries, index), "query_id", "left")
    none = F.array().cast("array<string>")
    intro = (F.coalesce("product_id", F.lit("")) != "") & T.intro_query(F.col("text"), vocab.INTRO_QUERY)
    more = F.when(intro, F.array(F.concat("text", F.lit(vocab.INTRO_SUFFIX)), F.lit(vocab.INTRO_EXTRA))).otherwise(none)
    every = F.array_distinct(F.concat(F.array("text"), more, F.coalesce("extras", none)))
    return rows.select("query_id", F.posexplode(every).alias("sub_ord", "text")).withColumn("sub_ord", F.col("sub_ord").cast("long"))
