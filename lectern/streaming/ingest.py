"""Manuals that arrive in a folder, chunked and merged into the collection batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern import schema
from lectern.functions import text as T
from lectern.operators import chunker, sync, topics
from lectern.providers import Embedder, embed
from lectern.sources.manuals import stem
from lectern.sources.tables import Collection


def stream_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """New *.md files of a folder as (md_stem, file_path, text)."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").load(folder)
    path = F.col("_metadata.file_path")
    return files.select(stem(path).alias("md_stem"), path.alias("file_path"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))


def merge_batch(collection: Collection, products: DataFrame, now: int, embedder: Callable[[], Embedder] | None = None):
    """For foreachBatch: the chunks of each document that a batch brings replace those of its older versions. Repeating a batch changes nothing.

    The section index follows, and with an embedder the vectors.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        latest = batch.groupBy("md_stem").agg(F.max_by(F.struct("file_path", "text"), "file_path").alias("m")).select("md_stem", "m.*")
        collection.write("batch_chunks", chunker.document_chunks(latest, products, now))
        new = collection.read("batch_chunks", schema.CHUNKS)
        base = collection.read("chunks", schema.CHUNKS)
        # of every document of the batch, also of those that have no chunk left
        came = latest.join(products.select("md_stem"), "md_stem", "left_semi").select(T.doc_id(F.col("md_stem")).alias("full_doc_id"))
        replaced = base.join(came, "full_doc_id", "left_semi").select("chunk_id")
        if embedder is not None:
            vectors = collection.read("vectors", schema.VECTORS)
            fresh = embed(sync.sync_payload(new), "chunk_id", "content", embedder)
            collection.write("vectors", sync.upsert(vectors, fresh, replaced))
        collection.write("chunks", sync.upsert(base, new, replaced))
        merged = collection.read("chunks", schema.CHUNKS)
        collection.write("sections", topics.section_index(merged.withColumn("pos", F.struct("full_doc_id", "chunk_order_index"))))
        collection.drop("batch_chunks")

    return run


def start_ingest(spark: SparkSession, folder: str, collection: Collection, products: DataFrame, checkpoint: str, now: int, once: bool = False, embedder: Callable[[], Embedder] | None = None) -> StreamingQuery:
    """Start merging; with once, take what is there and stop."""
    writer = stream_markdown(spark, folder).writeStream.foreachBatch(merge_batch(collection, products, now, embedder)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
