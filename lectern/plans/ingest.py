"""Ingest: manuals to chunks, vectors and a manifest, in full or only what has changed.

python -m lectern.plans.ingest ROOT_OF_COLLECTION --products FILE --markdown DIR --files DIR [--sync] [--product-id ID] [--force]
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schema
from lectern.operators import chunker, sync, topics
from lectern.providers import Embedder, HashedEmbedder, embed
from lectern.sources import manuals, products
from lectern.sources.tables import Collection


def ingest(
    collection: Collection, configured: DataFrame, markdown: DataFrame, files: DataFrame, *, now: int, only_changes: bool = False, product_ids: list[str] | None = None,
    min_tokens: int = 80, force: bool = False, embedder: Callable[[], Embedder] | None = HashedEmbedder, page_headers: list[str] = (),
) -> DataFrame:
    """Bring the collection up to date and return the changes (product_id, status).

    configured: products; markdown (md_stem, file_path, text); files (product_id, sha256, mtime). Chunks of products that are left alone
    stay as they are; only new chunks are embedded.
    """
    old, vectors, manifest = collection.read("chunks", schema.CHUNKS), collection.read("vectors", schema.VECTORS), collection.read("manifest", schema.MANIFEST)
    changes = sync.detect_changes(configured, files, manifest)
    if only_changes:
        changes = sync.safe_removals(changes, force)
    else:
        changes = changes.withColumn("status", F.when(F.col("status") == "unchanged", "changed").when(F.col("status") == "missing", "new").otherwise(F.col("status")))
    if product_ids:
        changes = changes.filter(F.col("product_id").isin(product_ids))
    todo = configured.join(changes.filter("status IN ('new', 'changed')"), "product_id", "left_semi")
    chunks = chunker.document_chunks(manuals.first_of_stem(markdown), todo, now, min_tokens, list(page_headers))
    gone = sync.tombstones(manifest, changes)
    collection.write("tombstones", gone)
    gone = collection.read("tombstones", schema.TOMBSTONES)
    collection.write("changes", changes)
    changes = collection.read("changes", changes.schema)
    collection.write("new_chunks", chunks)
    new = collection.read("new_chunks", schema.CHUNKS)
    if embedder is not None:
        fresh = sync.sync_payload(new).join(vectors.join(gone, "chunk_id", "left_anti"), "chunk_id", "left_anti")
        collection.write("vectors", sync.upsert(vectors, embed(fresh, "chunk_id", "content", embedder), gone))
    collection.write("chunks", sync.upsert(old, new, gone), partition_by=())
    now_chunks = collection.read("chunks", schema.CHUNKS)
    touched = sync.manifest_entries(now_chunks, files).join(changes.filter("status <> 'removed'"), "product_id", "left_semi")
    left = manifest.join(changes.filter("status IN ('removed', 'new', 'changed')"), "product_id", "left_anti")
    collection.write("manifest", left.unionByName(touched))
    pos = F.struct("full_doc_id", "chunk_order_index")
    collection.write("sections", topics.section_index(now_chunks.withColumn("pos", pos)))
    for name in ("tombstones", "new_chunks"):
        collection.drop(name)
    return changes


def main(args: list[str] | None = None) -> None:
    cli = argparse.ArgumentParser(description=__doc__)
    cli.add_argument("root")
    cli.add_argument("--products", required=True)
    cli.add_argument("--markdown", required=True)
    cli.add_argument("--files", required=True)
    cli.add_argument("--sync", action="store_true")
    cli.add_argument("--force", action="store_true")
    cli.add_argument("--product-id", action="append")
    cli.add_argument("--min-chunk-tokens", type=int, default=80)
    cli.add_argument("--now", type=int, default=None)
    a = cli.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    known = products.read_products(spark, a.products)
    done = ingest(
        Collection(spark, a.root), known, manuals.read_markdown(spark, a.markdown), manuals.hashed_files(spark, a.files, known), now=a.now or int(time.time()),
        only_changes=a.sync, product_ids=a.product_id, min_tokens=a.min_chunk_tokens, force=a.force,
    )
    done.groupBy("status").count().show()


if __name__ == "__main__":
    main()
