"""Changes between what is configured, what is on disk and what has been ingested, and applying them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detect_changes(products: DataFrame, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(product_id, status): new, changed, unchanged, missing (configured, never ingested, no file) or removed.

    products (product_id), files (product_id, sha256, mtime) and manifest (product_id, pdf_sha256, pdf_mtime, full_doc_id). A
    product is removed if it is in the manifest and its file is gone or it is no longer configured.
    """
    p, f, m = products.select("product_id", F.lit(True).alias("configured")), files.select("product_id", "sha256", "mtime"), manifest.select("product_id", "pdf_sha256", "pdf_mtime", "full_doc_id", F.lit(True).alias("known"))
    rows = p.join(f, "product_id", "left").join(m, "product_id", "full_outer")
    gone = F.col("configured").isNull() | (F.col("sha256").isNull() & F.col("known"))
    same = (F.col("sha256") == F.col("pdf_sha256")) & (F.col("mtime") == F.col("pdf_mtime")) & (F.coalesce("full_doc_id", F.lit("")) != "")
    status = F.when(gone, "removed").when(F.col("sha256").isNull(), "missing").when(F.col("known").isNull(), "new").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return rows.select("product_id", status.alias("status"))


def safe_removals(changes: DataFrame, force: bool = False) -> DataFrame:
    """changes, unless they would remove every product that is known: a folder that isn't there must not empty the collection."""
    if not force:
        known = changes.filter("status IN ('removed', 'changed', 'unchanged')")
        if not known.isEmpty() and known.filter("status <> 'removed'").isEmpty():
            raise ValueError("all products would be removed; pass force=True if that is meant")
    return changes


def tombstones(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """(chunk_id): distinct chunks of products that are removed or changed, in order."""
    out = manifest.join(changes.filter("status IN ('removed', 'changed')"), "product_id", "left_semi")
    return out.select(F.explode("chunk_ids").alias("chunk_id")).distinct()


def without_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunks of other documents than those in documents (full_doc_id)."""
    return chunks.join(documents.select("full_doc_id").distinct(), "full_doc_id", "left_anti").select(*chunks.columns)


def upsert(base: DataFrame, new: DataFrame, deletes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """base without deleted and replaced rows, and the new rows."""
    gone = deletes.select(key).unionByName(new.select(key)).distinct()
    return base.join(gone, key, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def manifest_entries(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """One manifest row per product: its document, its chunks in order, and its file's hash and time."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("chunk_order_index", "chunk_id"))), lambda x: x["chunk_id"])
    rows = chunks.groupBy("product_id").agg(F.first("source_pdf").alias("source_pdf"), F.first("full_doc_id").alias("full_doc_id"), ids.alias("chunk_ids"))
    return rows.join(files, "product_id", "left").select("product_id", "source_pdf", "full_doc_id", "chunk_ids", F.col("sha256").alias("pdf_sha256"), F.col("mtime").alias("pdf_mtime"))


def sync_payload(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Rows with content to embed; of those, the ones in ids (chunk_id) unless ids is None or empty."""
    full = rows.filter(F.trim(F.coalesce("content", F.lit(""))) != "")
    return full if ids is None or ids.isEmpty() else full.join(ids, "chunk_id", "left_semi")
