"""Manuals on disk: Markdown files, the outputs of parsers, and files with hashes for change detection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.session import ship_package


def stem(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.regexp_replace(T.basename(path), r"\+", "%2B")), r"\.[^.]*$", "")


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(md_stem, file_path, text) of every *.md below root; bytes that are no UTF-8 are dropped, line ends become line feeds."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.md").load(root)
    text = F.regexp_replace(F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\\x{FFFD}", ""), r"\r\n?", "\n")
    return files.select(stem(F.col("path")).alias("md_stem"), F.col("path").alias("file_path"), text.alias("text"))


def first_of_stem(manuals: DataFrame) -> DataFrame:
    """Of files of one stem, the one whose path comes first."""
    return manuals.groupBy("md_stem").agg(F.min_by(F.struct("file_path", "text"), "file_path").alias("m")).select("md_stem", "m.*")


def matched(manuals: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manuals of known products, manuals of none)."""
    stems = products.select(F.col("md_stem"))
    return manuals.join(stems, "md_stem", "left_semi"), manuals.join(stems, "md_stem", "left_anti")


def output_path(root: str, stem_: Column, method: Column) -> tuple[Column, Column]:
    """Where a parser may have left a document's Markdown: below root/stem/method, or in root itself."""
    name = F.concat(stem_, F.lit(".md"))
    return F.concat_ws("/", F.lit(root), stem_, method, name), F.concat_ws("/", F.lit(root), name)


def hashed_files(spark: SparkSession, root: str, products: DataFrame) -> DataFrame:
    """(product_id, sha256, mtime) of the source files that products name."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True).load(root)
    rows = files.select(F.url_decode(F.regexp_replace(T.basename(F.col("path")), r"\+", "%2B")).alias("manual_pdf"), T.file_hash(F.col("content")).alias("sha256"), F.unix_micros("modificationTime").alias("us"))
    return products.join(rows, "manual_pdf").select("product_id", "sha256", (F.col("us") / 1e6).alias("mtime"))


class DocumentParser(Protocol):
    """Turns the bytes of a document into Markdown; raises for what it can't read."""

    def parse(self, name: str, data: bytes, method: str) -> str: ...


IMAGE_SUFFIXES = r"(?i)\.(?:png|jpe?g|bmp|tiff?|gif|webp)$"


def parse_documents(files: DataFrame, done: DataFrame, parser: Callable[[], DocumentParser], method: str = "auto") -> DataFrame:
    """files (path, content) that are not in done (md_stem) to (md_stem, path, method, text, error); images are always read by ocr."""
    ship_package(files.sparkSession)
    rows = files.withColumn("md_stem", stem(F.col("path"))).join(done.select("md_stem").distinct(), "md_stem", "left_anti")
    rows = rows.withColumn("method", F.when(F.rlike("path", F.lit(IMAGE_SUFFIXES)), "ocr").otherwise(method))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = parser()
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    out.append((r.md_stem, r.path, r.method, tool.parse(r.path, r.content, r.method), None))
                except Exception as e:  # reported in the row
                    out.append((r.md_stem, r.path, r.method, None, str(e)))
            yield pd.DataFrame(out, columns=["md_stem", "path", "method", "text", "error"])

    return rows.select("md_stem", "path", "method", "content").mapInPandas(run, "md_stem string, path string, method string, text string, error string")
