"""Image files: sizes from their first bytes, inline parts for a model, copies into the collection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 4 * 1024 * 1024
MIME_TYPES = ("image/jpeg", "image/png", "image/webp", "image/gif")


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG or JPEG; None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xFF:  # filling
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def with_sizes(files: DataFrame) -> DataFrame:
    """files (path, content) with width and height, null where they can't be read."""

    @F.pandas_udf("width int, height int")
    def sizes(content: pd.Series) -> pd.DataFrame:
        found = [image_size(bytes(c)) if c is not None else None for c in content]
        return pd.DataFrame({"width": pd.array([f and f[0] for f in found], "Int32"), "height": pd.array([f and f[1] for f in found], "Int32")})

    return files.withColumn("size", sizes("content")).select("*", "size.width", "size.height").drop("size")


def mime_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix == "png", "image/png").when(suffix == "webp", "image/webp").when(suffix == "gif", "image/gif").otherwise("image/jpeg")


def inline_parts(files: DataFrame, most: int = 5) -> DataFrame:
    """files (query_id, pos, path, content) as parts (mimeType, data) of each query, up to its first repeated path; larger files are left out."""
    from pyspark.sql import Window as W

    again = F.row_number().over(W.partitionBy("query_id", "path").orderBy("pos")) > 1
    rows = files.withColumn("again", again).withColumn("stopped", F.max(F.col("again").cast("int")).over(W.partitionBy("query_id").orderBy("pos")))
    rows = rows.filter((F.col("stopped") == 0) & F.col("content").isNotNull() & (F.octet_length("content") <= MOST_BYTES))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("pos"))).filter(F.col("n") <= most)
    part = F.struct("n", F.struct(mime_type(F.col("path")).alias("mimeType"), F.base64("content").alias("data")).alias("part"))
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"]).alias("parts"))


def referenced_images(chunks: DataFrame, root: str) -> DataFrame:
    """(rel_path, content) of the files below root that chunks name in image_paths, for the collection's table of images."""
    wanted = chunks.select(F.explode("image_paths").alias("path")).distinct().select(F.regexp_replace("path", "^images/", "").alias("rel_path"), F.element_at(F.split("path", "/"), -1).alias("name"))
    files = chunks.sparkSession.read.format("binaryFile").options(recursiveFileLookup=True).load(root)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "content").join(wanted, "name")
    return found.groupBy("rel_path").agg(F.min_by("content", "path").alias("content"))
