"""Tables of the collection: versions in a folder, of which a pointer names the current one.

A table is never written over while it may be read: a write makes a new version, and the pointer moves when it is whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern import schema


class Collection:
    """The tables below one root, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._cached: dict[str, DataFrame] = {}

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/current"

    def version(self, name: str) -> str | None:
        """The current version of a table, None if there is none."""
        path = self._path(self._pointer(name))
        if not self._fs.exists(path):
            return None
        return self.spark.read.text(self._pointer(name), wholetext=True).first()[0].strip()

    def exists(self, name: str) -> bool:
        return self.version(name) is not None

    def read(self, name: str, empty: StructType) -> DataFrame:
        """The current rows; an empty frame of the schema `empty` if the table isn't there."""
        version = self.version(name)
        if version is None:
            return self.spark.createDataFrame([], empty)
        return self.spark.read.schema(empty).parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        """Replace a table's rows; df may read the table itself."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{name}/{version}")
        self._point(name, version)

    def _point(self, name: str, version: str) -> None:
        staged, final = self._path(f"{self.root}/{name}/staged-{version}"), self._path(self._pointer(name))
        out = self._fs.create(staged, True)
        out.write(bytearray(version.encode()))
        out.close()
        jvm, places = self.spark.sparkContext._jvm, (self._fs.makeQualified(staged), self._fs.makeQualified(final))
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        # one step: whoever reads, or a crash, finds the old pointer or the new one
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(*places, over)
        self._cached.pop(name, None)

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)
        self._cached.pop(name, None)

    def cached(self, name: str, empty: StructType, force: bool = False) -> DataFrame:
        """read(), kept in memory until the table changes or force is given."""
        if force:
            self.reset(name)
        if name not in self._cached:
            self._cached[name] = self.read(name, empty).cache()
        return self._cached[name]

    def reset(self, name: str | None = None) -> None:
        for n in [name] if name else list(self._cached):
            if n in self._cached:
                self._cached.pop(n).unpersist()

    def status(self) -> dict[str, object]:
        """Which parts of the collection are there, and how many chunks."""
        chunks = self.exists("chunks")
        return {"vectors_ready": self.exists("vectors"), "terms_ready": chunks, "chunk_count": self.read("chunks", schema.CHUNKS).count() if chunks else 0}


def collection_root(spark: SparkSession, root: str, names: tuple[str, ...] = ("chunks",)) -> str:
    """Where the tables are: root, its folder `collection`, or, if root is such a folder's child, its parent; else root."""
    root = root.rstrip("/")
    for place in (root, f"{root}/collection", root.rsplit("/", 1)[0]):
        if any(Collection(spark, place).exists(n) for n in names):
            return place
    return root


def read_chunk_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of one object, id to record, as rows of the chunk table; anything but an object is an error."""
    kind = schema.CHUNKS
    value = StructType([f for f in kind.fields if f.name != "chunk_id"])
    raw = spark.read.text(path, wholetext=True).select(F.col("value"))
    checked = raw.select(F.when(F.startswith(F.ltrim("value"), F.lit("{")), F.col("value")).otherwise(F.raise_error(F.lit("a chunk file has to hold one object"))).alias("value"))
    parsed = checked.select(F.from_json("value", f"map<string,{value.simpleString()}>", {"mode": "FAILFAST"}).alias("m"))
    rows = parsed.select(F.explode("m").alias("chunk_id", "r"))
    return rows.select("chunk_id", "r.*").select(*kind.names)


def write_chunk_map(chunks: DataFrame, path: str) -> None:
    """The chunks as lines of JSON, one object each."""
    chunks.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """What write_chunk_map() wrote."""
    return spark.read.schema(schema.CHUNKS).json(path, mode="FAILFAST")


def metadata(chunks: DataFrame) -> DataFrame:
    """chunks with scalar metadata only: lists joined by semicolons, nested values as JSON, content left out."""
    out = []
    for f in chunks.schema.fields:
        if f.name == "content":
            continue
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        out.append((F.array_join(c.cast("array<string>"), ";") if kind == "array" else F.to_json(c) if kind in ("map", "struct") else c).alias(f.name))
    return chunks.select(*out)


def read_manifest(collection: Collection) -> DataFrame:
    return collection.read("manifest", schema.MANIFEST)


def section_index_json(index: DataFrame) -> str:
    """The section index (product_id, bucket, titles) as one JSON text; one row per product and topic."""
    out: dict[str, dict[str, list[str]]] = {}
    for r in index.orderBy("product_id", "bucket").toLocalIterator():
        out.setdefault(r["product_id"], {})[r["bucket"]] = list(r["titles"])
    return json.dumps(out, ensure_ascii=False, indent=2)
