"""What the training-data operators share: scratch tables in the folder that all machines see, and sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: below spark.checkpoint.dir, which a cluster has to share between its machines.

    Where the session names none (tests, local mode), one below the warehouse is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lectern-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written as Parquet to the shared folder and read again, so that a lost executor costs one task."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a frame of stored() that nothing reads any more."""
    path = getattr(df, "_lectern_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_bytes(column: str):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def crc_mod(column: str, modulus: int):
    """crc32 of an id written as decimal text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def hash_share(share: float, *columns: str):
    """Whether a row is in a sample of `share` of all rows, told by a hash of these columns; it needs no order and no exchange."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)).cast("double") < share * float(1 << 40)
