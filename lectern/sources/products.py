"""The product tree: series with their products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import text as T


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """One row per product of a JSON file, with its series."""
    return flatten_products(spark.read.json(path, schema=schema.PRODUCT_TREE, multiLine=True, mode="FAILFAST"))


def flatten_products(tree: DataFrame) -> DataFrame:
    series = tree.select(F.explode("series").alias("s"))
    rows = series.select(F.col("s.id").alias("series_id"), F.col("s.name").alias("series_name"), F.explode("s.products").alias("p"))
    return rows.select(F.col("p.id").alias("product_id"), "p.display_name", "p.manual_pdf", "p.md_stem", "p.aliases", "series_id", "series_name")


def by_id(products: DataFrame, product_id: str) -> DataFrame:
    return products.filter(F.col("product_id") == product_id).limit(1)


def by_stem(products: DataFrame, stem: str) -> DataFrame:
    return products.filter(T.strip(F.col("md_stem")) == stem.strip()).limit(1)


def by_pdf(products: DataFrame, file_name: str) -> DataFrame:
    return products.filter(F.col("manual_pdf") == file_name).limit(1)


def choices(products: DataFrame) -> DataFrame:
    """(label, product_id) to choose from."""
    return products.select(F.concat(F.col("series_name"), F.lit(" / "), F.col("display_name")).alias("label"), "product_id")
