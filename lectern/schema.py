"""Schemas of the knowledge base's tables."""

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
PRODUCT_TREE = _struct(series=T.ArrayType(_struct(id=_S, name=_S, products=T.ArrayType(_struct(id=_S, display_name=_S, manual_pdf=_S, md_stem=_S, aliases=STRINGS)))))
PRODUCTS = _struct(product_id=_S, display_name=_S, manual_pdf=_S, md_stem=_S, aliases=STRINGS, series_id=_S, series_name=_S)
CHUNKS = _struct(
    chunk_id=_S, tokens=_I, content=_S, chunk_order_index=_I, full_doc_id=_S, file_path=_S, image_paths=STRINGS, product_id=_S, series_id=_S,
    display_name=_S, section_title=_S, section_number=_S, section_path=_S, chunk_type=_S, source_pdf=_S, content_hash=_S, create_time=_L, update_time=_L,
)
VECTORS = _struct(chunk_id=_S, embedding=T.ArrayType(T.FloatType()))
MANIFEST = _struct(product_id=_S, source_pdf=_S, full_doc_id=_S, chunk_ids=STRINGS, pdf_sha256=_S, pdf_mtime=_D)
TOMBSTONES = _struct(chunk_id=_S)
IMAGES = _struct(rel_path=_S, content=T.BinaryType())
