"""Section-aware chunks of Markdown manuals, for many documents at once.

Blocks start at first-level headings; a chunk is an island of neighbouring blocks. Where islands start is decided by windows
over a document's blocks, so that no document is walked through in a loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as T

PAGE_DOTS = r"[·.]{2,}\s*\d*\s*$"


def parse_numbered(title: Column) -> tuple[Column, Column]:
    """(section number, title without it); the number is empty where a title has none that white space follows."""
    clean = T.strip(F.regexp_replace(title, r"[·.]+\s*\d+\s*$", ""))
    pattern = rf"^(\d+(?:\.\d+)*){T.SPACE}+(.+)$"
    return F.regexp_extract(clean, pattern, 1), T.strip(F.regexp_extract(clean, pattern, 2))


def classify_title(title: Column, page_headers: list[str]) -> Column:
    t = T.strip(title)
    numbered = parse_numbered(t)[0] != ""
    return (
        F.when(t.isin(vocab.TOC_TITLES), "toc").when(t.isin(vocab.WARNING_TITLES), "warning")
        .when(t.isin(page_headers) if page_headers else F.lit(False), "page_header").when(t.isin(vocab.FRONT_TITLES), "front_matter")
        .when(numbered & F.rlike(t, F.lit(PAGE_DOTS)), "toc_entry").when(numbered, "numbered").otherwise("plain")
    )


def split_blocks(docs: DataFrame, page_headers: list[str] = ()) -> DataFrame:
    """docs (doc_id, text) to blocks (doc_id, pos, title, content, block_type, section_number, clean_title)."""
    parts = docs.select("doc_id", F.posexplode(F.split(T.text(F.col("text")), r"(?md)^#\s", -1)).alias("pos", "part"))
    parts = parts.filter(T.strip(F.col("part")) != "")
    body = F.when(F.col("pos") == 0, T.strip(F.col("part"))).otherwise(F.concat(F.lit("# "), T.strip(F.col("part"))))
    rows = parts.select("doc_id", "pos", body.alias("content"))
    first = F.substring_index("content", "\n", 1)
    title = F.when(F.col("pos") == 0, T.strip(first)).otherwise(T.strip(F.regexp_replace(first, r"^#+\s*", "")))
    rows = rows.withColumn("title", title)
    kind = F.when(F.col("pos") == 0, "plain").otherwise(classify_title(F.col("title"), list(page_headers)))
    number, clean = parse_numbered(F.col("title"))
    rows = rows.withColumn("block_type", kind)
    numbered = F.col("block_type") == "numbered"
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "title", "content", "block_type", F.when(numbered, number).otherwise("").alias("section_number"), F.when(numbered, clean).otherwise("").alias("clean_title"))


def must_flush(old: Column, new: Column) -> Column:
    """Whether a section `new` ends the chunk of section `old`: anything but a deeper section of it."""
    parts = lambda n: F.transform(F.split(n, r"\."), lambda p: F.regexp_replace(p, r"^0+(?=\d)", ""))
    a, b = parts(old), parts(new)
    m = F.least(F.size(a), F.size(b))
    return (F.slice(a, F.lit(1), m) != F.slice(b, F.lit(1), m)) | (F.size(b) <= F.size(a))


def infer_chunk_type(path: Column, title: Column) -> Column:
    both = F.concat_ws(" ", path, title)
    return reduce(lambda c, rule: c.when(F.rlike(both, F.lit(rule[0])), rule[1]), vocab.CHUNK_TYPES, F.when(F.lit(False), "")).otherwise("general")


def section_path(numbered: Column, pos: Column, number: Column) -> Column:
    """Titles of a section and its ancestors that are still open at pos; numbered: a document's structs (pos, number, title)."""
    parts = F.split(number, r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    before = F.filter(numbered, lambda x: x["pos"] <= pos)
    depth = lambda n: F.size(F.split(n, r"\."))

    def open_title(key: Column) -> Column:
        own = F.element_at(F.filter(before, lambda x: x["number"] == key), -1)
        closing = F.exists(before, lambda q: (q["pos"] > own["pos"]) & (q["number"] != key) & (depth(q["number"]) <= depth(key)) & ~F.startswith(key, F.concat(q["number"], F.lit("."))) & ~F.startswith(q["number"], F.concat(key, F.lit("."))))
        return F.when(F.exists(before, lambda x: x["number"] == key) & ~closing, F.concat_ws(" ", key, own["title"]))

    return F.array_join(F.filter(F.transform(keys, open_title), lambda x: x.isNotNull()), " > ")


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """blocks to chunks (doc_id, chunk_pos, content, section_title, section_number, section_path, chunk_type, block_types)."""
    rows = blocks.filter("block_type <> 'toc_entry'")
    plain_alone = (F.col("block_type") == "plain") & ((parse_numbered(F.col("title"))[0] != "") | (F.length(T.body_without_title(F.col("content"))) >= 40))
    by_doc = W.partitionBy("doc_id").orderBy("pos")
    single = F.col("block_type").isin("toc", "front_matter")
    rows = rows.withColumn("reset", single | plain_alone).withColumn("number", F.when(F.col("block_type") == "numbered", F.col("section_number")))
    past = by_doc.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"since": F.coalesce(F.sum(F.col("reset").cast("int")).over(past), F.lit(0)), "after_single": F.coalesce(F.lag(single).over(by_doc), F.lit(False)), "nth": F.row_number().over(by_doc)})
    anchor = F.last("number", ignorenulls=True).over(W.partitionBy("doc_id", "since").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("anchor", anchor)
    starts = (F.col("nth") == 1) | F.col("reset") | F.col("after_single") | (F.col("number").isNotNull() & F.col("anchor").isNotNull() & must_flush(F.col("anchor"), F.col("number")))
    rows = rows.withColumn("island", F.sum(starts.cast("int")).over(by_doc))
    numbered = F.collect_list(F.when(F.col("number").isNotNull(), F.struct("pos", F.col("number").alias("number"), F.col("clean_title").alias("title")))).over(W.partitionBy("doc_id"))
    rows = rows.withColumn("numbered", F.array_sort(numbered))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "content", "block_type", "title", "number", "clean_title")))
    islands = rows.groupBy("doc_id", "island").agg(ordered.alias("b"), F.first("numbered").alias("numbered"), F.min_by("anchor", "pos").alias("anchor"))
    last = F.element_at(F.filter("b", lambda x: x["number"].isNotNull()), -1)
    kind = F.get("b", F.lit(0))["block_type"]
    has_number = F.exists("b", lambda x: x["number"].isNotNull())
    first_title = F.get("b", F.lit(0))["title"]
    leaked = F.coalesce(F.col("anchor"), F.lit(""))
    number = F.when(kind == "toc", "").when(kind == "front_matter", leaked).when(has_number, last["number"]).otherwise("")
    title = F.when(kind == "toc", "目录").when(kind == "front_matter", first_title).when(has_number, F.concat_ws(" ", last["number"], last["clean_title"])).otherwise(first_title)
    at = F.when(has_number, last["pos"]).otherwise(F.get("b", F.lit(0))["pos"])
    out = islands.select("doc_id", F.col("island").cast("long").alias("chunk_pos"), "b", "numbered", kind.alias("kind"), number.alias("section_number"), title.alias("section_title"), at.alias("at"))
    path = F.when(F.col("section_number") != "", section_path(F.col("numbered"), F.col("at"), F.col("section_number"))).otherwise(F.col("section_title"))
    out = out.withColumn("section_path", path)
    content = F.array_join(F.filter(F.transform("b", lambda x: T.strip(x["content"])), lambda x: x != ""), "\n\n")
    ctype = F.when(F.col("kind") == "toc", "toc").when(F.col("kind") == "front_matter", "meta").otherwise(infer_chunk_type(F.col("section_path"), F.col("section_title")))
    return out.select("doc_id", "chunk_pos", content.alias("content"), "section_title", "section_number", "section_path", ctype.alias("chunk_type"), F.transform("b", lambda x: x["block_type"]).alias("block_types"))


def step_parts(content: Column) -> Column:
    """content cut before every line that starts a step; blank parts are left out."""
    marked = F.regexp_replace(content, r"(?md)^([ \t]*步骤[ \t]*\d+)", "\u0001$1")
    return F.filter(F.transform(F.split(marked, "\u0001"), T.strip), lambda p: p != "")


def packed_paragraphs(content: Column, max_tokens: int) -> Column:
    """Paragraphs of content, greedily packed up to max_tokens; one that is longer stands alone."""
    paragraphs = F.filter(F.split(content, r"\n\s*\n"), lambda p: T.strip(p) != "")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(s: Column, p: Column) -> Column:
        joined = F.when(s["open"] == "", p).otherwise(F.concat_ws("\n\n", s["open"], p))
        over = (s["open"] != "") & (T.token_count(joined) > max_tokens)
        return F.struct(F.when(over, F.array_append(s["done"], T.strip(s["open"]))).otherwise(s["done"]).alias("done"), F.when(over, p).otherwise(joined).alias("open"))

    return F.aggregate(paragraphs, state, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], T.strip(s["open"]))))


def split_oversized(chunks: DataFrame, max_tokens: int = vocab.MAX_CHUNK_TOKENS) -> DataFrame:
    """chunks of more than max_tokens cut at their steps, or else between paragraphs, with (i/n) behind the title; adds part."""
    steps = step_parts(F.col("content"))
    parts = F.when(T.token_count(F.col("content")) <= max_tokens, F.array("content")).when(F.size(steps) > 1, steps).otherwise(packed_paragraphs(F.col("content"), max_tokens))
    rows = chunks.withColumn("parts", parts).withColumn("n", F.size("parts"))
    rows = rows.withColumn("parts", F.when(F.col("n") > 1, F.col("parts")).otherwise(F.array("content")))
    rows = rows.select(*[c for c in rows.columns if c not in ("content", "parts")], F.posexplode("parts").alias("part", "content"))
    suffix = F.when(F.col("n") > 1, F.format_string(" (%d/%d)", F.col("part") + 1, F.col("n"))).otherwise("")
    return rows.withColumn("section_title", F.concat("section_title", suffix)).withColumn("part", F.col("part").cast("long")).drop("n")


def split_semantic(docs: DataFrame, max_tokens: int = vocab.MAX_CHUNK_TOKENS, min_body: int = vocab.MIN_BODY_CHARS, page_headers: list[str] = ()) -> DataFrame:
    """docs (doc_id, text) to chunks with order_index; short ones without image or table are dropped, tables of contents and front matter kept."""
    rows = split_oversized(merge_blocks(split_blocks(docs, page_headers)), max_tokens)
    long_enough = F.col("chunk_type").isin("toc", "meta") | (F.length(T.body_without_title(F.col("content"))) >= min_body) | T.has_image(F.col("content")) | T.has_table(F.col("content"))
    rows = rows.filter(long_enough)
    return rows.withColumn("order_index", (F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_pos", "part")) - 1).cast("long"))


def document_chunks(manuals: DataFrame, products: DataFrame, now: int, min_tokens: int = 80, page_headers: list[str] = ()) -> DataFrame:
    """manuals (md_stem, file_path, text) of known products to rows of the chunk table (see schema.CHUNKS)."""
    known = manuals.join(products, "md_stem").withColumn("full_doc_id", T.doc_id(F.col("md_stem")))
    sections = split_semantic(known.select(F.col("full_doc_id").alias("doc_id"), "text"), min_body=max(60, min_tokens), page_headers=page_headers)
    rows = sections.withColumnRenamed("doc_id", "full_doc_id").join(known.drop("text"), "full_doc_id")
    rows = rows.withColumn("image_paths", T.chunk_images(T.image_targets(F.col("content")), F.col("full_doc_id"))).withColumn("clean", T.without_images(F.col("content"))).filter("clean <> ''")
    rows = rows.withColumn("content", T.with_prefix(F.col("clean"), F.coalesce("display_name", "md_stem"), F.col("section_title"), F.col("section_path"), F.col("chunk_type")))
    rows = rows.withColumn("tokens", T.token_count(F.col("content")))
    rows = rows.filter((F.col("tokens") >= min_tokens) | (F.size("image_paths") > 0) | T.has_table(F.col("clean")))
    return rows.select(
        T.chunk_id(F.col("full_doc_id"), F.col("order_index"), F.col("content")).alias("chunk_id"), F.col("tokens").cast("int").alias("tokens"), "content",
        F.col("order_index").cast("int").alias("chunk_order_index"), "full_doc_id", "file_path", "image_paths", "product_id", "series_id", "display_name",
        "section_title", "section_number", "section_path", "chunk_type", F.col("manual_pdf").alias("source_pdf"), T.content_hash(F.col("content")).alias("content_hash"),
        F.lit(now).cast("long").alias("create_time"), F.lit(now).cast("long").alias("update_time"),
    )
