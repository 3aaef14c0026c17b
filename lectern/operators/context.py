"""What an answering model is shown: images, context, history and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern import vocab
from lectern.functions import text as T
from lectern.functions.frames import history_line
from lectern.functions.urls import display_url


def meaningful(width: Column, height: Column, side: int = vocab.MIN_IMAGE_SIDE) -> Column:
    """Whether an image is more than an icon; one whose size is unknown is."""
    return F.coalesce((width >= side) & (height >= side), F.lit(True))


def image_catalog(images: DataFrame, most: int = vocab.MAX_IMAGES) -> DataFrame:
    """images (query_id, chunk_rank, pos, rel_path, width, height, content, section_title) to a numbered catalogue of each query.

    An image counts where it comes first; the n-th that a chunk adds gets its n-th caption.
    """
    rows = images.filter(meaningful(F.col("width"), F.col("height")))
    first = rows.withColumn("seen", F.row_number().over(W.partitionBy("query_id", "rel_path").orderBy("chunk_rank", "pos"))).filter("seen = 1")
    nth = F.row_number().over(W.partitionBy("query_id", "chunk_rank").orderBy("pos"))
    number = F.row_number().over(W.partitionBy("query_id").orderBy("chunk_rank", "pos"))
    rows = first.withColumns({"nth": nth, "vision_index": number}).filter(F.col("vision_index") <= most)
    hint = F.coalesce(F.try_element_at(T.captions(F.col("content")), F.col("nth")), F.lit(""))
    return rows.select(
        "query_id", F.concat(F.lit("图-"), F.col("vision_index").cast("string")).alias("image_id"), F.col("vision_index").cast("long").alias("vision_index"), "rel_path",
        display_url(F.col("rel_path")).alias("display_url"), T.strip(F.col("section_title")).alias("section_title"), hint.alias("caption_hint"),
    )


def context(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, context) from ranked hits (query_id, rank, display_name, section_title, content, score, image_paths)."""
    entry = F.array_sort(F.collect_list(F.struct("vision_index", "rel_path", "image_id", "display_url", "caption_hint")))
    listed = catalog.groupBy("query_id").agg(entry.alias("catalog"))
    rows = hits.join(listed, "query_id", "left")
    none = F.array().cast("array<struct<vision_index:bigint,rel_path:string,image_id:string,display_url:string,caption_hint:string>>")
    rows = rows.withColumn("catalog", F.coalesce("catalog", none))
    shown = F.filter(F.transform(F.coalesce("image_paths", F.array().cast("array<string>")), lambda p: F.get(F.filter("catalog", lambda e: e["rel_path"] == p), F.lit(0))), lambda e: e.isNotNull())
    rows = rows.withColumn("shown", shown).withColumn("body", T.strip(F.col("content")))
    rows = rows.withColumn("kept", (F.length("body") >= vocab.SHORT_CONTEXT) | (F.size("shown") > 0) | T.has_table(F.col("body")))
    hint = lambda e: F.when(e["caption_hint"] != "", F.concat(F.lit("（"), e["caption_hint"], F.lit("）"))).otherwise("")
    line = lambda e: F.concat(F.lit("  - ["), e["image_id"], F.lit("] "), e["display_url"], hint(e), F.lit(vocab.IMAGE_PLACE), e["vision_index"].cast("string"), F.lit(vocab.IMAGE_PLACE_END))
    block = F.when(F.size("shown") > 0, F.concat(F.lit(vocab.FRAGMENT_IMAGES), F.array_join(F.transform("shown", line), "\n"), F.lit("\n"))).otherwise("")
    named = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(vocab.UNKNOWN))
    part = F.concat(
        F.format_string(vocab.FRAGMENT_HEAD, F.col("rank")), named(F.col("display_name")), F.lit(vocab.FRAGMENT_SECTION), named(F.col("section_title")),
        F.format_string(vocab.FRAGMENT_SCORE, F.col("score")), block, F.lit(vocab.FRAGMENT_BODY), F.col("body"), F.lit("\n"),
    )
    fragments = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("rank", part.alias("part")))))
    out = rows.groupBy("query_id").agg(F.transform(fragments, lambda x: x["part"]).alias("parts"), F.first("catalog").alias("catalog"))
    ids = F.array_join(F.transform("catalog", lambda e: e["image_id"]), "、")
    head = F.array(F.lit(vocab.CONTEXT_HEAD))
    images = F.when(F.size("catalog") > 0, F.array(F.concat(F.format_string(vocab.CONTEXT_IMAGES, F.size("catalog")), ids, F.lit("。\n")))).otherwise(F.array().cast("array<string>"))
    return out.select("query_id", F.array_join(F.concat(head, images, F.col("parts")), "\n").alias("context"))


def sources(hits: DataFrame) -> DataFrame:
    """Citations of each query's hits in the order of rank."""
    row = F.struct("rank", F.col("display_name"), F.col("section_title"), F.col("source"), F.col("score"), F.left(T.text(F.col("content")), F.lit(vocab.SNIPPET_CHARS)).alias("snippet"))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("sources"))


def search_response(hits: DataFrame) -> DataFrame:
    """Hits as a search request returns them: sources and titles filled in, content cut."""
    source = T.first_filled([F.col("source"), F.col("file_path"), F.lit("local")])
    title = T.first_filled([F.col("section_title"), F.col("title"), T.basename(source)])
    return hits.select("query_id", "rank", "chunk_id", F.left(T.text(F.col("content")), F.lit(vocab.RESPONSE_CHARS)).alias("content"), title.alias("title"), source.alias("source"), "score")


def history(turns: DataFrame, last: int = vocab.HISTORY_TURNS) -> DataFrame:
    """(conv_id, history): the last turns of each conversation (conv_id, turn, role, text), users' and assistants' as lines."""
    recent = turns.withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("back") <= last)
    lines = recent.withColumn("line", history_line(F.col("role"), F.col("text"))).filter("line IS NOT NULL")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return lines.groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("history"))


def display_name(product_id: Column, name: Column) -> Column:
    return F.when(T.text(product_id) == "", vocab.ALL_PRODUCTS).otherwise(F.coalesce(name, product_id))


def user_prompt(question: Column, context_: Column, name: Column, history_: Column, subject: str) -> Column:
    """The user's part of a prompt about the manuals of `subject`; name: the chosen product's, or null."""
    found = F.concat(F.lit(vocab.ASK), question, F.lit(vocab.ASK_FRAGMENTS.format(subject=subject)), context_)
    general = F.concat(found, F.lit(vocab.ASK_END))
    chosen = F.concat(F.lit(vocab.ASK_PRODUCT), name, F.lit("\n\n"), found, F.lit(vocab.ASK_PRODUCT_END))
    past = F.when(T.text(history_) != "", F.concat(F.lit(vocab.ASK_HISTORY), history_)).otherwise("")
    return F.concat(F.when(name.isNotNull(), chosen).otherwise(general), past)


def prepared(questions: DataFrame, contexts: DataFrame, best: DataFrame, subject: str, least: float = vocab.MIN_SCORE) -> DataFrame:
    """questions (query_id, text, name, history) with state (blank, no_result or ready) and prompt; best: (query_id, score) of the first hit."""
    rows = questions.join(contexts, "query_id", "left").join(best.select("query_id", F.col("score").alias("best")), "query_id", "left")
    state = F.when(T.strip(F.col("text")) == "", "blank").when(F.coalesce("best", F.lit(-1.0)) < least, "no_result").otherwise("ready")
    prompt = user_prompt(F.col("text"), F.col("context"), F.col("name"), F.col("history"), subject)
    return rows.select("query_id", state.alias("state"), F.when(state == "ready", prompt).alias("prompt"))
