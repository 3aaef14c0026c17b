"""Column functions on texts, identifiers and metadata. Null texts count as empty throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode, as a class for Java's and RE2's regular expressions.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\x{4e00}-\x{9fa5}]|" + WORD
IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(text(c), rf"^{SPACE}+|{SPACE}+\z", "")


def doc_id(name: Column) -> Column:
    return F.concat(F.lit("doc-"), F.md5(text(name).cast("binary")))


def chunk_id(doc: Column, order: Column, content: Column) -> Column:
    return F.concat(F.lit("chunk-"), F.md5(F.concat_ws("|", doc, order.cast("string"), text(content)).cast("binary")))


def content_hash(content: Column) -> Column:
    return F.md5(text(content).cast("binary"))


def file_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def token_count(c: Column) -> Column:
    """Han characters one by one, and other words."""
    return F.regexp_count(text(c), F.lit(TOKEN)).cast("long")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit(WORD), F.lit(0))


HAN = r"\p{IsHan}"


def search_tokens(c: Column) -> Column:
    """Words to search by: words as in words(), but of an unbroken run of Han characters its overlapping pairs (or its only character)."""
    lower = F.lower(text(c))
    rest = F.regexp_extract_all(F.regexp_replace(lower, f"{HAN}+", " "), F.lit(WORD), F.lit(0))
    pairs = F.regexp_extract_all(lower, F.lit(f"(?=({HAN}{{2}}))"), F.lit(1))
    single = F.regexp_extract_all(lower, F.lit(f"(?<!{HAN}){HAN}(?!{HAN})"), F.lit(0))
    return F.when(lower.rlike(HAN), F.concat(rest, pairs, single)).otherwise(words(c))


def bigrams(c: Column) -> Column:
    """Overlapping pairs of characters; single characters of a text of two or fewer."""
    s = strip(c)
    pattern = F.when(F.length(s) <= 2, F.lit("(?s)(.)")).otherwise(F.lit("(?s)(?=(..))"))
    return F.regexp_extract_all(s, pattern, F.lit(1))


def first_filled(columns: Sequence[Column]) -> Column:
    """The first value that is neither null nor empty, else an empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def doc_key(_id: Column, chunk: Column, id_: Column, source: Column, fallback: Column) -> Column:
    return first_filled([_id, chunk, id_, source, fallback])


def chunk_key(_id: Column, chunk: Column, id_: Column, product: Column, title: Column, content: Column) -> Column:
    return first_filled([_id, chunk, id_, F.concat_ws(":", text(product), text(title), F.left(text(content), F.lit(120)))])


def image_targets(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit(IMAGE), F.lit(1))


def without_images(c: Column) -> Column:
    plain = F.regexp_replace(text(c), IMAGE, "")
    return strip(F.regexp_replace(plain, "\n{3,}", "\n\n"))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def chunk_images(targets: Column, doc: Column) -> Column:
    """Paths of a chunk's images in the collection, distinct and sorted; blank targets are left out."""
    kept = F.filter(F.transform(targets, strip), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(kept, lambda p: F.concat(F.lit("images/"), doc, F.lit("/"), basename(p)))))


def with_prefix(content: Column, display: Column, title: Column, path: Column, kind: Column) -> Column:
    """content below a line that names its product, section and kind; unchanged where the line is there already."""
    label = first_filled([path, title])
    tail = F.when(text(kind) != "", F.concat(F.lit(" | 类型: "), kind)).otherwise("")
    head = F.concat(F.lit("[产品: "), text(display), F.lit(" | 章节路径: "), label, tail, F.lit("]\n"))
    return F.when(F.startswith(text(content), head), content).otherwise(F.concat(head, text(content)))


def body_without_title(c: Column) -> Column:
    first = F.substring_index(text(c), "\n", 1)
    rest = F.when(F.contains(text(c), F.lit("\n")), F.substr(text(c), F.length(first) + 2)).otherwise("")
    return F.when(F.startswith(strip(first), F.lit("#")), strip(rest)).otherwise(strip(c))


def has_image(c: Column) -> Column:
    return F.contains(text(c), F.lit("!["))


def has_table(c: Column) -> Column:
    return F.contains(F.lower(text(c)), F.lit("<table"))


def captions(c: Column) -> Column:
    found = F.regexp_extract_all(text(c), F.lit(rf"图{SPACE}*\p{{Nd}}(?:\p{{Nd}}|-|\+|{SPACE})*[^\n]{{0,50}}"), F.lit(0))
    return F.transform(found, strip)


def metadata_list(value: Column) -> Column:
    """A list written as JSON or with semicolons: trimmed, blanks left out."""
    parsed = F.from_json(value, "array<string>")
    parts = F.when(F.startswith(strip(value), F.lit("[")) & parsed.isNotNull(), parsed).otherwise(F.split(text(value), ";"))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def image_paths(value: Column) -> Column:
    return F.filter(F.transform(F.split(text(value), ";"), strip), lambda x: x != "")


def flat_list(values: Column) -> Column:
    return F.array_join(values, ";")


def flat_map(values: Column) -> Column:
    return F.to_json(values)


def rerank_snippet(title: Column, content: Column, limit: int) -> Column:
    """A title above at most `limit` characters of content, of which a first line that opens with a bracket is left out."""
    s = strip(content)
    first = F.substring_index(s, "\n", 1)
    below = strip(F.substr(s, F.length(first) + 2))
    body = F.left(F.when(F.startswith(s, F.lit("[")) & F.contains(s, F.lit("\n")), below).otherwise(s), F.lit(limit))
    return F.concat_ws("\n", F.nullif(strip(title), F.lit("")), F.nullif(body, F.lit("")))


def intro_query(query: Column, pattern: str) -> Column:
    return F.rlike(text(query), F.lit(pattern))


def heading_level(style: Column) -> Column:
    """Level 1 to 6 that a paragraph style names, null for none; titles are level 1."""
    name = strip(style)
    number = strip(F.replace(name, F.lit("Heading"), F.lit(""))).try_cast("int")
    named = F.when(name.isin("Title", "标题"), 1)
    return F.when(F.startswith(name, F.lit("Heading")) & (number >= 0), F.greatest(F.lit(1), F.least(F.lit(6), number))).otherwise(named)


#: Short lines that head a section without a heading style.
IMPLICIT_HEADINGS = ["用户登录", "关机操作", "开机操作", "充放电模式切换", "充放电模式设置", "服务商注册", "创建场站", "系统自检", "工单", "反馈"]


def implicit_heading(line: Column) -> Column:
    """Whether a line reads as a heading: numbered, one of a list, or a short one about an operation."""
    s = strip(line)
    operation = F.endswith(s, F.lit("操作")) & (F.length(s) <= 12) & ~F.startswith(s, F.lit("·"))
    return (s != "") & (F.length(s) <= 40) & (F.rlike(s, F.lit(rf"^\p{{Nd}}+\.[^{SPACE[1:]}")) | s.isin(IMPLICIT_HEADINGS) | operation)


def markdown_table(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table: white space squeezed, short rows filled, the first row above a rule."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda x: strip(F.regexp_replace(text(x), rf"{SPACE}+", " "))))
    width = F.array_max(F.transform(clean, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    full = F.transform(clean, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(full, 1, 1), F.array(rule), F.slice(full, F.lit(2), F.size(full))), "\n")).otherwise("")


def sources_markdown(sources: Column) -> Column:
    """A numbered list of struct(display_name, section_title, score) below a heading; empty for no sources."""
    line = F.transform(sources, lambda s, i: F.format_string("%d. %s / %s (score=%.3f)", i + 1, text(s["display_name"]), text(s["section_title"]), F.coalesce(s["score"], F.lit(0.0))))
    return F.when(F.size(sources) > 0, F.array_join(F.concat(F.array(F.lit("**参考来源：**")), line), "\n")).otherwise("")


def escape_html(c: Column) -> Column:
    out = text(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
