"""Image references: paths in the collection, display addresses and answers that quote them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import IMAGE, strip, text

ROOT = "/kb_images/"
#: A document's image anywhere in a text, with whatever host or root stands before it.
STORED_IMAGE = r"(?i)(?:https?://[^/]+/)?(?:kb[._-]?images/)?(doc-[a-f0-9]+/[a-f0-9]+\.(?:jpg|jpeg|png|webp|gif))"


def _slashes(c: Column) -> Column:
    return F.replace(strip(c), F.lit("\\"), F.lit("/"))


def encode_path(path: Column) -> Column:
    """Percent-encoded, with / : @ and the unreserved characters kept."""
    out = F.url_encode(path)
    for coded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), ("%3A", ":"), ("%40", "@")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def image_url(path: Column) -> Column:
    """The address of an image path; addresses stay as they are, blanks give an empty text."""
    p = _slashes(path)
    bare = F.regexp_replace(F.regexp_replace(p, "^images/", ""), "^/+", "")
    whole = F.startswith(p, F.lit("http://")) | F.startswith(p, F.lit("https://")) | F.startswith(p, F.lit(ROOT))
    return F.when(p == "", "").when(whole, p).otherwise(F.concat(F.lit(ROOT), encode_path(bare)))


def display_url(path: Column) -> Column:
    return F.concat(F.lit(ROOT), F.regexp_replace(path, "^images/", ""))


def relative_path(url: Column) -> Column:
    """The path below the image root that a reference of any form means; null if none."""
    p = _slashes(url)
    at = F.locate(ROOT, p)
    below = lambda c: F.regexp_replace(c, "^/+", "")
    found = F.regexp_extract(p, STORED_IMAGE, 1)
    return (
        F.when(at > 0, below(F.substr(p, at + len(ROOT))))
        .when(F.startswith(p, F.lit("kb_images/")), below(F.substr(p, F.lit(len("kb_images/") + 1))))
        .when(found != "", found)
    )


def public_url(reference: Column, base: str = "") -> Column:
    """The address a reader can open; references that mean no stored image stay as they are."""
    rel = relative_path(reference)
    return F.when(F.coalesce(rel, F.lit("")) == "", strip(reference)).otherwise(F.concat(F.lit(base.rstrip("/") + ROOT), rel))


def related_images(paths: Column) -> Column:
    """A Markdown block of images; of equal addresses the first, numbers as in the list."""
    urls = F.transform(paths, image_url)
    keep = F.filter(F.transform(urls, lambda u, i: F.struct(u.alias("u"), i.alias("i"), F.array_position(urls, u).alias("first"))), lambda x: (x["u"] != "") & (x["first"] == x["i"] + 1))
    lines = F.transform(keep, lambda x: F.concat(F.lit("![Manual image "), (x["i"] + 1).cast("string"), F.lit("]("), x["u"], F.lit(")")))
    return F.when(F.size(lines) > 0, F.array_join(F.concat(F.array(F.lit("Related images:")), lines), "\n")).otherwise("")


def _rewritten(c: Column, pattern: str, change) -> Column:
    """c with every match of pattern replaced by change(match)."""
    gaps, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.when(m.isNull(), "").otherwise(change(m)))), "")


def cited_images(answer: Column, images: Column, base: str = "") -> Column:
    """answer with each [图-N] of images (structs image_id, display_url, caption_hint) written as a Markdown image; others stay."""

    def change(m: Column) -> Column:
        hit = F.filter(images, lambda e: strip(e["image_id"]) == F.regexp_extract(m, r"\[(图-\d+)\]", 1))
        e = F.element_at(hit, -1)
        alt = strip(F.coalesce(F.nullif(e["caption_hint"], F.lit("")), strip(e["image_id"])))
        return F.when(F.size(hit) > 0, F.concat(F.lit("!["), alt, F.lit("]("), public_url(e["display_url"], base), F.lit(")"))).otherwise(m)

    return _rewritten(text(answer), r"\[图-\d+\]", change)


def public_answer(answer: Column, images: Column, base: str = "") -> Column:
    """Cited images, then the addresses of all Markdown images and bare references to stored images put right."""
    cited = cited_images(answer, images, base)

    def change(m: Column) -> Column:
        return F.concat(F.lit("!["), F.regexp_extract(m, r"!\[([^\]]*)\]", 1), F.lit("]("), public_url(F.regexp_extract(m, IMAGE, 1), base), F.lit(")"))

    shown = _rewritten(cited, r"!\[[^\]]*\]\([^)]+\)", change)
    return F.regexp_replace(shown, STORED_IMAGE, base.rstrip("/") + ROOT + "$1") if base else _bare(shown)


def public_images(images: Column, base: str = "") -> Column:
    """The fields of catalogue entries that a client needs, with addresses it can open."""
    return F.transform(images, lambda e: F.struct(e["image_id"].alias("image_id"), public_url(e["display_url"], base).alias("display_url"), text(e["caption_hint"]).alias("caption_hint")))


def _bare(c: Column) -> Column:
    return _rewritten(c, STORED_IMAGE, lambda m: F.concat(F.lit(ROOT), F.regexp_extract(m, STORED_IMAGE, 1)))
