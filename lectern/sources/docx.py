"""Word documents to Markdown: paragraphs, tables and images in their order, read from the package's XML."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_SPACE = re.compile(r"\s+")
_KNOWN_IMAGES = {"png", "jpg", "jpeg", "gif", "webp", "bmp"}


def heading_level(style: str) -> int | None:
    """The level that a style's name gives, 1 to 6."""
    name = (style or "").strip()
    number = name.removeprefix("Heading").strip()
    if name.startswith("Heading") and number.isdigit():
        return min(6, max(1, int(number)))
    return 1 if name in ("Title", "标题") else None


def implicit_heading(line: str) -> bool:
    """The rule of functions.text.implicit_heading, for one line in a worker."""
    from lectern.functions.text import IMPLICIT_HEADINGS

    s = line.strip()
    if not s or len(s) > 40:
        return False
    return bool(re.match(r"\d+\.\S", s)) or s in IMPLICIT_HEADINGS or (s.endswith("操作") and len(s) <= 12 and not s.startswith("·"))


def table_markdown(rows: list[list[str]]) -> str:
    """A Markdown table; short rows are filled up."""
    if not rows:
        return ""
    width = max(map(len, rows))
    full = [[*r, *[""] * (width - len(r))] for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in full]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


class DocxParser:
    """A document parser for .docx; images maps the names that the Markdown quotes to their bytes."""

    def __init__(self) -> None:
        self.images: dict[str, bytes] = {}

    def blocks(self, data: bytes) -> list[tuple[str, str, object]]:
        """(kind, style, content) of the body's paragraphs (text, image names) and tables (rows of cells)."""
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
            names = set(z.namelist())
            styles, links = {}, {}
            if "word/styles.xml" in names:
                for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                    label = s.find(f"{_W}name")
                    styles[s.get(f"{_W}styleId")] = label.get(f"{_W}val") if label is not None else ""
            if "word/_rels/document.xml.rels" in names:
                for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")):
                    links[r.get("Id")] = r.get("Target")
            out: list[tuple[str, str, object]] = []
            for child in body if body is not None else []:
                if child.tag == f"{_W}tbl":
                    out.append(("table", "", [[_SPACE.sub(" ", _text(c)).strip() for c in row.iter(f"{_W}tc")] for row in child.iter(f"{_W}tr")]))
                elif child.tag == f"{_W}p":
                    style = child.find(f"{_W}pPr/{_W}pStyle")
                    name = styles.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else ""
                    images = [self._image(z, links.get(b.get(f"{_R}embed")), names) for b in child.iter(f"{_A}blip")]
                    out.append(("paragraph", _title_case(name), (_SPACE.sub(" ", _text(child)).strip(), [i for i in images if i])))
            return out

    def _image(self, z: zipfile.ZipFile, target: str | None, names: set[str]) -> str | None:
        path = f"word/{target}" if target and not target.startswith("/") else (target or "").lstrip("/")
        if path not in names:
            return None
        blob = z.read(path)
        suffix = path.rsplit(".", 1)[-1].lower()
        name = f"images/{hashlib.md5(blob).hexdigest()}.{suffix if suffix in _KNOWN_IMAGES else 'png'}"
        self.images[name] = blob
        return name

    def parse(self, name: str, data: bytes, method: str = "auto") -> str:
        """The document as Markdown; every heading is a first-level one."""
        out: list[str] = []
        for kind, style, content in self.blocks(data):
            if kind == "table":
                found = table_markdown(content)
                out += [found, ""] if found else []
                continue
            text, images = content
            if text:
                out += [("# " if heading_level(style) or implicit_heading(text) else "") + text, ""]
            for image in images:
                out += [f"![{image.rsplit('/', 1)[-1].rsplit('.', 1)[0][:12]}]({image})", ""]
        return "\n".join(out).strip() + "\n"


def _text(node: ElementTree.Element) -> str:
    return "".join((t.text or "") if t.tag == f"{_W}t" else "\n" if t.tag == f"{_W}br" else "\t" for t in node.iter() if t.tag in (f"{_W}t", f"{_W}br", f"{_W}tab"))


def _title_case(style: str) -> str:
    return "Heading" + style[7:] if style.lower().startswith("heading") else "Title" if style.lower() == "title" else style
