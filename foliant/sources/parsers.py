"""Document formats to flat lists of headed parts.

Each ``parse_*`` takes bytes and returns ``(title, parts)``; a part is a dict of
level, title, content, page_start, page_end, metadata.  Level 0 is text before
any heading.  Hierarchy is built afterwards, in Spark.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from foliant.functions.text import decode_lossy


def part(level: int, title: str, content: str = "", page_start: int = 0, page_end: int = 0, **metadata: str) -> dict:
    return {"level": level, "title": title, "content": content.strip(), "page_start": page_start, "page_end": page_end, "metadata": {k: str(v) for k, v in metadata.items()}}


def grid(rows: list[list[str]]) -> str:
    """A Markdown table whose header is the first row."""
    clean = [[" ".join(str(c or "").split()).replace("|", "\\|") for c in r] for r in rows]
    width = max((len(r) for r in clean), default=0)
    clean = [r + [""] * (width - len(r)) for r in clean]
    clean = [r for r in clean if any(r)]
    if not clean:
        return ""
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(clean[0]), "|" + " --- |" * width, *map(line, clean[1:])])


def derived_title(parts: list[dict]) -> str:
    return next((p["title"] for p in parts if p["level"] == 1), parts[0]["title"] if parts else "")


# ---- Markdown --------------------------------------------------------------------

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_NESTED = re.compile(r"^ {0,3}(?:>|[-*+][ \t]|\d{1,9}[.)][ \t])")
_MARKUP = ((re.compile(r"!?\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"`+([^`]*)`+"), r"\1"), (re.compile(r"(\*\*|__|\*|~~)(?=\S)(.+?)(?<=\S)\1"), r"\2"))


def plain(line: str) -> str:
    for pattern, to in _MARKUP:
        line = pattern.sub(to, line)
    return line


def parse_markdown(raw: bytes) -> tuple[str, list[dict]]:
    """Headings at the top level split; those in quotes, lists and fences don't."""
    parts, body, fence = [part(0, "")], [], None
    paragraph: list[str] = []

    def begin(level: int, title: str) -> None:
        parts[-1]["content"] = "\n".join(body).strip()
        parts.append(part(level, plain(title).strip()))
        body.clear()
        paragraph.clear()

    in_html = False
    for line in decode_lossy(raw).replace("\r\n", "\n").split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
            else:
                body.append(line)
            continue
        if mark:
            fence = mark[1]
            paragraph.clear()
            continue
        if in_html or re.match(r"^ {0,3}<(?:/?[a-zA-Z][a-zA-Z0-9-]*(?:[\s/>]|$)|!--)", line):
            in_html = bool(line.strip())
            continue
        if m := _ATX.match(line):
            begin(len(m[1]), m[2] or "")
        elif (m := _SETEXT.match(line)) and paragraph:
            title = " ".join(paragraph)
            del body[len(body) - len(paragraph) :]
            begin(1 if m[1][0] == "=" else 2, title)
        elif not line.strip():
            body.append("")
            paragraph.clear()
        else:
            if _NESTED.match(line):
                paragraph.clear()
                text = re.sub(r"^[ \t]*(?:>[ \t]?|[-*+][ \t]+|\d{1,9}[.)][ \t]+)+(?:#{1,6}[ \t]+)?", "", line)
                body.append(plain(text))
            else:
                paragraph.append(line.strip())
                body.append(plain(line))
    parts[-1]["content"] = "\n".join(body).strip()
    return derived_title([p for p in parts if p["level"]]), parts


# ---- HTML ------------------------------------------------------------------------

_SKIPPED = {"script", "style", "noscript", "template", "nav", "header", "footer", "aside"}
_BLOCKS = {"p", "div", "section", "article", "ul", "ol", "li", "pre", "blockquote", "table", "tr", "br", "hr", "dl", "dt", "dd", "figure", "main", "body"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Opening one of these ends an open one of the same set entry.
_ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_ENDS |= {b: {"p"} for b in _BLOCKS - {"p", "li", "tr", "dt", "dd", "br"}} | {f"h{i}": {"p"} for i in range(1, 7)}


class _Node:
    __slots__ = ("tag", "kids")

    def __init__(self, tag: str):
        self.tag, self.kids = tag, []

    def find(self, tag: str):
        if self.tag == tag:
            return self
        for k in self.kids:
            if isinstance(k, _Node) and (hit := k.find(tag)):
                return hit
        return None

    def text(self) -> str:
        said = (k if isinstance(k, str) else "" if k.tag in _SKIPPED else k.text() for k in self.kids)
        return " ".join(" ".join(s.split()) for s in said if s.strip())


class _Tree(HTMLParser):
    """A tree that closes what malformed pages leave open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ends = _ENDS.get(tag, set())
        while len(self.open) > 1 and self.open[-1].tag in ends:
            self.open.pop()
        node = _Node(tag)
        self.open[-1].kids.append(node)
        if tag not in _VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].kids.append(_Node(tag))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("table", "body", "main", "article") and tag not in ("body", "html", "main", "article", "table"):
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def _table_rows(node: _Node) -> list[list[str]]:
    rows = []
    for k in node.kids:
        if isinstance(k, _Node):
            if k.tag == "tr":
                rows.append([c.text() for c in k.kids if isinstance(c, _Node) and c.tag in ("td", "th")])
            elif k.tag != "table":
                rows += _table_rows(k)
    return rows


def parse_html(raw: bytes) -> tuple[str, list[dict]]:
    tree = _Tree()
    tree.feed(decode_lossy(raw))
    tree.close()
    title = tree.root.find("title")
    top = tree.root.find("main") or tree.root.find("article") or tree.root.find("body") or tree.root
    parts, body = [part(0, "")], []

    def close() -> None:
        paragraphs = (" ".join(p.split()) if not p.lstrip().startswith("| ") else p.strip() for p in "".join(body).split("\n\n"))
        parts[-1]["content"] = "\n\n".join(p for p in paragraphs if p)
        body.clear()

    def visit(node: _Node) -> None:
        for k in node.kids:
            if isinstance(k, str):
                if k.strip():
                    body.append(" ".join(k.split()) + " ")
            elif k.tag in _SKIPPED or k.tag == "title":
                continue
            elif re.fullmatch("h[1-6]", k.tag):
                close()
                parts.append(part(int(k.tag[1]), k.text()))
            elif k.tag == "table":
                body.append("\n\n" + grid(_table_rows(k)) + "\n\n")
            else:
                visit(k)
                if k.tag in _BLOCKS:
                    body.append("\n\n")

    visit(top)
    close()
    said = title.text() if title else ""
    return said or derived_title([p for p in parts if p["level"]]), parts


# ---- plain text, CSV -------------------------------------------------------------

def parse_csv(raw: bytes) -> tuple[str, list[dict]]:
    """One section with the table; ragged rows are padded."""
    rows = [r for r in csv.reader(io.StringIO(decode_lossy(raw).lstrip("﻿"), newline=""), strict=False) if r]
    first = rows[0][0].strip() if rows and rows[0] else ""
    title = first if 0 < len(first.encode()) <= 60 else "Data"
    return title, [part(1, "Data", grid(rows))]


# ---- Office ----------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _member(z: zipfile.ZipFile, name: str):
    try:
        return ElementTree.fromstring(z.read(name))
    except KeyError:
        return None


def style_level(style: str) -> int:
    """Heading level of a paragraph style: "Title" 1, "Heading2" or "Heading 2" 2; 0 for text."""
    name = style.replace(" ", "").lower()
    if name == "title":
        return 1
    m = re.fullmatch(r"heading(\d+)", name)
    return min(int(m[1]), 6) if m and int(m[1]) > 0 else 0


def _run_text(node) -> str:
    out = []
    for e in node.iter():
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag in (f"{_W}tab",):
            out.append("\t")
        elif e.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def parse_docx(raw: bytes) -> tuple[str, list[dict]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        document, notes = _member(z, "word/document.xml"), _member(z, "word/footnotes.xml")
    if document is None:
        raise ValueError("no word/document.xml")
    parts, blocks = [part(0, "")], []
    body = document.find(f"{_W}body")
    for block in body if body is not None else ():
        if block.tag == f"{_W}tbl":
            rows = [[" ".join(_run_text(p) for p in c.iter(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in block.findall(f"{_W}tr")]
            blocks.append(grid(rows))
        elif block.tag == f"{_W}p":
            text, level = _run_text(block).strip(), 0
            props = block.find(f"{_W}pPr")
            if props is not None:
                style, outline = props.find(f"{_W}pStyle"), props.find(f"{_W}outlineLvl")
                level = style_level(style.get(f"{_W}val", "")) if style is not None else 0
                if not level and outline is not None and outline.get(f"{_W}val", "").isdigit() and int(outline.get(f"{_W}val")) < 9:
                    level = min(int(outline.get(f"{_W}val")) + 1, 6)
            if level and text:
                parts[-1]["content"] = "\n\n".join(b for b in blocks if b)
                blocks = []
                parts.append(part(level, text))
            elif text:
                blocks.append(text)
    parts[-1]["content"] = "\n\n".join(b for b in blocks if b)
    if notes is not None:
        real = [n for n in notes.findall(f"{_W}footnote") if n.get(f"{_W}type") in (None, "normal")]
        said = [t for n in real if (t := _run_text(n).strip())]
        if said:
            parts.append(part(1, "Footnotes", "\n\n".join(said)))
    return derived_title([p for p in parts if p["level"]]), parts


def column_index(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for ch in re.match(r"[A-Za-z]*", reference)[0].upper():
        n = 26 * n + ord(ch) - 64
    return n - 1


def parse_xlsx(raw: bytes) -> tuple[str, list[dict]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        strings = _member(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in strings.findall(f"{_S}si")] if strings is not None else []
        book, rels = _member(z, "xl/workbook.xml"), _member(z, "xl/_rels/workbook.xml.rels")
        targets = {r.get("Id"): r.get("Target", "") for r in rels} if rels is not None else {}
        sheets = []
        for i, s in enumerate(book.iter(f"{_S}sheet") if book is not None else (), 1):
            target = targets.get(s.get(f"{_R}id"), f"worksheets/sheet{i}.xml").lstrip("/")
            sheets.append((s.get("name", f"Sheet{i}"), _member(z, target if target.startswith("xl/") else f"xl/{target}")))
    parts = []
    for name, sheet in sheets:
        rows = []
        for r in sheet.iter(f"{_S}row") if sheet is not None else ():
            cells: list[str] = []
            for c in r.findall(f"{_S}c"):
                at = column_index(c.get("r", "")) if c.get("r") else len(cells)
                v = c.find(f"{_S}v")
                kind, value = c.get("t"), (v.text or "") if v is not None else ""
                if kind == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                cells += [""] * (at + 1 - len(cells))
                cells[at] = value
            rows.append(cells)
        parts.append(part(1, name, grid(rows)))
    if not parts:
        raise ValueError("no sheets")
    return parts[0]["title"], parts
