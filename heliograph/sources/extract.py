"""Files to text blocks: one table function over (path, content) for all formats that the standard library can read.

Blocks are (block, text, page_number, heading, section). A file that can't be read gives one row with an error, so a
damaged file never fails a job; models (OCR, speech) plug in by suffix.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from heliograph.sources import ole
from heliograph.sources.pdf import pdf

# Fixed values.
SKIPPED_TAGS = frozenset("script style noscript template svg head".split())
BLOCK_TAGS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table section article header footer blockquote pre hr title".split())
MAX_ROWS, MAX_CELL, MAX_TOTAL, MAX_RATIO, FREE_MEMBER, MAX_XML = 2000, 500, 200 << 20, 100, 1 << 20, 50 << 20
ODF_REPEAT_CELLS = 50

Block = tuple[str, int | None, str | None, str | None]
OUT = "path string, block int, text string, page_number int, heading string, section string, error string"


def decode(data: bytes) -> str:
    """By byte-order mark (UTF-32 before UTF-16), else UTF-8, else Windows-1252."""
    for mark, name in ((b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def _line(self, tag):
        if tag in BLOCK_TAGS:
            self.parts.append("\n")

    def handle_starttag(self, tag, attrs):
        if tag == "body":  # whatever was left open before it
            self.depth = 0
        if tag in SKIPPED_TAGS:
            self.depth += 1
        self._line(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED_TAGS:
            self.depth = max(0, self.depth - 1)
        self._line(tag)

    def handle_data(self, data):
        if self.depth == 0:
            self.parts.append(data)


def html_text(raw: str) -> str:
    page = _Visible()
    page.feed(raw)
    page.close()
    return "".join(page.parts).strip()


_RTF = re.compile(r"\\u(-?\d+) ?(?:\\'[0-9a-f]{2}|[^\\{}\r\n])?|\\'([0-9a-f]{2})|\\([a-z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}]+)", re.I | re.S)
# Fixed values.
_RTF_SILENT = ("fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "listtable", "listoverridetable", "generator", "themedata", "colorschememapping", "latentstyles", "datastore", "xmlnstbl")


def rtf_text(raw: str) -> str:
    """One pass over the tokens of a rich text; groups without prose (and starred ones) are left out."""
    out, stack, silent = [], [], False
    for code, hexed, word, _, sign, brace, plain in _RTF.findall(raw):
        if brace == "{":
            stack.append(silent)
        elif brace == "}":
            silent = stack.pop() if stack else False
        elif word.lower() in _RTF_SILENT or sign == "*":
            silent = True
        elif silent:
            continue
        elif code:
            out.append(chr(int(code) % 0x10000))
        elif hexed:
            out.append(bytes.fromhex(hexed).decode("cp1252", "replace"))
        elif word.lower() in ("par", "line", "tab"):
            out.append("\n")
        elif sign in "{}\\" and sign:
            out.append(sign)
        elif plain:
            out.append(plain.replace("\r", "").replace("\n", ""))
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()


def table_text(raw: str, tabs: bool = False) -> str:
    """Rows as lines of cells; the delimiter is sniffed over the first 4 KB."""
    try:
        dialect = csv.excel_tab if tabs else csv.Sniffer().sniff(raw[:4096], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    rows = []
    for n, row in enumerate(csv.reader(io.StringIO(raw, newline=""), dialect)):
        if n == MAX_ROWS:
            break
        if line := " ".join(c.strip()[:MAX_CELL] for c in row if c.strip()):
            rows.append(line)
    return "\n".join(rows)


def open_zip(data: bytes) -> zipfile.ZipFile:
    """Refuses archives that unpack to far more than they hold."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    members = archive.infolist()
    if sum(m.file_size for m in members) > MAX_TOTAL:
        raise ValueError("archive is too large when unpacked")
    if any(m.file_size > FREE_MEMBER and m.file_size > MAX_RATIO * max(1, m.compress_size) for m in members):
        raise ValueError("archive member is compressed too strongly")
    return archive


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    data = archive.read(name)
    if len(data) > MAX_XML or b"<!DOCTYPE" in data[:4096]:
        raise ValueError(f"{name} is refused")
    return ElementTree.fromstring(data)


def _tag(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _attr(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


def _under(node: ElementTree.Element, tag: str) -> list[ElementTree.Element]:
    return [n for n in node.iter() if _tag(n) == tag]


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def docx(data: bytes) -> Iterator[Block]:
    with open_zip(data) as archive:
        section = heading = None
        for node in next(iter(_under(_xml(archive, "word/document.xml"), "body")), []):
            if _tag(node) == "p":
                text = "".join(t.text or "" if _tag(t) == "t" else "\t" for t in node.iter() if _tag(t) in ("t", "tab")).strip()
                style = next((_attr(s, "val") or "" for s in _under(node, "pStyle")), "").lower().replace(" ", "")
                if text and style in ("heading1", "title"):
                    section, heading = text, None
                elif text and style.startswith("heading"):
                    heading = text
                if text:
                    yield text, None, heading, section
            elif _tag(node) == "tbl":
                rows = [" ".join(filter(None, ("".join(t.text or "" for t in _under(c, "t")).strip() for c in _under(r, "tc")))) for r in _under(node, "tr")]
                if text := "\n".join(filter(None, rows)):
                    yield text, None, heading, section


def pptx(data: bytes) -> Iterator[Block]:
    with open_zip(data) as archive:
        for n, name in enumerate(_numbered(archive, r"ppt/slides/slide(\d+)\.xml"), 1):
            lines, title = [], None
            for shape in _under(_xml(archive, name), "sp"):
                text = "\n".join(filter(None, ("".join(t.text or "" for t in _under(p, "t")).strip() for p in _under(shape, "p"))))
                if text and title is None and any(_attr(h, "type") in ("title", "ctrTitle") for h in _under(shape, "ph")):
                    title = text
                lines.append(text)
            notes = name.replace("slides/slide", "notesSlides/notesSlide")
            if notes in archive.namelist():
                lines.append("".join(t.text or "" for t in _under(_xml(archive, notes), "t")).strip())
            if text := "\n".join(filter(None, lines)):
                yield text, n, title, None


def xlsx(data: bytes) -> Iterator[Block]:
    with open_zip(data) as archive:
        strings = [("".join(t.text or "" for t in _under(s, "t"))) for s in _under(_xml(archive, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in archive.namelist() else []
        names = [_attr(s, "name") for s in _under(_xml(archive, "xl/workbook.xml"), "sheet")]
        for name, sheet in zip(names, _numbered(archive, r"xl/worksheets/sheet(\d+)\.xml"), strict=False):
            lines = []
            for row in _under(_xml(archive, sheet), "row")[:MAX_ROWS]:
                cells = []
                for cell in _under(row, "c"):
                    value = "".join(v.text or "" for v in cell.iter() if _tag(v) in ("v", "t"))
                    cells.append((strings[int(value)] if _attr(cell, "t") == "s" and value else value).strip()[:MAX_CELL])
                lines.append(" ".join(filter(None, cells)))
            if text := "\n".join(filter(None, lines)):
                yield text, None, None, name


def odf(data: bytes, suffix: str) -> Iterator[Block]:
    with open_zip(data) as archive:
        body = next(iter(_under(_xml(archive, "content.xml"), "body")))
        whole = lambda n: "".join(n.itertext()).strip()
        if suffix == "odp":
            for n, page in enumerate(_under(body, "page"), 1):
                if text := "\n".join(filter(None, map(whole, _under(page, "p")))):
                    yield text, n, _attr(page, "name"), None
        elif suffix == "ods":
            for sheet in _under(body, "table"):
                lines = []
                for row in _under(sheet, "table-row")[:MAX_ROWS]:
                    cells = []
                    for cell in _under(row, "table-cell"):
                        cells += [whole(cell)[:MAX_CELL]] * min(int(_attr(cell, "number-columns-repeated") or 1), ODF_REPEAT_CELLS)
                    lines.append(" ".join(filter(None, cells)))
                if text := "\n".join(filter(None, lines)):
                    yield text, None, None, _attr(sheet, "name")
        else:
            section = heading = None
            for node in body.iter():
                if _tag(node) in ("h", "p") and (text := whole(node)):
                    if _tag(node) == "h" and (_attr(node, "outline-level") or "1") == "1":
                        section, heading = text, None
                    elif _tag(node) == "h":
                        heading = text
                    yield text, None, heading, section


def epub(data: bytes) -> Iterator[Block]:
    with open_zip(data) as archive:
        names, order = archive.namelist(), []
        package = next((n for n in names if n.endswith(".opf")), None)
        locked = set(re.findall(r'URI="([^"]+)"', archive.read("META-INF/encryption.xml").decode("utf-8", "replace"))) if "META-INF/encryption.xml" in names else set()
        if package:
            tree = _xml(archive, package)
            paths = {_attr(i, "id"): posixpath.normpath(posixpath.join(posixpath.dirname(package), _attr(i, "href") or "")) for i in _under(tree, "item")}
            order = [paths[_attr(i, "idref")] for i in _under(tree, "itemref") if _attr(i, "idref") in paths]
        order = [n for n in order or names if n in names and n.lower().endswith((".xhtml", ".html", ".htm"))]
        if order and all(n in locked for n in order):
            raise ValueError("all chapters are protected")
        for n, name in enumerate((x for x in order if x not in locked), 1):
            raw = decode(archive.read(name))
            title = re.search(r"<title[^>]*>(.*?)</title>", raw, re.I | re.S)
            if text := html_text(raw):
                yield text, n, None, html_text(title[1]) if title else None


def eml(data: bytes) -> Iterator[Block]:
    message = email.message_from_bytes(data, policy=email.policy.default)
    head = [f"{k}: {message[k]}" for k in ("Subject", "From", "To", "Date") if message[k]]
    body = message.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body and body.get_content_subtype() == "html":
        text = html_text(text)
    yield "\n".join([*head, "", text.strip()]).strip(), None, None, None


def _one(text: str) -> list[Block]:
    return [(text.strip(), None, None, None)] if text.strip() else []


FORMATS: dict[str, Callable[[bytes], Iterator[Block] | list[Block]]] = {
    "html": lambda d: _one(html_text(decode(d))),
    "htm": lambda d: _one(html_text(decode(d))),
    "rtf": lambda d: _one(rtf_text(decode(d))),
    "csv": lambda d: _one(table_text(decode(d))),
    "tsv": lambda d: _one(table_text(decode(d), True)),
    "docx": docx,
    "pptx": pptx,
    "xlsx": xlsx,
    "xlsm": xlsx,
    "odt": lambda d: odf(d, "odt"),
    "ods": lambda d: odf(d, "ods"),
    "odp": lambda d: odf(d, "odp"),
    "epub": epub,
    "eml": eml,
    "msg": lambda d: ole.msg(d, html_text),
    "pdf": pdf,
    "doc": ole.doc,
    "ppt": ole.ppt,
    "xls": ole.xls,
}


def extract(files: DataFrame, more: dict[str, Callable[[bytes], Iterator[Block]]] | None = None) -> DataFrame:
    """Blocks of files (path, content). Suffixes without a reader of their own are plain text; `more` adds readers
    (OCR, speech) or replaces them. Errors are told in their column."""
    readers = FORMATS | (more or {})

    def each(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            rows = []
            for path, content in zip(page["path"], page["content"], strict=True):
                suffix = path.rpartition(".")[2].lower() if "." in path else ""
                try:
                    blocks = list(readers.get(suffix, lambda d: _one(decode(d)))(bytes(content)))
                    rows += [(path, i, t, p, h, s, None) for i, (t, p, h, s) in enumerate(blocks)]
                except Exception as error:  # one bad file is a row, not a failed job
                    rows.append((path, 0, None, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "block", "text", "page_number", "heading", "section", "error"]).astype({"page_number": "Int32"})

    return files.select("path", "content").mapInPandas(each, OUT)
