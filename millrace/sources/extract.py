"""Text out of HTML, LaTeX and PDF."""

from __future__ import annotations

import re
import zlib
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_latex_comments

# Tags whose text isn't shown, and tags that begin and end lines.
HIDDEN = {"script", "style", "noscript", "template"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul",
}
# Fixed values of the HTML standard: tags without content, tags that end a paragraph, tags that are taken out alone
# when they are closed out of order, tags of a head, tags that the parts of a table end, and tags beyond which nothing is closed.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDS_PARAGRAPH = HEADINGS | {
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
CELLS, ROW_GROUPS = {"td", "th"}, {"tbody", "thead", "tfoot"}
SCOPE = {"applet", "caption", "html", "marquee", "object", "table", "td", "template", "th"}
# Media types, endings and mirrors.
MEDIA = {"text/html": "html", "application/xhtml+xml": "html", "application/pdf": "pdf", "application/x-latex": "latex", "application/x-tex": "latex", "text/x-latex": "latex", "text/x-tex": "latex"}
ENDINGS = {"html": "html", "htm": "html", "xhtml": "html", "pdf": "pdf", "tex": "latex", "latex": "latex"}
MIRRORS = ["arxiv.org", "export.arxiv.org", "api.semanticscholar.org", "www.semanticscholar.org", "semanticscholar.org", "github.com", "raw.githubusercontent.com", "pypi.org", "files.pythonhosted.org"]


def format_from_media(media: Column) -> Column:
    return F.create_map(*(F.lit(x) for p in MEDIA.items() for x in p))[media]


def format_from_path(path: Column) -> Column:
    return F.create_map(*(F.lit(x) for p in ENDINGS.items() for x in p))[F.lower(F.substring_index(path, ".", -1))]


def detect_format(path: Column, media: Column) -> Column:
    """The path decides before the media type; null if neither tells."""
    return F.coalesce(format_from_path(path), format_from_media(media))


def from_mirror(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).isin(MIRRORS), F.lit(False))


class _Node:
    """An element with its children: strings and elements."""

    __slots__ = ("name", "children", "parent")

    def __init__(self, name: str, parent: _Node | None = None):
        self.name, self.children, self.parent = name, [], parent


class _Page(HTMLParser):
    """The tree of a page as the HTML standard builds it: left-out tags are put in, tags that close nothing are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("html")
        self.open = [self.root]
        self.head = self.body = False

    def _push(self, name: str) -> None:
        node = _Node(name, self.open[-1])
        self.open[-1].children.append(node)
        self.open.append(node)

    def _in_scope(self, names: set[str], bounds: set[str] = SCOPE) -> bool:
        for node in reversed(self.open):
            if node.name in names:
                return True
            if node.name in bounds:
                return False
        return False

    def _close(self, names: set[str]) -> None:
        while self.open.pop().name not in names:
            pass

    def _enter_body(self) -> None:
        if not self.body:
            self.head = self.body = True
            self.open = [self.root]
            self._push("body")

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body", "head"):
            if tag == "body":
                self._enter_body()
            elif tag == "head" and not self.head:
                self.head = True
                self._push("head")
            return
        if not self.body:
            if tag in HEAD:
                if not self.head:
                    self.head = True
                    self._push("head")
                self._push(tag)
                if tag in VOID:
                    self.open.pop()
                return
            self._enter_body()
        if tag in ENDS_PARAGRAPH and self._in_scope({"p"}, SCOPE | {"button"}):
            self._close({"p"})
        if tag in HEADINGS and self.open[-1].name in HEADINGS:
            self.open.pop()
        elif tag == "li" and self._in_scope({"li"}, SCOPE | {"ol", "ul"}):
            self._close({"li"})
        elif tag in ("dd", "dt") and self._in_scope({"dd", "dt"}, SCOPE | {"dl"}):
            self._close({"dd", "dt"})
        elif tag in ("option", "optgroup") and self.open[-1].name == "option":
            self.open.pop()
        elif tag in CELLS | ROW_GROUPS | {"tr"}:
            if not self._in_scope({"table"}, {"html", "template"}):
                return
            ended = CELLS if tag in CELLS else CELLS | {"tr"} if tag == "tr" else CELLS | {"tr"} | ROW_GROUPS
            while self._in_scope(ended, {"html", "table", "template"}):
                self._close(ended)
            if tag not in ROW_GROUPS and self.open[-1].name == "table":
                self._push("tbody")
            if tag in CELLS and self.open[-1].name in ROW_GROUPS:
                self._push("tr")
        self._push(tag)
        if tag in VOID:
            self.open.pop()

    def handle_startendtag(self, tag, attrs):
        # The slash says nothing in HTML.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "head" and not self.body and self.open[-1].name == "head":
            self.open.pop()
        elif tag in ("html", "body", "head") or tag in VOID:
            return
        elif tag == "p" and not self._in_scope({"p"}, SCOPE | {"button"}):
            self._enter_body()
            self._push("p")
            self.open.pop()
        elif tag in HEADINGS:
            if self._in_scope(HEADINGS):
                self._close(HEADINGS)
        elif tag in FORMATTING:
            at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].name == tag), 0)
            if at and any(n.name in ENDS_PARAGRAPH | SCOPE for n in self.open[at + 1 :]):
                del self.open[at]  # blocks that began inside go on without it
            elif at:
                del self.open[at:]
        elif self._in_scope({tag}, SCOPE - {tag} if tag not in {"table", "tr"} | ROW_GROUPS else {"html", "template"}):
            self._close({tag})

    def handle_data(self, data):
        data = data.replace("\0", "")
        if not self.body and self.open[-1].name in ("html", "head"):
            blank = not data.strip(" \t\n\f\r")
            if blank and not self.head:
                return
            if not blank:
                self._enter_body()
        here = self.open[-1]
        if here.name in ROW_GROUPS | {"table", "tr"} and data.strip(" \t\n\f\r"):
            table = next(n for n in reversed(self.open) if n.name == "table")
            table.parent.children.insert(table.parent.children.index(table), data)  # text can't stand between cells
        else:
            if here.name == "pre" and not here.children and data[:1] == "\n":
                data = data[1:]
            here.children.append(data)


def html_text(content: bytes) -> str:
    """Shown text with a line break before and after each block, if there is text before it; what isn't UTF-8 raises."""
    page = _Page()
    page.feed(content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n"))
    page.close()
    out: list[str] = []
    waiting: list[_Node | str | None] = [page.root]
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            if node:
                out.append(node)
        elif node is None or node.name in BLOCKS:
            if out and not out[-1].endswith("\n"):
                out.append("\n")
        if isinstance(node, _Node) and node.name not in HIDDEN:
            waiting += ([None] if node.name in BLOCKS else []) + node.children[::-1]
    return "".join(out)


def latex_text(content: bytes) -> str:
    return re.sub(r"(?<!\\)%[^\n]*", "", content.decode("utf-8"))


_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_PDF_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s\[\]()<>/]*|[^\s\[\]()<>/]+", re.S)
# PDF's short escapes.
_PDF_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    octal = lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1)[:1].isdigit() else _PDF_ESCAPE.get(m.group(1), b"" if m.group(1) in (b"\n", b"\r") else m.group(1))
    return re.sub(rb"\\([0-7]{1,3}|.)", octal, token[1:-1], flags=re.S)


def _pdf_string(token: bytes, font: dict[bytes, str] | None) -> str:
    raw = _pdf_bytes(token)
    if font:
        width = len(next(iter(font)))
        return "".join(font.get(raw[k : k + width], "") for k in range(0, len(raw), width))
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _pdf_stream(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """Shown strings of one page; a text move begins a line."""
    out: list[str] = []
    operands: list[bytes] = []
    font = None
    for token in _PDF_TOKEN.findall(content):
        strings = [t for t in operands if t[:1] in (b"(", b"<")]
        if token == b"Tf":
            font = next((fonts.get(t[1:]) for t in operands if t[:1] == b"/"), None)
        elif token in (b"Tj", b"'") and strings:
            out.append(_pdf_string(strings[0], font))
        elif token == b'"' and strings:
            out.append(_pdf_string(strings[-1], font))
        elif token == b"TJ":
            out += [_pdf_string(s, font) for s in strings]
        elif token in (b"T*", b"Td", b"TD") and out and not out[-1].endswith("\n"):
            out.append("\n")
        if token[:1] in b"(<[]/" or re.fullmatch(rb"[-+.\d]+", token):
            operands.append(token)
        else:
            operands = []
    return "".join(out)


class _Pdf:
    """The objects of a file, those inside object streams too, and its pages in the order of the page tree."""

    def __init__(self, content: bytes):
        self.objects = {int(n): body for n, _, body in _OBJECT.findall(content)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                inner, first = self.data(body), int(re.search(rb"/First\s+(\d+)", body).group(1))
                numbers = [int(x) for x in inner[:first].split()]
                places = numbers[1::2] + [len(inner) - first]
                for k, number in enumerate(numbers[::2]):
                    self.objects.setdefault(number, inner[first + places[k] : first + places[k + 1]])

    def data(self, body: bytes) -> bytes:
        found = _STREAM.search(body)
        if not found:
            return b""
        return zlib.decompressobj().decompress(found.group(1)) if b"/FlateDecode" in body[: found.start()] else found.group(1)

    def follow(self, body: bytes, name: bytes) -> bytes:
        """The value of a name: what it refers to, or the dictionary or list that stands there."""
        at = re.search(rb"/" + name + rb"\b\s*", body)
        if not at:
            return b""
        refers = re.match(rb"(\d+)\s+\d+\s+R", body[at.end() :])
        if refers:
            return self.objects.get(int(refers.group(1)), b"")
        depth = 0
        for mark in re.finditer(rb"<<|>>|\[|\]", body[at.end() :]):
            depth += 1 if mark.group() in (b"<<", b"[") else -1
            if depth <= 0:
                return body[at.end() : at.end() + mark.end()]
        return body[at.end() :]

    def pages(self) -> list[tuple[bytes, bytes]]:
        """Each page with its resources, which it may have from the tree above it."""
        is_page, is_tree = re.compile(rb"/Type\s*/Page\b(?!s)"), re.compile(rb"/Type\s*/Pages\b")
        kids = {n: [int(k) for k in re.findall(rb"(\d+)\s+\d+\s+R", self.follow(b, b"Kids"))] for n, b in self.objects.items() if is_tree.search(b)}
        below = {k for ks in kids.values() for k in ks}
        out, seen, waiting = [], set(), [(n, b"") for n in sorted(set(kids) - below)][::-1]
        while waiting:
            n, resources = waiting.pop()
            body = self.objects.get(n, b"")
            if n in seen:
                continue
            seen.add(n)
            own = self.follow(body, b"Resources") or resources
            if n in kids:
                waiting += [(k, own) for k in reversed(kids[n])]
            elif is_page.search(body):
                out.append((body, own))
        return out or [(b, self.follow(b, b"Resources")) for _, b in sorted(self.objects.items()) if is_page.search(b)]

    def fonts(self, resources: bytes) -> dict[bytes, dict[bytes, str]]:
        """The characters that the codes of each font stand for, where the font tells."""
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.follow(resources, b"Font")):
            table = self.follow(self.objects.get(int(number), b""), b"ToUnicode")
            codes = self._codes(self.data(table)) if table else {}
            if codes:
                out[name] = codes
        return out

    @staticmethod
    def _codes(table: bytes) -> dict[bytes, str]:
        out, text = {}, lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
            for code, char in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                out[bytes.fromhex(code.decode())] = text(char)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
            for low, high, char in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                for k in range(min(int(high, 16) - int(low, 16) + 1, 1 << 16)):
                    first = text(char)
                    out[(int(low, 16) + k).to_bytes(len(low) // 2, "big")] = first[:-1] + chr(ord(first[-1]) + k)
        return out


def pdf_text(content: bytes) -> str:
    """Text of all pages in the order of the page tree; no page raises. Streams may be plain or deflated, objects inside streams, fonts with their own codes."""
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
        raise ValueError("the file is encrypted")
    file = _Pdf(content)
    pages = file.pages()
    if not pages:
        raise ValueError("the file has no pages")
    out = []
    for page, resources in pages:
        found = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        fonts = file.fonts(resources)
        for n in re.findall(rb"(\d+)\s+\d+\s+R", found.group(1)) if found else []:
            out.append(_pdf_stream(file.data(file.objects.get(int(n), b"")), fonts))
    return "\n".join(p for p in out if p)


EXTRACTORS = {"html": html_text, "latex": latex_text, "pdf": pdf_text}


def extract_text(content: bytes | None, kind: str | None) -> tuple[str | None, str | None]:
    """``(text, error)``; errors are unsupported, empty and unparseable."""
    if kind not in EXTRACTORS:
        return None, "unsupported"
    if not content:
        return None, "empty"
    try:
        return EXTRACTORS[kind](bytes(content)), None
    except (ValueError, AttributeError, zlib.error):
        return None, "unparseable"


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def _extract(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract_text(c, k) for c, k in zip(content, kind)], columns=["text", "error"])


def extract(blobs: DataFrame) -> DataFrame:
    """``(path, text, format, source, content_hash, bytes_in, error)`` of ``(path, content, media_type)``."""
    rows = blobs.select("path", "content", detect_format(F.col("path"), F.col("media_type")).alias("format"))
    done = rows.withColumn("e", _extract("content", "format"))
    return done.select("path", "e.text", "format", F.col("path").alias("source"), F.sha2("e.text", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("bytes_in"), "e.error")


def read_blobs(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content", F.lit(None).cast("string").alias("media_type"))


def latex_columns(text: Column) -> Column:
    """The LaTeX extractor as a Column, for texts that are in a table already."""
    return strip_latex_comments(text)

