"""Title, description, visible text, links and tables of HTML pages."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = frozenset(("script", "style", "noscript"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An ampersand that begins no numeric reference, with the name behind it that a semicolon ends.
_OPEN = re.compile(r"&(?!#[0-9]+;|#[xX][0-9A-Fa-f]+;)([A-Za-z][A-Za-z0-9]*;)?")


class Page(HTMLParser):
    """What is kept of a page. Tables inside a table count for the outer one too.

    As in browsers, some character references need no semicolon (`&amp` is `&`). With `closed` all need one: what has
    none stays as it is written.
    """

    def __init__(self, text: str, closed: bool = False):
        super().__init__(convert_charrefs=True)
        self._sign = None
        if closed and "&" in text:  # ampersands that begin no reference wait as a character that the page does not have
            self._sign = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in text)
            text = _OPEN.sub(lambda m: m[0] if m[1] in html5 else self._sign + (m[1] or ""), text)
        self.title = self.description = None
        self.texts: list[str] = []
        self.links: list[tuple[str, str, str | None]] = []
        self.tables: list[list[list[str]]] = []
        self._open: list[str] = []
        self._title: list[str] | None = None
        self._link: tuple | None = None
        self._tables: list[list] = []
        self._rows: list[list] = []
        self._cells: list[list] = []
        self._piece: list[str] = []
        self.feed(text)
        self.close()
        self._flush()

    def _flush(self):
        piece = "".join(self._piece).strip()
        self._piece = []
        if piece and not HIDDEN & set(self._open) and not {"head", "title"} & set(self._open):
            self.texts.append(piece)

    def _plain(self, data: str) -> str:
        return data.replace(self._sign, "&") if self._sign else data

    def handle_starttag(self, tag, attrs):
        self._flush()
        a = {k: self._plain(v or "") for k, v in attrs}
        if tag not in VOID:
            self._open.append(tag)
        if tag == "title" and self.title is None and self._title is None:
            self._title = []
        elif tag == "meta" and a.get("name") == "description" and self.description is None and "content" in a:
            self.description = a["content"].strip()
        elif tag == "a" and a.get("href"):
            self._link = (a["href"], [], a.get("title"))
        elif tag == "table":
            self._tables.append([])
        elif tag == "tr" and self._tables:
            row: list = []
            for t in self._tables:
                t.append(row)
            self._rows.append(row)
        elif tag in ("td", "th") and self._rows:
            cell: list = []
            self._rows[-1].append(cell)
            self._cells.append(cell)

    def handle_endtag(self, tag):
        self._flush()
        if tag in self._open:
            while self._open.pop() != tag:
                pass
        if tag == "title" and self._title is not None and self.title is None:
            self.title = "".join(self._title).strip() or None
            self._title = None
        elif tag == "a" and self._link:
            self.links.append((self._link[0], "".join(self._link[1]).strip(), self._link[2]))
            self._link = None
        elif tag in ("td", "th") and self._cells:
            self._cells.pop()
        elif tag == "tr" and self._rows:
            self._rows.pop()
        elif tag == "table" and self._tables:
            rows = [["".join(c).strip() for c in r] for r in self._tables.pop()]
            rows = [r for r in rows if any(r)]
            if rows:
                self.tables.append(rows)

    def handle_data(self, data):
        data = self._plain(data)
        if self._title is not None:
            self._title.append(data)
        if self._link:
            self._link[1].append(data)
        for c in self._cells:
            c.append(data)
        self._piece.append(data)

    @property
    def text(self) -> str:
        return " ".join(self.texts)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", closed: bool = False) -> DataFrame:
    """(id, title, description, text, links array, tables array); an empty page has nulls and empty arrays. `closed`: see Page."""
    kind = pages.schema[id_col].dataType.simpleString()
    link = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string()), ("title", pa.string())]))
    tables = pa.list_(pa.list_(pa.list_(pa.string())))

    def run(batches):
        for b in batches:
            got = [Page(t or "", closed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([p.title for p in got], pa.string()), pa.array([p.description for p in got], pa.string()), pa.array([p.text or None for p in got], pa.string()),
                    pa.array([[{"href": h, "text": t, "title": x} for h, t, x in p.links] for p in got], link), pa.array([p.tables for p in got], tables),
                ],
                [id_col, "title", "description", "text", "links", "tables"],
            )

    rows = pages.select(id_col, F.col(html_col).cast("string").alias("h"))
    return rows.mapInArrow(run, f"{id_col} {kind}, title string, description string, text string, links array<struct<href:string,text:string,title:string>>, tables array<array<array<string>>>")


def title_of(html):
    """The first title, in the JVM; entities stay as they are."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def route(mime) -> F.Column:
    """The extractor of a media type: parameters and case do not count; null for types that are not taken."""
    m = F.trim(F.substring_index(F.lower(mime), ";", 1))
    return F.when(m == "application/pdf", "pdf").when(m.isin("text/html", "application/xhtml+xml"), "html").when(m.isin("text/csv", "application/csv", "text/tab-separated-values"), "csv").when(m.isin("text/plain", "text/markdown", "application/json"), "text")
