"""Documents from files: text, Markdown, CSV, DOCX, XLSX and, where a reader is installed, PDF.

Files are read with Spark's binary source, so listing, splitting of work and remote stores are Spark's;
one file is parsed in one task. Each reader gives (path, title, text, error).
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 20 * 1024 * 1024
MAX_CHARS = 200_000
SCHEMA = "path string, title string, text string, error string"
#: The words that rendered rows begin with.
ROW, COLUMN, SHEET, TABLE = "Dòng", "Cột", "# Sheet:", "Bảng dữ liệu:"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def render_rows(rows: list[list[str]]) -> list[str]:
    """Rows under a header as `Dòng n | header: value | ...`; blank cells go, blank headers get a number."""
    if not rows:
        return []
    header = [h.strip() or f"{COLUMN} {i}" for i, h in enumerate(rows[0], 1)]
    out = []
    for n, row in enumerate(rows[1:], 2):
        cells = [f"{header[i] if i < len(header) else f'{COLUMN} {i + 1}'}: {v.strip()}" for i, v in enumerate(row) if v.strip()]
        if cells:
            out.append(" | ".join([f"{ROW} {n}", *cells]))
    return out


def text_of_csv(data: bytes) -> str:
    """Rows of a CSV file, delimiter found among comma, semicolon and tab."""
    text = data.decode("utf-8-sig")
    try:
        dialect = csv.Sniffer().sniff(text[:8192], delimiters=",;\t")
    except csv.Error:
        dialect = csv.excel
    rows = render_rows(list(csv.reader(io.StringIO(text), dialect)))
    if not rows:
        raise ValueError("no data rows")
    return "\n".join(rows)


def text_of_docx(data: bytes) -> str:
    """Paragraphs in order, heading styles as Markdown, tables as rows."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{W}t")).strip()
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{W}p" and (text := said(node)):
            style = node.find(f"{W}pPr/{W}pStyle")
            level = re.fullmatch(r"[Hh]eading\s*(\d+)", style.get(f"{W}val", "")) if style is not None else None
            out.append("#" * min(6, max(1, int(level[1]))) + " " + text if level else text)
        elif node.tag == f"{W}tbl":
            rows = render_rows([[said(c) for c in row.iter(f"{W}tc")] for row in node.iter(f"{W}tr")])
            out += [TABLE, *rows] if rows else []
    return "\n".join(out)


def text_of_xlsx(data: bytes) -> str:
    """Each sheet under a heading, rows as in CSV."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{S}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{S}si")]
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}

    def cell(c: ElementTree.Element) -> str:
        value = c.find(f"{S}v")
        if c.get("t") == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{S}t"))
        if value is None or value.text is None:
            return ""
        return shared[int(value.text)] if c.get("t") == "s" else value.text

    def place(reference: str) -> int:
        at = 0
        for letter in re.match("[A-Z]*", reference)[0]:
            at = at * 26 + ord(letter) - 64
        return at

    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{S}sheet"):
        target = targets[sheet.get(R)].lstrip("/")
        root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        rows = []
        for row in root.iter(f"{S}row"):
            cells: dict[int, str] = {}
            for i, c in enumerate(row.iter(f"{S}c"), 1):
                cells[place(c.get("r", "")) or i] = cell(c)
            rows.append([cells.get(i, "") for i in range(1, max(cells, default=0) + 1)])
        if found := render_rows(rows):
            out += [f"{SHEET} {sheet.get('name')}", *found]
    if not out:
        raise ValueError("no data rows")
    return "\n".join(out)


def text_of_pdf(data: bytes) -> str:
    """Text of the pages, by a reader that is optional."""
    try:
        import pymupdf
    except ImportError as error:
        raise ValueError("no PDF reader is installed") from error
    with pymupdf.open(stream=data, filetype="pdf") as document:
        if document.needs_pass or document.page_count > 200:
            raise ValueError("encrypted, or over 200 pages")
        return "\n".join(page.get_text() for page in document)


READERS = {"txt": lambda d: d.decode("utf-8-sig"), "md": lambda d: d.decode("utf-8-sig"), "csv": text_of_csv, "docx": text_of_docx, "xlsx": text_of_xlsx, "pdf": text_of_pdf}


def parse_file(path: str, data: bytes) -> tuple[str, str, str | None, str | None]:
    """(path, title, text, error) of a file, by its extension."""
    title, extension = posixpath.splitext(posixpath.basename(path))
    reader = READERS.get(extension.lstrip(".").lower())
    try:
        if reader is None:
            raise ValueError("unsupported extension")
        text = reader(data)
        if not text.strip():
            raise ValueError("no text")
        if len(text) > MAX_CHARS:
            raise ValueError("too long")
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, csv.Error) as error:
        return path, title, None, str(error)
    return path, title, text, None


def read_documents(spark: SparkSession, path: str, pattern: str = "*", max_bytes: int = MAX_BYTES) -> DataFrame:
    """All files under a path as (path, title, text, error); too large ones aren't loaded. Spark passes over empty files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    fits = F.col("length") <= max_bytes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_file(p, bytes(c)) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=["path", "title", "text", "error"])

    good = found.where(fits).select("path", "content").mapInPandas(run, SCHEMA)
    title = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    bad = found.where(~fits).select("path", title.alias("title"), F.lit(None).cast("string").alias("text"), F.lit("too large").alias("error"))
    return good.unionByName(bad)


def watch_documents(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    """New files under a path as a stream of (path, content); done ones go to `archive`, if given."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)
