"""Readers of files: delimited text, JSON, journals, office documents, Markdown, plain text, whole trees.

Office files are read as ``binaryFile`` rows and taken apart in Arrow batches
on the executors with the standard library; one file is one row, and the size
caps are applied before its content is opened, with a code in ``warnings``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Largest file that is opened, and blocks of one file from which a code is set.
MAX_BYTES, MAX_BLOCKS = 25 * 1024 * 1024, 50_000
BLOCKS = "path string, idx int, block_type string, level int, text string, heading_path array<string>, anchor string, warnings array<string>"


def sniff_delimiter(line: str) -> str:
    """The most frequent of comma, semicolon, tab and pipe outside quotes; comma if none stands there."""
    bare = re.sub(r'"[^"]*"', "", line)
    return max(",;\t|", key=lambda c: (bare.count(c), -",;\t|".index(c)))


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Delimited text with a header, all columns as strings; the delimiter is sniffed from the first line."""
    if delimiter is None:
        first = spark.read.text(path).limit(1).collect()
        delimiter = sniff_delimiter(first[0].value) if first else ","
    df = spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list, or an object that holds its list as rows, records or data."""
    df = spark.read.option("multiLine", True).json(path)
    for name in ("rows", "records", "data"):
        if name in df.columns and df.schema[name].dataType.typeName() == "array":
            return df.select(F.explode(name).alias("r")).select("r.*")
    return df


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only file of JSON lines; broken lines are left out and can be counted."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    return journal_rows(raw, schema)


def journal_rows(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    parsed = lines.select(F.from_json(column, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r._broken IS NULL").select("r.*").drop("_broken")


def read_tree(spark: SparkSession, path: str, skip: tuple[str, ...] = (".git", "node_modules", "__pycache__"), most: int = MAX_BYTES) -> DataFrame:
    """``path, length, content, code`` of all files under a folder, but for the folders to skip.

    A file of more than ``most`` bytes keeps its row without content, with a code; its content is never read.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    for name in skip:
        df = df.where(~F.col("path").contains(f"/{name}/"))
    small = df.where(F.col("length") <= most).select("path", "length", "content", F.lit(None).cast("string").alias("code"))
    return small.unionByName(df.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("FILE_TOO_LARGE").alias("code")))


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all documents under a path; see ``parse_documents``."""
    return parse_documents(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content"))


class _Out:
    """Blocks of one file, with the headings above each."""

    def __init__(self, path: str) -> None:
        self.path, self.rows, self.stack, self.warnings = path, [], [], []

    def add(self, kind: str, text: str, level: int | None = None, anchor: str | None = None) -> None:
        text = text.strip()
        if not text:
            return
        # Blocks beyond the limit stay; the code tells of them.
        if len(self.rows) >= MAX_BLOCKS and "MANY_BLOCKS" not in self.warnings:
            self.warnings.append("MANY_BLOCKS")
        if kind == "heading":
            self.stack = [h for h in self.stack if h[0] < (level or 1)]
        above = [h[1] for h in self.stack]
        self.rows.append((self.path, len(self.rows), kind, level, text, above, anchor))
        if kind == "heading":
            self.stack.append((level or 1, text))


_BULLET = re.compile(r"^\s*([-*+•]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+(.*)$")


def markdown(text: str, out: _Out) -> None:
    """Headings, list items, pipe tables and paragraphs; fences are skipped, wrapped lines joined."""
    para: list[str] = []
    fence = ""

    def flush() -> None:
        out.add("paragraph", " ".join(para))
        para.clear()

    for line in text.splitlines():
        mark = re.match(r"^\s*(`{3,}|~{3,})", line)
        if fence:
            if mark and mark.group(1)[0] == fence:
                fence = ""
            continue
        if mark:
            flush()
            fence = mark.group(1)[0]
            continue
        head = re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", line)
        item = _BULLET.match(line)
        if head:
            flush()
            out.add("heading", head.group(2), len(head.group(1)))
        elif re.match(r"^\s*\|.*\|\s*$", line):
            flush()
            if not re.match(r"^[\s|:-]+$", line):
                out.add("table_row", " | ".join(c.strip() for c in line.strip().strip("|").split("|")))
        elif item:
            flush()
            out.add("list_item", item.group(2))
        elif not line.strip():
            flush()
        else:
            para.append(line.strip())
    flush()


def plain(text: str, out: _Out) -> None:
    """Paragraphs between blank lines; a short one in capitals or ending with a colon is a heading."""
    for part in re.split(r"\n\s*\n", text):
        one = " ".join(part.split())
        if one and len(one) <= 80 and (one.endswith(":") or one.upper() == one and one.lower() != one):
            out.add("heading", one.rstrip(":"), 1)
        else:
            out.add("paragraph", one)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node: ET.Element, *names: str) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) in names)


def docx(content: bytes, out: _Out) -> None:
    """Paragraphs, headings by style, list items by numbering, and table rows of a word-processor file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
        notes = [n for n in ("word/footnotes.xml", "word/endnotes.xml") if n in z.namelist()]
        extra = [ET.fromstring(z.read(n)) for n in notes]
    top = next(x for x in body.iter() if _local(x.tag) == "body")
    for node in top:
        kind = _local(node.tag)
        if kind == "p":
            style = next((v for x in node.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
            m = re.match(r"(?i)heading\s*(\d)", style)
            numbered = any(_local(x.tag) == "numPr" for x in node.iter())
            text = _texts(node, "t", "tab")
            out.add("heading" if m else "list_item" if numbered or "list" in style.lower() else "paragraph", text, int(m.group(1)) if m else None)
        elif kind == "tbl":
            for row in (x for x in node if _local(x.tag) == "tr"):
                out.add("table_row", " | ".join(_texts(c, "t").strip() for c in row if _local(c.tag) == "tc"))
    for tree in extra:
        for note in (x for x in tree if _local(x.tag) in ("footnote", "endnote")):
            ident = next((v for k, v in note.attrib.items() if _local(k) == "id"), "")
            out.add("paragraph", _texts(note, "t"), anchor=f"note {ident}")


def read_tracked(files: DataFrame) -> DataFrame:
    """``path, para, seg, kind, author, bold, text``: runs of word-processor files given as ``path, content``, with tracked changes."""
    names = ["path", "para", "seg", "kind", "author", "bold", "text"]

    def segments(content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ET.fromstring(z.read("word/document.xml"))
        for k, p in enumerate((x for x in body.iter() if _local(x.tag) == "p"), 1):
            seg = 0
            for node in p:
                kind = {"ins": "ins", "del": "del", "r": "regular"}.get(_local(node.tag))
                if kind:
                    seg += 1
                    author = next((v for key, v in node.attrib.items() if _local(key) == "author"), None)
                    yield k, seg, kind, author, any(_local(x.tag) == "b" for x in node.iter()), _texts(node, "t", "delText")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(path, *s) for path, content in zip(pdf["path"], pdf["content"]) for s in segments(bytes(content))], columns=names)

    return files.select("path", "content").mapInPandas(run, "path string, para int, seg int, kind string, author string, bold boolean, text string")


def pptx(content: bytes, out: _Out) -> None:
    """Titles and texts of slides in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n).group(1)))
        for k, name in enumerate(names, 1):
            for shape in (x for x in ET.fromstring(z.read(name)).iter() if _local(x.tag) == "sp"):
                title = any(_local(x.tag) == "ph" and x.attrib.get("type") in ("title", "ctrTitle") for x in shape.iter())
                for p in (x for x in shape.iter() if _local(x.tag) == "p"):
                    out.add("heading" if title else "paragraph", _texts(p, "t"), 1 if title else None, f"slide {k}")


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group(0):
        n = n * 26 + ord(c) - 64
    return n


def sheet_rows(content: bytes) -> Iterator[tuple[str, list[str]]]:
    """Sheet name and cell texts of every row of a workbook; gaps in sparse rows are empty cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [_texts(si, "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        book = ET.fromstring(z.read("xl/workbook.xml"))
        titles = [s.attrib.get("name", "") for s in book.iter() if _local(s.tag) == "sheet"]
        files = sorted((n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n).group(1)))
        for k, name in enumerate(files):
            for row in (x for x in ET.fromstring(z.read(name)).iter() if _local(x.tag) == "row"):
                cells: list[str] = []
                for c in (x for x in row if _local(x.tag) == "c"):
                    at = column_number(c.attrib["r"]) if "r" in c.attrib else len(cells) + 1
                    cells += [""] * (at - 1 - len(cells))
                    value = _texts(c, "t") if c.attrib.get("t") == "inlineStr" else _texts(c, "v")
                    cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value else value)
                yield (titles[k] if k < len(titles) else f"sheet{k + 1}"), cells


def xlsx(content: bytes, out: _Out) -> None:
    sheet = None
    for title, cells in sheet_rows(content):
        if title != sheet:
            out.add("heading", title, 1)
            sheet = title
        out.add("table_row", " | ".join(cells), anchor=f"sheet {title}")


def parse_documents(files: DataFrame) -> DataFrame:
    """Blocks of files given as ``path, content``; the format goes by the suffix, then by the text itself.

    A file that is too large or broken has no blocks but one row with its code in ``warnings``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "idx", "block_type", "level", "text", "heading_path", "anchor", "warnings"]
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                out = _Out(path)
                kind = path.rsplit(".", 1)[-1].lower()
                try:
                    if content is None or len(content) > MAX_BYTES:
                        out.warnings.append("FILE_TOO_LARGE" if content is not None else "EMPTY")
                    elif kind in ("docx", "pptx", "xlsx"):
                        {"docx": docx, "pptx": pptx, "xlsx": xlsx}[kind](bytes(content), out)
                    else:
                        text = bytes(content).decode("utf-8", "replace").lstrip("﻿")
                        marked = kind == "md" or kind not in ("txt", "text") and re.search(r"(?m)^#{1,6} |^\s*[-*] ", text)
                        (markdown if marked else plain)(text, out)
                except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration, ValueError):
                    out.rows.clear()
                    out.warnings.append("UNREADABLE")
                if out.rows:
                    rows += [(*r, list(out.warnings)) for r in out.rows]
                else:
                    rows.append((path, 0, None, None, None, [], None, out.warnings or ["EMPTY"]))
            frame = pd.DataFrame(rows, columns=names)
            frame["level"] = frame["level"].astype("Int32")
            yield frame

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def read_workbook_rows(files: DataFrame) -> DataFrame:
    """``path, sheet, row, cells`` of workbooks given as ``path, content``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, sheet, k, cells) for path, content in zip(pdf["path"], pdf["content"]) for k, (sheet, cells) in enumerate(sheet_rows(bytes(content)))]
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells array<string>")


def with_header(rows: DataFrame, known: list[str]) -> DataFrame:
    """Workbook rows as maps from header to cell: the header is the first row that holds two known headers."""
    hits = F.size(F.filter("cells", lambda c: F.lower(F.trim(c)).isin(*[k.lower() for k in known])))
    heads = rows.withColumn("__h", hits).where("__h >= 2").groupBy("path", "sheet").agg(F.min_by(F.struct("row", "cells"), "row").alias("head"))
    data = rows.join(heads, ["path", "sheet"]).where(F.col("row") > F.col("head.row"))
    pairs = F.filter(F.arrays_zip(F.transform("head.cells", lambda c: F.lower(F.trim(c))).alias("k"), F.col("cells").alias("v")), lambda x: x["k"].isNotNull() & (x["k"] != ""))
    return data.select("path", "sheet", "row", F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["k"], F.coalesce(x["v"], F.lit(""))))).alias("cells"))
