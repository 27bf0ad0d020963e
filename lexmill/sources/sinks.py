"""Writers: delimited text, JSON, workbooks, calendars, Markdown tables, HTML reports."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.functions import text as T


def write_delimited(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """Text columns with empty strings for nulls."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(header: list[str], rows: list[list[str]], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet with inline strings."""
    lines = []
    for k, cells in enumerate([header, *rows], 1):
        cols = "".join(f'<c r="{_letters(j)}{k}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for j, v in enumerate(cells, 1) if v not in (None, ""))
        lines.append(f'<row r="{k}">{cols}</row>')
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buffer.getvalue()


def workbooks(df: DataFrame, key: str, columns: list[str], most: int = 100_000) -> DataFrame:
    """``path, content``: workbooks of each key's rows, at most ``most`` rows each, further ones numbered on."""
    rows = df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*columns)) - 1).withColumn("__part", F.floor(F.col("__k") / most))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__k")
        body = pdf[columns].astype(object).where(pdf[columns].notna(), "").astype(str).values.tolist()
        name = f"{pdf[key].iloc[0]}-{int(pdf['__part'].iloc[0])}.xlsx"
        return pd.DataFrame({"path": [name], "content": [workbook(columns, body)]})

    return rows.groupBy(key, "__part").applyInPandas(build, "path string, content binary")


def rewrite_docx(files: DataFrame, edits: dict[str, str]) -> DataFrame:
    """Word-processor files (``path, content``) with words of their text replaced, packed again; other parts stay as they are."""

    def rewritten(content: bytes) -> bytes:
        buffer = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as new:
            for item in old.infolist():
                data = old.read(item)
                if item.filename.startswith("word/") and item.filename.endswith(".xml"):
                    text = data.decode("utf-8")
                    for a, b in edits.items():
                        text = re.sub(r"(<w:t(?: [^>]*)?>)([^<]*)", lambda m, a=a, b=b: m.group(1) + m.group(2).replace(escape(a), escape(b)), text)
                    data = text.encode("utf-8")
                new.writestr(item.filename, data)
        return buffer.getvalue()

    @F.pandas_udf("binary")
    def rewrite(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: rewritten(bytes(c)) if c is not None else None)

    return files.withColumn("content", rewrite("content"))


def fold_line(line: str) -> str:
    """A calendar line cut into pieces of at most 75 octets, none within a character."""
    out, size = [], 0
    for c in line:
        n = len(c.encode())
        if size + n > 75:
            out.append("\r\n ")
            size = 1
        out.append(c)
        size += n
    return "".join(out)


def calendar_events(uid: Column, day: Column, end: Column, title: Column) -> Column:
    """Calendar text of an all-day event, lines not yet folded."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd")
    return F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART;VALUE=DATE:"), stamp(day)), F.concat(F.lit("DTEND;VALUE=DATE:"), stamp(end)), F.concat(F.lit("SUMMARY:"), T.escape(title, "ics")), F.lit("END:VEVENT"))


def fold_calendar(df: DataFrame, column: str) -> DataFrame:
    """The calendar text with every line folded, in Arrow batches."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "\r\n".join(fold_line(x) for x in t.split("\r\n")) if t is not None else None)

    return df.withColumn(column, fold(column))


def markdown_row(*cells: Column) -> Column:
    """One row of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[T.escape(F.coalesce(c.cast("string"), F.lit("")), "md") for c in cells]), F.lit(" |"))


def html_report(df: DataFrame, group: str, title: Column, body: Column) -> DataFrame:
    """One HTML fragment per group: a heading and a list of escaped items in order."""
    item = F.concat(F.lit("<li>"), T.escape(body, "xml"), F.lit("</li>"))
    out = df.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("__i"), F.min(title).alias("__t"))
    return out.select(group, F.concat(F.lit("<h2>"), T.escape(F.col("__t"), "xml"), F.lit("</h2><ul>"), F.array_join("__i", ""), F.lit("</ul>")).alias("html"))


def aligned_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pipe rows padded to each column's widest value; the widths come from one aggregation."""
    widths = df.agg(*[F.max(F.length(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(f"__w_{c}") for c in columns])
    wide = df.join(F.broadcast(widths))
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(f"__w_{c}"), F.lit(" ")) for c in columns]
    return wide.select(*df.columns, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
