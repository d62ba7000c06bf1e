"""Sheets of workbooks, read where the files lie: any number of workbooks, of which each is read by one task."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _place(reference: str) -> int:
    """The column number of a cell reference such as AB12, from 0."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes, name: str) -> Iterator[list[str | None]]:
    """The rows of a sheet as texts; empty cells are null. No sheet of that name: no rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): links[s.get(_LINK)] for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        if name not in sheets:
            return
        target = sheets[name].lstrip("/")
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _place(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value = c.find(f"{_MAIN}v")
                    if c.get("t") == "s" and value is not None:
                        cells[at] = shared[int(value.text)]
                    elif c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif value is not None:
                        cells[at] = value.text
                yield cells
                row.clear()


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A plain workbook of texts and numbers."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_LINK[1:-3]}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>' + "".join("<row>" + "".join(map(cell, row)) + "</row>" for row in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def sheet_of(books: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(path, columns as texts) of the rows of one sheet of workbooks (path, content). The first row names the columns; columns
    that a sheet lacks are null, others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = sheet_rows(content.as_py(), name)
                head = {c: i for i, c in enumerate(next(rows, []))}
                held: list[list] = []
                for row in rows:
                    held.append([row[head[c]] if c in head and head[c] < len(row) else None for c in columns])
                    if len(held) == 5_000:
                        yield _batch(path, held, columns)
                        held = []
                if held:
                    yield _batch(path, held, columns)

    return books.select("path", "content").mapInArrow(run, "path string, " + ", ".join(f"`{c}` string" for c in columns))


def _batch(path: str, rows: list[list], columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *(pa.array([r[i] for r in rows], pa.string()) for i in range(len(columns)))], ["path", *columns])


def sheet(spark: SparkSession, path: str, name: str, columns: list[str]) -> DataFrame:
    """(path, columns as texts) of one sheet of all workbooks under a path that Spark can read."""
    return sheet_of(spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content")), name, columns)
