"""XLSX workbooks as rows of cells, with the standard library alone.

A sheet of a workbook is one partition. Its XML is streamed from the zip member, so a sheet is never held whole; the
workbook's shared strings are read once for each task. Files are opened by byte ranges through pyarrow's file systems.

Defined cases: a cell has the text that the file stores (numbers and dates as their number, truth values as TRUE or FALSE); a cell
without a value is null; rows keep their number in the sheet, and rows that are not stored are not there; sheets without rows
give none; other parts (charts, macros) are not read.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import wanted_tabs

# Names of the parts and of the XML elements of the file format.
BOOK, LINKS, STRINGS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = 2_000


def _open(path: str) -> zipfile.ZipFile:
    store, where = fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:", path) else (fs.LocalFileSystem(), path)
    return zipfile.ZipFile(store.open_input_file(where))


def _files(path: str) -> list[str]:
    store, where = fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:", path) else (fs.LocalFileSystem(), path)
    if store.get_file_info(where).type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(where, recursive=True))
    return sorted(path.rstrip("/") + f.path[len(where.rstrip("/")) :] for f in found if f.is_file and f.path.lower().endswith(".xlsx"))


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def sheets_of(path: str) -> list[tuple[str, str]]:
    """(tab, part) of each sheet, in the workbook's order."""
    with _open(path) as z:
        parts = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read(LINKS))}
        tabs = [(e.get("name"), parts[e.get(REL)]) for e in ElementTree.fromstring(z.read(BOOK)).iter() if _name(e.tag) == "sheet"]
    return [(tab, part.lstrip("/") if part.startswith("/") else f"xl/{part}") for tab, part in tabs]


def _text(element) -> str:
    """Text of a string, its runs after each other; phonetic marks don't count."""
    if element is None:
        return ""
    return "".join((e.text or "") if _name(e.tag) == "t" else _text(e) if _name(e.tag) == "r" else "" for e in element)


def _strings(z: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    if STRINGS in z.namelist():
        with z.open(STRINGS) as f:
            for _, e in ElementTree.iterparse(f):
                if _name(e.tag) == "si":
                    out.append(_text(e))
                    e.clear()
    return out


def _column(ref: str) -> int:
    n = 0
    for letter in ref:
        if not letter.isalpha():
            break
        n = n * 26 + ord(letter.upper()) - 64
    return n - 1


def _value(cell, strings: list[str]) -> str | None:
    kind = cell.get("t", "n")
    parts = {_name(e.tag): e for e in cell}
    if kind == "inlineStr":
        return _text(parts.get("is"))
    raw = parts["v"].text if "v" in parts else None
    if raw is None:
        return None
    return strings[int(raw)] if kind == "s" else ("TRUE" if raw == "1" else "FALSE") if kind == "b" else raw


def sheet_rows(z: zipfile.ZipFile, part: str, strings: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 1, cells) of each stored row."""
    number, root = 0, None
    with z.open(part) as f:
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            if event == "start":
                root = e if _name(e.tag) == "sheetData" else root
            elif _name(e.tag) == "row":
                number = int(e.get("r") or number + 1)
                cells: list[str | None] = []
                for c in e:
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    cells.append(_value(c, strings))
                yield number, cells
                root.clear()  # rows that have been read


class SheetPartition(InputPartition):
    def __init__(self, path: str, tab: str, part: str):
        self.path, self.tab, self.part = path, tab, part


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.all = options["path"], options.get("alltabs", "false").lower() == "true"

    def partitions(self) -> list[SheetPartition]:
        out = []
        for path in _files(self.path):
            sheets = sheets_of(path)
            wanted = {t for t, _ in sheets} if self.all else set(wanted_tabs([t for t, _ in sheets]))
            out += [SheetPartition(path, tab, part) for tab, part in sheets if tab in wanted]
        return out

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        def batch(numbers, cells):
            n = len(numbers)
            cols = [pa.array([partition.path] * n), pa.array([partition.tab] * n), pa.array(numbers, pa.int64()), pa.array(cells, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(cols, ["file", "tab", "row_idx", "cells"])

        numbers, cells = [], []
        with _open(partition.path) as z:
            for number, row in sheet_rows(z, partition.part, _strings(z)):
                numbers.append(number), cells.append(row)
                if len(numbers) >= ROWS:
                    yield batch(numbers, cells)
                    numbers, cells = [], []
        if numbers:
            yield batch(numbers, cells)


class WorkbookSource(DataSource):
    """spark.read.format("workbook").load(path): file, tab, row_idx, cells. path: a workbook or a folder of them; option
    allTabs: also backups, copies and other tabs that hold no inventory."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "file string, tab string, row_idx long, cells array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)


def read_workbook(spark: SparkSession, path: str, all_tabs: bool = False) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").option("allTabs", str(all_tabs).lower()).load(path)


def tab_table(rows: DataFrame, tab: str) -> DataFrame:
    """A tab's rows under the names of its first row, with file and row_idx, as read_csv() gives a CSV file's; tab names are compared
    without regard to case. All workbooks read at a time share the columns of the first one. Missing cells are null."""
    own = rows.where(F.lower(F.trim("tab")) == tab.strip().lower())
    first = own.groupBy("file").agg(F.min("row_idx").alias("head"))
    head = own.orderBy("file", "row_idx").limit(1).collect()  # the header of one sheet
    if not head:
        raise ValueError(f"no rows in a tab named {tab}")
    names, seen = [], set()
    for i, c in enumerate(head[0]["cells"]):
        name = (c or f"_c{i}").strip()
        names.append(name if name.lower() not in seen else f"{name}{i}")
        seen.add(names[-1].lower())
    body = own.join(first, "file").where("row_idx > head")
    return body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)], "file", "row_idx")


def cells_of(rows: DataFrame) -> DataFrame:
    """(file, tab, row, col, value) of the filled cells; columns from 0."""
    each = rows.select("file", "tab", F.col("row_idx").alias("row"), F.posexplode("cells").alias("col", "value"))
    return each.where(F.trim("value") != "")
