"""Spreadsheets (xlsx) and SQLite files as tables of text, with import limits."""

from __future__ import annotations

import io
import math
import re
import sqlite3
import time
import zipfile
from contextlib import closing
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .delimited import Table, read_head


class ImportLimit(ValueError):
    """A file that exceeds a limit; nothing of it is returned."""


@dataclass(frozen=True)
class Limits:
    file_bytes: int = 100 << 20
    rows: int = 1_048_576
    columns: int = 16_384
    cells: int = 10_000_000
    cell_chars: int = 32_767 * 4
    inflated_bytes: int = 1 << 30
    seconds: float = 60.0


NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Number formats of the standard that show dates.
DATE_FORMATS = frozenset((*range(14, 23), *range(45, 48)))


class _Budget:
    def __init__(self, limits: Limits):
        self.limits, self.cells, self.until = limits, 0, time.monotonic() + limits.seconds

    def row(self, number: int, cells: list[str]) -> None:
        m = self.limits
        self.cells += len(cells)
        if number > m.rows or len(cells) > m.columns or self.cells > m.cells or any(len(c) > m.cell_chars for c in cells):
            raise ImportLimit("too many rows, columns or cells, or a cell is too long")
        if time.monotonic() > self.until:
            raise ImportLimit("the import took too long")


def _inflate(archive: zipfile.ZipFile, name: str, limits: Limits) -> bytes:
    info = archive.getinfo(name)
    if info.file_size > limits.inflated_bytes:
        raise ImportLimit(f"{name} is too large")
    with archive.open(info) as f:
        data = f.read(limits.inflated_bytes + 1)
    if len(data) > limits.inflated_bytes:
        raise ImportLimit(f"{name} is too large")
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise ImportLimit("document type declarations are not read")
    return data


def xlsx_sheets(content: bytes) -> list[tuple[str, str]]:
    """(name, part) of each sheet in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(_inflate(z, "xl/workbook.xml", Limits()))
        links = ElementTree.fromstring(_inflate(z, "xl/_rels/workbook.xml.rels", Limits()))
    target = {r.get("Id"): r.get("Target") for r in links}
    out = []
    for s in book.iter(f"{NS}sheet"):
        path = target.get(s.get(f"{REL}id"), "")
        out.append((s.get("name"), path.lstrip("/") if path.startswith("/") else f"xl/{path}"))
    return out


def serial_date(serial: float, epoch_1904: bool = False) -> str:
    """A spreadsheet's day number as ISO text; day 60 of the 1900 system doesn't exist."""
    if epoch_1904:
        day = datetime(1904, 1, 1) + timedelta(days=serial)
    else:
        day = datetime(1899, 12, 30) + timedelta(days=serial)
    return day.strftime("%Y-%m-%d %H:%M:%S" if serial - math.floor(serial) > 1e-9 else "%Y-%m-%d")


def column_number(reference: str) -> int:
    """0-based column of a cell reference like BC12."""
    out = 0
    for ch in re.match(r"[A-Za-z]+", reference).group().upper():
        out = out * 26 + ord(ch) - 64
    return out - 1


def dated_code(code: str) -> bool:
    """Whether a custom number format shows a date: years or days, or months together with hours or seconds."""
    plain = re.sub(r'"[^"]*("|$)|\[[^\]]*(\]|$)', "", code).lower()
    return "y" in plain or "d" in plain or ("m" in plain and ("h" in plain or "s" in plain))


def _date_styles(z: zipfile.ZipFile, limits: Limits) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(_inflate(z, "xl/styles.xml", limits))
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{NS}numFmt")}
    dated = set()
    for i, xf in enumerate(root.find(f"{NS}cellXfs") if root.find(f"{NS}cellXfs") is not None else ()):
        number = int(xf.get("numFmtId", 0))
        if number in DATE_FORMATS or dated_code(custom.get(number, "")):
            dated.add(i)
    return dated


def xlsx_rows(content: bytes, sheet: str | None = None, limits: Limits = Limits()):
    """Rows of a sheet as lists of text; gaps between rows and cells are filled."""
    budget = _Budget(limits)
    part = next((p for n, p in xlsx_sheets(content) if sheet is None or n == sheet), None)
    if part is None:
        raise KeyError(sheet)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(_inflate(z, "xl/sharedStrings.xml", limits)).iter(f"{NS}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{NS}t")))
        dated = _date_styles(z, limits)
        book = ElementTree.fromstring(_inflate(z, "xl/workbook.xml", limits))
        props = book.find(f"{NS}workbookPr")
        old_epoch = props is not None and props.get("date1904") in ("1", "true")
        data = _inflate(z, part, limits)
    expected, width, rows = 1, 0, []
    for _, row in ElementTree.iterparse(io.BytesIO(data)):
        if row.tag != f"{NS}row":
            continue
        number = int(row.get("r") or expected)
        cells: list[str] = []
        for c in row.iter(f"{NS}c"):
            at = column_number(c.get("r")) if c.get("r") else len(cells)
            if at >= limits.columns:
                raise ImportLimit("too many columns")
            cells += [""] * (at - len(cells))
            value = c.find(f"{NS}v")
            text = value.text or "" if value is not None else ""
            kind = c.get("t", "n")
            if kind == "s":
                text = shared[int(text)] if text else ""
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{NS}t"))
            elif kind == "b":
                text = "TRUE" if text == "1" else "FALSE"
            elif kind == "n" and text and int(c.get("s", 0)) in dated:
                text = serial_date(float(text), old_epoch)
            cells.append(text)
        if number - expected > limits.rows:
            raise ImportLimit("too many rows")
        rows += [[] for _ in range(expected, number)]
        budget.row(number, cells)
        rows.append(cells)
        width = max(width, len(cells))
        expected = number + 1
        row.clear()
    for cells in rows:
        yield cells + [""] * (width - len(cells))


def _opened(content: bytes) -> sqlite3.Connection:
    """A SQLite file's bytes as a database in memory."""
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    return db


def sqlite_tables(content: bytes) -> list[str]:
    """Tables, then views, each by name."""
    with closing(_opened(content)) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' "
                                         "ORDER BY CASE type WHEN 'table' THEN 0 ELSE 1 END, name")]


def sqlite_rows(content: bytes, table: str, limits: Limits = Limits()):
    """Header, then rows as text: null is blank, a blob is ``<blob N bytes>``."""
    budget = _Budget(limits)

    def text(v) -> str:
        return "" if v is None else f"<blob {len(v)} bytes>" if isinstance(v, bytes) else str(v)

    with closing(_opened(content)) as db:
        quoted = table.replace('"', '""')
        found = db.execute(f'SELECT * FROM "{quoted}"')
        yield [d[0] for d in found.description]
        for i, r in enumerate(found, 1):
            cells = [text(v) for v in r]
            budget.row(i, cells)
            yield cells


def _table(spark: SparkSession, path: str, rows_of, header_of) -> Table:
    """A table whose rows one task reads from a whole file."""
    names = header_of()
    schema = pa.schema([("_row", pa.int64()), ("_fields", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = list(rows_of(content))[1:]  # limits hold before anything is returned
                for lo in range(0, len(rows), 10_000):
                    part = rows[lo:lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(range(lo + 1, lo + 1 + len(part)), pa.int64()), pa.array(part, pa.list_(pa.string()))], schema=schema)

    df = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "_row long, _fields array<string>")
    return Table(df.select("_row", "_fields", *[F.get("_fields", F.lit(i)).alias(f"c{i}") for i in range(len(names))]), names)


def _content(spark: SparkSession, path: str, limits: Limits) -> bytes:
    content = read_head(spark, path, limits.file_bytes + 1)
    if len(content) > limits.file_bytes:
        raise ImportLimit("the file is too large")
    return content


def open_xlsx(spark: SparkSession, path: str, sheet: str | None = None, limits: Limits = Limits()) -> Table:
    content = _content(spark, path, limits)
    return _table(spark, path, lambda c: xlsx_rows(c, sheet, limits), lambda: next(iter(xlsx_rows(content, sheet, limits)), [""]))


def open_sqlite(spark: SparkSession, path: str, table: str | None = None, limits: Limits = Limits()) -> Table:
    content = _content(spark, path, limits)
    table = table or sqlite_tables(content)[0]
    return _table(spark, path, lambda c: sqlite_rows(c, table, limits), lambda: next(sqlite_rows(content, table, limits)))
