"""Opening a file by its kind."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession

from .delimited import Table, open_delimited, open_text, read_head
from .sas import open_sas
from .spss import open_sav
from .workbooks import open_sqlite, open_xlsx
from .xls import open_xls

#: Fixed value: bytes 12 to 31 of a sas7bdat file.
SAS_MAGIC = bytes.fromhex("c2ea8160b31411cfbd92080009c7318c181f1011")


def route(name: str, head: bytes) -> str:
    """delimited, xlsx, sqlite, xls, sav or sas7bdat, by first bytes and extension."""
    ending = name.rsplit(".", 1)[-1].lower()
    if head.startswith(b"PK\x03\x04") and ending in ("xlsx", "xlsm"):
        return "xlsx"
    if head.startswith(b"SQLite format 3\0"):
        return "sqlite"
    if head.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        return "xls"
    if head[:4] in (b"$FL2", b"$FL3"):
        return "sav"
    if ending == "sas7bdat" or head[12:32] == SAS_MAGIC:
        return "sas7bdat"
    return "delimited"


def open_any(spark: SparkSession, path: str, part: str | None = None) -> Table:
    """Open a file by its kind."""
    kind = route(path, read_head(spark, path, 64))
    if kind == "xlsx":
        return open_xlsx(spark, path, part)
    if kind == "sqlite":
        return open_sqlite(spark, path, part)
    if kind == "sav":
        return open_sav(spark, path)
    if kind == "xls":
        return open_xls(spark, path, part)
    if kind == "sas7bdat":
        return open_sas(spark, path)
    return open_delimited(spark, path)


def open_pasted(spark: SparkSession, text: str) -> Table:
    """Pasted text: an existing path or file address is opened, anything else is the table itself."""
    line = text.strip()
    parts = urlsplit(line) if line.startswith("file:") else None
    path = unquote(parts.path) if parts else line
    if path and "\n" not in path and os.path.isfile(os.path.expanduser(path)):
        return open_any(spark, os.path.abspath(os.path.expanduser(path)))
    return open_text(spark, text)
