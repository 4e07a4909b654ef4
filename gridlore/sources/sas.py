"""sas7bdat files, by the reader of pandas, within the import limits."""

from __future__ import annotations

import io
import math
from datetime import datetime

from pyspark.sql import SparkSession

from .delimited import Table
from .workbooks import ImportLimit, Limits, _Budget, _content, _table

WARNING = "sas-best-effort"
ROWS_READ = 10_000


def cell_text(v) -> str:
    """A cell as text: missing values are blank, whole numbers have no point, midnight is a day."""
    if v is None or v != v:
        return ""
    if isinstance(v, bytes):
        return v.decode("utf-8", "replace").rstrip()
    if isinstance(v, float):
        return str(int(v)) if math.isfinite(v) and v == math.floor(v) and abs(v) < 1e15 else repr(v)
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%d" if (v.hour, v.minute, v.second) == (0, 0, 0) else "%Y-%m-%d %H:%M:%S")
    return str(v).rstrip()


def sas_rows(content: bytes, limits: Limits = Limits()):
    """Header, then rows as text."""
    import pandas as pd

    budget = _Budget(limits)
    with pd.read_sas(io.BytesIO(content), format="sas7bdat", encoding="infer", chunksize=ROWS_READ) as reader:
        number = 0
        for part in reader:
            if not number:
                names = [str(c) for c in part.columns]
                if len(names) > limits.columns:
                    raise ImportLimit("too many columns")
                yield names
            for row in part.itertuples(index=False, name=None):
                number += 1
                cells = [cell_text(v) for v in row]
                budget.row(number, cells)
                yield cells


def open_sas(spark: SparkSession, path: str, limits: Limits = Limits()) -> Table:
    content = _content(spark, path, limits)
    table = _table(spark, path, lambda c: sas_rows(c, limits), lambda: next(sas_rows(content, limits), [""]))
    table.warnings.append(WARNING)
    return table
