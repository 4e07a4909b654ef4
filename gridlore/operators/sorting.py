"""Sorting by one or more columns, source order, and top-k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions.running import positions


@dataclass(frozen=True)
class SortKey:
    column: str
    ascending: bool = True


def numeric_columns(df: DataFrame, columns: list[str]) -> set[str]:
    """Columns whose every cell is blank or a number (one aggregate over text columns)."""
    typed = {c for c in columns if isinstance(S.kind_of(df, c), T.NumericType)}
    rest = [c for c in columns if c not in typed]
    if not rest:
        return typed
    fits = [F.min(((F.trim(S.text(df, c)) == "") | S.number(df, c).isNotNull()).cast("int")).alias(f"f{i}") for i, c in enumerate(rest)]
    row = df.agg(*fits).first()
    return typed | {c for i, c in enumerate(rest) if row[f"f{i}"] == 1}


def sort_columns(df: DataFrame, keys: list[SortKey], row_col: str) -> list[Column]:
    """Order expressions: numbers with blanks first, or text ignoring case; ties by source row."""
    numeric = numeric_columns(df, [k.column for k in keys])
    out = []
    for k in keys:
        key = F.coalesce(S.number(df, k.column), F.lit(float("-inf"))) if k.column in numeric else S.order_text(S.text(df, k.column))
        out.append(key.asc() if k.ascending else key.desc())
    return [*out, F.col(row_col).asc()]


def sort(df: DataFrame, keys: list[SortKey], row_col: str) -> DataFrame:
    return df.orderBy(*sort_columns(df, keys, row_col))


def toggle(keys: tuple[SortKey, ...], column: str, additive: bool = False) -> tuple[SortKey, ...]:
    """A header click: flip the column's direction, or make it the key, or add it."""
    flipped = tuple(SortKey(k.column, not k.ascending) if k.column == column else k for k in keys)
    if any(k.column == column for k in keys):
        return flipped if additive else tuple(k for k in flipped if k.column == column)
    return (*keys, SortKey(column)) if additive else (SortKey(column),)


def top_k(df: DataFrame, keys: list[SortKey], row_col: str, k: int) -> DataFrame:
    return sort(df, keys, row_col).limit(k)


def stride_sample(df: DataFrame, order: list, cap: int) -> DataFrame:
    """Rows round(i * (n - 1) / (cap - 1)) of the order, all where n <= cap."""
    spark = df.sparkSession
    n = df.count()
    if n <= cap:
        return df
    if cap < 2:
        return df.orderBy(*order).limit(cap)
    wanted = spark.range(cap).select(F.floor(F.col("id") * (n - 1) / (cap - 1) + 0.5).cast("long").alias("__at")).distinct()
    return positions(df, order, "__at").join(F.broadcast(wanted), "__at", "left_semi")  # cap rows
