"""Column helpers: numbers, dates, blanks, text matching and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens that count as missing, by operator family.
TYPE_NULLS = ("", "na", "n/a", "null", "nil", "missing")
QUALITY_SENTINELS = ("na", "n/a", "null", "nil", "none", "missing", "unknown", "-", "?", ".", "9999", "-9999", "99999", "-99999",
                     "#n/a", "#value!", "#ref!")
BOOLEANS = ("true", "false", "yes", "no", "y", "n", "0", "1")

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
NUMBER_WORD = r"^[+-]?(?i:inf|infinity|nan)$"
#: Patterns that cover the accepted unambiguous date layouts; single letters take one or two digits.
DATE_PATTERNS = ("yyyy-M-d", "yyyy-M-d H:mm", "yyyy-M-d H:mm:ss", "yyyy.M.d", "yyyy. M. d", "yyyy.M.d H:mm", "yyyy.M.d H:mm:ss",
                 "yyyy/M/d", "yyyy/M/d H:mm", "yyyy/M/d H:mm:ss", "yyyy-M", "yyyy.M", "yyyy/M", "yyyy년 M월 d일", "yyyy년 M월 d일 H:mm", "yyyy년 M월 d일 H:mm:ss")
MONTH_FIRST = ("M/d/yyyy", "M-d-yyyy")
DAY_FIRST = ("d/M/yyyy", "d-M-yyyy")
DATE_GATE = r"^(?=(?:\D*\d){5})(?=.*[-./:년월]).*$"
COMPACT = r"^(\d{8}|\d{14})$"


def kind_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def text(df: DataFrame, column: str) -> Column:
    """A cell as text; a missing field is blank."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_number(c: Column, style: str = "plain") -> Column:
    """Text as a double, or null.  Styles: plain, us (1,234.5) and european (1.234,5)."""
    t = trim_all(c)
    if style == "european":
        t = F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")
    plain = F.when(t.rlike(NUMBER) | t.rlike(NUMBER_WORD), t.try_cast("double"))
    if style == "us":
        bare = F.regexp_replace(t, ",", "")
        return F.coalesce(plain, F.when(bare.rlike(NUMBER), bare.try_cast("double")))
    return plain


def number(df: DataFrame, column: str, style: str = "plain") -> Column:
    """A column's numbers: a cast for numeric columns, else parsed text."""
    if isinstance(kind_of(df, column), T.NumericType):
        return F.col(column).cast("double")
    return parse_number(F.col(column).cast("string"), style)


def finite(c: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def identifier_like(t: Column) -> Column:
    """Digits that read as an identifier: a leading zero, or more than 15 of them."""
    return t.rlike(r"^[+-]?0\d+$") | t.rlike(r"^[+-]?\d{16,}$")


def parse_date(c: Column, day_first: bool = False, compact: bool = True) -> Column:
    """Text as a timestamp without zone, or null; patterns run only on date-like text."""
    t = trim_all(c)
    ambiguous = (*DAY_FIRST, *MONTH_FIRST) if day_first else (*MONTH_FIRST, *DAY_FIRST)
    tried = [F.try_to_timestamp(t, F.lit(p)).cast("timestamp_ntz") for p in (*DATE_PATTERNS, *ambiguous)]
    iso = F.when(t.rlike(r"T|Z$"), t.try_cast("timestamp").cast("timestamp_ntz"))
    out = F.when(t.rlike(DATE_GATE), F.coalesce(iso, *tried))
    if compact:
        out = F.when(t.rlike(COMPACT), F.coalesce(*[F.try_to_timestamp(t, F.lit(p)).cast("timestamp_ntz") for p in ("yyyyMMdd", "yyyyMMddHHmmss")])).otherwise(out)
    return out


def date(df: DataFrame, column: str, day_first: bool = False) -> Column:
    kind = kind_of(df, column)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(column).cast("timestamp_ntz")
    return parse_date(F.col(column).cast("string"), day_first)


def date_label(ts: Column, unit: str) -> Column:
    """day yyyy-MM-dd, week yyyy-Www (weeks begin on Sunday, week 1 holds January 1), month yyyy-MM, year yyyy."""
    unit = unit.lower()
    if unit == "week":
        day = ts.cast("date")
        saturday = F.date_add(day, F.lit(7) - F.dayofweek(day))
        week = F.floor((F.dayofyear(saturday) - 1) / 7).cast("int") + 1
        return F.format_string("%04d-W%02d", F.year(saturday), week)
    return F.date_format(ts, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit])


def contains_text(c: Column, needle: str) -> Column:
    """Contains, ignoring case and diacritics; an empty needle matches nothing."""
    if needle == "":
        return F.lit(False)
    return F.contains(F.collate(c, "UNICODE_CI_AI"), F.collate(F.lit(needle), "UNICODE_CI_AI"))


def order_text(c: Column) -> Column:
    """Sort key for text that ignores case."""
    return F.collate(c, "UNICODE_CI")


def null_key(c: Column) -> Column:
    """Pivot key of a cell: missing tokens read as the word null."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.lower(trim_all(t)).isin(*TYPE_NULLS), F.lit("null")).otherwise(t)
