"""Column filters, text conditions and the filter expression language, as Column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


@dataclass(frozen=True)
class SelectedValues:
    """Cells that are one of ``values``; blanks by ``include_blanks``."""

    column: str
    values: tuple[str, ...] = ()
    include_blanks: bool = False

    def predicate(self, df: DataFrame) -> Column | None:
        if not self.values and not self.include_blanks:
            return None
        cell = S.text(df, self.column)
        return F.when(cell == "", F.lit(self.include_blanks)).otherwise(cell.isin(*self.values) if self.values else F.lit(False))

    def describe(self) -> str:
        shown = [f'"{v}"' for v in self.values] + ["(Blank)"] * self.include_blanks
        return f"{self.column} in {', '.join(shown)}"


@dataclass(frozen=True)
class DateRange:
    """Dates from ``low`` to ``high`` inclusive; either may be open."""

    column: str
    low: str | None = None
    high: str | None = None

    def predicate(self, df: DataFrame) -> Column:
        day = S.date(df, self.column)
        parts = [day.isNotNull()]
        if self.low is not None:
            parts.append(day >= F.lit(self.low).cast("timestamp_ntz"))
        if self.high is not None:
            parts.append(day <= F.lit(self.high).cast("timestamp_ntz"))
        return F.coalesce(reduce(Column.__and__, parts), F.lit(False))

    def describe(self) -> str:
        return f"{self.column} between {self.low or '...'} and {self.high or '...'}"


@dataclass(frozen=True)
class NumericRange:
    """Finite numbers in [low, high), or [low, high] if ``closed``."""

    column: str
    low: float
    high: float
    closed: bool = False

    def predicate(self, df: DataFrame) -> Column | None:
        if not self.low <= self.high:
            return None
        x = S.finite(S.number(df, self.column))
        return F.coalesce((x >= self.low) & ((x <= self.high) if self.closed else (x < self.high)), F.lit(False))

    def describe(self) -> str:
        return f"{self.low:.4g} <= {self.column} {'<=' if self.closed else '<'} {self.high:.4g}"


@dataclass(frozen=True)
class FilterState:
    """At most one filter per column, and a text condition; all must hold."""

    filters: tuple = ()
    text: str = ""
    text_column: str | None = None

    def with_filter(self, new) -> "FilterState":
        return FilterState((*[f for f in self.filters if f.column != new.column], new), self.text, self.text_column)

    def without(self, column: str) -> "FilterState":
        return FilterState(tuple(f for f in self.filters if f.column != column), self.text, self.text_column)

    def toggled(self, column: str, value: str) -> "FilterState":
        """A facet click: values of one column add up; a blank value is the blank entry."""
        old = next((f for f in self.filters if f.column == column and isinstance(f, SelectedValues)), SelectedValues(column))
        if value == "":
            new = SelectedValues(column, old.values, not old.include_blanks)
        elif value in old.values:
            new = SelectedValues(column, tuple(v for v in old.values if v != value), old.include_blanks)
        else:
            new = SelectedValues(column, (*old.values, value), old.include_blanks)
        return self.with_filter(new) if new.values or new.include_blanks else self.without(column)

    def predicate(self, df: DataFrame) -> Column:
        parts = [p for f in self.filters if (p := f.predicate(df)) is not None]
        if self.text.strip():
            parts.append(condition(df, self.text, self.text_column))
        return reduce(Column.__and__, parts, F.lit(True))

    def describe(self) -> list[str]:
        return [f.describe() for f in self.filters] + ([self.text] if self.text.strip() else [])


def equals(column: str, value: str) -> Column:
    """Exact equality of text; a missing field never matches."""
    return F.coalesce(F.col(column).cast("string") == F.lit(value), F.lit(False))


def contains(df: DataFrame, needle: str, column: str | None = None) -> Column:
    """Contains in one column, or in any."""
    if needle == "":
        return F.lit(False)
    return reduce(Column.__or__, [S.contains_text(S.text(df, c), needle) for c in ([column] if column else df.columns)])


def looks_like_expression(text: str) -> bool:
    return bool(re.search(r"(?i)\b(and|or|contains)\b|==|!=|>=|<=|[><=]", text))


def condition(df: DataFrame, text: str, column: str | None = None) -> Column:
    """A text condition: an expression where it reads as one, else plain contains."""
    return expression(df, text) if column is None and looks_like_expression(text) else contains(df, text.strip(), column)


class ExpressionError(ValueError):
    """A filter expression that can't be read."""


_TOKEN = re.compile(r"""\s*(?:(?P<op>==|!=|>=|<=|=|>|<)|(?P<paren>[()])|"(?P<quoted>(?:[^"\\]|\\.)*)"|(?P<word>[^\s()=!<>"]+))""")


@dataclass
class _Parser:
    """``condition (AND condition)* (OR ...)*`` with parentheses; AND binds tighter."""

    df: DataFrame
    tokens: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0

    def read(self, source: str) -> Column:
        place = 0
        while place < len(source.rstrip()):
            m = _TOKEN.match(source, place)
            if not m:
                raise ExpressionError(f"unexpected text at {place}: {source[place:place + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            place = m.end()
        out = self.either()
        if self.at < len(self.tokens):
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def word(self, *names: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "word" and self.tokens[self.at][1].lower() in names

    def paren(self, which: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at] == ("paren", which)

    def either(self) -> Column:
        out = self.both()
        while self.word("or"):
            self.at += 1
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.single()
        while self.word("and"):
            self.at += 1
            out = out & self.single()
        return out

    def operand(self, stop) -> str:
        parts = []
        while self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "quoted") and not stop():
            parts.append(self.tokens[self.at][1])
            self.at += 1
        if not parts:
            raise ExpressionError("a column or value is missing")
        return " ".join(parts)

    def single(self) -> Column:
        if self.paren("("):
            self.at += 1
            out = self.either()
            if not self.paren(")"):
                raise ExpressionError("missing )")
            self.at += 1
            return out
        name = self.operand(lambda: self.word("contains", "and", "or"))
        if self.word("contains"):
            op = "contains"
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "op":
            op = self.tokens[self.at][1]
        else:
            raise ExpressionError(f"an operator must follow {name!r}")
        self.at += 1
        value = self.operand(lambda: self.word("and", "or"))
        return compare(self.df, find_column(self.df, name), op, value)


def find_column(df: DataFrame, name: str) -> str:
    """First header equal to ``name`` ignoring case, else ``columnN`` (1-based)."""
    for c in df.columns:
        if c.lower() == name.lower():
            return c
    m = re.fullmatch(r"(?i)column(\d+)", name)
    if m and 1 <= int(m[1]) <= len(df.columns):
        return df.columns[int(m[1]) - 1]
    raise ExpressionError(f"no column {name!r}")


def compare(df: DataFrame, column: str, op: str, value: str) -> Column:
    """One condition.  Order is numeric if both sides are numbers, else text ignoring case."""
    raw = F.col(column)
    cell = raw.cast("string")
    if op == "contains":
        return F.coalesce(S.contains_text(cell, value), F.lit(False))
    if op in ("=", "=="):
        return F.coalesce(cell == F.lit(value), F.lit(False))
    if op == "!=":
        return F.coalesce(cell != F.lit(value), F.lit(True))
    x = S.number(df, column)
    try:
        y = float(value.strip()) if re.match(S.NUMBER, value.strip()) else None
    except ValueError:
        y = None
    by_text = F.collate(cell, "UNICODE_CI")
    other = F.collate(F.lit(value), "UNICODE_CI")
    pairs = {">": (lambda a, b: a > b), ">=": (lambda a, b: a >= b), "<": (lambda a, b: a < b), "<=": (lambda a, b: a <= b)}[op]
    out = pairs(by_text, other) if y is None else F.when(x.isNotNull(), pairs(x, F.lit(y))).otherwise(pairs(by_text, other))
    return F.coalesce(out, F.lit(False))


def expression(df: DataFrame, source: str) -> Column:
    """A filter expression over the columns of ``df`` as one predicate."""
    return _Parser(df).read(source)
