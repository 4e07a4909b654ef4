"""Search modes, the pattern safety gate, and finding the next match."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


class UnsafePattern(ValueError):
    """A pattern that is invalid or could backtrack without bound."""


@dataclass(frozen=True)
class SearchQuery:
    text: str
    mode: str = "contains"  # contains, regex or fuzzy
    column: str | None = None


def parse_search(text: str) -> SearchQuery:
    """``regex:p`` and ``/p/`` are patterns, ``fuzzy:t`` is fuzzy, the rest contains."""
    t = text.strip()
    if t.lower().startswith("regex:"):
        return SearchQuery(t[6:].strip(), "regex")
    if t.lower().startswith("fuzzy:"):
        return SearchQuery(t[6:].strip(), "fuzzy")
    if len(t) > 2 and t[0] == t[-1] == "/":
        return SearchQuery(t[1:-1], "regex")
    return SearchQuery(t)


def check_pattern(pattern: str) -> None:
    """Refuse invalid patterns and a repeated group that itself holds a repeat."""
    try:
        re.compile(pattern)
    except re.error as problem:
        raise UnsafePattern(str(problem)) from None
    repeats_inside: list[bool] = []
    closed = False  # whether the group just closed holds a repeat
    i, in_class = 0, False
    while i < len(pattern):
        c = pattern[i]
        unbounded = c in "*+{"
        if c == "\\":
            i += 2
            closed = False
            continue
        if in_class:
            in_class = c != "]"
            closed = False
        elif c == "[":
            in_class, closed = True, False
            i += len(re.match(r"\^?\]?", pattern[i + 1:]).group())  # a bracket first in a class stands for itself
        elif c == "(":
            repeats_inside.append(False)
            closed = False
        elif c == ")" and repeats_inside:
            closed = repeats_inside.pop()
            if repeats_inside:
                repeats_inside[-1] |= closed
        elif unbounded:
            if closed:
                raise UnsafePattern("a repeat inside a repeated group")
            if repeats_inside:
                repeats_inside[-1] = True
            closed = False
        else:
            closed = False
        i += 1


def _plain_letters() -> tuple[str, str]:
    """Letters with marks below U+2000, and the letters without."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, UNMARKED = _plain_letters()


def fold(c: Column) -> Column:
    """Lower case without diacritics, composed or not."""
    return F.lower(F.regexp_replace(F.translate(c, MARKED, UNMARKED), r"\p{M}", ""))


def matches(cell: Column, query: SearchQuery) -> Column:
    if query.mode == "regex":
        check_pattern(query.text)
        return cell.rlike("(?i)" + query.text)
    if query.mode == "fuzzy":
        plain = "".join(ch for ch in unicodedata.normalize("NFD", query.text.strip()) if not unicodedata.combining(ch)).lower()
        return fold(cell).rlike("(?s)" + ".*".join(re.escape(ch) for ch in plain)) if plain else F.lit(True)
    return S.contains_text(cell, query.text)


def search(df: DataFrame, query: SearchQuery) -> Column:
    """Predicate: some searched column matches."""
    columns = [query.column] if query.column else df.columns
    return reduce(Column.__or__, [F.coalesce(matches(S.text(df, c), query), F.lit(False)) for c in columns])


def find_next(df: DataFrame, query: SearchQuery, position: str, start: int = 0, wrap: bool = True) -> DataFrame:
    """At most one row: position, column (0-based), value of the first match at or after ``start``."""
    columns = [query.column] if query.column else [c for c in df.columns if c != position]
    hits = [F.when(F.coalesce(matches(S.text(df, c), query), F.lit(False)),
                   F.struct(F.lit(i).alias("i"), S.text(df, c).alias("value"))) for i, c in enumerate(columns)]
    found = df.select(F.col(position).alias("position"), F.coalesce(*hits).alias("hit")).where("hit IS NOT NULL")
    if not wrap:
        found = found.where(F.col("position") >= start)
    found = found.orderBy((F.col("position") < start).cast("int"), "position").limit(1)
    return found.select("position", F.col("hit.i").alias("column_index"), F.col("hit.value").alias("value"))


def position_of(df: DataFrame, row_col: str, row: int, position: str) -> DataFrame:
    """View position of a source row; empty if it isn't in the view."""
    return df.where(F.col(row_col) == row).select(F.col(position).alias("position"))
