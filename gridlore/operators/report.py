"""Reports and small result tables: provenance, quality and pivot output, default parameters.

Everything here works on results of bounded size that other operators have computed.
"""

from __future__ import annotations

import csv
import html
import io
import json
import time
import unicodedata
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregate, profile

PREVIEW_ROWS = 100
LIGHTS = {"green": "\U0001F7E2", "yellow": "\U0001F7E1", "orange": "\U0001F7E0", "red": "\U0001F534"}


@dataclass(frozen=True)
class Provenance:
    """What a result was computed from."""

    visible_rows: int
    total_rows: int
    filters: tuple[str, ...] = ()
    sort: str = ""
    columns: tuple[str, ...] = ()
    parameters: tuple[str, ...] = ()
    scanned_rows: int | None = None
    elapsed_ms: int | None = None

    def lines(self) -> list[str]:
        out = [f"Rows: {self.visible_rows:,} / {self.total_rows:,}", f"View: {'Filtered current view' if self.filters or self.visible_rows < self.total_rows else 'All rows'}"]
        if self.scanned_rows is not None and self.scanned_rows < self.visible_rows:
            out.append(f"Scope: showing first {self.scanned_rows:,} rows")
        if self.filters:
            out.append("Filters: " + " | ".join(self.filters))
        if self.sort:
            out.append(f"Sort: {self.sort}")
        if self.columns:
            out.append("Columns: " + ", ".join(self.columns[:6]) + (", ..." if len(self.columns) > 6 else ""))
        out += self.parameters
        return out if self.elapsed_ms is None else [*out, f"Elapsed: {self.elapsed_ms} ms"]


@dataclass(frozen=True)
class Section:
    """Named rows of text; metrics have two cells a row and no header."""

    title: str
    header: tuple[str, ...]
    rows: tuple[tuple[str, ...], ...]
    truncated: bool = False


def _shown(v) -> str:
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


def table_section(title: str, df: DataFrame, cap: int = PREVIEW_ROWS) -> Section:
    """The first rows of a result; one more is read to see whether there are others."""
    rows = df.limit(cap + 1).collect()
    return Section(title, tuple(df.columns), tuple(tuple(_shown(v) for v in r) for r in rows[:cap]), len(rows) > cap)


def metrics_section(title: str, values: dict) -> Section:
    return Section(title, (), tuple((k, _shown(v)) for k, v in values.items()))


@dataclass(frozen=True)
class Report:
    title: str
    summary: str
    provenance: Provenance
    sections: tuple[Section, ...] = ()

    def timed(self, began: float) -> "Report":
        """With the time since ``began`` (time.perf_counter)."""
        return replace(self, provenance=replace(self.provenance, elapsed_ms=round((time.perf_counter() - began) * 1000)))

    def grid(self) -> list[list[str]]:
        out = [[self.title], [self.summary], *([x] for x in self.provenance.lines())]
        for s in self.sections:
            out += [[], [s.title], *([list(s.header)] if s.header else []), *map(list, s.rows)]
        return out

    def tsv(self) -> str:
        clean = str.maketrans("\t\r\n", "   ")
        return "\n".join("\t".join(c.translate(clean) for c in r) for r in self.grid())

    def csv(self) -> str:
        return _csv(self.grid())

    def markdown(self) -> str:
        def cell(v: str) -> str:
            return v.replace("\\", "\\\\").replace("|", "\\|").replace("\n", "<br>")

        out = [f"# {self.title}", "", self.summary, "", "## Run Details", *(f"- {x}" for x in self.provenance.lines())]
        for s in self.sections:
            out += ["", f"## {s.title}"]
            if s.header:
                out += ["| " + " | ".join(map(cell, r)) + " |" for r in (s.header, ("---",) * len(s.header), *s.rows)]
                out += ["", "_Only the first rows are shown._"] if s.truncated else []
            else:
                out += [f"- {a}: {b}" for a, b in s.rows]
        return "\n".join(out)

    def json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=2, sort_keys=True)


def _csv(rows: list[list[str]]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(c))


def _number(text: str) -> float | None:
    try:
        return float(text.replace(",", ""))
    except ValueError:
        return None


@dataclass(frozen=True)
class PivotGrid:
    """A pivot as shown: text cells that can be sorted, narrowed and written."""

    header: tuple[str, ...]
    rows: tuple[tuple[str, ...], ...]
    title: str = ""

    def sort(self, column: int, ascending: bool = True) -> "PivotGrid":
        """Numbers by value when all cells of the column are numbers, else text; a last row ``Total`` stays last."""
        rows = list(self.rows)
        last = [rows.pop()] if rows and rows[-1][0] == "Total" else []
        cells = [r[column] if column < len(r) else "" for r in rows]
        numbers = [_number(c) for c in cells]
        keys = [_folded(c) for c in cells] if None in numbers else numbers
        order = sorted(range(len(rows)), key=keys.__getitem__, reverse=not ascending)  # stable either way
        return replace(self, rows=tuple([rows[i] for i in order] + last))

    def filter(self, needle: str, column: int | None = None) -> "PivotGrid":
        """Rows that contain the text in one column or any, without case and accents."""
        want = _folded(needle.strip())
        return self if not want else replace(self, rows=tuple(r for r in self.rows if any(want in _folded(c) for c in (r if column is None else r[column:column + 1]))))

    def tsv(self) -> str:
        return "\n".join("\t".join(r) for r in (self.header, *self.rows)) + "\n"

    def csv(self) -> str:
        return _csv([list(self.header), *map(list, self.rows)])


def pivot_grid(cells: list[tuple[str, str, float]], row_title: str = "", totals: bool = True, title: str = "") -> PivotGrid:
    """A long pivot's (row, column, value) as a grid; a missing cell is 0, totals add the shown cells."""
    columns, values = sorted({c for _, c, _ in cells}), {(r, c): v for r, c, v in cells}
    keys = sorted({r for r, _, _ in cells})

    def number(v: float) -> str:
        return f"{v:.0f}" if float(v).is_integer() else f"{v:.3f}"

    def line(label: str, numbers: list[float]) -> tuple[str, ...]:
        return (label, *map(number, [*numbers, sum(numbers)] if totals else numbers))

    body = [[values.get((r, c), 0.0) for c in columns] for r in keys]
    rows = [line(k.replace("\x1f", " | "), b) for k, b in zip(keys, body, strict=True)]
    if totals and body:
        rows.append(line("Total", [sum(x) for x in zip(*body, strict=True)]))
    header = (row_title, *(c.replace("\x1f", " | ") for c in columns), *(("Total",) if totals else ()))
    return PivotGrid(header, tuple(rows), title)


def write_grids(grids: list[PivotGrid], kind: str = "tsv") -> str:
    """One grid per measure; several have a title line each."""
    text = [g.tsv() if kind == "tsv" else g.csv() for g in grids]
    return text[0] if len(grids) == 1 else "\n".join(f"{g.title}\n{t}" for g, t in zip(grids, text, strict=True))


def measures_for(kind: str) -> tuple[str, ...]:
    """Functions offered for a column of a type; count is the default."""
    return aggregate.FUNCTIONS if kind in ("Numeric", "Integer", "Float", "Empty") else ("count", "unique")


@dataclass(frozen=True)
class QualityReport:
    name: str
    score: int
    rows: int
    duplicates: int
    issues: tuple[dict, ...]
    columns: tuple[dict, ...]
    codebook: dict[str, list[tuple[str, int]]] = field(default_factory=dict)

    def json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=2, sort_keys=True, default=str)

    def _parts(self):
        """(heading, lines) for the readable forms."""
        scan = [f"Rows: {self.rows:,}", f"Columns: {len(self.columns)}", *([f"Duplicate rows: {self.duplicates:,}"] if self.duplicates else [])]
        yield "Scan", scan
        yield f"Issues ({len(self.issues)})", [f"[{i['severity']}] {i['kind']} {i['column']}: {i['count']:,}" for i in self.issues] or ["No issues found."]
        if self.codebook:
            yield "Codebook", [f"{c}: " + ", ".join(f"{v} ({n:,})" for v, n in items) for c, items in self.codebook.items()]

    def _table(self) -> list[list[str]]:
        names = ("column", "type", "blank", "sentinel", "distinct_count")
        return [["Column", "Type", "Blank", "Sentinel", "Distinct"], *([str(c.get(n, "")) for n in names] for c in self.columns)]

    def _score(self) -> str:
        return f"{LIGHTS[profile.score_light(self.score)]} Score: {self.score} / 100"

    def markdown(self) -> str:
        out = [f"# Data Quality Report: {self.name}", "", self._score()]
        for heading, lines in self._parts():
            out += ["", f"## {heading}", *(f"- {x}" for x in lines)]
        head, *rows = [[c.replace("|", "\\|") for c in r] for r in self._table()]
        out += ["", "## Column Profiles", *("| " + " | ".join(r) + " |" for r in (head, ["---"] * len(head), *rows))]
        return "\n".join(out) + "\n"

    def html(self) -> str:
        out = [f"<h1>Data Quality Report: {html.escape(self.name)}</h1>", f"<p>{self._score()}</p>"]
        for heading, lines in self._parts():
            out += [f"<h2>{heading}</h2>", "<ul>" + "".join(f"<li>{html.escape(x)}</li>" for x in lines) + "</ul>"]
        rows = ["<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in r) + "</tr>" for r in self._table()]
        return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"></head><body>{''.join(out)}<h2>Column Profiles</h2><table>{''.join(rows)}</table></body></html>\n"


def quality_report(df: DataFrame, columns: list[str], name: str, ragged=None) -> QualityReport:
    """The whole quality profile; what is collected has a few rows per column and up to 20 codebook values."""
    counted = profile.duplicate_row_count(df, columns).first()
    book: dict[str, list[tuple[str, int]]] = {}
    for r in profile.quality_codebook(df, columns).collect():
        book.setdefault(r["column"], []).append((r["value"], r["count"]))
    return QualityReport(name, profile.quality_score(df, columns, ragged).first()["score"], counted["rows"], counted["duplicates"],
                         tuple(r.asDict() for r in profile.quality_issues(df, columns, ragged).collect()),
                         tuple(r.asDict() for r in profile.quality_profile(df, columns).collect()), book)


@dataclass(frozen=True)
class Defaults:
    """Parameters an analysis starts with."""

    date: str | None
    numeric: str | None
    group: str | None
    described: tuple[str, ...]
    pair: tuple[str, str] | None


def default_parameters(df: DataFrame, types: dict[str, str]) -> Defaults:
    """First date, numeric and other column by inferred type; up to six numeric ones; the two most frequent groups."""
    numeric = [c for c, t in types.items() if t.lower() in ("numeric", "integer", "float")]
    dates = [c for c, t in types.items() if t.lower() == "date"]
    others = [c for c in types if c not in numeric]
    group = others[0] if others else None
    top = [r[0] for r in aggregate.distinct_values(df.where(F.coalesce(F.col(group).cast("string"), F.lit("")) != ""), group, 2).collect()] if group else []
    return Defaults(dates[0] if dates else None, numeric[0] if numeric else None, group, tuple(numeric[:6]), (top[0], top[1]) if len(top) == 2 else None)


def filter_choice(kind: str) -> str | None:
    """The filter a column's menu offers: values, a date range, or none (numeric ranges come from facets)."""
    return {"categorical": "values", "date": "range"}.get(kind.lower())
