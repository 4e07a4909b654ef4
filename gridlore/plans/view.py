"""A view: filters, sorting, hidden columns and a row cap over a table, as one lazy plan; saved views."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import filters, search, sorting
from ..operators.filters import DateRange, FilterState, NumericRange, SelectedValues
from ..operators.sorting import SortKey

ANALYSIS_ROWS = 2_000_000


@dataclass(frozen=True)
class View:
    """Immutable; every method gives a new view.  ``base`` has a source row column."""

    base: DataFrame
    row_col: str = "_row"
    state: FilterState = FilterState()
    keys: tuple[SortKey, ...] = ()
    hidden: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    extra: Column | None = None

    def where(self, condition: Column | str) -> "View":
        """Narrow the view by a predicate, keeping its order."""
        new = F.expr(condition) if isinstance(condition, str) else condition
        return replace(self, extra=new if self.extra is None else self.extra & new)

    def filter(self, state: FilterState) -> "View":
        """Filter all rows anew; the sort goes."""
        return replace(self, state=state, keys=(), extra=None)

    def sort(self, *keys: SortKey) -> "View":
        return replace(self, keys=tuple(keys))

    def click(self, column: str, additive: bool = False) -> "View":
        return replace(self, keys=sorting.toggle(self.keys, column, additive))

    def hide(self, *columns: str) -> "View":
        return replace(self, hidden=(*self.hidden, *columns))

    def clear(self) -> "View":
        return replace(self, state=FilterState(), keys=(), extra=None)

    def columns(self) -> list[str]:
        """Visible columns: ordered ones first, then the rest."""
        rest = [c for c in self.base.columns if c not in self.order and c != self.row_col and not c.startswith("_")]
        return [c for c in (*self.order, *rest) if c not in self.hidden]

    def rows(self) -> DataFrame:
        """The view's rows, in source order within Spark's own order."""
        data = self.base.select(*[c for c in self.base.columns if not c.startswith("_")])
        cells = data if data.columns else self.base
        out = self.base.where(self.state.predicate(cells))
        return out.where(self.extra) if self.extra is not None else out

    def ordered(self) -> DataFrame:
        return sorting.sort(self.rows(), list(self.keys), self.row_col)

    def page(self, start: int, size: int) -> DataFrame:
        """Rows start .. start + size - 1 of the ordered view."""
        return self.ordered().offset(start).limit(size)

    def capped(self, cap: int = ANALYSIS_ROWS) -> DataFrame:
        """What analyses read: the first rows of the view, all where there are no more than ``cap``."""
        rows = self.rows()
        return rows if rows.limit(cap + 1).count() <= cap else self.ordered().limit(cap)

    def search(self, text: str, start: int = 0, wrap: bool = True) -> DataFrame:
        placed = sorting.positions(self.rows().select(self.row_col, *self.columns()), sorting.sort_columns(self.rows(), list(self.keys), self.row_col), "__pos")
        return search.find_next(placed.drop(self.row_col), search.parse_search(text), "__pos", start, wrap)


@dataclass(frozen=True)
class SavedView:
    name: str
    text: str = ""
    sorts: tuple[tuple[str, bool], ...] = ()
    hidden: tuple[str, ...] = ()
    search: str = ""
    filters: tuple = ()

    def to_dict(self) -> dict:
        out = asdict(replace(self, filters=()))
        out["filters"] = [{"kind": type(f).__name__, **asdict(f)} for f in self.filters]
        return out

    @staticmethod
    def from_dict(d: dict) -> "SavedView":
        """Filters of an unknown kind are left out."""
        kinds = {k.__name__: k for k in (SelectedValues, DateRange, NumericRange)}
        found = []
        for f in d.get("filters", []):
            kind = kinds.get(f.get("kind"))
            if kind:
                values = {k: tuple(v) if isinstance(v, list) else v for k, v in f.items() if k != "kind"}
                found.append(kind(**values))
        return SavedView(d["name"], d.get("text", ""), tuple((c, bool(a)) for c, a in d.get("sorts", [])), tuple(d.get("hidden", [])), d.get("search", ""), tuple(found))

    def restore(self, base: DataFrame, row_col: str = "_row") -> View:
        """Filters first, then sorts and hidden columns."""
        view = View(base, row_col).filter(FilterState(self.filters, self.text))
        return view.sort(*[SortKey(c, a) for c, a in self.sorts]).hide(*self.hidden)


class ViewStore:
    """Saved views by source path in one JSON file, latest first."""

    def __init__(self, path: str):
        self.path = path

    def _load(self) -> dict[str, list[dict]]:
        if not os.path.exists(self.path):
            return {}
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def _save(self, data: dict) -> None:
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            json.dump(data, f, ensure_ascii=False, indent=1)
        os.replace(f"{self.path}.new", self.path)

    def put(self, source: str, view: SavedView) -> None:
        data = self._load()
        data[source] = [view.to_dict(), *[v for v in data.get(source, []) if v["name"] != view.name]]
        self._save(data)

    def list(self, source: str) -> list[SavedView]:
        return [SavedView.from_dict(v) for v in self._load().get(source, [])]

    def latest(self, source: str) -> SavedView | None:
        return next(iter(self.list(source)), None)

    def delete(self, source: str, name: str | None = None) -> None:
        data = self._load()
        data[source] = [v for v in data.get(source, []) if name is not None and v["name"] != name]
        self._save({k: v for k, v in data.items() if v})
