"""SPSS system files (sav, zsav) as tables of text with labels, written from the public format notes.

A value is blank when it is system-missing or declared missing.  Numbers are shown
with 15 significant digits; trailing blanks of strings go.
"""

from __future__ import annotations

import codecs
import struct
import sys
import zlib
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .delimited import Table
from .workbooks import ImportLimit, Limits, _Budget, _content, _table

SYSMIS = -sys.float_info.max
#: Stored bytes of each segment of a string longer than 255 bytes, and bytes its width counts.
SEGMENT, COUNTED = 255, 252


@dataclass
class Variable:
    """One column; ``slot`` is its first 8-byte unit in a case."""

    short: str
    width: int
    slot: int
    label: str = ""
    format: int = 0
    missing: tuple = ()
    missing_range: tuple | None = None
    measure: int = 0
    name: str = ""
    total: int = 0
    labels: dict[str, str] = field(default_factory=dict)

    @property
    def declared_type(self) -> str:
        #: Print formats DOLLAR 4, PCT 31, E 17, CCA to CCE 32 to 36.
        if self.format == 4:
            return "currency"
        if self.format == 31:
            return "percent"
        if self.format == 17:
            return "scientific"
        if self.measure in (1, 2):
            return ("categorical", "ordinal")[self.measure - 1]
        return "categorical" if self.width else "float"


@dataclass
class SystemFile:
    variables: list[Variable]
    encoding: str
    rows: int
    start: int
    slots: int
    compression: int
    bias: float
    order: str


def number_text(v: float) -> str:
    return f"{v:.15g}"


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.order = data, 0, "<"

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the file ends too early")
        self.at += n
        return self.data[self.at - n:self.at]

    def ints(self, n: int = 1):
        out = struct.unpack(f"{self.order}{n}i", self.take(4 * n))
        return out[0] if n == 1 else out

    def double(self) -> float:
        return struct.unpack(f"{self.order}d", self.take(8))[0]


def _codec(name: str) -> str:
    try:
        return codecs.lookup(name).name
    except LookupError:
        return "utf-8"


def read_dictionary(data: bytes) -> SystemFile:
    """Variables, labels and where the cases begin."""
    r = _Reader(data)
    if r.take(4) not in (b"$FL2", b"$FL3"):
        raise ValueError("not a system file")
    r.take(60)
    if struct.unpack("<i", data[64:68])[0] not in (2, 3):
        r.order = ">"
    r.ints()
    _, compression, _, cases = r.ints(4)
    bias = r.double()
    r.take(84)
    found: list[Variable] = []
    raw_names: list[bytes] = []
    raw_labels: list[bytes] = []
    slots, sets, extensions = 0, [], {}
    pending: list[tuple[bytes, bytes]] = []
    while True:
        kind = r.ints()
        if kind == 2:
            width, has_label, n_missing, shown, _ = r.ints(5)
            name = r.take(8).rstrip(b" \0")
            label = b""
            if has_label:
                size = r.ints()
                label = r.take((size + 3) // 4 * 4)[:size]
            values = [r.take(8) for _ in range(abs(n_missing))]
            if width >= 0:
                v = Variable("", width, slots, format=shown >> 16 & 0xFF)
                if not width:
                    numbers = [struct.unpack(f"{r.order}d", x)[0] for x in values]
                    if n_missing < 0:
                        v.missing_range, numbers = (numbers[0], numbers[1]), numbers[2:]
                    v.missing = tuple(numbers)
                else:
                    v.missing = tuple(x.rstrip(b" ") for x in values)
                found.append(v)
                raw_names.append(name)
                raw_labels.append(label)
            slots += 1
        elif kind == 3:
            pending = []
            for _ in range(r.ints()):
                value, size = r.take(8), r.take(1)[0]
                pending.append((value, r.take((size + 8) // 8 * 8 - 1)[:size]))
        elif kind == 4:
            count = r.ints()
            sets.append((pending, [r.ints() for _ in range(count)]))
        elif kind == 6:
            r.take(80 * r.ints())
        elif kind == 7:
            subtype, size, count = r.ints(3)
            extensions[subtype] = (size, count, r.take(size * count))
        elif kind == 999:
            r.ints()
            break
        else:
            raise ValueError(f"unknown record {kind}")

    encoding = "utf-8"
    if 20 in extensions:
        encoding = _codec(extensions[20][2].decode("ascii", "replace").strip())
    elif 3 in extensions and len(extensions[3][2]) >= 32:
        code = struct.unpack(f"{r.order}8i", extensions[3][2][:32])[7]
        encoding = _codec({65001: "utf-8", 949: "cp949", 2: "latin-1", 3: "latin-1"}.get(code, f"cp{code}"))

    def text(b: bytes) -> str:
        return b.decode(encoding, "replace")

    for v, name, label in zip(found, raw_names, raw_labels, strict=True):
        v.short, v.name, v.label, v.total = text(name), text(name), text(label), v.width
    by_short = {v.short.upper(): v for v in found}
    if 11 in extensions and found:
        size, count, raw = extensions[11]
        each = count // len(found)
        if size == 4 and each in (2, 3):
            shown = struct.unpack(f"{r.order}{count}i", raw)
            for i, v in enumerate(found):
                v.measure = shown[i * each]

    def pairs(subtype: int):
        for item in text(extensions[subtype][2]).split("\t") if subtype in extensions else ():
            key, eq, value = item.partition("=")
            if eq and key.upper() in by_short:
                yield by_short[key.upper()], value.rstrip("\0")

    for v, value in pairs(14):
        v.total = int(value)
    for v, value in pairs(13):
        v.name = value
    by_slot = {v.slot: v for v in found}
    for labels, targets in sets:
        for slot in targets:
            v = by_slot.get(slot - 1)
            for value, label in labels if v else ():
                key = text(value[:v.width].rstrip(b" ")) if v.width else number_text(struct.unpack(f"{r.order}d", value)[0])
                v.labels[key] = text(label)
    if 21 in extensions:
        long = _Reader(extensions[21][2])
        long.order = r.order
        by_name = {v.name.upper(): v for v in found} | by_short
        while long.at < len(long.data):
            v = by_name.get(text(long.take(long.ints())).upper())
            _, count = long.ints(2)
            for _ in range(count):
                key, label = text(long.take(long.ints()).rstrip(b" ")), text(long.take(long.ints()))
                if v:
                    v.labels[key] = label
    kept, skip = [], 0
    for v in found:
        if skip:  # the later segments of a long string
            skip -= 1
            continue
        skip = (v.total + COUNTED - 1) // COUNTED - 1 if v.total > SEGMENT else 0
        kept.append(v)
    return SystemFile(kept, encoding, cases, r.at, slots, compression, bias, r.order)


def _inflated(data: bytes, start: int, order: str, limits: Limits):
    """The command stream of a zsav file, a block at a time."""
    _, trailer, _ = struct.unpack(f"{order}3q", data[start:start + 24])
    blocks = struct.unpack(f"{order}i", data[trailer + 20:trailer + 24])[0]
    total = 0
    for i in range(blocks):
        _, at, plain, packed = struct.unpack(f"{order}2q2i", data[trailer + 24 + 24 * i:trailer + 48 + 24 * i])
        total += plain
        if plain <= 0 or total > limits.inflated_bytes:
            raise ImportLimit("the file is too large when inflated")
        yield zlib.decompressobj().decompress(data[at:at + packed], plain)


def _units(data: bytes, book: SystemFile, limits: Limits):
    """8-byte units of all cases; None for system-missing."""
    if book.compression == 0:
        for at in range(book.start, len(data) - 7, 8):
            yield data[at:at + 8]
        return
    stream = b"".join(_inflated(data, book.start, book.order, limits)) if book.compression == 2 else data
    at = 0 if book.compression == 2 else book.start
    while at + 8 <= len(stream):
        commands = stream[at:at + 8]
        at += 8
        for c in commands:
            if c == 0:
                continue
            if c == 252:
                return
            if c == 253:
                if at + 8 > len(stream):
                    raise ValueError("the file ends too early")
                yield stream[at:at + 8]
                at += 8
            elif c == 254:
                yield b" " * 8
            elif c == 255:
                yield None
            else:
                yield struct.pack(f"{book.order}d", c - book.bias)


def _cell(v: Variable, units: list, book: SystemFile) -> str:
    if not v.width:
        raw = units[v.slot]
        x = SYSMIS if raw is None else struct.unpack(f"{book.order}d", raw)[0]
        span = v.missing_range
        if x == SYSMIS or x != x or x in v.missing or (span and span[0] <= x <= span[1]):
            return ""
        return number_text(x)
    if v.total <= SEGMENT:
        raw = b"".join(u or b" " * 8 for u in units[v.slot:v.slot + (v.width + 7) // 8])[:v.width]
    else:
        parts, slot, count = [], v.slot, (v.total + COUNTED - 1) // COUNTED
        for i in range(count):
            width = SEGMENT if i < count - 1 else v.total - (count - 1) * COUNTED
            size = (width + 7) // 8
            parts.append(b"".join(u or b" " * 8 for u in units[slot:slot + size])[:width])
            slot += size
        raw = b"".join(parts)[:v.total]
    raw = raw.rstrip(b" ")
    return "" if raw in v.missing else raw.decode(book.encoding, "replace")


def sav_rows(data: bytes, limits: Limits = Limits(rows=1_000_000)):
    """Names, then rows as text."""
    book, budget = read_dictionary(data), _Budget(limits)
    if book.rows > limits.rows or len(book.variables) > limits.columns:
        raise ImportLimit("too many rows or columns")
    yield [v.name for v in book.variables]
    units, number = [], 0
    for u in _units(data, book, limits) if book.slots else ():
        units.append(u)
        if len(units) == book.slots:
            number += 1
            cells = [_cell(v, units, book) for v in book.variables]
            budget.row(number, cells)
            yield cells
            units = []
            if number == book.rows:
                return


def open_sav(spark: SparkSession, path: str, limits: Limits = Limits(rows=1_000_000)) -> Table:
    """A system file; value labels by column name are in ``labels``, declared types and variable labels in ``metadata``."""
    book = read_dictionary(_content(spark, path, limits))
    table = _table(spark, path, lambda c: sav_rows(c, limits), lambda: [v.name for v in book.variables])
    table.encoding = book.encoding
    table.labels = {v.name: v.labels for v in book.variables if v.labels}
    table.metadata = {v.name: {"label": v.label or None, "declared_type": v.declared_type} for v in book.variables}
    return table
