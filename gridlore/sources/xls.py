"""Legacy spreadsheets (xls, BIFF8 in a compound file) as tables of text, from the public format notes.

Numbers are shown with 15 significant digits, formulas by their stored result, truth values
as true or false, errors as ``*error*``; cells of hidden columns are blank.
"""

from __future__ import annotations

import struct

from pyspark.sql import SparkSession

from .delimited import Table
from .workbooks import ImportLimit, Limits, _Budget, _content, _table

#: Record numbers of the format.
BOF, EOF, BOUNDSHEET, SST, CONTINUE, COLINFO = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0x7D
RK, MULRK, NUMBER, LABEL, LABELSST, BOOLERR, FORMULA, STRING, FILEPASS = 0x27E, 0xBD, 0x203, 0x204, 0xFD, 0x205, 0x06, 0x207, 0x2F
LAST_SECTOR = 0xFFFFFFFA  # numbers from here on mark ends and free space


def compound_stream(data: bytes, names: tuple[str, ...]) -> bytes:
    """The first stream of a compound file with one of the names."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("not a compound file")
    size, mini_size = 1 << struct.unpack("<H", data[30:32])[0], 1 << struct.unpack("<H", data[32:34])[0]
    first_dir, cutoff, first_mini = struct.unpack("<I", data[48:52])[0], *struct.unpack("<2I", data[56:64])
    first_difat, = struct.unpack("<I", data[68:72])

    def sector(n: int) -> bytes:
        return data[(n + 1) * size:(n + 2) * size]

    def words(raw: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[:len(raw) // 4 * 4]))

    tables, seen = words(data[76:512]), set()
    while first_difat < LAST_SECTOR and first_difat not in seen:
        seen.add(first_difat)
        *more, first_difat = words(sector(first_difat))
        tables += more
    fat = [w for n in tables if n < LAST_SECTOR for w in words(sector(n))]

    def chain(n: int, links: list[int], part) -> bytes:
        out, steps = [], 0
        while n < LAST_SECTOR:
            steps += 1
            if n >= len(links) or steps > len(links):
                raise ValueError("damaged sector chain")
            out.append(part(n))
            n = links[n]
        return b"".join(out)

    folder = chain(first_dir, fat, sector)
    root = None
    for at in range(0, len(folder) - 127, 128):
        entry = folder[at:at + 128]
        length = struct.unpack("<H", entry[64:66])[0]
        name = entry[:max(length - 2, 0)].decode("utf-16-le", "replace")
        start, total = struct.unpack("<2I", entry[116:124])
        if entry[66] == 5:
            root = start
        if entry[66] == 2 and name in names:
            if total >= cutoff:
                return chain(start, fat, sector)[:total]
            mini = chain(root, fat, sector) if root is not None else b""
            links = words(chain(first_mini, fat, sector))
            return chain(start, links, lambda n: mini[n * mini_size:(n + 1) * mini_size])[:total]
    raise ValueError("no workbook in the file")


def _records(stream: bytes, at: int = 0):
    while at + 4 <= len(stream):
        kind, size = struct.unpack("<2H", stream[at:at + 4])
        yield kind, stream[at + 4:at + 4 + size]
        at += 4 + size


def _text(raw: bytes, wide: bool) -> str:
    return raw.decode("utf-16-le" if wide else "latin-1", "replace")


def _short_string(raw: bytes) -> str:
    """16-bit length, flags, characters."""
    count, flags = struct.unpack("<HB", raw[:3])
    return _text(raw[3:3 + count * (1 + (flags & 1))], bool(flags & 1))


def shared_strings(parts: list[bytes]) -> list[str]:
    """Strings of the shared table; one may go on in the next record, where its flags are given anew."""
    total = struct.unpack("<I", parts[0][4:8])[0]
    part, at, out = 0, 8, []

    def take(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while len(got) < n:
            if at >= len(parts[part]):
                part, at = part + 1, 0
                if part >= len(parts):
                    raise ValueError("the string table ends too early")
            piece = parts[part][at:at + n - len(got)]
            got += piece
            at += len(piece)
        return got

    while len(out) < total:
        count, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        wide, chars = bool(flags & 1), []
        while count:
            if at >= len(parts[part]):
                part, at = part + 1, 0
                if part >= len(parts):
                    raise ValueError("the string table ends too early")
                wide, at = bool(parts[part][0] & 1), 1
            n = min(count, (len(parts[part]) - at) // (1 + wide))
            if not n:
                raise ValueError("damaged string table")
            chars.append(_text(take(n * (1 + wide)), wide))
            count -= n
        take(4 * runs + extra)
        out.append("".join(chars))
    return out


def rk_number(raw: int) -> float:
    value = float(raw >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<q", (raw & 0xFFFFFFFC) << 32))[0]
    if raw & 2 and raw & 0x80000000:
        value -= 1 << 30
    return value / 100 if raw & 1 else value


def _workbook(data: bytes) -> tuple[bytes, list[tuple[str, int]], list[str]]:
    stream = compound_stream(data, ("Workbook", "Book"))
    sheets, strings, table = [], [], False
    for i, (kind, raw) in enumerate(_records(stream)):
        if i == 0 and (kind != BOF or struct.unpack("<H", raw[:2])[0] != 0x600):
            raise ValueError("only BIFF8 workbooks are read")
        if kind == FILEPASS:
            raise ValueError("the workbook is encrypted")
        if kind == BOUNDSHEET and raw[5] == 0:
            sheets.append((_text(raw[8:8 + raw[6] * (1 + (raw[7] & 1))], bool(raw[7] & 1)), struct.unpack("<I", raw[:4])[0]))
        if kind == SST or (kind == CONTINUE and table):
            strings.append(raw)
        table = kind == SST or (kind == CONTINUE and table)
        if kind == EOF:
            break
    return stream, sheets, shared_strings(strings) if strings else []


def xls_sheets(data: bytes) -> list[str]:
    return [n for n, _ in _workbook(data)[1]]


def _shown(v: float) -> str:
    return f"{v:.15g}"


def _truth(value: int, error: int) -> str:
    return "*error*" if error else "true" if value else "false"


def xls_rows(data: bytes, sheet: str | None = None, limits: Limits = Limits()):
    """Rows of a sheet as lists of text, from its first row; gaps are blank."""
    stream, sheets, strings = _workbook(data)
    start = next((at for n, at in sheets if sheet is None or n == sheet), None)
    if start is None:
        raise KeyError(sheet)
    cells: dict[int, dict[int, str]] = {}
    hidden: set[int] = set()
    waiting, depth = None, 0
    for kind, raw in _records(stream, start):
        if kind == BOF:
            depth += 1
        elif kind == EOF:
            depth -= 1
            if not depth:
                break
        if depth > 1:  # an embedded chart
            continue
        if kind == COLINFO:
            lo, hi, _, _, options = struct.unpack("<5H", raw[:10])
            hidden |= set(range(lo, min(hi, limits.columns) + 1)) if options & 1 else set()
            continue
        if kind == STRING and waiting:
            row, col = waiting
            cells[row][col] = _short_string(raw)
            waiting = None
            continue
        if kind not in (RK, MULRK, NUMBER, LABEL, LABELSST, BOOLERR, FORMULA):
            continue
        row, col = struct.unpack("<2H", raw[:4])
        if kind == MULRK:
            values = [_shown(rk_number(struct.unpack("<I", raw[at + 2:at + 6])[0])) for at in range(4, len(raw) - 2, 6)]
        elif kind == RK:
            values = [_shown(rk_number(struct.unpack("<I", raw[6:10])[0]))]
        elif kind == NUMBER:
            values = [_shown(struct.unpack("<d", raw[6:14])[0])]
        elif kind == LABELSST:
            values = [strings[struct.unpack("<I", raw[6:10])[0]]]
        elif kind == LABEL:
            values = [_short_string(raw[6:])]
        elif kind == BOOLERR:
            values = [_truth(raw[6], raw[7])]
        elif raw[12:14] != b"\xff\xff":
            values = [_shown(struct.unpack("<d", raw[6:14])[0])]
        else:  # a formula without a number: text follows, or a truth value, an error, a blank
            waiting = (row, col) if raw[6] == 0 else None
            values = [_truth(raw[8], raw[6] == 2) if raw[6] in (1, 2) else ""]
        if row >= limits.rows or col + len(values) > limits.columns:
            raise ImportLimit("too many rows or columns")
        cells.setdefault(row, {}).update(zip(range(col, col + len(values)), values))
    budget = _Budget(limits)
    width = max((max(r) for r in cells.values()), default=-1) + 1
    for row in range(max(cells, default=-1) + 1):
        at = cells.get(row, {})
        out = ["" if c in hidden else at.get(c, "") for c in range(width)]
        budget.row(row + 1, out)
        yield out


def open_xls(spark: SparkSession, path: str, sheet: str | None = None, limits: Limits = Limits()) -> Table:
    content = _content(spark, path, limits)
    return _table(spark, path, lambda c: xls_rows(c, sheet, limits), lambda: next(iter(xls_rows(content, sheet, limits)), [""]))
