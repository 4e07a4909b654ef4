"""Delimited text: encoding and delimiter detection, records, headers.

A file is read in Spark's splits, side by side.  One pass counts lines and looks for
quotes.  Without quotes lines are records and are split by Spark itself.  With quotes a
second pass follows each split from both states it may begin in, outside or inside a
quoted field; the driver chains these results, a row per split, so every split's state
and first row number are known.  The third pass parses the splits; the few records
that cross splits are put together from their pieces.  Nothing is shuffled but those.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.running import store

PROBE = 1 << 20
SIDE_PROBE = 1 << 16
DELIMITERS = (",", ";", "\t", "|")
HEADER_LINES = 4
LONG_RECORD = 100
HELD = 1 << 20


class UnsupportedEncoding(ValueError):
    """An encoding that is recognised and can't be read."""


@dataclass
class Table:
    """Rows with ``_row`` (1-based), ``_fields`` and text columns c0..cN; names are for display."""

    df: DataFrame
    names: list[str]
    encoding: str = "utf-8"
    delimiter: str = ","
    warnings: list[str] = field(default_factory=list)
    labels: dict[str, dict[str, str]] = field(default_factory=dict)
    metadata: dict[str, dict] = field(default_factory=dict)

    def column(self, which: int | str) -> str:
        if isinstance(which, int):
            return f"c{which}"
        return f"c{self.names.index(which)}"

    def named(self) -> DataFrame:
        """Columns under display names: empty ones ``Column N``, repeated ones ``name (2)``."""
        return self.df.select("_row", *[F.col(f"c{i}").alias(n) for i, n in enumerate(unique_names(self.names))])


def unique_names(names: list[str]) -> list[str]:
    out, seen = [], {}
    for i, n in enumerate(names):
        base = n or f"Column {i + 1}"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base} ({seen[base]})")
    return out


def read_head(spark: SparkSession, path: str, size: int = PROBE, start: int = 0) -> bytes:
    """The first bytes of a file, or those from ``start`` on, wherever Spark can read it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        stream.seek(start)
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def first_file(spark: SparkSession, path: str) -> str:
    """The path itself, or a folder's first file that isn't hidden: files of a folder are read as one, in name order."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.getFileStatus(target).isDirectory():
        return path
    found = sorted(f.getPath().toString() for f in fs.listStatus(target) if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", ".")))
    if not found:
        raise FileNotFoundError(path)
    return found[0]


def file_size(spark: SparkSession, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).getLen()


def valid_utf8(probe: bytes) -> bool:
    """Whether bytes cut out of a file are UTF-8; a character may be cut at either end."""
    begin = next((i for i in range(min(4, len(probe))) if probe[i] & 0xC0 != 0x80), 0)
    try:
        probe[begin:].decode("utf-8")
    except UnicodeDecodeError as problem:
        return problem.start >= len(probe) - begin - 3 and problem.reason == "unexpected end of data"
    return True


def probe_encoding(spark: SparkSession, path: str) -> str:
    """The encoding by the file's beginning, and by probes in its middle and at its end where the beginning reads as UTF-8."""
    found = detect_encoding(read_head(spark, path))
    size = file_size(spark, path)
    if found != "utf-8" or size <= PROBE:
        return found
    sides = (read_head(spark, path, SIDE_PROBE, max(0, at)) for at in (size // 2, size - SIDE_PROBE))
    return "utf-8" if all(map(valid_utf8, sides)) else "cp949"


def detect_encoding(head: bytes) -> str:
    """utf-8, utf-8-sig or cp949; UTF-16 and UTF-32 are recognised and refused."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    for mark, name in ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if head.startswith(mark):
            raise UnsupportedEncoding(name)
    pairs = len(head) // 2
    if pairs >= 2:
        even, odd = head[0:pairs * 2:2].count(0), head[1:pairs * 2:2].count(0)
        if max(even, odd) * 10 >= pairs * 3 and min(even, odd) * 10 < pairs:
            raise UnsupportedEncoding("utf-16-be" if even > odd else "utf-16-le")
    for cut in range(4):  # the probe may end inside a character
        try:
            head[: len(head) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError as problem:
            if problem.start < len(head) - 4:
                return "cp949"
    return "cp949"


def detect_delimiter(text: str) -> str:
    """The most frequent candidate outside quotes in the first line; the earlier one wins ties."""
    counts = dict.fromkeys(DELIMITERS, 0)
    quoted = False
    for ch in text:
        if ch == '"':
            quoted = not quoted
        elif not quoted and ch in "\r\n":
            break
        elif not quoted and ch in counts:
            counts[ch] += 1
    best = max(DELIMITERS, key=lambda d: counts[d])
    return best if counts[best] else ","


def records(text: str, delimiter: str = ",") -> Iterator[tuple[list[str], int, bool]]:
    """(fields, lines, complete) of each record.

    A quote opens a quoted field only at its start; ``""`` is a quote; line ends inside
    quotes become LF; text after a closing quote is appended.  A blank line is a record
    of one blank field; a final line end adds none.  ``complete`` is False when the text
    ends inside quotes.
    """
    at, size = 0, len(text)
    while at < size:
        fields, lines = [], 1
        while True:
            value: list[str] = []
            ended = True
            if at < size and text[at] == '"':
                at += 1
                ended = False
                while at < size:
                    stop = at
                    while stop < size and text[stop] not in '"\r':
                        stop += 1
                    value.append(text[at:stop])
                    lines += text.count("\n", at, stop)
                    at = stop
                    if at >= size:
                        break
                    if text[at] == "\r":
                        value.append("\n")
                        lines += 1
                        at += 2 if text.startswith("\r\n", at) else 1
                    elif text.startswith('""', at):
                        value.append('"')
                        at += 2
                    else:
                        at += 1
                        ended = True
                        break
            stop = at
            while stop < size and text[stop] != delimiter and text[stop] not in "\r\n":
                stop += 1
            value.append(text[at:stop])
            fields.append("".join(value))
            at = stop
            if at < size and text[at] == delimiter:
                at += 1
                continue
            if at < size:
                at += 2 if text.startswith("\r\n", at) else 1
            break
        yield fields, lines, ended


def read_header(head: str, delimiter: str) -> tuple[list[str], bool]:
    """(names, damaged): a header whose quotes swallow many lines is its first physical line."""
    first = head.splitlines()[0] if head else ""
    fields, lines, _ = next(records(head, delimiter), ([""], 1, True))
    if first.count('"') % 2 and lines - 1 > HEADER_LINES:
        return first.split(delimiter), True
    return fields, False


def open_delimited(spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None, header: bool = True) -> Table:
    """Open a delimited file as a Table; its splits are indexed now, its cells are read when asked for."""
    first = first_file(spark, path)
    encoding = encoding or probe_encoding(spark, first)
    head = read_head(spark, first).decode(encoding, "replace")
    delimiter = delimiter or detect_delimiter(head)
    names, damaged = read_header(head, delimiter)
    if not header:
        names = [""] * len(names)
    warnings = ["the header's quotes are damaged; its first line was used"] if damaged else []
    lines = _lines(spark, path)
    blocks = _line_counts(lines)
    if not blocks:
        rows = spark.createDataFrame([], "_row long, _fields array<string>")
    elif any(b["quoted"] for b in blocks) or encoding not in ("utf-8", "utf-8-sig"):
        rows, problem = _quoted(spark, path, lines, encoding, delimiter, blocks, damaged)
        warnings += [problem] if problem else []
    else:
        rows = _plain(spark, lines, delimiter, blocks)
    if header:
        rows = rows.where("_row > 0")
    else:
        rows = rows.withColumn("_row", F.col("_row") + 1)
    df = rows.select("_row", "_fields", *[F.get("_fields", F.lit(i)).alias(f"c{i}") for i in range(len(names))])
    return Table(df, names, encoding, delimiter, warnings)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, f, b, i): lines with their split's file and first byte, and a number that grows within the split.

    Every pass must meet the splits that the first one counted.  Spark cuts files by settings and by the executors
    there are just then, so the scan belongs to a session of its own that keeps what held when the file was opened.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.files.minPartitionNum", spark.conf.get("spark.sql.files.minPartitionNum", None) or str(spark.sparkContext.defaultParallelism))
    lines = own.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("f"),
                                       F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, lines._jdf.queryExecution().analyzed()), spark)


def _line_counts(lines: DataFrame) -> list:
    """(f, b, n, first, quoted) of every split that has lines, in file order."""
    found = lines.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"), F.max(F.contains("line", F.lit('"'))).alias("quoted"))
    return found.orderBy("f", "b").collect()


def _plain(spark: SparkSession, lines: DataFrame, delimiter: str, blocks: list) -> DataFrame:
    """(_row from 0, _fields) of quote-free files: a line's row follows from its split's first row."""
    start, rows = 0, []
    for r in blocks:
        rows.append((r["f"], r["b"], start - r["first"]))
        start += r["n"]
    base = F.broadcast(spark.createDataFrame(rows, "f string, b long, base long"))  # a row per split
    lines = lines.join(base, ["f", "b"])
    row = F.col("base") + F.col("i")
    bare = F.when(row == 0, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line"))
    return lines.select(row.alias("_row"), F.split(bare, "\\Q" + delimiter + "\\E", -1).alias("_fields"))


class QuoteState:
    """Whether a line leaves a record open: a quote opens a field only at the field's start."""

    def __init__(self, delimiter: str):
        self.closing = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
        self.opening = delimiter + '"'
        self.delimiter = delimiter

    def after(self, line: str, inside: bool) -> bool:
        """The state at the line's end."""
        at = 0
        if not inside:
            at = 0 if line.startswith('"') else self._next(line, 0)
            if at < 0:
                return False
            at += 1
        while True:
            closed = self.closing.match(line, at)
            if not closed:
                return True
            at = self._next(line, closed.end())
            if at < 0:
                return False
            at += 1

    def _next(self, line: str, at: int) -> int:
        """The place of the next quote that opens a field."""
        found = line.find(self.opening, at)
        return found + 1 if found >= 0 else -1


_SPLIT = "f string, b long, out_n long, out_end boolean, out_lines long, out_last long, out_open string, in_n long, in_end boolean, in_lines long, in_last long, in_first long, in_open string, lead string"


def _both_states(path_lines: DataFrame, encoding: str, delimiter: str) -> DataFrame:
    """One row per split: records begun, state at the end, lines of the longest record, and the text of a record left
    open, from either state; ``lead`` is what a split that begins inside gives to the record before it.  Texts of more
    than ``HELD`` characters are null: ``_long_texts`` reads them where they are wanted."""
    names = [c.split()[0] for c in _SPLIT.split(", ")]

    class Way:
        def __init__(self, inside: bool):
            self.inside, self.n, self.lines, self.longest, self.first = inside, 0, 0, 0, None
            self.text: list[str] | None = []
            self.lead: list[str] | None = [] if inside else None
            self.size = 0

        def hold(self, text: str) -> None:
            """Keep a line of the open record, or of the lead, while there are few."""
            leading = self.n == 0
            self.size += len(text) + 1
            if self.size > HELD:
                if leading:
                    self.lead = None
                else:
                    self.text = None
            elif leading and self.lead is not None:
                self.lead.append(text)
            elif not leading and self.text is not None:
                self.text.append(text)

        def wants(self) -> bool:
            return self.inside and (self.lead if self.n == 0 else self.text) is not None

        def plain(self, n: int) -> None:
            """Lines without quotes."""
            if self.inside:
                self.lines += n
            else:
                self.n += n
                self.lines = 1

        def line(self, text: str, state: QuoteState) -> None:
            if not self.inside:
                self.n, self.lines, self.text, self.size = self.n + 1, 0, [], 0
            self.hold(text)
            self.inside = state.after(text, self.inside)
            self.lines += 1
            self._closed()

        def _closed(self) -> None:
            if not self.inside:
                if self.n == 0 and self.first is None:
                    self.first = self.lines
                self.longest = max(self.longest, self.lines)

    def run(batches):
        state = QuoteState(delimiter)
        here, ways, held = None, (), []

        def done():
            out, inn = ways
            opened = ["\n".join(w.text) if w.inside and w.n and w.text is not None else None for w in ways]
            lead = "\n".join(inn.lead) if inn.lead is not None else None
            return (*here, out.n, out.inside, max(out.longest, out.lines), out.lines, opened[0], inn.n, inn.inside, max(inn.longest, inn.lines), inn.lines, inn.first, opened[1], lead)

        for batch in batches:
            raw = batch.column(2)
            marked = pc.match_substring(raw, '"').to_pylist()
            files, starts = batch.column(0), batch.column(1)
            at, size = 0, len(batch)
            while at < size:
                key = (files[at].as_py(), starts[at].as_py())
                stop = at + 1
                while stop < size and starts[stop].as_py() == key[1] and files[stop].as_py() == key[0]:
                    stop += 1
                if key != here:
                    if here is not None:
                        held.append(done())
                    here, ways = key, (Way(False), Way(True))
                for i in range(at, stop):
                    if not marked[i]:
                        text = None
                        for w in ways:
                            if w.wants():
                                text = raw[i].as_py().decode(encoding, "replace") if text is None else text
                                w.hold(text)
                            w.plain(1)
                        continue
                    text = raw[i].as_py().decode(encoding, "replace")
                    for w in ways:
                        w.line(text, state)
                at = stop
        if here is not None:
            held.append(done())
        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held, strict=True), strict=True)) if held else {n: [] for n in names}, schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _SPLIT.split(", ")])
    return path_lines.select("f", "b", F.col("line").cast("binary").alias("line")).mapInArrow(run, _SPLIT)


def _quoted(spark: SparkSession, path: str, lines: DataFrame, encoding: str, delimiter: str, blocks: list, damaged: bool) -> tuple[DataFrame, str | None]:
    """((_row from 0, _fields), warning) of files with quotes or of another encoding."""
    if damaged:  # the header is the first line, whatever its quotes
        lines = lines.where((F.col("b") > 0) | (F.col("i") != blocks[0]["first"]) | (F.col("f") != blocks[0]["f"]))
    states = store(_both_states(lines, encoding, delimiter))
    numbers = states.select("f", "b", "out_n", "out_end", "out_lines", "out_last", "in_n", "in_end", "in_lines", "in_last", "in_first", F.col("lead").isNull().alias("no_lead"),
                            F.col("in_open").isNull().alias("no_in"), F.col("out_open").isNull().alias("no_out")).orderBy("f", "b").collect()
    row, inside, previous, problem, carry = int(damaged), False, None, None, 0
    plan, long = [], []
    for r in numbers:  # a row per split
        if r["f"] != previous:
            if inside:
                problem = "the file ends inside quotes"
            inside, carry = False, 0
        plan.append((r["f"], r["b"], row, inside))
        longest = r["in_lines"] if inside else r["out_lines"]
        if inside:
            longest = max(longest, carry + (r["in_first"] or r["in_last"]))
        if longest > LONG_RECORD and not problem:
            problem = f"a record spans {longest} lines"
        if inside:
            carry = r["in_last"] + (0 if r["in_n"] else carry)
        else:
            carry = r["out_last"]
        begun, ends = (r["in_n"], r["in_end"]) if inside else (r["out_n"], r["out_end"])
        lead_row = row - 1 if inside and r["no_lead"] else None
        open_row = row + begun - 1 if ends and begun and (r["no_in"] if inside else r["no_out"]) else None
        if lead_row is not None or open_row is not None:
            long.append((r["f"], r["b"], inside, lead_row, open_row))
        row += r["in_n"] if inside else r["out_n"]
        inside, previous = (r["in_end"] if inside else r["out_end"]), r["f"]
    if inside:
        problem = "the file ends inside quotes"
    plan_rows = F.broadcast(spark.createDataFrame(plan, "f string, b long, row long, inside boolean"))  # a row per split
    schema = pa.schema([("_row", pa.int64()), ("_fields", pa.list_(pa.string()))])
    parsed = lines.join(plan_rows, ["f", "b"]).select("f", "b", "row", "inside", F.col("line").cast("binary").alias("line"))

    def parse(batches):
        csv.field_size_limit((1 << 31) - 1)
        state = QuoteState(delimiter)
        here, number, inside, skipping, held = None, 0, False, False, []

        def rows(texts):
            for fields in csv.reader(texts, delimiter=delimiter):
                yield fields or [""]

        for batch in batches:
            raw, whole_lines, places = batch.column(4).to_pylist(), [], []
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            first, starts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, line in enumerate(raw):
                if keys[i] != here:
                    here, number, inside, skipping, held = keys[i], first[i], starts[i], starts[i], []
                text = line.decode(encoding, "replace")
                inside = state.after(text, inside) if b'"' in line else inside
                if skipping:  # belongs to a record of an earlier split
                    skipping = inside
                    continue
                held.append(text + "\n")
                if not inside:
                    whole_lines += held
                    places.append(number)
                    number += 1
                    held = []
            if places and places[0] == 0:
                whole_lines[0] = whole_lines[0].removeprefix("\ufeff")
            out = list(rows(whole_lines))
            for lo in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(places[lo:lo + 10_000], pa.int64()), pa.array(out[lo:lo + 10_000], pa.list_(pa.string()))], schema=schema)

    inner = parsed.mapInArrow(parse, "_row long, _fields array<string>")
    # records that cross splits: what the split they begin in leaves open, then the leads of those that follow
    at = states.join(plan_rows, ["f", "b"])
    begun = F.when(F.col("inside"), F.col("in_open")).otherwise(F.col("out_open"))
    begun_n = F.when(F.col("inside"), F.col("in_n")).otherwise(F.col("out_n"))
    pieces = at.select((F.col("row") + begun_n - 1).alias("_row"), "f", "b", begun.alias("text")).where("text IS NOT NULL")
    pieces = pieces.unionByName(at.where("inside AND lead IS NOT NULL").select((F.col("row") - 1).alias("_row"), "f", "b", F.col("lead").alias("text")))
    if long:
        wanted = F.broadcast(spark.createDataFrame(long, "f string, b long, inside boolean, lead_row long, open_row long"))  # a row per split
        pieces = pieces.unionByName(_long_texts(lines.join(wanted, ["f", "b"]), encoding, delimiter))

    def join(key, table):
        table = table.sort_by([("f", "ascending"), ("b", "ascending")])
        fields = next(records("\n".join(table.column("text").to_pylist()).removeprefix("\ufeff" if key[0].as_py() == 0 else ""), delimiter), ([""], 1, True))[0]
        return pa.table({"_row": pa.array([key[0].as_py()], pa.int64()), "_fields": pa.array([fields], pa.list_(pa.string()))}, schema=schema)

    crossing = pieces.groupBy("_row").applyInArrow(join, "_row long, _fields array<string>")
    out = inner.unionByName(crossing)
    if damaged:
        title = read_head(spark, first_file(spark, path)).decode(encoding, "replace").splitlines()[0].split(delimiter)
        out = out.unionByName(spark.createDataFrame([(0, title)], "_row long, _fields array<string>"))
    return out, problem


def _long_texts(lines: DataFrame, encoding: str, delimiter: str) -> DataFrame:
    """(_row, f, b, text) of the lead and the open record of splits, where a row asks for them; such a text is one cell."""
    def run(batches):
        state = QuoteState(delimiter)
        here, inside, leading, lead, opened, rows = None, False, False, None, [], (None, None)

        def done():
            out = [(rows[0], *here, "\n".join(lead or []))] if rows[0] is not None else []
            return out + ([(rows[1], *here, "\n".join(opened))] if rows[1] is not None else [])

        for batch in batches:
            found = []
            for f, b, line, begins, lead_row, open_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (f, b) != here:
                    found += done() if here else []
                    here, inside, leading, lead, opened, rows = (f, b), begins, begins, [], [], (lead_row, open_row)
                text = line.decode(encoding, "replace")
                if leading:
                    lead.append(text)
                else:
                    opened = opened if inside else []
                    opened.append(text)
                inside = state.after(text, inside) if b'"' in line else inside
                leading = leading and inside
            yield batch_of(found)
        yield batch_of(done() if here else [])

    schema = pa.schema([("_row", pa.int64()), ("f", pa.string()), ("b", pa.int64()), ("text", pa.string())])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema.types, strict=True)], schema=schema)

    return lines.select("f", "b", F.col("line").cast("binary").alias("line"), "inside", "lead_row", "open_row").mapInArrow(run, "_row long, f string, b long, text string")


def quote_damage(text: str, delimiter: str = ",") -> str | None:
    """A warning where quotes look damaged: the text ends inside quotes, or a record is very long."""
    for fields, lines, complete in records(text, delimiter):
        if not complete:
            return "the file ends inside quotes"
        if lines > LONG_RECORD:
            return f"a record spans {lines} lines"
    return None


def ragged(table: Table):
    """Predicate: a row whose field count is not the header's."""
    return F.size("_fields") != len(table.names)


def open_text(spark: SparkSession, text: str) -> Table:
    """Pasted text as a table."""
    delimiter = detect_delimiter(text)
    rows = [f for f, _, _ in records(text, delimiter)]
    names = rows[0] if rows else [""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows[1:], 1)], "_row long, _fields array<string>")
    return Table(df.select("_row", "_fields", *[F.get("_fields", F.lit(i)).alias(f"c{i}") for i in range(len(names))]), names, "utf-8", delimiter)


def with_labels(column: str, labels: dict[str, str]):
    """A column's value labels where it has them; filters still see the raw values."""
    if not labels:
        return F.col(column)
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(table, F.col(column)), F.col(column))
