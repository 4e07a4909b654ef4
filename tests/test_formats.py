"""System files, legacy spreadsheets, pasted paths and reports."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from gridlore.operators import report as R
from gridlore.operators.profile import column_statistics
from gridlore.sources import delimited as D
from gridlore.sources import formats, spss, xls
from gridlore.sources.workbooks import ImportLimit, Limits


def system_file(compression=0, order="<"):
    """age (missing 99; labels), name (string of 5), long (string of 300 in two segments)."""
    def i(*v):
        return struct.pack(f"{order}{len(v)}i", *v)

    def d(v):
        return struct.pack(f"{order}d", v)

    def var(kind, name, label=b"", missing=(), shown=0x050802):
        out = i(2, kind, int(bool(label)), len(missing), shown, shown) + name.ljust(8)
        if label:
            out += i(len(label)) + label.ljust((len(label) + 3) // 4 * 4)
        return out + b"".join(map(d, missing))

    cont = i(2, -1, 0, 0, 0, 0) + b" " * 8
    head = (b"$FL3" if compression == 2 else b"$FL2") + b"test".ljust(60) + i(2, 1 + 1 + 32 + 6, compression, 0, 3) + d(100.0) + b" " * 84
    body = var(0, b"AGE", "나이".encode(), (99.0,)) + var(5, b"NAME") + var(255, b"LONG") + cont * 31 + var(48, b"LONG0") + cont * 5
    body += i(3, 2) + d(1.0) + bytes([3]) + b"one".ljust(7) + d(2.5) + bytes([9]) + b"two point".ljust(15) + i(4, 1, 1)
    for subtype, raw in ((13, b"AGE=Age in years\tNAME=Name"), (14, b"LONG=00300\0\t"), (20, b"UTF-8")):
        body += i(7, subtype, 1, len(raw)) + raw
    body += i(7, 11, 4, 12) + i(2, 8, 1, 1, 8, 0, 1, 8, 0, 1, 8, 0) + i(999, 0)
    text = "".join(chr(97 + n % 26) for n in range(300)).encode()
    cases = []
    for age, name in ((1.0, b"Ann"), (99.0, b""), (spss.SYSMIS, "é".encode())):
        long = text[:255].ljust(256) + text[255:].ljust(48)
        cases.append([d(age), name.ljust(8), *[long[k:k + 8] for k in range(0, len(long), 8)]])
    if not compression:
        return head + body + b"".join(b"".join(c) for c in cases)
    units, stream = [u for c in cases for u in c], b""
    codes = [(255, b"") if u == d(spss.SYSMIS) else (254, b"") if u == b" " * 8 else (101, b"") if u == d(1.0) else (253, u) for u in units]
    codes += [(252, b"")]
    for k in range(0, len(codes), 8):
        part = codes[k:k + 8]
        stream += bytes(c for c, _ in part).ljust(8, b"\0") + b"".join(x for _, x in part)
    if compression == 1:
        return head + body + stream
    at = len(head + body)
    half = len(stream) // 2
    packed = [zlib.compress(stream[:half]), zlib.compress(stream[half:])]
    trailer = struct.pack(f"{order}2q2i", -100, 0, 0x3FF000, 2)
    where = at + 24
    for raw, p in ((stream[:half], packed[0]), (stream[half:], packed[1])):
        trailer += struct.pack(f"{order}2q2i", 0, where, len(raw), len(p))
        where += len(p)
    return head + body + struct.pack(f"{order}3q", at, where, len(trailer)) + b"".join(packed) + trailer


@pytest.mark.parametrize(("compression", "order"), [(0, "<"), (1, "<"), (2, "<"), (0, ">"), (1, ">")])
def test_system_file(compression, order):
    data = system_file(compression, order)
    names, *rows = spss.sav_rows(data)
    assert names == ["Age in years", "Name", "LONG"]
    text = "".join(chr(97 + n % 26) for n in range(300))
    assert rows == [["1", "Ann", text], ["", "", text], ["", "é", text]]
    age, name, _ = spss.read_dictionary(data).variables
    assert age.labels == {"1": "one", "2.5": "two point"}
    assert (age.label, age.declared_type, name.declared_type) == ("나이", "ordinal", "categorical")
    with pytest.raises(ImportLimit):
        list(spss.sav_rows(data, Limits(rows=2)))
    with pytest.raises(ValueError):
        list(spss.sav_rows(data[:150]))


def legacy_workbook():
    """Two sheets; the first holds every kind of cell and a hidden column."""
    def rec(kind, raw=b""):
        return struct.pack("<2H", kind, len(raw)) + raw

    def cell(row, col):
        return struct.pack("<3H", row, col, 0)

    def sheets(a, b):
        return b"".join(rec(xls.BOUNDSHEET, struct.pack("<IBB", at, 0, 0) + bytes([len(n), 0]) + n.encode()) for at, n in ((a, "First"), (b, "Second")))

    table = struct.pack("<2I", 3, 3) + struct.pack("<HB", 4, 0) + b"name" + struct.pack("<HB", 2, 1) + "값é".encode("utf-16-le") + struct.pack("<HB", 6, 0) + b"abc"
    strings = rec(xls.SST, table) + rec(xls.CONTINUE, b"\1" + "def".encode("utf-16-le"))
    bof = rec(xls.BOF, struct.pack("<2H", 0x600, 5) + b"\0" * 12)
    first = bof + rec(xls.COLINFO, struct.pack("<6H", 7, 7, 0, 0, 1, 0))
    for c in range(3):
        first += rec(xls.LABELSST, cell(0, c) + struct.pack("<I", c))
    first += rec(xls.NUMBER, cell(2, 0) + struct.pack("<d", 0.1)) + rec(xls.RK, cell(2, 1) + struct.pack("<I", 12345 << 2 | 3))
    first += rec(xls.MULRK, struct.pack("<2H", 2, 2) + b"".join(struct.pack("<HI", 0, (v << 2 | 2) & 0xFFFFFFFF) for v in (7, -8)) + struct.pack("<H", 3))
    first += rec(xls.BOOLERR, cell(2, 4) + b"\1\0") + rec(xls.BOOLERR, cell(2, 5) + b"\7\1")
    first += rec(xls.FORMULA, cell(2, 6) + b"\0\0\0\0\0\0\xff\xff" + b"\0" * 8) + rec(xls.STRING, struct.pack("<HB", 2, 0) + b"ok")
    first += rec(xls.NUMBER, cell(2, 7) + struct.pack("<d", 5.0)) + rec(xls.EOF)
    second = bof + rec(xls.NUMBER, cell(0, 0) + struct.pack("<d", 1e20)) + rec(xls.EOF)
    size = len(bof + sheets(0, 0) + strings + rec(xls.EOF))
    book = (bof + sheets(size, size + len(first)) + strings + rec(xls.EOF) + first + second).ljust(4608, b"\0")

    def entry(name, kind, start, total):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, *[0xFFFFFFFF] * 3) + b"\0" * 36 + struct.pack("<3I", start, total, 0)

    n = len(book) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, 2 + n), 0xFFFFFFFE]
    folder = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(book))).ljust(512, b"\0")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<6I", 1, 1, 0, 4096, 0xFFFFFFFE, 0) + struct.pack("<2I", 0xFFFFFFFE, 0) + struct.pack("<I", 0)
    return head.ljust(512, b"\xff") + struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat))) + folder + book


def test_legacy_spreadsheet():
    data = legacy_workbook()
    assert xls.xls_sheets(data) == ["First", "Second"]
    head, blank, cells = xls.xls_rows(data)
    assert head == ["name", "값é", "abcdef", "", "", "", "", ""] and blank == [""] * 8
    assert cells == ["0.1", "123.45", "7", "-8", "true", "*error*", "ok", ""]
    assert list(xls.xls_rows(data, "Second")) == [["1e+20"]]
    with pytest.raises(KeyError):
        list(xls.xls_rows(data, "Third"))
    with pytest.raises(ImportLimit):
        list(xls.xls_rows(data, limits=Limits(columns=3)))
    with pytest.raises(ValueError):
        xls.xls_sheets(data[:700])


def test_open_by_kind(spark, tmp_path):
    sav, book, text = tmp_path / "a.sav", tmp_path / "b.xls", tmp_path / "c.csv"
    sav.write_bytes(system_file(1))
    book.write_bytes(legacy_workbook())
    text.write_text("x,y\n1,2\n")
    t = formats.open_any(spark, f"file://{sav}")
    assert [r.c1 for r in t.df.orderBy("_row").collect()] == ["Ann", "", "é"]
    assert t.labels["Age in years"]["1"] == "one" and t.metadata["Name"]["declared_type"] == "categorical"
    assert [r.c4 for r in formats.open_any(spark, f"file://{book}").df.orderBy("_row").collect()] == ["", "true"]
    assert formats.open_pasted(spark, f" {text} ").names == ["x", "y"]
    assert formats.open_pasted(spark, f"file://{text}").df.count() == 1
    assert formats.open_pasted(spark, "p;q\n1;2\n3;4").df.count() == 2
    assert formats.route("x.bin", b"\0" * 12 + formats.SAS_MAGIC) == "sas7bdat"


def test_pivot_grid():
    g = R.pivot_grid([("a", "x", 10.0), ("B", "x", 9.0), ("B", "y", 0.5), ("é", "y", 2.0)], "key")
    assert g.header == ("key", "x", "y", "Total")
    assert g.rows[-1] == ("Total", "19", "2.500", "21.500")
    assert [r[0] for r in g.sort(1).rows] == ["é", "B", "a", "Total"]
    assert [r[0] for r in g.sort(0, False).rows] == ["é", "B", "a", "Total"]
    assert [r[0] for r in g.filter("E").rows] == ["é"]
    assert g.filter(" b ", 0).rows == (("B", "9", "0.500", "9.500"),)
    assert R.write_grids([g]) == g.tsv()
    assert R.write_grids([R.pivot_grid([("a,b", "x", 1.0)], title="sum", totals=False)] * 2, "csv").count("sum\n") == 2
    assert R.pivot_grid([]).rows == ()


def test_reports(spark):
    df = spark.createDataFrame([(i, f"g{i % 2}|", str(i) if i < 8 else "", "2024-01-0" + str(1 + i % 9)) for i in range(12)], "_row long, g string, n string, d string")
    prov = R.Provenance(12, 20, ("g in \"a\"",), "n ascending", tuple("abcdefg"), scanned_rows=5)
    assert prov.lines()[:3] == ["Rows: 12 / 20", "View: Filtered current view", "Scope: showing first 5 rows"]
    section = R.table_section("Groups", df.select("g", "n").orderBy("_row"), 3)
    assert section.truncated and section.rows[0] == ("g0|", "0")
    rep = R.Report("T", "s", prov, (R.metrics_section("M", {"mean": 1 / 3}), section))
    assert "- mean: 0.333333" in rep.markdown() and "| g0\\| | 0 |" in rep.markdown()
    assert "g\tn" in rep.tsv().split("\n") and "g,n" in rep.csv().split("\n")
    assert '"total_rows": 20' in rep.json()
    q = R.quality_report(df, ["g", "n", "d"], "f<x>")
    assert q.rows == 12 and q.codebook["g"] == [("g0|", 6), ("g1|", 6)]
    assert "| g |" in q.markdown() and "f&lt;x&gt;" in q.html() and '"score"' in q.json()
    types = {r["column"]: r["type"] for r in column_statistics(df, ["g", "n", "d"]).collect()}
    got = R.default_parameters(df.select("g", "n", "d"), types)
    assert got.numeric == "n" and got.date == "d" and got.group == "g" and got.pair == ("g0|", "g1|")
    assert R.measures_for("Text") == ("count", "unique") and R.filter_choice("Date") == "range"
    assert R.quality_report(df.where(F.lit(False)), ["g"], "none").score == 100


def as_records(text, delimiter=","):
    return [f for f, _, _ in D.records(text.replace("\r\n", "\n").replace("\r", "\n"), delimiter)]


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def read_rows(t):
    rows = sorted((r["_row"], list(r["_fields"])) for r in t.df.select("_row", "_fields").collect())
    assert [n for n, _ in rows] == list(range(1, len(rows) + 1))
    return [f for _, f in rows]


@pytest.mark.parametrize("held", [1 << 20, 10])
def test_quotes_over_splits(spark, tmp_path, small_splits, monkeypatch, held):
    """Quoted fields that cross one or many splits, from either state, against the record parser."""
    monkeypatch.setattr(D, "HELD", held)
    rng = random.Random(21)
    for k in (0, 3, 5):
        parts = ["h1,h2,h3"]
        for _ in range(40):
            cells = []
            for _ in range(rng.randint(1, 3)):
                plain = "".join(rng.choice("ab \"x") for _ in range(rng.randint(0, 6))).lstrip('"')
                inner = "".join(rng.choice(["a", "b,", "\n", '""', "c", "\r\n"]) for _ in range(rng.randint(0, 120 if rng.random() < 0.1 else 6)))
                cells.append(rng.choice([plain, f'"{inner}"', f'"{inner}"tail', ""]))
            parts.append(",".join(cells))
        text = "\n".join(parts) + ('\n"never closed\nto the end' if k == 5 else "\n")
        path = tmp_path / f"q{k}.csv"
        path.write_bytes(text.encode())
        t = D.open_delimited(spark, str(path))
        assert read_rows(t) == as_records(text)[1:]
        assert bool(t.warnings) == (k == 5)


def test_late_quote_and_encoding(spark, tmp_path):
    """What the first bytes don't show: a quote, and another encoding."""
    lines = ["id,a,b", *(f"{i},plain text of some length,more" for i in range(60_000))]
    quoted = "\n".join([*lines, '900001,"x,y",z', '900002,"line1\nline2",z']) + "\n"
    (tmp_path / "late.csv").write_text(quoted)
    t = D.open_delimited(spark, f"{tmp_path}/late.csv")
    got = {r["c0"]: r["c1"] for r in t.df.where("_row > 60000").collect()}
    assert t.df.count() == 60_002 and got == {"900001": "x,y", "900002": "line1\nline2"} and t.warnings == []
    (tmp_path / "late949.csv").write_bytes(("\n".join(lines) + "\n900001,한국어,z\n").encode("cp949"))
    t = D.open_delimited(spark, f"{tmp_path}/late949.csv")
    assert t.encoding == "cp949" and t.df.where("c0 = '900001'").first()["c1"] == "한국어" and t.df.count() == 60_001
    (tmp_path / "late8.csv").write_text("\n".join(lines) + "\n900001,한국어,z\n")
    assert D.open_delimited(spark, f"{tmp_path}/late8.csv").encoding == "utf-8"


def test_quote_warnings(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text('name,note\nAlice,"never closed\nmore\nlines\n')
    assert D.open_delimited(spark, str(path)).warnings == ["the file ends inside quotes"]
    path.write_text('name,note\nAlice,"oops\n' + "".join(f"row{i},x\n" for i in range(150)) + 'closed"\nBob,ok\n')
    t = D.open_delimited(spark, str(path))
    assert "spans" in t.warnings[0] and t.df.count() == 2
    path.write_text('name,note\n"A ""b""",x\n5" pipe,y\n')
    t = D.open_delimited(spark, str(path))
    assert t.warnings == [] and read_rows(t) == [['A "b"', "x"], ['5" pipe', "y"]]


@pytest.mark.parametrize("cell", ["b", '"b, c"'])
def test_splits_stay_as_opened(spark, tmp_path, cell):
    (tmp_path / "t.csv").write_text("k,v\n" + "".join(f"{i},{cell}\n" for i in range(20_000)))
    t = D.open_delimited(spark, str(tmp_path / "t.csv"))
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # as executors that come and go cut files anew
        assert t.df.agg(F.count("*"), F.max("_row"), F.count_if(F.col("_row") == F.col("c0").cast("long") + 1)).first() == (20_000, 20_000, 20_000)
        cut = D.open_delimited(spark, str(tmp_path / "t.csv"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    assert cut.df.agg(F.count("*"), F.count_if(F.col("_row") == F.col("c0").cast("long") + 1)).first() == (20_000, 20_000)
