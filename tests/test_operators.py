"""Operators on small inline tables."""

import json
import math
import sqlite3
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from gridlore.functions import scalars as S
from gridlore.functions import tails
from gridlore.operators import aggregate as A
from gridlore.operators import charts as C
from gridlore.operators import filters as FI
from gridlore.operators import profile as P
from gridlore.operators import search as SE
from gridlore.operators import sorting as SO
from gridlore.operators import stats as T
from gridlore.plans.view import SavedView, View, ViewStore
from gridlore.sources import delimited as D
from gridlore.sources import export, formats, workbooks

A10 = [12.4, 15.9, 11.2, 19.7, 14.1, 16.3, 13.8, 18.2, 15.1, 10.6]
B8 = [21.5, 24.9, 20.3, 22.8, 26.1, 23.7, 19.4, 25.2]
C6 = [17.3, 16.8, 18.9, 20.1, 15.7, 19.6]


def frame(spark, names, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], ", ".join(["_row long", *[f"{n} string" for n in names]]))


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, *values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


@pytest.mark.parametrize("style, text, want", [
    ("us", "1,234.56", 1234.56), ("european", "1.234,56", 1234.56), ("european", "1,5", 1.5), ("european", "1,2,3", None), ("plain", "1,234", None),
    ("plain", "1d", None), ("plain", " .5 ", 0.5), ("plain", "1e3", 1000.0), ("plain", "", None), ("plain", "inf", math.inf)])
def test_numbers(spark, style, text, want):
    assert rows(one(spark, text).select(S.parse_number(F.col("v"), style))) == [(want,)]


@pytest.mark.parametrize("text, day_first, want", [
    ("2026-01-02", False, "2026-01-02"), ("2026.01.02", False, "2026-01-02"), ("2026년 1월 15일", False, "2026-01-15"), ("20260131", False, "2026-01-31"),
    ("03/04/2020", False, "2020-03-04"), ("03/04/2020", True, "2020-04-03"), ("25/12/2020", False, "2020-12-25"), ("2026-02-30", False, None), ("12", False, None),
    ("20260131235959", False, "2026-01-31"), ("hello-world", False, None)])
def test_dates(spark, text, day_first, want):
    got = one(spark, text).select(F.date_format(S.parse_date(F.col("v"), day_first), "yyyy-MM-dd"))
    assert rows(got) == [(want,)]


def test_week_label(spark):
    df = one(spark, "2025-12-27", "2025-12-28", "2026-01-04").select(S.date_label(S.parse_date(F.col("v")), "week"))
    assert rows(df) == [("2025-W52",), ("2026-W01",), ("2026-W02",)]


def test_group_by(spark):
    df = frame(spark, ["site", "arm", "value"], [("A", "T", "10"), ("A", "T", "20"), ("A", "C", "30"), ("B", "T", "5")])
    got = A.group_by(df.where(FI.contains(df, "t", "arm")), ["site"], "value")
    assert rows(got) == [("A", 2, 30.0, 15.0, 15.0, 10.0, 20.0, 2, 5.0), ("B", 1, 5.0, 5.0, 5.0, 5.0, 5.0, 1, 0.0)]
    empty = frame(spark, ["g", "v"], [("x", "none"), ("x", "")])
    assert rows(A.group_by(empty, ["g"], "v", ("count", "sum", "mean", "std", "unique"))) == [("x", 2, 0.0, 0.0, 0.0, 2)]


def test_duplicates(spark):
    df = frame(spark, ["p", "d"], [("P1", "1"), ("P1", "1"), ("P2", "1"), ("P2", "2")])
    assert rows(A.duplicate_groups(df, ["p", "d"], "_row")) == [("P1", "1", 2, 1, [1, 2])]
    assert sorted(rows(A.duplicate_rows(df, ["p", "d"], "_row").select("row", "count"))) == [(1, 2), (2, 2)]
    same = frame(spark, ["a", "b"], [("1", "x"), ("2", "y"), ("1", "x"), ("1", "x")])
    assert rows(P.duplicate_row_count(same, ["a", "b"])) == [(4, 2)]


def test_distribution(spark):
    df = frame(spark, ["v"], [(str(i),) for i in range(1, 6)])
    assert [r[3] for r in rows(A.histogram(df, "v", 2))] == [2, 3]
    got = A.numeric_summary(df, "v").first()
    assert (got["q1"], got["median"], got["q3"]) == (2.0, 3.0, 4.0)
    wild = A.numeric_summary(frame(spark, ["v"], [("1",), ("2",), ("inf",), ("3",), ("4",)]), "v").first()
    assert (wild["count"], wild["min"], wild["max"]) == (4, 1.0, 4.0)
    assert [r[3] for r in rows(A.histogram(frame(spark, ["v"], [("7",), ("7",)]), "v"))] == [2]


def test_date_histogram(spark):
    df = frame(spark, ["d", "v"], [("2026.01.01", "10"), ("2026년 1월 15일", "20"), ("20260131", "x"), ("no", "1")])
    assert rows(A.date_histogram(df, "d", "month", "v")) == [("2026-01", 3, 30.0, 10.0)]


def test_pivot(spark):
    df = frame(spark, ["site", "arm", "event", "value"], [("A", "T", "AE", "2"), ("A", "T", "SAE", "1"), ("A", "C", "AE", "3"), ("B", "T", "AE", "4")])
    got = rows(A.pivot(df, ["site"], ["arm", "event"], "value"))
    assert [r[1] for r in got[:3]] == ["C\x1fAE", "T\x1fAE", "T\x1fSAE"]
    assert [r[2] for r in got] == [3.0, 2.0, 1.0, 0.0, 4.0, 0.0]
    totals = {(r[0], r[1]): r[2] for r in rows(A.pivot_totals(A.pivot(df, ["site"], ["arm"], "value", "mean")))}
    assert totals[("grand", "")] == 1.5 + 3 + 4
    gaps = frame(spark, ["k", "v"], [("NA", "1"), ("", "2"), ("x", "3")])
    assert {r[0]: r[2] for r in rows(A.pivot(gaps, ["k"], [], "v"))} == {"null": 3.0, "x": 3.0}
    years = frame(spark, ["d", "s", "v"], [("2026-01-02", "A", "3"), ("2026-02-01", "A", "7"), ("2027-01-01", "A", "11")])
    assert rows(A.pivot(years, ["s"], [], "v", filters={"d": "2026"}, units={"d": "year"})) == [("A", "", 10.0)]
    assert rows(A.pivot_filter_values(years, "d", "_row", "year", 2)) == [("2026",)]
    assert export.pivot_csv([("A", "x\x1fy", 3.0), ("A", "z", 1.5)]) == ",x | y,z\nA,3,1.500\n"


def test_distinct_and_frequency(spark):
    df = frame(spark, ["site"], [("A",), ("B",), ("A",), ("",)])
    assert rows(A.distinct_values(df, "site")) == [("A", 2), ("", 1), ("B", 1)]
    f = frame(spark, ["v"], [(x,) for x in ["a", "b", "a", "c", "a", "b", "", "a"]])
    got = rows(A.frequency(f, "v"))
    assert got[0][1:4] == ("a", 4, 50.0) and got[1][4] == 75.0 and got[-1][1] == "" and got[-1][4] == 100.0
    assert [r[1] for r in rows(A.pareto(f, "v", 2))] == ["a", "b"]


def test_column_filters(spark):
    df = frame(spark, ["site", "date"], [("A", "20260102"), ("", "2026-01-03"), ("B", "2026-01-02"), ("A", "2026-01-04")])
    state = FI.FilterState((FI.SelectedValues("site", ("A",), True), FI.DateRange("date", "2026-01-02", "2026-01-03 23:59:59")))
    assert [r["_row"] for r in df.where(state.predicate(df)).collect()] == [1, 2]
    n = frame(spark, ["v"], [("2",), ("3.99",), ("4",), (" 2.5 ",), ("4.01",), ("inf",)])
    assert [r["_row"] for r in n.where(FI.NumericRange("v", 2, 4).predicate(n)).collect()] == [1, 2, 4]
    assert [r["_row"] for r in n.where(FI.NumericRange("v", 2, 4, True).predicate(n)).collect()] == [1, 2, 3, 4]
    assert state.toggled("site", "B").filters[-1].values == ("A", "B")
    assert state.describe()[0] == 'site in "A", (Blank)' or state.describe()[0].startswith("site in")
    assert FI.NumericRange("x", 1, 2).describe() == "1 <= x < 2"


def test_expression(spark):
    df = frame(spark, ["name", "age", "sex", "note"], [("Alice", "70", "F", "positive response"), ("Bob", "55", "M", "negative"),
                                                       ("Chris", "72", "M", "Positive response"), ("Dana", "40", "F", "pending")])
    def got(e):
        return [r["_row"] for r in df.where(FI.expression(df.drop("_row"), e)).collect()]

    assert got('age > 65 AND sex == "M" AND note contains "positive"') == [3]
    assert got("sex = M or age < 50") == [2, 3, 4]
    assert got("(sex = F or name = Bob) and age >= 55") == [1, 2]
    assert got("column1 != Bob") == [1, 3, 4]
    for bad in ("age >", "age 5", "(age > 5", "nothing == 1"):
        with pytest.raises(FI.ExpressionError):
            got(bad)
    assert FI.looks_like_expression("a=1") and not FI.looks_like_expression("plain words")


def test_search(spark):
    assert SE.parse_search("/a+/").mode == "regex" and SE.parse_search("fuzzy: ab").text == "ab" and SE.parse_search("x").mode == "contains"
    for bad in ("(a+)+", "((a*)b)*", "(", "(x{2,})+"):
        with pytest.raises(SE.UnsafePattern):
            SE.check_pattern(bad)
    for good in ("(ab)+", "[a+]+", "a+b*", r"(\+)+"):
        SE.check_pattern(good)
    df = frame(spark, ["t"], [("Café au lait",), ("tea",), ("CAFE",)])
    assert [r["_row"] for r in df.where(SE.search(df.drop("_row"), SE.SearchQuery("cafe"))).collect()] == [1, 3]
    assert [r["_row"] for r in df.where(SE.search(df, SE.SearchQuery("cflt", "fuzzy", "t"))).collect()] == [1]
    assert rows(SE.find_next(df, SE.SearchQuery("tea"), "_row", 3)) == [(2, 0, "tea")]
    assert rows(SE.find_next(df, SE.SearchQuery("tea"), "_row", 3, wrap=False)) == []
    assert df.where(SE.search(df, SE.SearchQuery(""))).count() == 0


def test_sorting(spark):
    def order(names, data, *keys):
        return [tuple(r)[1:] for r in SO.sort(frame(spark, names, data), list(keys), "_row").collect()]

    assert order(["n"], [("2",), ("10",), ("",), ("1",)], SO.SortKey("n")) == [("",), ("1",), ("2",), ("10",)]
    assert order(["n"], [("apple",), ("Cherry",), ("banana",)], SO.SortKey("n", False)) == [("Cherry",), ("banana",), ("apple",)]
    assert order(["k", "i"], [("x", "1"), ("x", "2"), ("x", "3")], SO.SortKey("k", False)) == [("x", "1"), ("x", "2"), ("x", "3")]
    assert order(["d", "a"], [("B", "30"), ("A", "40"), ("B", "20"), ("A", "25")], SO.SortKey("d"), SO.SortKey("a", False)) == [
        ("A", "40"), ("A", "25"), ("B", "30"), ("B", "20")]
    big = spark.range(100).select(F.col("id").alias("_row"))
    assert sorted(r["_row"] for r in SO.stride_sample(big, ["_row"], 5).collect()) == [0, 25, 50, 74, 99]
    assert [r["p"] for r in SO.positions(big, ["_row"], "p").orderBy("_row").collect()] == list(range(100))


def test_whole_table_queries(spark, tmp_path):
    from gridlore.queries import QUERIES

    spark.range(50_100).selectExpr("id AS o_orderkey", "date_add(DATE'2020-01-01', CAST(if(id < 50000, 0, 400) AS int)) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(6000).selectExpr("id AS c_custkey", "'n' || id AS c_name", "'s' AS c_mktsegment", "id AS c_nationkey", "id / 4 AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    assert [r["value"] for r in QUERIES["pivot_filter_values_whole"](spark, str(tmp_path)).collect()] == ["2020-01", "2021-02"]
    got = {r["column"]: r for r in QUERIES["column_statistics_whole"](spark, str(tmp_path)).collect()}
    assert got["c_name"]["unique_count"] == 6000 and got["c_nationkey"]["max"] == 5999


def test_column_statistics(spark):
    df = frame(spark, ["id", "age", "score", "enrolled", "visit", "site"], [
        ("1", "42", "10.5", "true", "2026-01-02", "A"), ("2", "", "11.5", "false", "2026-01-03", "A"),
        ("3", "65", "9.0", "true", "2026-01-04", "B"), ("4", "65", "12.0", "true", "", "B")])
    got = {r["column"]: r for r in P.column_statistics(df, order="_row").collect()}
    assert [got[c]["type"] for c in ("id", "age", "score", "enrolled", "visit", "site")] == ["Integer", "Integer", "Float", "Boolean", "Date", "Categorical"]
    assert (got["age"]["null_count"], got["age"]["non_null_count"], got["age"]["unique_count"], got["age"]["median"]) == (1, 3, 2, 65.0)
    codes = frame(spark, ["z", "d", "e"], [("007", "20260102", ""), ("012", "20260103", "NA")])
    kinds = {r["column"]: r["type"] for r in P.column_statistics(codes, order="_row").collect()}
    assert kinds == {"z": "Categorical", "d": "Date", "e": "Empty"}
    assert P.override_rule("Integer", "Float") == "allow" and P.override_rule("Date", "Boolean") == "validate" and P.override_rule("Float", "Integer") == "block"
    assert rows(P.override_failures(frame(spark, ["v"], [("1",), ("x",), ("x",), ("2",)]), "v", "Integer")) == [("x", 2)]


def test_facets(spark):
    df = frame(spark, ["status"], [(x,) for x in ["open"] * 3 + ["closed"] * 2 + ["pending", "review", "hold"]])
    got = rows(P.facet_top(df, ["status"], k=3).orderBy("rank").select("value", "count", "other_count"))
    assert got == [("open", 3, 2), ("closed", 2, 2), ("hold", 1, 2)]
    n = frame(spark, ["v"], [(str(i),) for i in range(13)] + [("oops",)])
    h = rows(P.facet_histogram(n, "v").select("count", "numeric_count", "non_numeric_count"))
    assert [r[0] for r in h] == [2, 2, 2, 2, 2, 3] and h[0][1:] == (13, 1)
    assert rows(P.facet_histogram(frame(spark, ["r"], [("5",), ("3",), ("1",)]), "r")) == []
    x = frame(spark, ["city", "status"], [("NY", "open"), ("LA", "open"), ("NY", "closed"), ("SF", "open")])
    cross = {(r["column"], r["value"]): r["count"] for r in P.facet_top(x, ["city", "status"], filters={"city": FI.equals("city", "NY")}).collect()}
    assert cross == {("city", "NY"): 2, ("city", "LA"): 1, ("city", "SF"): 1, ("status", "closed"): 1, ("status", "open"): 1}


def test_quality(spark):
    df = frame(spark, ["amount", "city"], [("10", "Seoul"), ("NA", "Busan"), ("20", ""), ("-9999", "Jeonju"), ("30", "Seoul")])
    got = {r["column"]: r for r in P.quality_profile(df, ["amount", "city"]).collect()}
    assert (got["amount"]["blank"], got["amount"]["sentinel"], got["amount"]["numeric"], got["city"]["blank"]) == (0, 2, 3, 1)
    bad = frame(spark, ["value"], [(str(i),) for i in range(1, 10)] + [("oops",)])
    assert ("typeValidity", "warning", "value", 1) in rows(P.quality_issues(bad, ["value"]))
    ids = frame(spark, ["user_id", "name"], [("u1", "a"), ("u2", "b"), ("u1", "c"), ("u3", "d")])
    assert ("keyUniqueness", "error", "user_id", 1) in rows(P.quality_issues(ids, ["user_id", "name"]))
    assert rows(P.quality_score(frame(spark, ["id", "v"], [("a", "1"), ("b", "2"), ("c", "3")]), ["id", "v"])) == [(100,)]
    assert [P.key_like(x) for x in ("id", "user_id", "userId", "customerID", "고객번호")] == [True] * 5
    assert not any(P.key_like(x) for x in ("grid", "valid", "void", "rapid", "squid", "aphid"))
    book = frame(spark, ["s", "n"], [("open", "a"), ("closed", "b"), ("open", "c"), ("pending", "d"), ("open", "e")])
    assert rows(P.quality_codebook(book, ["s", "n"]))[0] == ("s", "open", 3)


def test_statistics(spark):
    df = frame(spark, ["v"], [(str(x),) for x in A10] + [("",), ("NA",)])
    r = T.descriptive(df, ["v"]).first()
    assert (r["n"], r["missing"]) == (10, 2)
    q = duckdb.connect().execute(f"""SELECT avg(v) AS mean, stddev_samp(v) AS sd, stddev_samp(v) / sqrt(10) AS se, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3,
      quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, skewness(v) AS skewness, kurtosis(v) AS kurtosis, stddev_samp(v) / avg(v) AS cv FROM unnest({A10}::DOUBLE[]) t(v)""")
    for name, want in zip([c[0] for c in q.description], q.fetchone(), strict=True):
        assert r[name] == pytest.approx(want, abs=1e-9)
    half = 2.2621571627409915 * r["se"]  # of 9 degrees of freedom, from published tables
    assert T.confidence_interval(r["mean"], r["se"], 10) == pytest.approx((r["mean"] - half, r["mean"] + half), abs=1e-9)
    assert rows(T.modes(frame(spark, ["v"], [(x,) for x in "122334"]), "v").select("mode")) == [(2.0,), (3.0,)]
    g = spark.createDataFrame([(k, x) for k, v in (("A", A10), ("B", B8), ("C", C6)) for x in v], "g string, v double")
    t = T.anova_test(g, "g", "v")
    every = [A10, B8, C6]
    grand, means = sum(map(sum, every)) / 24, [sum(v) / len(v) for v in every]
    between, within = sum(len(v) * (m - grand) ** 2 for v, m in zip(every, means, strict=True)), sum((x - m) ** 2 for v, m in zip(every, means, strict=True) for x in v)
    f = between / 2 / (within / 21)
    # with two degrees of freedom above, the tail has a closed form
    assert t.statistic == pytest.approx(f) and t.p == pytest.approx((21 / (21 + 2 * f)) ** 10.5, rel=1e-8) and t.extra["eta_squared"] == pytest.approx(between / (between + within))
    assert T.anova_test(g.where("g = 'A'"), "g", "v").p == 1.0
    w, p, _ = tails.shapiro_wilk(sorted(A10))
    assert w == pytest.approx(0.9744, abs=5e-4) and p == pytest.approx(0.928, abs=5e-3)  # the query's SQL computes W and p independently
    assert tails.shapiro_wilk([1.0, 2.0])[2] == "sample too small" and tails.shapiro_wilk([1.0] * 5)[2] == "constant data"
    groups = spark.createDataFrame([("A", x) for x in (14.2, 15.1, 13.9, 14.8, 15.4)] + [("B", x) for x in (12.8, 13.0, 12.5, 13.4, 12.9)], "g string, v double")
    t = T.welch_test(groups, "g", "A", "B", "v")
    assert t.statistic == pytest.approx(5.5993, abs=1e-4) and t.df == pytest.approx(6.0548, abs=1e-4) and 0.001 < t.p < 0.002
    pairs = spark.createDataFrame([(10, 12), (12, 15), (14, 17), (13, 16), (11, 13)], "x int, y int")
    t = T.paired_test(pairs, "x", "y")
    assert t.statistic == pytest.approx(10.6145, abs=1e-4) and 0.0004 < t.p < 0.0005 and t.extra["difference"] == pytest.approx(2.6)
    cells = spark.createDataFrame([("A", "x")] + [("A", "y")] + [("A", "z")] * 4 + [("B", "x")] * 2 + [("B", "y")] * 7 + [("B", "z")], "r string, c string")
    t = T.chi_square_test(cells, "r", "c")
    assert t.statistic == pytest.approx(6.0089, abs=1e-4) and t.df == 2 and t.p == pytest.approx(0.0496, abs=1e-4)
    line = spark.createDataFrame([(1, 2), (2, 4), (3, 6), (4, 8)], "x int, y int")
    assert all(T.correlation_test(line, "x", "y", m).p < 0.001 for m in ("pearson", "spearman"))


def test_charts(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3), (5, 5)], "x int, y int")
    assert tuple(C.regression(df, "x", "y").first()) == pytest.approx((5, 0.8, 0.6, 0.64))
    box = one(spark, *[float(i) for i in (*range(1, 10), 100)], kind="double")
    r = C.box_plot(box, "v").first()
    assert (r["median"], r["q1"], r["q3"], r["whisker_low"], r["whisker_high"], r["outliers"]) == (5.5, 3.25, 7.75, 1.0, 9.0, 1)
    assert rows(C.outliers(box, "v")) == [(100.0,)]
    points = spark.createDataFrame([(0.0, 0.0), (0.1, 0.1), (9.9, 9.9), (10.0, 10.0)], "x double, y double")
    assert sorted(rows(C.density_grid(points, "x", "y", 2, 2))) == [(0, 0, 2), (1, 1, 2)]
    assert C.scatter(points, "x", "y", 3)[0] == "grid" and C.scatter(points, "x", "y", 4)[0] == "points"
    curve = rows(C.kde(one(spark, *A10, kind="double"), "v"))
    assert len(curve) == 128 and 0.7 < sum(r[2] for r in curve) * (curve[1][1] - curve[0][1]) < 1.01
    q = rows(C.qq(one(spark, *[float(i) for i in range(1, 100)], kind="double"), "v"))
    assert len(q) == 99 and q[49][1] == pytest.approx(0, abs=1e-9) and q[49][2] == 50.0


def test_records():
    def read(text, d=","):
        return [f for f, _, _ in D.records(text, d)]

    assert read('a,"b, c"\r\nd,"x ""y"" z"\n') == [["a", "b, c"], ["d", 'x "y" z']]
    assert read('"l1\r\nl2",q\n\nz') == [["l1\nl2", "q"], [""], ["z"]]
    assert read('"ab"cd,e') == [["abcd", "e"]]
    assert [c for _, _, c in D.records('a\n"b')] == [True, False]
    assert D.detect_delimiter('a;b;"c,d,e,f"\n1') == ";" and D.detect_delimiter("abc") == "," and D.detect_delimiter("a\tb") == "\t"
    assert D.detect_encoding("é".encode()) == "utf-8" and D.detect_encoding("﻿a".encode()) == "utf-8-sig" and D.detect_encoding("한글,테스트".encode("cp949") * 5) == "cp949"
    with pytest.raises(D.UnsupportedEncoding):
        D.detect_encoding("a,b".encode("utf-16"))
    assert D.quote_damage('a\n"b') and D.quote_damage('a,"b"') is None
    assert D.unique_names(["value", "value", "note", ""]) == ["value", "value (2)", "note", "Column 4"]


def test_open_delimited(spark, tmp_path):
    (tmp_path / "q.csv").write_bytes('name,note\r\nAlice,"hello, world"\r\nBob,"a ""quoted"" value"\r\nCy\r\n'.encode())
    t = D.open_delimited(spark, f"file://{tmp_path}/q.csv")
    got = rows(t.df.select("_row", "c0", "c1").orderBy("_row"))
    assert t.names == ["name", "note"] and got == [(1, "Alice", "hello, world"), (2, "Bob", 'a "quoted" value'), (3, "Cy", None)]
    assert t.df.where(D.ragged(t)).count() == 1
    (tmp_path / "p.csv").write_bytes(b"\xef\xbb\xbfa;b\n1;2\n\n3;4\n")
    t = D.open_delimited(spark, f"file://{tmp_path}/p.csv")
    assert t.names == ["a", "b"] and rows(t.df.select("_row", "c0", "c1").orderBy("_row")) == [(1, "1", "2"), (2, "", None), (3, "3", "4")]
    (tmp_path / "k.csv").write_bytes("이름,값\n한글,1\n".encode("cp949"))
    t = D.open_delimited(spark, f"file://{tmp_path}/k.csv")
    assert t.encoding == "cp949" and rows(t.named().drop("_row")) == [("한글", "1")]
    assert rows(D.open_text(spark, "a\tb\n1\t2").named()) == [(1, "1", "2")]


def test_exports(spark, tmp_path):
    df = frame(spark, ["n", "t"], [("Alice", "a|b"), ("=1", 'x "y", z')])
    for kind in ("csv", "markdown", "json", "html"):
        assert not export.write_file(df.orderBy("_row"), ["n", "t"], ["n", "t"], f"{tmp_path}/o.{kind}", kind, sanitize=True)
    assert (tmp_path / "o.csv").read_text() == 'n,t\nAlice,a|b\n\'=1,"x ""y"", z"\n'
    assert "a\\|b" in (tmp_path / "o.markdown").read_text() and "&quot;y&quot;" in (tmp_path / "o.html").read_text()
    assert json.loads((tmp_path / "o.json").read_text())[0] == {"n": "Alice", "t": "a|b"}
    assert export.write_file(frame(spark, ["t"], [("🙂",)]), ["t"], ["t"], f"{tmp_path}/k.csv", "csv", "cp949")


def test_workbooks(spark, tmp_path):
    path = tmp_path / "w.sqlite"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE people (id INTEGER, name TEXT, b BLOB)")
        db.executemany("INSERT INTO people VALUES (?, ?, ?)", [(1, "Ann", b"xy"), (2, None, None)])
        db.execute("CREATE VIEW v AS SELECT * FROM people")
        db.execute("CREATE TABLE empty_table (x)")
    assert workbooks.sqlite_tables(path.read_bytes()) == ["empty_table", "people", "v"]
    t = workbooks.open_sqlite(spark, f"file://{path}", "people")
    assert t.names == ["id", "name", "b"] and rows(t.df.select("c0", "c1", "c2").orderBy("_row")) == [("1", "Ann", "<blob 2 bytes>"), ("2", "", "")]
    book = tmp_path / "b.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>day</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
                   '<row r="3"><c r="B3" t="b"><v>1</v></c><c r="C3" s="1"><v>45292</v></c></row></sheetData></worksheet>')
    t = formats.open_any(spark, f"file://{book}")
    assert t.names == ["name", "", "day"] and rows(t.df.select("c0", "c1", "c2").orderBy("_row")) == [("", "", ""), ("", "TRUE", "2024-01-01")]
    assert workbooks.serial_date(45292.5) == "2024-01-01 12:00:00" and workbooks.serial_date(1, True) == "1904-01-02" and workbooks.serial_date(61) == "1900-03-01"
    with pytest.raises(workbooks.ImportLimit):
        list(workbooks.xlsx_rows(book.read_bytes(), limits=workbooks.Limits(rows=2)))
    assert formats.route("a.xls", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1") == "xls"


def test_views(spark, tmp_path):
    df = frame(spark, ["site", "n"], [("A", "3"), ("B", "1"), ("A", "2"), ("C", "9")])
    view = View(df).filter(FI.FilterState((FI.SelectedValues("site", ("A", "B")),))).sort(SO.SortKey("n"))
    assert [r["_row"] for r in view.ordered().collect()] == [2, 3, 1]
    assert [r["_row"] for r in view.page(1, 1).collect()] == [3] and view.hide("n").columns() == ["site"]
    assert view.capped(2).count() == 2 and view.where("n = '3'").rows().count() == 1
    assert rows(view.search("3")) == [(2, 1, "3")]
    store = ViewStore(f"{tmp_path}/views.json")
    saved = SavedView("mine", "site = A", (("n", False),), ("n",), "", (FI.SelectedValues("site", ("A",)),))
    store.put("f.csv", saved)
    store.put("f.csv", SavedView("other"))
    assert [v.name for v in store.list("f.csv")] == ["other", "mine"] and store.list("f.csv")[1] == saved
    assert [r["_row"] for r in saved.restore(df).ordered().collect()] == [1, 3]
    store.delete("f.csv", "other")
    assert store.latest("f.csv").name == "mine"


def test_stream(spark, tmp_path):
    from gridlore.streaming.date_histogram import daily_counts

    spark.createDataFrame([("2026-01-01 10:00:00", 2.0), ("2026-01-01 11:00:00", 4.0), ("2026-01-02 00:00:00", 1.0)], "ts string, v double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts string, v double").parquet(f"{tmp_path}/in")
    q = daily_counts(stream, "ts", "v").writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(rows(spark.table("days").select("label", "count", "sum"))) == [("2026-01-01", 2, 6.0), ("2026-01-02", 1, 1.0)]
