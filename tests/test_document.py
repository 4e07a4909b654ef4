"""Reference rules on own samples: types, keys, patterns, folding, dates, date styles, and a document as a whole."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from gridlore.functions import running, tails
from gridlore.functions import scalars as S
from gridlore.operators import charts, document, search, stats
from gridlore.sources import sas, workbooks


@pytest.mark.parametrize("pattern, safe", [("(.*a){20}", False), ("(a+)+", False), ("((a+))+", False), ("(a{2}){3}", False), (r"(\d+)-(\d+)", True),
                                           ("[(a+)]+", True), ("[]+)]*(x)", True), ("a{2,3}b+", True), ("(", False)])
def test_pattern_gate(pattern, safe):
    if safe:
        search.check_pattern(pattern)
    else:
        with pytest.raises(search.UnsafePattern):
            search.check_pattern(pattern)


def test_folding(spark):
    words = ["Čapek", "ŁÓDŹ", "Ἀθῆναι", "Ṩx", "ét́", "plain"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(search.fold(F.col("w"))).collect()]
    assert got == ["capek", "łodz", "αθηναι", "sx", "et", "plain"]
    assert spark.createDataFrame([("Čapek",)], "w string").where(search.matches(F.col("w"), search.SearchQuery("cpk", "fuzzy"))).count() == 1


def test_dates(spark):
    cases = {"2024년 3월 5일 10:30": "2024-03-05 10:30:00", "2024년 3월 5일 10:30:15": "2024-03-05 10:30:15", "2024년 3월": None, "3/4/2020 10:00": None,
             "3/4/2020": "2020-03-04 00:00:00", "2020-1": "2020-01-01 00:00:00", "2020. 1. 9": "2020-01-09 00:00:00"}
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", S.parse_date(F.col("t")).cast("string").alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == cases


def test_date_styles():
    shown = {"yyyy-mm-dd": True, "d": True, "mmm": False, "ss.0": False, "h:mm": True, "mm:ss": True, "[h]:ss": False, '"day" 0': False, "General": False, "0.00": False}
    assert {c: workbooks.dated_code(c) for c in shown} == shown
    assert 14 in workbooks.DATE_FORMATS and 47 in workbooks.DATE_FORMATS and not {27, 36, 50, 58} & workbooks.DATE_FORMATS
    assert workbooks.serial_date(45292.0) == "2024-01-01" and workbooks.serial_date(45292.75) == "2024-01-01 18:00:00"


@pytest.mark.parametrize("n", range(4, 15))
def test_shapiro_of_its_own_weights(n):
    """A sample that fits exactly must not raise; its W is 1 and nothing speaks against normality."""
    values = [tails.normal_quantile((i + 0.625) / (n + 0.25)) for i in range(n)]
    for shift in range(40):
        w, p, text = tails.shapiro_wilk([v * (shift + 1) + shift for v in values])
        assert 0.9 < w <= 1 and 0 <= p <= 1 and text.startswith("consistent")
    assert tails.shapiro_wilk([0.0] * (n - 1) + [1.0])[2].startswith("deviates")


def test_descriptive_and_boxes(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("a", 90.0), ("b", 5.0), ("b", 5.0), ("b", 7.0), ("b", None)], "g string, x double")
    r = stats.descriptive(df, ["x"]).first()
    mean, se = 115 / 8, r["se"]
    assert (r["n"], r["missing"], r["median"], r["modes"], r["mode_count"]) == (8, 1, 4.0, [2.0, 5.0], 2)
    assert r["ci_low"] == pytest.approx(mean - 2.3646242515927849 * se) and r["ci_high"] == pytest.approx(mean + 2.3646242515927849 * se)
    chart = charts.box_chart(df, "x", "g")
    assert [(o["group"], o["place"], o["x"]) for o in chart["outliers"].collect()] == [("a", 1, 90.0)] and chart["anova"].df == 1
    assert charts.box_chart(df, "x")["anova"] is None
    assert stats.descriptive(df.where("false"), ["x"]).first()["n"] == 0


def test_quantiles_and_sums(spark):
    """Over more partitions than values, with a group and a value that most rows share."""
    rows = [("hot", 5)] * 300 + [("hot", i) for i in range(10)] + [("few", 1), ("few", 4), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(7)
    got = {r["g"]: (r["n"], r["q"]) for r in running.quantiles(df, ["g"], "x", (0.0, 0.25, 0.5, 1.0)).collect()}
    assert got == {"hot": (310, [0.0, 5.0, 5.0, 9.0]), "few": (2, [1.0, 1.75, 2.5, 4.0])}
    placed = running.positions(df.where("g = 'hot'").withColumn("i", F.monotonically_increasing_id()), ["x", "i"], "at").orderBy("at").collect()
    assert [r["at"] for r in placed] == list(range(310)) and [r["x"] for r in placed] == sorted(r["x"] for r in placed)


def test_document(spark):
    df = spark.createDataFrame([(i, f"v{i % 3}") for i in range(30)], "id long, v string")
    got = document.quick_stats(df, df.where("id < 12"), ["id", "v"], "id").orderBy("slot").collect()
    assert [(r["rows_visible"], r["rows_total"], r["columns"], r["column"], r["type"], r["unique_count"]) for r in got] == [
        (12, 30, 2, "id", "Integer", 12), (12, 30, 2, "v", "Categorical", 3)]
    assert document.Snapshot(1_234_567, 5000, 12, 3, seconds=0.5).lines() == [
        "File: 1.2 MB", "Rows: 12 / 5,000", "Columns: 3", "Storage: Disk", "Indexing: complete in 0.500 s", "Throughput: 10,000 rows/s"]
    assert document.Snapshot(10, 1, 1, 1, complete=False, memory_bytes=2000).lines()[-2:] == ["Memory: 2.0 KB", "Indexing: in progress"]


def test_cancel(spark):
    job = document.Job(spark)
    assert job.run(lambda: spark.range(5).count()) == 5
    threading.Timer(2.0, job.cancel).start()
    began = time.monotonic()
    with pytest.raises(document.Cancelled):
        job.run(lambda: spark.range(1 << 45).selectExpr("sum(hash(id))").collect())
    assert time.monotonic() - began < 60
    with pytest.raises(document.Cancelled):
        job.run(lambda: 1)


def test_sas_cells():
    import datetime

    values = [None, float("nan"), 3.0, 2.5, b"ab  ", "x ", datetime.datetime(2020, 1, 2), datetime.datetime(2020, 1, 2, 3, 4, 5), 1e300]
    assert [sas.cell_text(v) for v in values] == ["", "", "3", "2.5", "ab", "x", "2020-01-02", "2020-01-02 03:04:05", "1e+300"]
