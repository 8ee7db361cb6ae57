"""Work that is done once: a value split once, a file read in few passes, few bytes in a shuffle."""

from mercato.functions.temporal import mmss_micros, time_micros
from mercato.operators import quality
from mercato.plans import files, reports
from mercato.sources.records import read_records


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_times_are_split_once_for_each_parser(spark, star):
    plan = optimized(files.parsed_times(star))
    assert plan.count("CASE WHEN ((SalesID") <= 1 and plan.count("7:5.1234567") == 1  # the text isn't written out for each mention
    assert plan.count("split(trim(") == 2


def test_times_of_odd_texts(spark):
    said = ["14:30", "7:5.1234567", "60:00", "1:60", "1:2:3", "23:59:59.9", "24:0:0", "1:2:3:4", ":", "1:", "1:2.", "1:2.3.4", "1:2.x", " 5:06.25 ", "+1:2", "a:b", "", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", mmss_micros("s"), time_micros("s"))
    got = {said[r[0]]: tuple(r[1:]) for r in rows.collect()}
    s = 1_000_000
    want = {"14:30": (870 * s,) * 2, "7:5.1234567": (425_123_456,) * 2, "1:2:3": (None, 3723 * s), "23:59:59.9": (None, 86_399_900_000), "1:2.": (62 * s,) * 2,
            " 5:06.25 ": (306_250_000,) * 2, "+1:2": (62 * s,) * 2}
    assert got == {t: want.get(t, (None, None)) for t in said}


def test_a_folder_is_read_for_its_report_alone(spark, tmp_path):
    (tmp_path / "countries.csv").write_text("CountryID,CountryName,CountryCode\n1,Argentina,AR\nx,,BR\n")
    report, summary = quality.validate_folder(spark, str(tmp_path))
    assert "FileScan text" not in str(summary._jdf.queryExecution().sparkPlan()) and "FileScan text" not in str(report._jdf.queryExecution().sparkPlan())
    found = {r["table"]: r for r in summary.collect()}
    assert found["countries.csv"]["problems"] == 2 and len(found["countries.csv"]["first_problems"]) == 2 and report.count() == 2 + 6


def test_lines_of_records_are_scanned_three_times_at_most(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x\n1,"a\nb"\n2,y\n')
    found = read_records(spark, str(tmp_path))
    assert len(found.collect()) == 2
    final = executed(found).split("Initial Plan")[0]
    # the splits' rows, the records, and the pieces across borders; the rest is read from an exchange again
    assert final.count("FileScan text") <= 3


def test_long_and_short_records_across_borders(spark, tmp_path):
    """Records of up to 12 lines in splits of 64 bytes and batches of 3 lines: those of over 5 lines come apart."""
    names, sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"), ("64", "0", "3")
    text, want, line = "id,x\n", [], 2
    for i in range(40):
        lines = [f"{i},q"] if i % 3 == 0 else [f'{i},"a', *["bb"] * (i % 11), 'c"']
        if len(lines) <= 5:
            want.append((line, i + 2, False, "\n".join(lines)))
        else:
            want += [(line + j, i + 2, True, x) for j, x in enumerate(lines)]
        text, line = text + "\n".join(lines) + "\n", line + len(lines)
    (tmp_path / "a.csv").write_text(text)
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, sizes):
            spark.conf.set(n, v)
        got = read_records(spark, str(tmp_path), max_lines=5).select("_line", "_record", "_unclosed", "record").collect()
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert sorted(map(tuple, got)) == want


def test_the_sales_view_shuffles_the_fact_narrow(spark, star, monkeypatch):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        shuffles = [x for x in executed(reports.sales_detail_view(star)).splitlines() if "Exchange hashpartitioning" in x]
        assert not any("SalesPersonID" in x or "l_suppkey" in x and "CustomerID" in x for x in shuffles)  # few sellers: no shuffle for them
        few = sorted(map(repr, reports.sales_detail_view(star).collect()))
        monkeypatch.setattr(reports, "SELLER_ROWS", 0)
        many = reports.sales_detail_view(star)
        assert "hashpartitioning(SalesPersonID" in executed(many)
        assert sorted(map(repr, many.collect())) == few and any("Vendedor=None" in r for r in few)
    finally:
        spark.conf.set(name, before)
