import csv
import io
from datetime import date, timedelta

import pytest

from gaugeflow.operators import climate_folder
from gaugeflow.sources import readers, writers

DAY = date(2000, 10, 1)


def test_csv_round_trip_keeps_leading_zeros(spark, tmp_path):
    df = spark.createDataFrame([("09380000", DAY, 1.5), ("9380001", DAY, None)], readers.DAILY_Q)
    writers.write_csv(df, str(tmp_path / "q"))
    back = readers.read_table(spark, str(tmp_path / "q"), readers.DAILY_Q, fmt="csv")
    assert {(r["site_no"], r["q"]) for r in back.collect()} == {("09380000", 1.5), ("09380001", None)}
    writers.write_parquet(df, str(tmp_path / "p"))
    assert readers.read_table(spark, str(tmp_path / "p")).count() == 2


def test_per_site_sink_and_partition_pruning(spark, tmp_path):
    df = spark.createDataFrame([("01", DAY, 1.0), ("02", DAY, 2.0)], readers.DAILY_Q)
    writers.write_by_site(df, str(tmp_path / "sites"))
    back = spark.read.parquet(str(tmp_path / "sites")).where("site_no = '02'")
    assert [r["q"] for r in back.collect()] == [2.0]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site_no" in plan
    writers.write_by_site(df, str(tmp_path / "buckets"), buckets=4)
    assert {r["site_no"] for r in spark.read.parquet(str(tmp_path / "buckets")).collect()} == {"01", "02"}


def test_per_site_files_take_the_id_from_the_name(spark, tmp_path):
    for site, q in (("01", 1), ("02", 2)):
        (tmp_path / f"DailyEstimate_{site}.csv").write_text(f"date,q\n2000-10-01,{q}\n")
    df = readers.read_per_site_files(spark, str(tmp_path / "DailyEstimate_*.csv"), schema="date DATE, q DOUBLE")
    assert {(r["site_no"], r["q"]) for r in df.collect()} == {("01", 1.0), ("02", 2.0)}


def test_many_files_with_different_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("dates,x\n1,2\n")
    (tmp_path / "b.csv").write_text("dates,y\n3,4\n")
    df = readers.read_many(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(map(tuple, df.collect())) == [("1", "2", None), ("3", None, "4")]


def test_an_index_column_is_left_out(spark, tmp_path):
    (tmp_path / "s.csv").write_text('"","site_no","sample_dt","result_va"\n"1","09380000","2000-10-01",2.5\n"2","09380001","2000-10-02",NA\n')
    df = readers.read_table(spark, str(tmp_path / "s.csv"), readers.SAMPLES, fmt="csv")
    assert df.columns == ["site_no", "sample_dt", "result_va"]
    assert sorted((r["site_no"], str(r["sample_dt"]), r["result_va"]) for r in df.collect()) == [("09380000", "2000-10-01", 2.5), ("09380001", "2000-10-02", None)]
    assert readers.read_csv(spark, str(tmp_path / "s.csv")).columns == ["site_no", "sample_dt", "result_va"]


def test_columns_are_taken_by_name_in_every_file(spark, tmp_path):
    (tmp_path / "E_01.csv").write_text("date,q,gen_conc\n2000-10-01,20,2\n")
    (tmp_path / "E_02.csv").write_text('"",gen_conc,date,more,q\n1,2,2000-10-01,x,20\n')
    for k in range(3, 30):
        (tmp_path / f"E_{k:02}.csv").write_text("date,q,gen_conc\n2000-10-01,20,2\n")
    schema = "date DATE, q DOUBLE, gen_conc DOUBLE"
    df = readers.read_per_site_files(spark, str(tmp_path / "E_*.csv"), schema=schema)
    assert {(r["site_no"], r["date"], r["q"], r["gen_conc"]) for r in df.collect()} == {(f"{k:02}", DAY, 20.0, 2.0) for k in range(1, 30)}
    assert len(readers.header_groups(spark, str(tmp_path / "E_*.csv"))) == 2


def test_a_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,flow\n2000-10-01,1\n")
    with pytest.raises(ValueError, match="no column q"):
        readers.read_csv(spark, str(tmp_path / "a.csv"), "date DATE, q DOUBLE")


def _wide_file(path, sites, days, date_format, index=False, date="dates"):
    """A wide file; returns its (site, day, value) rows."""
    out, rows = io.StringIO(), []
    writer = csv.writer(out, quoting=csv.QUOTE_NONNUMERIC if index else csv.QUOTE_MINIMAL)
    writer.writerow(([""] if index else []) + [date] + [f"X{s}.." for s in sites])
    for n, d in enumerate(days):
        values = [None if (n + k) % 5 == 0 else n + k / 8 for k in range(len(sites))]
        writer.writerow(([n] if index else []) + [d.strftime(date_format)] + ["NA" if v is None else v for v in values])
        rows += [(s, d, v) for s, v in zip(sites, values)]
    path.write_text(out.getvalue())
    return rows


def test_two_thousand_files_of_three_layouts_are_one_plan(spark, tmp_path):
    few, many = tmp_path / "few", tmp_path / "many"
    few.mkdir(), many.mkdir()
    want = []
    for k in range(2000):
        days = [DAY + timedelta(days=10 * k % 300 + n) for n in range(14)]
        sites = [f"{k:04}{j:04}" for j in range(1 + k % 3)]
        layout = [("%Y-%m-%d", False), ("%m/%d/%y", True), ("%d/%m/%y", False)][k % 3]
        for folder in [many] + ([few] if k < 3 else []):
            rows = _wide_file(folder / f"f{k:04}.csv", sites, days, *layout)
        want += rows
    formats = ("yyyy-MM-dd", "M/d/yy", "d/M/yy")
    df = climate_folder(spark, str(many), formats=formats)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    nodes = [climate_folder(spark, str(f), formats=formats)._jdf.queryExecution().optimizedPlan().treeString().count("\n") for f in (few, many)]
    assert nodes[0] == nodes[1]


def test_drift_of_names_in_a_folder(spark, tmp_path):
    days = [DAY + timedelta(days=n) for n in range(20)]
    want = _wide_file(tmp_path / "a.csv", ["09380000", "09380001"], days, "%Y-%m-%d")
    want += _wide_file(tmp_path / "b.csv", ["09380002", "09380003"], days, "%m/%d/%y", date="Date")
    broken = "V1,V2,V3\n" + "\n".join(f"{d},{n},{n + 0.5}" for n, d in enumerate(days))
    (tmp_path / "c.csv").write_text(broken + "\n")
    want += [(s, d, n + h) for n, d in enumerate(days) for s, h in (("09380000", 0.0), ("09380001", 0.5))]
    (tmp_path / "d.csv").write_text("dates,X9380009..\n")
    (tmp_path / "e.csv").write_text("")
    df = climate_folder(spark, str(tmp_path), rename={"Date": "dates"}, names_from={"c.csv": "a.csv"})
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert climate_folder(spark, str(tmp_path / "e.csv")).collect() == []


def test_bad_headers_of_a_folder_are_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("day,X09380000..\n2000-10-01,1\n")
    with pytest.raises(Exception, match="no column dates in .*a.csv"):
        climate_folder(spark, str(tmp_path / "a.csv")).collect()
    (tmp_path / "b.csv").write_text("dates,x,x\n2000-10-01,1,2\n")
    with pytest.raises(Exception, match="a column name occurs twice in .*b.csv"):
        climate_folder(spark, str(tmp_path / "b.csv")).collect()
