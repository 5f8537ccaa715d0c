import random
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import collect, day
from gaugeflow import operators as op

SAMPLES = "site_no string, sample_dt date, result_va double"
DAILY = "site_no string, date date, q double"


def series(site, days, value=1.0):
    return [(site, day(n), float(value)) for n in days]


def test_coavailable_needs_both_and_type(make):
    catalog = make(
        [
            ("1", "ST", "00095"), ("1", "ST", "00094"), ("1", "ST", "00060"),
            ("2", "LK", "00095"), ("2", "LK", "00060"),
            ("3", "ST", "00095"),
            ("4", "ST", "00095"), ("4", "LK", "00060"),
        ],
        "site_no string, site_tp_cd string, parameter_cd string",
    )
    rows = collect(op.site_screen_coavailable(catalog), "site_no")
    assert [(r["site_no"], r["parameter_cd"]) for r in rows] == [("1", "00094"), ("4", "00095")]


def test_counts_are_of_distinct_dates(make):
    samples = make(series("a", [0, 0, 1, 2]) + series("b", [0, 1]) + series("c", [0, 1, 2]), SAMPLES)
    daily = make(series("a", [0]) + series("b", [0]), DAILY)
    assert [r["site_no"] for r in op.site_screen_counts(samples, daily, min_dates=2).collect()] == ["a"]


def test_continuity(make):
    samples = make(
        series("good", [5, 20]) + series("gap", [0, 60]) + series("null", [0, 40]) + series("outside", [100, 101]) + series("nodata", [0]), SAMPLES
    )
    daily = make(
        series("good", [0, *range(5, 21), 90])
        + series("gap", [0, 40, 60])
        + [("null", day(n), None if 1 <= n <= 31 else 1.0) for n in range(41)]
        + series("outside", range(10)),
        DAILY,
    )
    keep = {r["site_no"]: (r["keep"], r["max_run"]) for r in op.site_screen_continuity(samples, daily).collect()}
    assert keep == {"good": ("Good", 0), "gap": ("Bad", 39), "null": ("Bad", 31), "outside": ("Bad", None), "nodata": ("Bad", None)}


def test_segments_lose_first_date_and_last_row(make):
    days = [0, 0, 10, 20, 30, 1000, 1010, 1020, 1020]
    df = make(series("a", days), SAMPLES)
    kept = op.sample_segments(df, break_days=730, min_obs=2).orderBy("sample_dt").collect()
    assert [(r["sample_dt"], r["segment"], r["segment_obs"]) for r in kept] == [
        (day(10), 1, 3), (day(20), 1, 3), (day(30), 1, 3), (day(1000), 2, 2), (day(1010), 2, 2)
    ]
    whole = op.sample_segments(df, min_obs=2, keep_edges=True)
    assert [r["sample_dt"] for r in whole.orderBy("sample_dt").collect()] == [day(n) for n in (0, 10, 20, 30, 1000, 1010, 1020)]


def test_segment_at_threshold_and_single_row(make):
    df = make(series("edge", range(0, 62)) + series("short", range(0, 61)) + series("one", [3]), SAMPLES)
    counts = {r["site_no"]: r["n"] for r in op.sample_segments(df).groupBy("site_no").agg(F.count("*").alias("n")).collect()}
    assert counts == {"edge": 60}


def test_segment_classes(make):
    block = list(range(10))
    shifted = lambda k: [d + 1000 * k for d in block]
    df = make(
        series("none", block) + series("one", block + shifted(1)) + series("many", block + shifted(1) + shifted(2)) + series("single", [0]), SAMPLES
    )
    got = {r["site_no"]: (r["segment_class"], r["n_long_segments"]) for r in op.segment_classes(df, min_obs=9).collect()}
    assert got == {"none": ("no_break", 1), "one": ("one_break", 2), "many": ("many_breaks", 3), "single": ("many_breaks", 0)}


def test_model_window_bounds(make):
    first = date(2010, 1, 15)
    samples = make([("a", first + timedelta(days=30 * i), 1.0) for i in range(12)] + [("b", first, 1.0)], SAMPLES)
    lead = [first - timedelta(days=n) for n in (3654, 3653, 3652, 0)]
    daily = make([("a", d, 1.0) for d in lead + [first + timedelta(days=30 * 11)]] + [("b", first, 1.0)], DAILY)
    kept_daily, kept_samples = op.model_window_inputs(samples, daily)
    assert {r["date"] for r in kept_daily.collect()} == set(lead[1:]) | {first + timedelta(days=330)}
    # The last sample lies on the last discharge day, which is excluded.
    assert kept_samples.count() == 11
    assert op.model_window_inputs(samples, daily, inclusive=True)[1].count() == 12


def test_final_filter_removes_outliers_then_short_sites(make):
    years = [day(365 * y + i) for y in range(10) for i in range(7)]
    rows = [("long", d, 1.0 + 0.01 * (i % 5)) for i, d in enumerate(years)] + [("long", day(3), 1000.0)]
    rows += [("few", d, 1.0) for d in years[:59]] + [("young", day(n), 1.0) for n in range(70)]
    samples = make(rows, SAMPLES)
    daily = make(series("long", [-3653, -3654, 0, 9999]) + series("few", [0]) + series("young", [0]), DAILY)
    kept, flow = op.final_record_filter(samples, daily)
    assert {r["site_no"] for r in kept.collect()} == {"long"}
    assert kept.count() == 70
    assert sorted(r["date"] for r in flow.collect()) == [day(-3653), day(0)]


def test_final_filter_spreads_a_site_with_most_rows(spark, make):
    rng = random.Random(4)
    rows = [("hot", day(rng.randrange(9000)), rng.choice([None, 1.0, 2.0, rng.random(), 400.0])) for _ in range(4000)]
    rows += [(f"s{i % 9}", day(rng.randrange(9000)), rng.random()) for i in range(900)] + [("same", day(5), 1.0)] * 80 + [(None, day(1), 1.0)]
    flow = [(s, day(rng.randrange(-5000, 12000)), 1.0) for s in ("hot", "s1", "same", "gone") for _ in range(300)]
    # The rules once more, row by row.
    sites, want = {}, []
    for r in rows:
        sites.setdefault(r[0], []).append(r)
    span = {}
    for site, own in sites.items():
        values = [v for _, _, v in own if v is not None]
        cutoff = statistics.mean(values) + 2 * statistics.stdev(values) if len(values) > 1 else float("-inf")
        kept = [r for r in own if r[2] is not None and r[2] <= cutoff]
        if site is not None and len(kept) >= 60 and len({d.year + (d.month >= 10) for _, d, _ in kept}) >= 2:
            want += kept
            span[site] = (min(d for _, d, _ in own) - timedelta(days=3653), max(d for _, d, _ in own))
    assert {"hot", "s1"} <= set(span) and "same" not in span
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        samples, daily = op.final_record_filter(make(rows, SAMPLES), make(flow, DAILY), sd_k=2, min_years=2)
        assert sorted(map(tuple, samples.collect())) == sorted(want)
        assert sorted(map(tuple, daily.collect())) == sorted(r for r in flow if r[0] in span and span[r[0]][0] <= r[1] <= span[r[0]][1])
        tasks = samples.where("site_no = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in tasks) < 0.5 * sum(r["count"] for r in tasks)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_extra_inputs_are_added_by_name(make):
    a, b = make(series("a", range(3)), SAMPLES), make([("b", day(0), 2.0, "x")], SAMPLES + ", note string")
    daily = make(series("a", [0]) + series("b", [0]), DAILY)
    kept, _ = op.final_record_filter(a, daily, min_obs=1, min_years=1, more_samples=[b])
    assert "note" in kept.columns
    assert kept.where("site_no = 'a'").count() == 3


def test_record_summary(make):
    samples = make(series("a", [0, 70]) + series("b", [0, 7]) + series("c", [3, 4]), SAMPLES)
    daily = make([("a", day(0), 1.0), ("a", day(1), 3.0), ("b", day(0), 0.0), ("c", day(0), 5.0)], DAILY)
    rows = collect(op.record_summary(samples, daily), "site_no")
    assert [(r["display_rank"], r["median_q"]) for r in rows] == [(1, 2.0), (1, 0.0), (2, 5.0)]
    assert rows[0]["num_years"] == pytest.approx(10 / 52.25) and rows[1]["ln_median_q"] is None


def test_fill_gaps(make):
    daily = make(
        [("a", day(0), 1.0), ("a", day(4), 9.0), ("a", day(2), None), ("b", day(0), 2.0), ("n", day(0), None), ("n", day(2), 4.0), ("n", day(3), None)],
        DAILY,
    )
    assert [r["site_no"] for r in op.missing_day_sites(daily).orderBy("site_no").collect()] == ["a", "n"]
    filled = op.fill_daily_gaps(daily)
    rows = [(r["site_no"], r["date"], r["filled_q"], r["interp_flag"]) for r in filled.orderBy("site_no", "date").collect()]
    assert rows == [
        ("a", day(0), 1.0, "no"), ("a", day(1), 3.0, "yes"), ("a", day(2), 5.0, "yes"), ("a", day(3), 7.0, "yes"), ("a", day(4), 9.0, "no"),
        ("b", day(0), 2.0, "no"),
        ("n", day(0), None, "yes"), ("n", day(1), None, "yes"), ("n", day(2), 4.0, "no"), ("n", day(3), None, "yes"),
    ]
    assert {r["site_no"]: r["max_run"] for r in op.interpolated_runs(filled).collect()} == {"a": 3, "b": 0, "n": 2}


def test_long_gap_policy(make):
    daily = make(series("long", [0, 60, 61]) + series("gone", [0, 60]) + series("short", [0, 3]), DAILY)
    samples = make(series("long", [5]) + series("gone", [5]) + series("short", [2]), SAMPLES)
    whole = make(series("whole", [0, 1]) + series("short", [0]) + series("gone", [0]), DAILY)
    flow, kept = op.resolve_long_gaps(op.fill_daily_gaps(daily), samples, exclude=["gone"], complete=whole)
    days = {}
    for r in flow.collect():
        days.setdefault(r["site_no"], set()).add(r["date"])
    assert days == {"long": {day(n) for n in range(6, 62)}, "short": {day(n) for n in range(4)}, "whole": {day(0), day(1)}}
    assert {r["site_no"] for r in kept.collect()} == {"long", "short"}
    overlay = op.sample_overlay(op.fill_daily_gaps(daily), samples)
    assert {r["site_no"] for r in overlay.collect()} == {"long", "gone"}
    assert overlay.where("cond is not null").count() == 2


def test_results_do_not_depend_on_partitions(spark, make):
    df = make(series("a", [0, 3, 9, 800, 805, 1700]) + series("b", range(40)), SAMPLES)

    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return collect(op.sample_segments(df, min_obs=1), "site_no", "sample_dt")

    try:
        assert run("1") == run("7")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
