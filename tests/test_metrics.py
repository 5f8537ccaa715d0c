from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import collect, day
from gaugeflow import operators as op
from gaugeflow.functions.aggregates import bind_map, map_names

DAILY = "site_no string, date date, q double"
LONG = "site_no string, dates date, value double"


def year_of(site, wy, value=lambda n: 1.0 + n, skip=()):
    first = date(wy - 1, 10, 1)
    n_days = (date(wy, 10, 1) - first).days
    return [(site, first + timedelta(days=n), float(value(n))) for n in range(n_days) if n not in skip]


def test_complete_years_count_distinct_days(make):
    rows = year_of("a", 2001) + year_of("b", 2001, skip=[5]) + [("b", date(2000, 10, 2), 1.0)] + year_of("c", 2004, skip=[0])
    kept = op.complete_water_years(make(rows, DAILY))
    # b has 365 rows but 364 days; c is a leap year with one day missing.
    assert {r["site_no"] for r in kept.select("site_no").distinct().collect()} == {"a", "c"}
    assert "_days" not in kept.columns


def test_low_flow_with_null_policy(make):
    rows = [("a", date(y, 9, d), float(y - 1999 + d)) for y in (2000, 2001) for d in (1, 2)] + [("a", date(2001, 9, 3), None)]
    rows += [("b", date(y, 9, 1), float(y - 1999)) for y in (2000, 2001)]
    got = collect(op.low_flow_q5(make(rows, DAILY), null_policy="propagate"), "site_no", "year")
    assert [r["q5"] for r in got] == [pytest.approx(2.05), None, 1.0, 2.0]
    assert [r["norm_q5"] for r in got] == [None, None, 0.0, 1.0]
    skipped = collect(op.low_flow_q5(make(rows, DAILY)), "site_no", "year")
    assert [r["norm_q5"] for r in skipped] == [0.0, 1.0, 0.0, 1.0]
    with pytest.raises(ValueError):
        op.low_flow_q5(make(rows, DAILY), null_policy="poison")


def test_panel_and_summary_with_null_policy(make):
    facts = make([("a", 2000, 0.2), ("a", 2001, None), ("b", 2000, 0.4), ("b", 2001, 0.6)], "site_no string, water_year int, bf_prop double")
    means = lambda **how: [r["mean_bf"] for r in collect(op.harmonise(facts, **how), "site_no", "water_year")]
    assert means() == pytest.approx([0.2, 0.2, 0.5, 0.5])
    assert means(null_policy="propagate")[:2] == [None, None] and means(null_policy="propagate")[2:] == pytest.approx([0.5, 0.5])
    samples = make([("a", day(0), 1.0), ("b", day(0), 1.0)], "site_no string, sample_dt date, result_va double")
    daily = make([("a", day(0), 1.0), ("a", day(1), None), ("b", day(0), 3.0)], DAILY)
    assert [r["median_q"] for r in collect(op.record_summary(samples, daily, "propagate"), "site_no")] == [None, 3.0]


def test_low_flow_uses_calendar_year(make):
    rows = year_of("a", 2001) + year_of("a", 2002)
    got = collect(op.low_flow_q5(make(rows, DAILY)), "site_no", "year")
    values = {}
    for _, d, v in rows:
        if 8 <= d.month <= 10:
            values.setdefault(d.year, []).append(v)
    assert [r["year"] for r in got] == [2000, 2001, 2002]
    for r in got:
        assert r["q5"] == pytest.approx(np.quantile(values[r["year"]], 0.05))
    assert {r["norm_q5"] for r in got} >= {0.0, 1.0}


def test_separation_and_annual_baseflow(make):
    est = make(
        [("a", day(0), 2.0, 30.0), ("a", day(1), 0.0, 60.0), ("a", day(400), 1.0, 5.0), ("z", day(0), 1.0, 1.0)],
        "site_no string, date date, q double, gen_conc double",
    )
    members = make([("a", 10.0, 50.0), ("z", 4.0, 4.0)], "site_no string, runoff double, gw double")
    rows = collect(op.baseflow_separation(est, members), "site_no", "date")
    assert [(r["bf"], r["bf_percent"]) for r in rows] == [(1.0, 0.5), (0.0, None), (-0.125, -0.125), (None, None)]
    annual = op.annual_baseflow(op.baseflow_separation(est, members), min_years=2)
    assert [(r["site_no"], r["water_year"], r["median_bf"]) for r in collect(annual, "water_year")] == [("a", 2001, 0.5), ("a", 2002, -0.125)]
    strict = op.annual_baseflow(op.baseflow_separation(est, members), min_years=2, null_policy="propagate")
    assert collect(strict, "water_year")[0]["median_bf"] is None
    flags = op.baseflow_out_of_range(annual)
    assert flags.first()["flag"] == "flag" and op.in_range_sites(annual, flags).count() == 0


def test_end_members_agree_with_the_bounded_form(make):
    rng = np.random.default_rng(3)
    df = make([("a", day(i), float(v)) for i, v in enumerate(rng.lognormal(size=500))], "site_no string, sample_dt date, result_va double")
    a, b = op.end_members(df).first(), op.end_members(df, one_per_day=True).first()
    assert (a["runoff"], a["gw"]) == pytest.approx((b["runoff"], b["gw"]))


def test_normalised_drops_incomplete_years_first(make):
    bf = make([("a", y, 0.5) for y in (2001, 2002, 2003)] + [("f", 2001, 0.1), ("f", 2002, 0.1)], "site_no string, water_year int, median_bf double")
    q5 = make(
        [("a", 2001, 1.0, 0.0), ("a", 2002, 3.0, 0.0), ("a", 1990, 99.0, 0.0), ("f", 2001, 2.0, 0.0), ("f", 2002, 2.0, 0.0)],
        "site_no string, year int, q5 double, norm_q5 double",
    )
    rows = collect(op.low_flow_normalised(bf, q5), "site_no", "water_year")
    assert [(r["site_no"], r["norm_minmax"], r["diff_mean_lowflow"]) for r in rows] == [("a", 0.0, -0.5), ("a", 1.0, 0.5), ("f", None, 0.0), ("f", None, 0.0)]
    assert rows[0]["norm_zscore"] == pytest.approx(-1 / np.sqrt(2)) and rows[2]["norm_zscore"] is None
    assert [(r["water_year"], r["n"]) for r in op.driest_year_tally(op.low_flow_normalised(bf, q5)).collect()] == [(2001, 1)]
    joined = collect(op.site_year_stats(bf, q5), "site_no", "water_year")
    assert [r["q5"] for r in joined] == [1.0, 3.0, None, 2.0, 2.0]


def test_recession_filter_and_zero_flow(make):
    q = [10.0, 9.0, 5.0, 4.5, 0.0, 0.0, 3.0, 2.7]
    daily = make([("a", day(i), v) for i, v in enumerate(q)] + [("one", day(0), 1.0)], DAILY)
    points = collect(op.recession_points(daily), "date")
    # 5.0 and 0.0 fall too steeply; the zero after a zero is undefined; 3.0 rises from zero.
    assert [r["date"] for r in points] == [day(1), day(3), day(7)]
    fit = op.recession_slope(daily).first()
    assert fit["recession_curve_slope"] == pytest.approx(np.polyfit([9.0, 4.5, 2.7], [1.0, 0.5, 0.3], 1)[0])
    # Changes between the kept rows 9, 4.5, 3 and 2.7.
    assert op.flashiness_index(daily).first()["rbfi"] == pytest.approx((4.5 + 1.5 + 0.3) / (4.5 + 3 + 2.7))
    steps = np.abs(np.diff(q))
    assert op.flashiness_index(daily, standard=True).first()["rbfi"] == pytest.approx(steps.sum() / sum(q[1:]))


def test_recession_rate_uses_the_days_between_rows(make):
    daily = make([("a", day(0), 10.0), ("a", day(4), 8.0)], DAILY)
    assert op.recession_points(daily).first()["ln_recession"] == pytest.approx(np.log(0.5))


def brute_drawdown(rows, area, et, p, k=7):
    rows = [r for r in sorted(rows, key=lambda r: r[1])]
    years = {}
    for r in rows:
        wy = r[1].year + (r[1].month >= 10)
        years.setdefault(wy, []).append(r)
    kept = [r for wy in sorted(years) if len(years[wy]) == 365 for r in years[wy]]
    smooth = {r[1]: (np.mean([x[2] for x in kept[i - k + 1 : i + 1]]) if i >= k - 1 else None) for i, r in enumerate(kept)}
    out = {}
    for wy, days in years.items():
        if len(days) != 365:
            continue
        share = np.cumsum([d[2] for d in days]) / sum(d[2] for d in days)
        late = [d for d, s in zip(days, share) if s > 0.4]
        top = max(smooth[d[1]] for d in late)
        start = next(i for i, d in enumerate(late) if smooth[d[1]] == top)
        total = 0.0
        for d in late[start:]:
            total += p * 1000 - d[2] * 86400 * 1000 / (area * 2.59e6) - et * -1000
            out[d[1]] = total
    return out


def test_storage_drawdown_against_brute_force(make):
    rng = np.random.default_rng(5)
    rows = [r for wy in (2001, 2002, 2004) for r in year_of("a", wy, lambda n: float(rng.integers(1, 50)))]
    climate = lambda v: make([("a", r[1], v) for r in rows], LONG)
    area = make([("a", 120.0)], "site_no string, drain_area_va double")
    got = op.storage_drawdown(make(rows, DAILY), area, climate(-0.001), climate(0.002))
    want = brute_drawdown(rows, 120.0, -0.001, 0.002)
    found = {r["date"]: r["ds_sum"] for r in got.collect()}
    assert set(found) == set(want)
    for d in want:
        assert found[d] == pytest.approx(want[d])
    assert all(d.year + (d.month >= 10) != 2004 for d in found)


def test_wide_to_long_and_drift(spark, make):
    wide = make([("2000-10-01", 1.0, 2.0), ("1/2/55", 3.0, None)], "dates string, `X1234567..` double, `X09380000.1` double")
    long = op.climate_wide_to_long(wide)
    got = {(r["site_no"], r["dates"]): r["value"] for r in long.collect()}
    assert got[("01234567", date(2000, 10, 1))] == 1.0 and got[("09380000", date(2055, 1, 2))] is None
    assert len(got) == 4
    fixed = op.two_digit_year_fix(long)
    assert {r["dates"].year for r in fixed.collect()} == {2000, 1955}


def test_files_merge_from_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("dates,X01..,X02..\n2000-01-01,1,2\n")
    (tmp_path / "b.csv").write_text("dates,XA,XB\n1/5/99,3,4\n")
    (tmp_path / "c.csv").write_text("dates,X01..,X03..\n2000-01-03,5,NA\n")
    paths = [str(tmp_path / f"{n}.csv") for n in "abc"]
    merged = op.climate_files_merge(paths, {1: {"names_from": 0, "date_format": "M/d/yy"}}, spark=spark)
    assert merged.columns == ["dates", "X01..", "X02..", "X03.."]
    got = {(r["site_no"], r["dates"]): r["value"] for r in op.climate_wide_to_long(merged).where("value is not null").collect()}
    assert got == {
        ("001", date(2000, 1, 1)): 1.0, ("002", date(2000, 1, 1)): 2.0, ("001", date(2099, 1, 5)): 3.0,
        ("002", date(2099, 1, 5)): 4.0, ("001", date(2000, 1, 3)): 5.0,
    }


def test_annual_climate(make):
    df = make([("a", date(2000, 9, 30), 1.0), ("a", date(2000, 10, 1), 2.0), ("a", date(2000, 10, 2), None)], LONG)
    assert [r["annual_evap_mm"] for r in collect(op.annual_evaporation(df), "water_year")] == [-1000.0, -2000.0]
    assert [r["annual_precip_mm"] for r in collect(op.annual_precipitation(df, "propagate"), "water_year")] == [1000.0, None]
    assert [r["mean_temp_c"] for r in collect(op.annual_temperature(df), "water_year")] == pytest.approx([1 - 273.15, 2 - 273.15])


def test_snow(make):
    def year(site, values):
        return [(site, day(i), v) for i, v in enumerate(values)]

    rows = year("melt", [0.0, 2.0, 5.0, 5.0, 1.0, 0.0, 0.0, 1.0] + [0.0] * 7)
    rows += year("never", [0.0, 2.0, 0.0, 0.0]) + year("bare", [-1.0] * 9)
    swe = make(rows, LONG)
    peak = {r["site_no"]: (r["peak_swe_day"], r["peak_swe_mm"]) for r in op.peak_snow(swe).collect()}
    assert peak == {"melt": (3, 5000.0), "never": (2, 2000.0), "bare": (1, 0.0)}
    off = {r["site_no"]: (r["sdd"], r["melt_days"], r["melt_rate"]) for r in op.snow_disappearance(swe, op.peak_snow(swe)).collect()}
    assert off == {"melt": (9, 6, 5000.0 / 6), "bare": (2, 1, 0.0)}


def test_landscape(make):
    cover = make([("a", 2000, "x", 1.0), ("a", 2000, "y", 3.0), ("b", 2000, "x", 2.0)], "site_no string, year int, class string, area double")
    parts = [cover.where("site_no = 'a'"), cover.where("site_no = 'b'")]
    rows = collect(op.class_proportions(parts, ["x", "y"]), "site_no")
    assert rows == [{"site_no": "a", "year": 2000, "x": 0.25, "y": 0.75}, {"site_no": "b", "year": 2000, "x": 1.0, "y": None}]
    geo = make([("a", "l", 0.5), ("a", "l", 0.495), ("b", "l", 0.5), ("b", "m", None)], "site_no string, lith string, proportion double")
    long = {(r["site_no"], r["class"]): r["share"] for r in op.class_proportions(parts).collect()}
    assert long == {("a", "x"): 0.25, ("a", "y"): 0.75, ("b", "x"): 1.0}
    assert {(r["site_no"], r["lith"]): r["proportion"] for r in op.geology_proportions(geo).collect()} == {("a", "l"): 0.995, ("b", "l"): 0.5, ("b", "m"): None}
    wide = op.geology_proportions(geo, ["l", "m"])
    assert [r["site_no"] for r in op.complete_composition(wide, ["l", "m"]).collect()] == ["a"]
    sites = make([("a", 40.1, -110.3), ("far", 10.0, 10.0)], "site_no string, lat double, lon double")
    grid = make([(40.25, -110.25, 7)], "lat double, lon double, zone_code int")
    names = make([(7, "Arid")], "zone_code int, zone string")
    found = op.climate_zone_lookup(sites, grid, names)
    assert [(r["site_no"], r["zone"]) for r in found.collect()] == [("a", "Arid")]
    assert op.sites_per_zone(found).first()["n_sites"] == 1
    basin = make([(100.0, 200.0)], "`X01..` double, `X02..` double")
    assert {r["site_no"]: r["slope"] for r in op.basin_attribute(basin, "slope").collect()} == {"01": 100.0, "02": 200.0}


def test_sentinel_and_backfill(make):
    df = make([("a", 1, -999, None), ("a", 2, 4, 2.0), ("a", 3, None, None), ("b", 1, 5, None)], "site_no string, water_year int, n int, v double")
    rows = collect(op.sentinel_to_null(df, ["n"]), "site_no", "water_year")
    assert [r["n"] for r in rows] == [None, 4, None, 5]
    rows = collect(op.backfill_series(df, ["v"]), "site_no", "water_year")
    assert [r["v"] for r in rows] == [2.0, 2.0, None, None]


def test_a_class_no_list_knows_survives_to_the_panel(make):
    cover = make(
        [("a", 2000, "x", 1.0), ("a", 2000, "new", 3.0), ("a", 2002, "x", 2.0), ("a", 2002, "y", 2.0), ("b", 2001, None, 4.0), ("b", 2002, "x", 0.0)],
        "site_no string, year int, class string, area double",
    )
    facts = make([(s, y, None) for s in "ab" for y in range(2000, 2004)], "site_no string, water_year int, bf_prop double")
    maps = op.class_maps([cover]).withColumnRenamed("year", "water_year")
    panel = op.harmonise(facts, annual=[maps])
    rows = {(r["site_no"], r["water_year"]): r["shares"] for r in panel.collect()}
    assert rows[("a", 2000)] == {"new": 0.75, "x": 0.25} and rows[("b", 2001)] == {"": 1.0}
    assert rows[("b", 2002)] == {"x": None} and rows[("a", 2003)] is None
    filled = op.backfill_maps(panel, "shares")
    rows = {(r["site_no"], r["water_year"]): r["shares"] for r in filled.collect()}
    assert rows[("a", 2000)] == {"new": 0.75, "x": 0.25, "y": 0.5} and rows[("a", 2001)] == {"x": 0.5, "y": 0.5}
    assert rows[("a", 2003)] == {} and rows[("b", 2000)] == {"": 1.0} and rows[("b", 2002)] == {}
    bound = {(r["site_no"], r["water_year"]): (r["c_x"], r["c_other"]) for r in bind_map(filled, "shares", ["x"], "c_", other="other").collect()}
    assert bound[("a", 2000)] == (0.25, 1.25) and bound[("a", 2003)] == (None, None) and bound[("b", 2001)] == (None, 1.0)
    assert map_names(filled, "shares") == ["", "new", "x", "y"]
    with pytest.raises(ValueError, match="more than 2"):
        map_names(filled, "shares", most=2)
    assert op.class_maps([cover.limit(0)]).collect() == []


def test_several_daily_columns_are_filled_like_each_alone(make):
    rows = [("a", day(0), None, 1.0), ("a", day(3), 3.0, None), ("a", day(4), None, 9.0), ("a", day(9), 15.0, None), ("a", day(11), None, 2.0), ("b", day(5), None, None)]
    df = make(rows, "site_no string, date date, q double, c double")
    both = {(r["site_no"], r["date"]): (r["q"], r["c"]) for r in op.fill_daily_columns(df, ["q", "c"]).collect()}
    for place, name in enumerate("qc"):
        alone = op.fill_daily_gaps(df.select("site_no", "date", df[name].alias("q")))
        assert {(r["site_no"], r["date"]): r["filled_q"] for r in alone.collect()} == {k: v[place] for k, v in both.items()}
