import pytest
from pyspark.sql import functions as F

from conftest import collect
from gaugeflow import operators as op
from gaugeflow.operators.harmonise import CLIMATE_DRIVERS, DRIVER_SETS, SITE_DRIVERS

RES = "site_no string, water_year int, q5_norm double, pred double, residual double"
PANEL = ["bf_prop", "q5", "drain_area_va", *DRIVER_SETS["full"]]
PANEL_SCHEMA = "site_no string, water_year int, zone string, " + ", ".join(f"{c} double" for c in PANEL)


@pytest.fixture(scope="module")
def classes(spark):
    a = spark.createDataFrame([("s", 1, 4.0, 1.0, 3.0), ("s", 2, 4.0, 2.0, 2.0), ("s", 3, 4.0, 3.0, 1.0), ("t", 1, 2.0, 2.5, -0.5)], RES)
    b = spark.createDataFrame([("s", 1, 4.0, 3.5, 0.5), ("s", 2, 4.0, 1.5, 2.5), ("s", 3, 4.0, 2.9, 1.1)], RES)
    return op.residual_classes(a, b)


def test_classes(classes):
    rows = collect(classes, "site_no", "water_year")
    assert [r["class_a"] for r in rows] == ["poor prediction", "poor prediction", "good prediction", "good prediction"]
    assert [r["pos_neg"] for r in rows] == ["positive", "negative", "negative", None]
    counts = {r["label"]: (r["n"], r["share"]) for r in op.residual_class_counts(classes).collect()}
    assert counts["a poor"] == (2, 0.5) and counts["b poor"] == (1, 0.25) and counts["in range"] == (1, 0.25)
    means = {r["model"]: r["mean_abs_residual"] for r in op.poor_residual_means(classes).collect()}
    assert means == {"a": 2.5, "b": 2.5}


def test_zone_reports(classes):
    joined = op.flow_condition(classes.withColumns({"q5": F.col("q5_norm") * F.col("water_year"), "zone": F.lit("Arid")}))
    flow = {(r["site_no"], r["water_year"]): r["flow"] for r in joined.collect()}
    assert flow == {("s", 1): "low", ("s", 2): "median", ("s", 3): "high", ("t", 1): "median"}
    site = {r["site_no"]: (r["n_obs"], r["n_improved"]) for r in op.site_improvement(joined).collect()}
    assert site == {"s": (3, 1), "t": (1, 0)}
    zone = op.zone_class_shares(joined).first()
    assert (zone["poor_share"], zone["low_share"], zone["median_share"], zone["high_share"]) == (0.5, 0.25, 0.5, 0.25)
    levels = {(r["level"], r["flow"]): r for r in op.improvement_by_zone_flow(joined).collect()}
    assert set(levels) == {("zone_flow", "Low Flow"), ("zone", None), ("all", None)}
    assert levels[("zone", None)]["improved_share"] == 0.25 and levels[("all", None)]["share_of_poor"] == 0.5
    assert levels[("zone_flow", "Low Flow")]["flow_order"] == 1 and levels[("zone", None)]["zone_order"] == 1
    rel = op.relative_improvement(joined).first()
    assert rel["median_rel_gain"] == pytest.approx(2.5 / 4)
    assert rel["mean_ratio"] == pytest.approx(((2.5 - 0.5 - 0.1) / 3) / 3.5)


def test_zones_without_improvement_stay_in_the_zone_level(classes):
    joined = op.flow_condition(classes.withColumns({"q5": F.col("q5_norm"), "zone": F.when(F.col("site_no") == "t", "Subarctic").otherwise("Arid")}))
    rows = {(r["level"], r["zone"]): r["n_improved"] for r in op.improvement_by_zone_flow(joined).where("level <> 'zone_flow'").collect()}
    assert rows == {("zone", "Arid"): 1, ("zone", "Subarctic"): 0, ("all", None): 1}
    medians = {r["zone"]: r["median_rel_gain"] for r in op.relative_improvement(joined).collect()}
    assert medians["Subarctic"] is None and medians["Arid"] is not None


def test_snow_and_aridity(classes):
    joined = classes.withColumns({
        "zone": F.lit("z"), "peak_swe_mm": F.lit(2.0), "annual_precip_mm": F.lit(8.0), "annual_evap_mm": F.when(F.col("water_year") == 1, 0.0).otherwise(4.0)
    })
    rows = collect(op.snow_aridity_residual(joined), "water_year")
    assert [(r["snow_frac"], r["aridity"]) for r in rows] == [(0.25, None), (0.25, 2.0)]
    assert rows[0]["ln_rel_gain"] == pytest.approx(-0.470003629) and rows[1]["ln_rel_gain"] is None


def panel_row(site, year, **values):
    base = {c: float(year % 7 + i) for i, c in enumerate(PANEL)} | values
    return (site, year, "z", *[base[c] for c in PANEL])


def test_model_frame(make):
    rows = [panel_row("a", 2000, q5=3.0, drain_area_va=100.0), panel_row("a", 2001, sdd=None), panel_row("b", 2000), panel_row("x", 2000)]
    rows.append(("no zone", 2000, None, *panel_row("a", 2000)[3:]))
    panel = make(rows, PANEL_SCHEMA)
    full = op.model_frame(panel, exclude=["x"])
    assert full.columns == ["site_no", "water_year", "q5_norm", *DRIVER_SETS["full"]] and len(DRIVER_SETS["full"]) == 11
    got = collect(full, "site_no")
    assert [(r["site_no"], r["water_year"]) for r in got] == [("a", 2000), ("b", 2000)]
    assert got[0]["q5_norm"] == pytest.approx(3.0 / (100 * 2.58999e6) * 86400000)
    climate = op.model_frame(panel, "climate", units="per_area")
    assert climate.columns[3:] == list(CLIMATE_DRIVERS) and collect(climate, "site_no")[0]["q5_norm"] == pytest.approx(0.03)
    assert len(op.model_frame(panel, "no_baseflow").columns) == 13
    with pytest.raises(ValueError):
        op.model_frame(panel, units="furlong")


def test_harmonise_keeps_every_fact(make):
    facts = make([("a", 1, 0.2), ("a", 2, 0.4), ("b", 1, None)], "site_no string, water_year int, bf_prop double")
    annual = make([("a", 1, 5.0)], "site_no string, water_year int, rain double")
    static = make([("b", "Arid")], "site_no string, zone string")
    rows = collect(op.harmonise(facts, [annual], [static]), "site_no", "water_year")
    assert [(r["rain"], r["zone"]) for r in rows] == [(5.0, None), (None, None), (None, "Arid")]
    assert rows[0]["mean_bf"] == pytest.approx(0.3) and rows[2]["mean_bf"] is None


def test_record_tables(make):
    rows = [panel_row("a", y) for y in (1949, 1950, 1952)] + [panel_row("b", y) for y in (1951, 1950)] + [panel_row("c", 1960, sdd=None), panel_row("c", 1961)]
    panel = make(rows, PANEL_SCHEMA)
    grid = collect(op.record_grid(panel), "site_no", "water_year")
    assert [(r["site_no"], r["water_year"], r["first_year"], r["display_rank"], r["is_first_row"]) for r in grid] == [
        ("a", 1950, 1950, 1, True), ("a", 1952, 1950, 1, False), ("b", 1950, 1950, 1, True), ("b", 1951, 1950, 1, False), ("c", 1961, 1961, 2, True)
    ]
    profile = {r["site_no"]: (r["num_years"], r["min_year"], r["max_year"]) for r in op.site_profile(panel).collect()}
    assert profile == {"a": (3, 1949, 1952), "b": (2, 1950, 1951), "c": (2, 1960, 1961)}


def test_histograms_use_one_row_per_site_for_site_drivers(make):
    rows = [panel_row("a", y, mean_slope=1.0, sdd=float(y)) for y in (2000, 2001, 2002)] + [panel_row("b", 2000, mean_slope=9.0)]
    hist = op.driver_histograms(make(rows, PANEL_SCHEMA), bins=4).groupBy("variable").agg(F.sum("n").alias("n"))
    n = {r["variable"]: r["n"] for r in hist.collect()}
    assert n["Basin Slope (degrees)"] == 2 and n["Snow Disappearance Day (DOY)"] == 4 and n["ln_area"] == 2
    assert len(n) == 15


def test_correlation_takes_the_first_year_of_a_site(make):
    first = {"a": 2.0, "b": 1.0, "c": 5.0}
    rows = [panel_row(s, y, mean_slope=v, sdd=first[s] + 10 * (y - 2000)) for s, v in (("a", 1.0), ("b", 2.0), ("c", 3.0)) for y in (2000, 2001)]
    pairs = {(r["var_1"], r["var_2"]): r["r"] for r in op.driver_correlation(make(rows, PANEL_SCHEMA)).collect()}
    assert len(pairs) == 66 and pairs[("sdd", "sdd")] == pytest.approx(1)
    x, y = [1, 2, 3], [2, 1, 5]
    import numpy as np

    assert pairs[("sdd", "mean_slope")] == pytest.approx(np.corrcoef(x, y)[0, 1])
