"""All steps on one small record: each operator takes what the one before returns."""

from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from gaugeflow import operators as op
from gaugeflow.operators.model import predict
from gaugeflow.session import cut_lineage

FIRST = date(1990, 10, 1)
YEARS = 11


def records(site, seed):
    rng = np.random.default_rng(seed)
    days = [FIRST + timedelta(days=n) for n in range(int(365.25 * YEARS))]
    season = np.array([np.cos(2 * np.pi * (d.timetuple().tm_yday - 100) / 365) for d in days])
    q = np.exp(1.5 + season + 0.3 * rng.normal(size=len(days)))
    conc = np.exp(5 - 0.4 * np.log(q) + 0.1 * rng.normal(size=len(days)))
    missing = set(range(1000, 1020))
    daily = [(site, d, float(v)) for i, (d, v) in enumerate(zip(days, q)) if i not in missing]
    samples = [(site, days[i], float(conc[i])) for i in range(5, len(days), 13)]
    climate = [(site, d, float(-0.001 - 0.0005 * s), float(0.003 + 0.001 * s), float(280 + 5 * s), float(max(0, 0.05 * (s - 0.2)))) for d, s in zip(days, season)]
    return daily, samples, climate


def test_from_screening_to_attribution(spark):
    parts = [records(s, i) for i, s in enumerate(("01", "02", "03"))]
    frame = lambda k, schema: cut_lineage(spark.createDataFrame([r for p in parts for r in p[k]], schema))
    daily = frame(0, "site_no string, date date, q double")
    samples = frame(1, "site_no string, sample_dt date, result_va double")
    climate = frame(2, "site_no string, dates date, et double, p double, t double, swe double")
    metric = lambda c: climate.select("site_no", "dates", F.col(c).alias("value"))

    good = op.site_screen_counts(samples, daily).join(op.site_screen_continuity(samples, daily).where("keep = 'Good'"), "site_no")
    assert good.count() == 3
    segments = op.sample_segments(samples)
    unbroken = op.segment_classes(segments).where("segment_class = 'no_break'")
    inputs, sampled = op.model_window_inputs(segments.join(unbroken.select("site_no"), "site_no", "left_semi"), daily)
    sampled, inputs = op.final_record_filter(sampled.select("site_no", "sample_dt", "result_va"), inputs)
    assert op.missing_day_sites(inputs).count() == 3
    flow, sampled = op.resolve_long_gaps(op.fill_daily_gaps(inputs), sampled)
    flow, sampled = cut_lineage(flow), cut_lineage(sampled)
    assert op.record_summary(sampled, flow).count() == 3

    estimate = cut_lineage(op.residual_bridge(op.concentration_surface(sampled, flow), sampled))
    errors = op.estimate_errors(estimate, sampled, estimate="conc").collect()
    assert len(errors) == 3 and all(r["r2_log_conc"] > 0.8 and abs(r["flux_bias"]) < 0.05 for r in errors)

    separated = op.baseflow_separation(estimate, op.end_members(sampled))
    annual = op.annual_baseflow(op.complete_water_years(separated))
    q5 = op.low_flow_q5(op.complete_water_years(flow))
    facts = op.in_range_sites(op.site_year_stats(annual, q5), op.baseflow_out_of_range(annual))
    info = spark.createDataFrame([("01", 100.0, 1000.0, 5.0, "Arid"), ("02", 200.0, 1500.0, 9.0, "Arid"), ("03", 50.0, 500.0, 2.0, "Subarctic")],
                                 "site_no string, drain_area_va double, mean_elevation double, mean_slope double, zone string")
    swe = metric("swe")
    panel = cut_lineage(op.harmonise(
        facts,
        [op.annual_evaporation(metric("et")), op.annual_precipitation(metric("p")), op.annual_temperature(metric("t")),
         op.snow_disappearance(swe, op.peak_snow(swe))],
        [info, op.recession_slope(flow).select("site_no", "recession_curve_slope")],
    ))
    drawdown = op.storage_drawdown(flow, info, metric("et"), metric("p"))
    assert drawdown.select("site_no").distinct().count() == 3

    model_rows = cut_lineage(op.model_frame(panel))
    assert model_rows.count() >= 27
    reduced = cut_lineage(op.model_frame(panel, "climate"))
    full = op.forest_fit(model_rows, trees=5, max_depth=4)
    classes = op.residual_classes(predict(op.forest_fit(reduced, trees=5, max_depth=4), reduced), predict(full, model_rows))
    joined = op.flow_condition(classes.join(panel.drop("q5_norm"), ["site_no", "water_year"]))
    assert op.improvement_by_zone_flow(joined).where("level = 'all'").count() == 1
    shap = op.shapley_sampling(full, model_rows, samples=5)
    assert op.mean_abs_shap(shap, None, classes).select("feature").distinct().count() == 11
    assert op.shap_dependence(shap, panel, "peak_swe_mm").count() == model_rows.count()
