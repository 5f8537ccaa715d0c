from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import collect, day
from gaugeflow import operators as op
from gaugeflow.functions.columns import decimal_year
from gaugeflow.operators.model import predict, residual_summary
from gaugeflow.session import cut_lineage

SAMPLES = "site_no string, sample_dt date, result_va double"
DAILY = "site_no string, date date, q double"


@pytest.fixture(scope="module")
def record(spark):
    """Ten years of daily flow and a sample every twelfth day from a known log-linear surface."""
    rng = np.random.default_rng(7)
    first = date(2001, 1, 1)
    days = [first + timedelta(days=n) for n in range(3650)]
    frame = spark.createDataFrame([(d,) for d in days], "date date").select("date", decimal_year("date").alias("t")).toPandas()
    t = frame["t"].to_numpy()
    q = np.exp(2 + 0.8 * np.cos(2 * np.pi * t) + 0.4 * rng.normal(size=len(t)))
    truth = 3 + 0.02 * (t - 2005) - 0.3 * np.log(q) + 0.1 * np.sin(2 * np.pi * t) + 0.2 * np.cos(2 * np.pi * t)
    daily = spark.createDataFrame([("a", d, float(v)) for d, v in zip(days, q)], DAILY).cache()
    samples = spark.createDataFrame([("a", d, float(np.exp(y))) for d, y in list(zip(days, truth))[6::12]], SAMPLES).cache()
    return daily, samples, pd.DataFrame({"date": days, "t": t, "q": q, "truth": truth})


def test_surface_recovers_planted_coefficients(record):
    daily, samples, known = record
    got = op.concentration_surface(samples, daily).toPandas().merge(known, on="date", suffixes=("", "_known"))
    assert len(got) == 3650
    inner = got[(got["t"] > 2001.1) & (got["t"] < 2010.8)]
    # The relation is linear in the regressors; what is left is interpolation within a grid cell.
    assert np.abs(inner["y_hat"] - inner["truth"]).max() < 0.01
    assert inner["se"].max() < 0.01


def brute_node(t, lq, y, node, level, t_lo, t_hi, min_obs, half_y=7.0, half_q=2.0, half_s=0.5):
    tri = lambda u: np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0)
    edge = min(node - t_lo, t_hi - node)
    hy, hq, hs = (2 * half_y - edge if edge <= half_y else half_y), half_q, half_s
    growth = 0
    while True:
        d = np.abs(t - node)
        season = np.minimum(np.ceil(d) - d, d - np.floor(d))
        w = tri(d / hy) * tri((lq - level) / hq) * tri(season / hs)
        if (w > 0).sum() >= min_obs or growth > 60:
            break
        hy, hq, hs, growth = hy * 1.1, hq * 1.1, min(hs * 1.1, 0.5), growth + 1
    x = np.stack([np.ones_like(t), t - node, lq - level, np.sin(2 * np.pi * t), np.cos(2 * np.pi * t)], axis=1)
    b, *_ = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)
    at = np.array([1, 0, 0, np.sin(2 * np.pi * node), np.cos(2 * np.pi * node)])
    return b @ at, np.sqrt((w * (y - x @ b) ** 2).sum() / w.sum()), (w > 0).sum(), growth


@pytest.mark.parametrize("half_s, half_y, half_q", [(0.5, 7.0, 2.0), (0.3, 1.0, 0.5)])
def test_nodes_against_direct_regression(record, make, half_s, half_y, half_q):
    daily, _, known = record
    rng = np.random.default_rng(11)
    picked = known.iloc[np.sort(rng.choice(len(known) - 2, size=160, replace=False)) + 1]
    y = picked["truth"].to_numpy() + 0.3 * rng.normal(size=len(picked))
    samples = make([("a", d, float(np.exp(v))) for d, v in zip(picked["date"], y)], SAMPLES)
    surface = op.fit_surface(samples, daily, half_s=half_s, half_y=half_y, half_q=half_q).toPandas()
    t, lq = picked["t"].to_numpy(), np.log(picked["q"].to_numpy())
    all_lq = np.log(known["q"])
    l0, l1 = all_lq.min() - 0.05, all_lq.max() + 0.05
    assert len(surface) == 14 * (10 * 16 + 1)
    if half_y < 7:
        assert surface["growth"].max() > 0
    for row in surface.sample(60, random_state=1).itertuples():
        node, level = 2001 + row.ti / 16, l0 + row.li * (l1 - l0) / 13
        want = brute_node(t, lq, y, node, level, known["t"].min(), known["t"].max(), 45, half_y, half_q, half_s)
        assert (row.n_obs, row.growth) == want[2:]
        assert (row.y_hat, row.se) == pytest.approx(want[:2], rel=1e-6, abs=1e-8)


def test_repeated_samples_of_a_day_count_each(record, make):
    daily, samples, _ = record
    twice = samples.unionByName(samples.withColumn("result_va", F.col("result_va") * 1.1))
    once = op.fit_surface(samples, daily).toPandas().set_index(["ti", "li"])
    both = op.fit_surface(twice, daily, min_obs=90).toPandas().set_index(["ti", "li"])
    assert (both["n_obs"] == 2 * once["n_obs"]).all()
    assert np.allclose(both["y_hat"], once["y_hat"] + np.log(1.1) / 2, atol=1e-6)


def test_zero_flow_and_samples_outside(make):
    days = [day(n) for n in range(800)]
    daily = make([("z", d, 0.0 if i % 9 == 0 else 5.0 + i % 7) for i, d in enumerate(days)], DAILY)
    samples = make([("z", days[i], 10.0 + i % 5) for i in range(0, 800, 8)] + [("z", day(-5), 1.0), ("z", day(900), 1.0)], SAMPLES)
    got = op.concentration_surface(samples, daily).toPandas()
    assert len(got) == 800 and got["conc"].notna().all()


def test_bridge(make):
    est = make([("a", day(n), 1.0, 2.0, 0.5) for n in range(8)] + [("none", day(0), 1.0, 2.0, 0.5)], "site_no string, date date, q double, y_hat double, se double")
    samples = make([("a", day(2), float(np.exp(2.5))), ("a", day(5), float(np.exp(1.5)))], SAMPLES)
    got = {(r["site_no"], r["date"]): r["gen_conc"] for r in op.residual_bridge(est, samples, rho=0.9).collect()}
    assert got[("a", day(2))] == pytest.approx(np.exp(2.5)) and got[("a", day(5))] == pytest.approx(np.exp(1.5))
    # Joint normal: condition day 3 on both sample days directly.
    cov = lambda i, j: 0.9 ** abs(i - j)
    k = np.array([[cov(2, 2), cov(2, 5)], [cov(5, 2), cov(5, 5)]])
    c = np.array([cov(3, 2), cov(3, 5)])
    m, v = c @ np.linalg.solve(k, [1.0, -1.0]), 1 - c @ np.linalg.solve(k, c)
    assert got[("a", day(3))] == pytest.approx(np.exp(2 + 0.5 * m + 0.25 * v / 2))
    assert got[("a", day(0))] == pytest.approx(np.exp(2 + 0.5 * 0.81 + 0.25 * (1 - 0.81**2) / 2))
    assert got[("a", day(7))] == pytest.approx(np.exp(2 - 0.5 * 0.81 + 0.25 * (1 - 0.81**2) / 2))
    assert got[("none", day(0))] == pytest.approx(np.exp(2 + 0.125))


def test_estimate_errors(make):
    est = make([("a", day(n), 2.0, float(v)) for n, v in enumerate([10, 20, 30])], "site_no string, date date, q double, gen_conc double")
    samples = make([("a", day(n), float(v)) for n, v in enumerate([11, 19, 33])], SAMPLES)
    row = op.estimate_errors(est, samples, "gen_conc").first()
    o, e = np.log([11, 19, 33]), np.log([10, 20, 30])
    assert row["rmse_log"] == pytest.approx(np.sqrt(((o - e) ** 2).mean()))
    assert row["r2_log_conc"] == pytest.approx(1 - ((o - e) ** 2).sum() / ((o - o.mean()) ** 2).sum())
    assert row["flux_bias"] == pytest.approx((60 - 63) / 63) and row["flux_bias_of_estimate"] == pytest.approx((60 - 63) / 60)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(2)
    rows = [
        (f"s{i % 20:02d}", 1990 + i // 20, float(10 * a + 5 * (b > 0.5)), float(a), float(b), float(c))
        for i, (a, b, c) in enumerate(rng.uniform(size=(400, 3)))
    ]
    return cut_lineage(spark.createDataFrame(rows, "site_no string, water_year int, q5_norm double, x double, step double, noise double"))


@pytest.fixture(scope="module")
def forest(frame):
    return op.forest_fit(frame, trees=15, max_depth=8)


def test_forest_importance_and_fit(frame, forest):
    importance = {r["feature"]: r["importance"] for r in op.forest_importance(forest, frame).collect()}
    assert importance["noise"] < min(importance["x"], importance["step"])
    assert sum(importance.values()) == pytest.approx(1)
    assert residual_summary(predict(forest, frame)).first()["r2"] > 0.8


def test_held_out_residuals_cover_each_row_once(frame):
    res = op.forest_residuals(frame, folds=3, trees=8, max_depth=6)
    keys = res.select("site_no", "water_year")
    assert keys.count() == 400 and keys.distinct().count() == 400
    summary = residual_summary(res).first()
    assert 0.5 < summary["r2"] < 1 and summary["n"] == 400


def test_train_test_split_is_repeatable(frame):
    a, b = (collect(op.train_test_eval(frame, trees=5, max_depth=5), "part") for _ in range(2))
    assert a == b
    assert sum(r["n"] for r in a) == 400
    assert 0.6 < next(r["n"] for r in a if r["part"] == "train") / 400 < 0.8


def test_shapley_adds_up_and_ignores_unused(spark, frame):
    used = cut_lineage(frame.withColumn("noise", F.lit(1.0)))
    model = op.forest_fit(used, trees=10, max_depth=6)
    shap = op.shapley_sampling(model, used.where("site_no = 's03'"), samples=200, background=1000)
    again = op.shapley_sampling(model, used.where("site_no = 's03'").repartition(7), samples=200, background=1000)
    first = collect(shap, "water_year", "feature")
    second = collect(again, "water_year", "feature")
    assert [r["feature"] for r in first] == [r["feature"] for r in second]
    assert [r["phi"] for r in first] == pytest.approx([r["phi"] for r in second])
    rows = pd.DataFrame(first)
    assert (rows[rows["feature"] == "noise"]["phi"] == 0).all()
    scored = predict(model, used.where("site_no = 's03'")).toPandas().set_index("water_year")["pred"]
    total = rows.groupby("water_year")["phi"].sum()
    assert len(total) == len(scored)
    # The background is the frame itself; its mean is estimated from 200 draws per row.
    assert np.abs(total - (scored - scored.mean())).max() < 5 * scored.std() / np.sqrt(200)


def test_shap_tables(make):
    shap = make([("a", 1, "f", -2.0), ("a", 2, "f", 4.0), ("b", 1, "g", 1.0)], "site_no string, water_year int, feature string, phi double")
    labels = make([("a", 1, "poor prediction"), ("a", 2, "good prediction")], "site_no string, water_year int, class_a string")
    classes = make([("f", "Climate")], "feature string, class string")
    rows = {(r["feature"], r["class_a"]): r for r in op.mean_abs_shap(shap, classes, labels).collect()}
    assert rows[("f", "poor prediction")]["mean_abs_shap"] == 2.0 and rows[("f", "good prediction")]["mean_abs_shap_all"] == 3.0
    assert rows[("g", None)]["display_rank"] == 1 and rows[("f", "poor prediction")]["class"] == "Climate"
    panel = make([("a", 1, 7.0, "Arid"), ("a", 2, None, None), ("b", 1, 1.0, "Arid")], "site_no string, water_year int, f double, zone string")
    dep = collect(op.shap_dependence(shap, panel, "f"), "water_year")
    assert [(r["phi"], r["feature_value"], r["zone"]) for r in dep] == [(-2.0, 7.0, "Arid"), (4.0, None, "Arid")]
    assert [r["site_no"] for r in op.site_mean_filter(panel, "f", 5).collect()] == ["a"]


# --- estimates that have not seen the sample


def brute_without(t, lq, y, days, k, t_lo, t_hi, min_obs, half_y, half_q, half_s):
    """Refit at day k from all samples of other days."""
    other = days != days[k]
    tri = lambda u: np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0)
    edge = min(t[k] - t_lo, t_hi - t[k])
    hy, hq, hs = (2 * half_y - edge if edge <= half_y else half_y), half_q, half_s
    to, lo, yo = t[other], lq[other], y[other]
    growth = 0
    while True:
        d = np.abs(to - t[k])
        season = np.minimum(np.ceil(d) - d, d - np.floor(d))
        w = tri(d / hy) * tri((lo - lq[k]) / hq) * tri(season / hs)
        if (w > 0).sum() >= min_obs or growth > 80:
            break
        hy, hq, hs, growth = hy * 1.1, hq * 1.1, min(hs * 1.1, 0.5), growth + 1
    x = np.stack([np.ones_like(to), to - t[k], lo - lq[k], np.sin(2 * np.pi * to), np.cos(2 * np.pi * to)], axis=1)
    b, *_ = np.linalg.lstsq(x * np.sqrt(w)[:, None], yo * np.sqrt(w), rcond=None)
    at = np.array([1, 0, 0, np.sin(2 * np.pi * t[k]), np.cos(2 * np.pi * t[k])])
    return b @ at, np.sqrt((w * (yo - x @ b) ** 2).sum() / w.sum()), (w > 0).sum(), growth


@pytest.mark.parametrize("half_s, half_y, half_q", [(0.5, 7.0, 2.0), (0.3, 1.0, 0.5)])
def test_held_out_estimates_equal_refits(record, make, half_s, half_y, half_q):
    daily, _, known = record
    rng = np.random.default_rng(12)
    picked = known.iloc[np.sort(rng.choice(len(known) - 2, size=150, replace=False)) + 1]
    picked = picked.loc[picked.index.repeat(1 + (np.arange(len(picked)) % 10 == 0))]  # some days have two samples
    y = picked["truth"].to_numpy() + 0.3 * rng.normal(size=len(picked))
    samples = make([("a", d, float(np.exp(v))) for d, v in zip(picked["date"], y)], SAMPLES)
    found = op.held_out_estimates(samples, daily, half_s=half_s, half_y=half_y, half_q=half_q)
    t, lq, days = picked["t"].to_numpy(), np.log(picked["q"].to_numpy()), picked["date"].to_numpy()
    rows = {r["date"]: r for r in found.collect()}
    assert len(rows) == 150
    for k in range(len(picked)):
        row = rows[days[k]]
        want = brute_without(t, lq, y, days, k, known["t"].min(), known["t"].max(), 45, half_y, half_q, half_s)
        assert (row["n_obs"], row["growth"]) == want[2:]
        assert (row["y_hat"], row["se"]) == pytest.approx(want[:2], rel=1e-6, abs=1e-8)
        assert row["conc"] == pytest.approx(np.exp(want[0] + want[1] ** 2 / 2)) and 0 < row["leverage"] < 1
    # The errors of estimates that have seen the samples are too small.
    seen = op.estimate_errors(op.concentration_surface(samples, daily, half_s, half_y, half_q), samples, "conc").first()
    honest = op.estimate_errors(found, samples, "conc").first()
    assert honest["n"] == len(picked) and honest["rmse_log"] > seen["rmse_log"]
    assert honest["r2_log_conc"] < seen["r2_log_conc"]


def test_held_out_estimates_of_short_records(make):
    """Fewer samples than wanted, a lone sample, a sample that alone has its discharge."""
    days = [day(n) for n in range(1500)]
    flow = lambda i: 2.0 + i % 13
    daily = make([(s, d, flow(i) if s != "c" or i != 700 else 1e9) for s in "abc" for i, d in enumerate(days)], DAILY)
    rows = [("a", days[i], 10.0 + i % 7) for i in range(100, 1400, 60)] + [("b", days[700], 5.0)]
    rows += [("c", days[i], 10.0 + i % 7) for i in range(100, 1400, 30)]
    found = op.held_out_estimates(make(rows, SAMPLES), daily).toPandas()
    assert sorted(found.groupby("site_no").size().items()) == [("a", 22), ("b", 1), ("c", 44)]
    assert found[found.site_no != "b"]["y_hat"].notna().all()
    assert found[found.site_no == "b"][["y_hat", "se", "conc"]].isna().all(axis=None)
    assert op.held_out_estimates(make([], SAMPLES), daily).count() == 0


def test_placement_is_linear_in_the_record(spark, make, monkeypatch):
    """Windows of two years: a sample day goes to a few blocks, and no node changes by it."""
    from gaugeflow.operators import estimate

    rng = np.random.default_rng(5)
    first = date(1950, 1, 1)
    kept = {}
    for years in (20, 60):
        days = [first + timedelta(days=n) for n in range(365 * years)]
        q = np.exp(rng.normal(size=len(days)))
        daily = make([("a", d, float(v)) for d, v in zip(days, q)], DAILY)
        samples = make([("a", d, float(np.exp(rng.normal()))) for d in days[3::9]], SAMPLES)
        with_ln = estimate._with_ln_q(daily)
        points = estimate._sample_days(samples, with_ln, estimate._grid(with_ln))
        settings = (0.5, 2.0, 2.0, 45, True, 4)
        kept[years] = estimate._placed(points, *settings).count() / points.count()
        if years == 20:
            local = op.fit_surface(samples, daily, half_y=2.0)
            monkeypatch.setattr(estimate, "_reach", lambda *a: lambda cells: pd.DataFrame(
                [("a", b, 0, int(cells["sample_block"].max())) for b in range(6)], columns=["site_no", "block", "lo", "hi"]))
            whole = op.fit_surface(samples, daily, half_y=2.0)
            a, b = (s.toPandas().sort_values(["ti", "li"], ignore_index=True) for s in (local, whole))
            assert (a[["ti", "li", "n_obs", "growth"]] == b[["ti", "li", "n_obs", "growth"]]).all(axis=None)
            assert np.allclose(a[["y_hat", "se"]], b[["y_hat", "se"]], rtol=1e-7)
            monkeypatch.undo()
    assert kept[60] < 1.4 * kept[20] and kept[60] < 8
