from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import collect, day
from gaugeflow.functions import aggregates as ag
from gaugeflow.functions import columns as co
from gaugeflow.functions.quantiles import unbounded_quantiles
from gaugeflow.functions.series import align_daily, longest_missing_run, one_row_per_day


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "d, year, number",
    [
        (date(2000, 9, 30), 2000, 366),
        (date(2000, 10, 1), 2001, 1),
        (date(2001, 9, 30), 2001, 365),
        (date(2004, 2, 29), 2004, 152),
        (date(2004, 12, 31), 2005, 92),
    ],
)
def test_water_year_and_day(spark, d, year, number):
    assert one(spark, co.water_year(F.lit(d))) == year
    assert one(spark, co.water_year_day(F.lit(d))) == number


@pytest.mark.parametrize("text, want", [("9380000", "09380000"), ("09380000", "09380000"), ("123", "0123"), (None, None)])
def test_site_id_gets_one_zero_only(spark, text, want):
    assert one(spark, co.normalise_site_id(F.lit(text).cast("string"))) == want


def test_decoration_is_cut_from_both_ends():
    assert co.strip_decoration("X09380000..") == "09380000"


def test_century_fix_keeps_leap_day(spark):
    assert one(spark, co.century_fix(F.lit(date(2052, 2, 29)))) == date(1952, 2, 29)
    assert one(spark, co.century_fix(F.lit(date(2023, 12, 31)))) == date(2023, 12, 31)


def test_guards(spark):
    assert one(spark, co.clip_negative(F.lit(-1.0))) == 0.0
    assert one(spark, co.clip_negative(F.lit(None).cast("double"))) is None
    assert one(spark, co.safe_ln(F.lit(0.0))) is None
    assert one(spark, co.parse_date(F.lit("13/45/99"), ["yyyy-MM-dd", "M/d/yy"])) is None
    assert one(spark, co.parse_date(F.lit("2/3/99"), ["yyyy-MM-dd", "M/d/yy"])) == date(2099, 2, 3)
    assert one(spark, co.round_to_cell(F.lit(-119.9))) == -119.75
    assert one(spark, co.decimal_year(F.lit(date(2001, 1, 1)))) == pytest.approx(2001 + 0.5 / 365)


def test_drop_sites_with_empty_list_keeps_all(make):
    df = make([("a",), ("b",)], "site_no string")
    assert co.drop_sites(df, []).count() == 2
    assert [r[0] for r in co.drop_sites(df, ["a"]).collect()] == ["b"]


def test_nan_and_infinity_become_null(make):
    df = make([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert sorted([r[0] for r in co.nan_to_null(df, ["x"]).collect()], key=str) == [1.0, None, None]


def test_null_policy(make):
    df = make([("a", 1.0), ("a", None), ("b", 2.0)], "site_no string, v double")
    agg = lambda p: dict(df.groupBy("site_no").agg(ag.with_nulls(F.sum("v"), "v", p)).collect())
    assert agg("skip") == {"a": 1.0, "b": 2.0}
    assert agg("propagate") == {"a": None, "b": 2.0}


def test_first_per_key_keeps_columns_of_that_row(make):
    df = make([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "site_no string, water_year int, z string")
    assert collect(ag.first_per_key(df, ["site_no"], ["water_year"]), "site_no") == [
        {"site_no": "a", "water_year": 1, "z": "y"},
        {"site_no": "b", "water_year": 5, "z": None},
    ]


def test_bins(make):
    df = make([(0.0, 5.0), (1.0, 5.0), (30.0, 5.0), (None, None)], "x double, flat double")
    rows = {(r["variable"], r["bin"]): r["n"] for r in ag.equal_bins(df, ["x", "flat"]).collect()}
    assert rows == {("x", 0): 1, ("x", 1): 1, ("x", 29): 1, ("flat", 0): 3}
    fixed = {r["bin"]: r["n"] for r in ag.fixed_bins(df, "x", 10.0).collect()}
    assert fixed == {0: 2, 3: 1}
    starts = {r["bin"]: r["bin_start"] for r in ag.fixed_bins(df, "x", 10.0).collect()}
    assert starts == {0: -5.0, 3: 25.0}
    assert {r["bin"]: r["bin_start"] for r in ag.fixed_bins(df, "x", 10.0, centred=False).collect()} == {0: 0.0, 3: 30.0}
    first = next(r for r in ag.equal_bins(df, ["x"]).collect() if r["bin"] == 0)
    assert first["bin_start"] == pytest.approx(-15 / 29)


def test_linear_fit_statistics(make):
    rng = np.random.default_rng(0)
    x = rng.normal(size=50)
    y = 2 * x + 1 + rng.normal(size=50)
    row = make([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").agg(*ag.linear_fit("y", "x")).first()
    slope, intercept = np.polyfit(x, y, 1)
    residual = y - slope * x - intercept
    se = np.sqrt((residual**2).sum() / 48 / ((x - x.mean()) ** 2).sum())
    assert row["slope"] == pytest.approx(slope) and row["intercept"] == pytest.approx(intercept)
    assert row["t_stat"] == pytest.approx(slope / se) and row["n"] == 50


@pytest.mark.parametrize("shape", ["smooth", "ties", "outlier", "single"])
def test_unbounded_quantiles_are_exact(make, shape):
    rng = np.random.default_rng(1)
    values = {
        "smooth": rng.normal(size=3001),
        "ties": rng.integers(0, 4, size=2000).astype(float),
        "outlier": np.concatenate([rng.normal(size=999), [1e12]]),
        "single": np.array([3.5]),
    }[shape]
    rows = [("hot", float(v)) for v in values] + [("b", 1.0), ("b", 2.0), ("b", None), (None, 7.0)]
    probs = {"lo": 0.01, "mid": 0.5, "hi": 0.99}
    # A coarse sketch puts cuts far off the mark; the result must not depend on it.
    for accuracy in (10, 10_000):
        got = {r["site_no"]: r for r in unbounded_quantiles(make(rows, "site_no string, v double"), ["site_no"], "v", probs, accuracy).collect()}
        for name, p in probs.items():
            assert got["hot"][name] == pytest.approx(np.quantile(values, p))
            assert got["b"][name] == pytest.approx(1 + p)
            assert got[None][name] == 7.0


def test_longest_missing_run(make):
    rows = [
        ("a", day(0), 1.0), ("a", day(1), None), ("a", day(5), 1.0), ("a", day(6), 1.0),
        ("b", day(0), 1.0), ("b", day(1), 1.0),
        ("c", day(0), None), ("c", day(9), None), ("c", day(10), 2.0),
        ("d", day(0), None), ("d", day(3), None),
    ]
    df = make(rows, "site_no string, date date, q double")
    runs = {r["site_no"]: r["max_run"] for r in longest_missing_run(df, F.col("q").isNotNull()).collect()}
    assert runs == {"a": 4, "b": 0, "c": 10, "d": 4}


def test_align_daily_and_daily_mean(make):
    q = make([("a", day(0), 1.0), ("a", day(0), 3.0), ("a", day(1), 5.0)], "site_no string, date date, q double")
    et = make([("a", day(1), -0.5), ("a", day(2), -0.7)], "site_no string, dates date, value double")
    folded = align_daily({"q": (one_row_per_day(q), "date", "q"), "et": (et, "dates", "value")})
    got = [(r["date"], r["q"], r["et"], r["has_q"]) for r in folded.orderBy("date").collect()]
    assert got == [(day(0), 2.0, None, True), (day(1), 5.0, -0.5, True), (day(2), None, -0.7, False)]


def test_correlation_pairs_and_null_counts(make):
    df = make([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    pairs = {(r["var_1"], r["var_2"]): r["r"] for r in ag.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert pairs[("a", "b")] == pytest.approx(1.0) and pairs[("a", "a")] == 1.0
    assert pairs[("a", "c")] is None and pairs[("c", "c")] is None
    assert {r["column_name"]: r["n_null"] for r in ag.null_counts(df).collect()} == {"a": 0, "b": 1, "c": 0}


def test_quantiles_of_a_hot_group_are_spread(spark, make):
    """Nearly all rows in one site, no broadcast: no task reads more than its share of them."""
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(size=60_000), np.full(3000, 1.0), [-1e300, 1e300, -0.0]])
    df = make([("hot", float(v)) for v in values] + [(f"s{k}", float(k % 7)) for k in range(600)], "site_no string, v double")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        probs = {"lo": 0.01, "mid": 0.5, "hi": 0.995}
        got = {r["site_no"]: r for r in unbounded_quantiles(df, ["site_no"], "v", probs).collect()}
        for name, p in probs.items():
            assert got["hot"][name] == pytest.approx(np.quantile(values, p), rel=1e-12)
        assert len(got) == 601
        # Rows of the hot site in the tasks of the widest step, the one that meets them with their group.
        from gaugeflow.functions import quantiles

        data = df.select("site_no", F.col("v").alias("_v")).groupBy("site_no", "_v").agg(F.count(F.lit(1)).alias("_c"))
        met = quantiles._meet(data, data.groupBy("site_no").agg(F.max("_v").alias("_high")), ["site_no"])
        share = met.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
        assert share[0] < 0.2 * share[1]
        # The last ordering sees few rows.
        assert quantiles.RANGES**quantiles.PASSES > 10**7
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ranks_and_medians_start_no_job(spark, make):
    from gaugeflow import operators as op

    started = []
    tracker = spark.sparkContext.statusTracker()
    samples = make([("a", day(0), 1.0), ("b", day(3), 2.0)], "site_no string, sample_dt date, result_va double")
    daily = make([("a", day(0), 1.0), ("b", day(1), 2.0)], "site_no string, date date, q double")
    spark.sparkContext.setJobGroup("plan-only", "plans")
    op.record_summary(samples, daily)
    op.end_members(samples)
    op.mean_abs_shap(make([("a", 1, "f", -2.0)], "site_no string, water_year int, feature string, phi double"))
    started += tracker.getJobIdsForGroup("plan-only")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not started
