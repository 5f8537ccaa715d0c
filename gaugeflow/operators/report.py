"""Tables behind the model reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.aggregates import (
    bounded_rank,
    correlation_pairs,
    equal_bins,
    first_per_key,
    fixed_bins,
    share_table,
)
from ..functions.columns import drop_sites, relabel, safe_ln, sort_key
from ..functions.quantiles import quantile, unbounded_quantiles
from ..functions.series import SITE
from .harmonise import CLIMATE_DRIVERS, DRIVER_SETS, SITE_DRIVERS

# Report labels and their order.
POOR, GOOD = "poor prediction", "good prediction"
FLOW_LABELS = {"low": "Low Flow", "median": "Median Flow", "high": "High Flow"}
ZONE_ORDER = ("Arid", "Mediterranean", "Semi-Arid", "Humid Temperate", "Humid Continental", "Subarctic")
DRIVER_LABELS = {
    "annual_evap_mm": "Annual Evaporation (mm)",
    "annual_precip_mm": "Annual Precipitation (mm)",
    "mean_temp_c": "Mean Temperature (C)",
    "peak_swe_day": "Peak SWE Day (DOY)",
    "peak_swe_mm": "Peak SWE (mm)",
    "sdd": "Snow Disappearance Day (DOY)",
    "melt_rate": "Melt Rate (mm/day)",
    "mean_slope": "Basin Slope (degrees)",
    "mean_elevation": "Mean Elevation (m)",
    "mean_bf": "Mean Baseflow Proportion",
    "recession_curve_slope": "Recession Curve Slope",
}


def residual_classes(res_a: DataFrame, res_b: DataFrame, k: float = 0.5) -> DataFrame:
    """Both models side by side with poor/good labels and the gain of model b over model a.

    Inputs: site_no, water_year, q5_norm, pred, residual. A prediction is poor when its residual
    reaches ``k`` times the observed value.
    """
    keys = [SITE, "water_year"]
    a = res_a.select(*keys, "q5_norm", F.col("pred").alias("pred_a"), F.col("residual").alias("residual_a"))
    b = res_b.select(*keys, F.col("pred").alias("pred_b"), F.col("residual").alias("residual_b"))
    threshold = F.col("q5_norm") * k

    def grade(column: str) -> Column:
        return F.when(F.abs(column) >= F.col("threshold"), POOR).when(F.abs(column) < F.col("threshold"), GOOD)

    joined = a.join(b, keys, "left").withColumn("threshold", threshold)
    gain = F.abs("residual_a") - F.abs("residual_b")
    graded = joined.withColumns({"res_diff": gain, "class_a": grade("residual_a"), "class_b": grade("residual_b")})
    sign = F.when(F.col("res_diff") > 0, "positive").when(F.col("res_diff") <= 0, "negative")
    return graded.withColumn("pos_neg", sign)


def residual_class_counts(classes: DataFrame, lo: float = -0.2, hi: float = 0.5) -> DataFrame:
    """Counts and shares of the labels, and of gains within ``lo`` to ``hi``, from one aggregation."""
    conditions = {
        "a poor": F.col("class_a") == POOR,
        "a good": F.col("class_a") == GOOD,
        "b poor": F.col("class_b") == POOR,
        "b good": F.col("class_b") == GOOD,
        "positive": F.col("pos_neg") == "positive",
        "negative": F.col("pos_neg") == "negative",
        "in range": F.col("res_diff").between(lo, hi),
    }
    wide = classes.agg(F.count(F.lit(1)).alias("_total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])
    tall = wide.unpivot(["_total"], [f"`{n}`" for n in conditions], "label", "n")
    return tall.select("label", "n", F.try_divide("n", "_total").alias("share"))


def poor_residual_means(classes: DataFrame) -> DataFrame:
    """Mean absolute residual among the poor predictions of each model."""
    wide = classes.agg(*[
        F.avg(F.when(F.col(f"class_{m}") == POOR, F.abs(f"residual_{m}"))).alias(m) for m in ("a", "b")
    ])
    return wide.unpivot([], ["a", "b"], "model", "mean_abs_residual")


def flow_condition(frame: DataFrame, hi: float = 1.25, lo: float = 0.75, flow: str = "q5") -> DataFrame:
    """High, low or median flow of a year against the site median. A site has one row per year."""
    median = quantile(flow, 0.5).over(Window.partitionBy(SITE))
    label = (
        F.when(F.col(flow) > F.col("median_q5") * hi, "high")
        .when(F.col(flow) < F.col("median_q5") * lo, "low")
        .otherwise("median")
    )
    return frame.withColumn("median_q5", median).withColumn("flow", label)


def flow_condition_counts(frame: DataFrame) -> DataFrame:
    """Rows and share per flow condition."""
    return share_table(frame, "flow")


def _improved() -> Column:
    """Poor under model a and better under model b."""
    return (F.col("class_a") == POOR) & (F.col("pos_neg") == "positive")


def site_improvement(joined: DataFrame) -> DataFrame:
    """Share of the rows of each site that were poor under model a and improved by model b."""
    return joined.groupBy(SITE).agg(
        F.count(F.lit(1)).alias("n_obs"), F.count_if(_improved()).alias("n_improved")
    ).withColumn("improved_share", F.col("n_improved") / F.col("n_obs"))


def zone_class_shares(joined: DataFrame, zone: str = "zone") -> DataFrame:
    """Shares of poor predictions and of flow conditions per zone, from one aggregation."""
    n = F.count(F.lit(1))
    graded = F.count_if(F.col("class_a").isNotNull())
    return joined.groupBy(zone).agg(
        n.alias("n"),
        F.try_divide(F.count_if(F.col("class_a") == POOR), graded).alias("poor_share"),
        *[F.try_divide(F.count_if(F.col("flow") == f), n).alias(f"{f}_share") for f in FLOW_LABELS],
    )


def improvement_by_zone_flow(joined: DataFrame, zone: str = "zone") -> DataFrame:
    """Improved rows over all rows by zone and flow, by zone, and overall (with share among poor).

    The rollup runs over the (zone, flow) counts, not over the rows. Zone-flow pairs without an
    improved row are left out; zones are all listed. ``flow_order`` and ``zone_order`` give the
    display order.
    """
    cells = joined.groupBy(zone, "flow").agg(
        F.count_if(_improved()).alias("_imp"),
        F.count_if(F.col("class_a") == POOR).alias("_poor"),
        F.count(F.lit(1)).alias("_n"),
    )
    rolled = cells.rollup(zone, "flow").agg(
        F.grouping_id().alias("_g"), F.sum("_imp").alias("n_improved"), F.sum("_poor").alias("n_poor"), F.sum("_n").alias("n_total")
    )
    level = F.when(F.col("_g") == 0, "zone_flow").when(F.col("_g") == 1, "zone").otherwise("all")
    flow = relabel("flow", FLOW_LABELS)
    return (
        rolled.where((F.col("_g") > 0) | (F.col("n_improved") > 0))
        .select(
            level.alias("level"),
            zone,
            flow.alias("flow"),
            "n_improved",
            "n_poor",
            "n_total",
            F.try_divide("n_improved", "n_total").alias("improved_share"),
            F.try_divide("n_improved", "n_poor").alias("share_of_poor"),
            sort_key(flow, FLOW_LABELS.values()).alias("flow_order"),
            sort_key(zone, ZONE_ORDER).alias("zone_order"),
        )
    )


def relative_improvement(joined: DataFrame, zone: str = "zone") -> DataFrame:
    """Median relative gain among improved poor rows, and the ratio of mean gain to mean flow, by zone.

    A zone can hold any share of the rows, so the median is taken without gathering it.
    """
    relative = F.when(_improved(), F.try_divide("res_diff", "q5_norm"))
    rows = joined.select(zone, "res_diff", "q5_norm", relative.alias("_rel"))
    medians = unbounded_quantiles(rows, [zone], "_rel", {"median_rel_gain": 0.5})
    ratios = rows.groupBy(zone).agg(F.try_divide(F.avg("res_diff"), F.avg("q5_norm")).alias("mean_ratio"))
    medians = medians.withColumnRenamed(zone, "_zone")
    return ratios.join(medians, F.col(zone).eqNullSafe(F.col("_zone")), "left").drop("_zone")


def snow_aridity_residual(joined: DataFrame, zone: str = "zone") -> DataFrame:
    """Snow fraction, aridity and log relative gain of the poor rows of model a."""
    return joined.where(F.col("class_a") == POOR).select(
        SITE,
        "water_year",
        zone,
        F.try_divide("peak_swe_mm", "annual_precip_mm").alias("snow_frac"),
        F.try_divide("annual_precip_mm", "annual_evap_mm").alias("aridity"),
        safe_ln(F.try_divide("res_diff", "q5_norm")).alias("ln_rel_gain"),
    )


def record_grid(
    frame: DataFrame, after: int = 1949, exclude: Iterable[str] = (), columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per site and year of the panel after a year, complete cases, ranked by first year."""
    rows = drop_sites(frame, exclude).where(F.col("water_year") > after)
    rows = rows.dropna(subset=list(columns)) if columns else rows.dropna()
    first = F.min("water_year").over(Window.partitionBy(SITE))
    tiles = rows.withColumn("first_year", first)
    tiles = tiles.withColumn("is_first_row", F.col("water_year") == F.col("first_year"))
    return bounded_rank(tiles, "first_year")


def site_profile(frame: DataFrame) -> DataFrame:
    """Mean area, number of years, first and last year of each site."""
    return frame.groupBy(SITE).agg(
        F.avg("drain_area_va").alias("area"),
        F.count_distinct("water_year").alias("num_years"),
        F.min("water_year").alias("min_year"),
        F.max("water_year").alias("max_year"),
    )


def driver_histograms(frame: DataFrame, bins: int = 30) -> DataFrame:
    """Binned climate drivers (all rows), site drivers (one row per site) and site profile.

    Columns: variable (report label), bin, bin_start, n.
    """
    sites = first_per_key(frame.select(SITE, "water_year", *SITE_DRIVERS), [SITE], ["water_year"])
    profile = site_profile(frame).withColumn("ln_area", safe_ln("area"))
    parts = [
        equal_bins(frame, list(CLIMATE_DRIVERS), bins),
        equal_bins(sites, list(SITE_DRIVERS), bins),
        equal_bins(profile, ["ln_area", "num_years", "min_year", "max_year"], bins),
    ]
    tall = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return tall.withColumn("variable", relabel("variable", DRIVER_LABELS, otherwise=F.col("variable")))


def gain_histogram(classes: DataFrame, width: float = 0.001, facet: str = "class_b") -> DataFrame:
    """Gain of model b in bins of fixed width, split by its class."""
    return fixed_bins(classes, "res_diff", width, [facet])


def driver_correlation(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of the drivers over sites: one row per site, its first year, with that year's climate."""
    columns = list(columns or DRIVER_SETS["full"])
    rows = first_per_key(frame.select(SITE, "water_year", *columns), [SITE], ["water_year"])
    return correlation_pairs(rows.select(*columns), columns)
