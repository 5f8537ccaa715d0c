"""Recession, flashiness and storage metrics of daily discharge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.aggregates import linear_fit
from ..functions.columns import safe_ln, water_year, water_year_day
from ..functions.series import SITE, align_daily, by_site

MM_PER_M = 1000
SECONDS_PER_DAY = 86400


def _changes(daily: DataFrame, min_ratio: float | None) -> DataFrame:
    """Change and rate of change to the previous row, without the steep drops.

    A row is kept when its ratio to the row before is at least ``min_ratio``. After a zero the
    ratio is infinite for positive discharge (kept) and undefined for zero (dropped).
    """
    before, day_before = F.lag("q").over(by_site()), F.lag("date").over(by_site())
    rows = daily.select(
        SITE, "date", "q", before.alias("_prev"), (F.col("q") - before).alias("dq"), F.datediff("date", day_before).alias("_days")
    ).where(F.col("dq").isNotNull())
    rows = rows.withColumn("dq_dt", F.try_divide(F.col("dq"), F.col("_days")))
    if min_ratio is not None:
        steady = F.when(F.col("_prev") == 0, F.col("q") > 0).otherwise(F.try_divide(F.col("q"), F.col("_prev")) >= min_ratio)
        rows = rows.where(steady)
    return rows


def _recession(daily: DataFrame, min_ratio: float) -> DataFrame:
    falling = _changes(daily, min_ratio).where(F.col("dq") < 0)
    return falling.select(SITE, "date", "q", (-F.col("dq_dt")).alias("recession"))


def recession_slope(daily: DataFrame, min_ratio: float = 0.7) -> DataFrame:
    """Slope of -dQ/dt on Q over the falling days of each site, with its fit statistics."""
    return (
        _recession(daily, min_ratio)
        .groupBy(SITE)
        .agg(*linear_fit("recession", "q"))
        .withColumnRenamed("slope", "recession_curve_slope")
    )


def recession_points(daily: DataFrame, min_ratio: float = 0.7) -> DataFrame:
    """Points of the log-log recession plot."""
    return _recession(daily, min_ratio).select(
        SITE, "date", safe_ln("q").alias("ln_q"), safe_ln("recession").alias("ln_recession")
    )


def flashiness_index(daily: DataFrame, min_ratio: float = 0.7, standard: bool = False) -> DataFrame:
    """Sum of absolute changes over total discharge.

    By default changes are taken anew between the rows that pass the ratio filter, which skips
    over the steep drops; ``standard`` uses every day.
    """
    rows = daily if standard else _changes(daily, min_ratio).select(SITE, "date", "q")
    change = F.col("q") - F.lag("q").over(by_site())
    moved = rows.select(SITE, "q", F.abs(change).alias("_abs")).where(F.col("_abs").isNotNull())
    return moved.groupBy(SITE).agg(F.try_divide(F.sum("_abs"), F.sum("q")).alias("rbfi"))


def storage_drawdown(
    daily: DataFrame,
    area: DataFrame,
    et: DataFrame,
    precip: DataFrame,
    start_share: float = 0.4,
    k: int = 7,
    exact_days: int = 365,
    area_factor: float = 2.59e6,
    q_to_m3s: float = 1.0,
    null_policy: str = "skip",
) -> DataFrame:
    """Running storage change from the smoothed discharge peak to the end of the water year.

    Per site: keep water years with exactly ``exact_days`` days (leap years go), smooth over
    ``k`` rows, keep the days after ``start_share`` of the year's flow has passed, start at the
    highest smoothed day, and sum P - Q - ET in millimetres from there. Smoothing, share and peak
    do not depend on the unit of discharge and are taken before conversion. ``et`` is negative
    for losses, as in the gridded product; ``null_policy='propagate'`` drops a year whose smoothed
    series has a null after the share filter, and leaves ``ds_sum`` null from the first day without
    rain or evaporation on, where ``skip`` leaves such a day out of the sum.
    """
    aligned = align_daily({
        "q": (daily, "date", "q"),
        "et": (et, "dates", "value"),
        "precip": (precip, "dates", "value"),
    }).where("has_q")
    # All frames are ordered by (water year, day) within the site, so that one sort serves them.
    in_year = Window.partitionBy(SITE, "water_year").orderBy("date")
    year = in_year.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = in_year.rowsBetween(Window.unboundedPreceding, 0)
    last_k = Window.partitionBy(SITE).orderBy("water_year", "date").rowsBetween(-(k - 1), 0)
    days = aligned.withColumn("water_year", water_year("date"))
    days = days.withColumn("_n", F.count(F.lit(1)).over(year)).where(F.col("_n") == exact_days)
    days = days.withColumn("_smooth", F.when(F.count("q").over(last_k) == k, F.avg("q").over(last_k)))
    days = days.withColumn("_cum", F.sum("q").over(running))
    late = days.withColumn("_share", F.try_divide(F.col("_cum"), F.max("_cum").over(year))).where(
        F.col("_share") > start_share
    )
    top = F.max("_smooth").over(year)
    if null_policy == "propagate":
        top = F.when(F.count("_smooth").over(year) == F.count(F.lit(1)).over(year), top)
    late = late.withColumn("_peak", F.coalesce(F.col("_smooth") == top, F.lit(False)))
    after = late.withColumn("_seen", F.max("_peak").over(running)).where("_seen")
    basin = area.select(SITE, "drain_area_va")
    depth = F.try_divide(
        F.col("q") * q_to_m3s * SECONDS_PER_DAY * MM_PER_M, F.col("drain_area_va") * area_factor
    )
    flux = after.join(basin, SITE, "left").withColumn("q_mm", depth)
    flux = flux.withColumn("ds", F.col("precip") * MM_PER_M - F.col("q_mm") - F.col("et") * -MM_PER_M)
    so_far = F.sum("ds").over(running)
    if null_policy == "propagate":
        so_far = F.when(F.count("ds").over(running) == F.count(F.lit(1)).over(running), so_far)
    return flux.select(
        SITE, "date", "q_mm", "water_year", "ds", so_far.alias("ds_sum"), water_year_day("date").alias("wy_day")
    )
