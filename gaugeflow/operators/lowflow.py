"""Annual baseflow and low-flow statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.aggregates import with_nulls
from ..functions.columns import month_between, water_year
from ..functions.quantiles import quantile
from ..functions.series import SITE


def complete_water_years(daily: DataFrame, min_days: int = 365) -> DataFrame:
    """Daily rows of the (site, water year) pairs with at least ``min_days`` distinct days.

    Distinct days are counted as the highest dense rank inside the pair, so that counting and
    filtering share one exchange instead of an aggregation joined back.
    """
    named = daily.withColumn("water_year", water_year("date"))
    year = Window.partitionBy(SITE, "water_year")
    ranked = named.withColumn("_day", F.dense_rank().over(year.orderBy("date")))
    return ranked.withColumn("_days", F.max("_day").over(year)).where(F.col("_days") >= min_days).drop("_day", "_days")


def annual_baseflow(bf: DataFrame, min_years: int = 10, null_policy: str = "skip") -> DataFrame:
    """Median daily baseflow proportion per (site, water year), for sites with enough years."""
    annual = bf.groupBy(SITE, water_year("date").alias("water_year")).agg(
        with_nulls(quantile("bf_percent", 0.5), "bf_percent", null_policy).alias("median_bf")
    )
    years = F.count(F.lit(1)).over(Window.partitionBy(SITE))
    return annual.withColumn("_years", years).where(F.col("_years") >= min_years).drop("_years")


def baseflow_out_of_range(annual_bf: DataFrame) -> DataFrame:
    """Flag per site: ``flag`` when any annual value lies outside 0 to 1, else ``fine``."""
    outside = (F.col("median_bf") < 0) | (F.col("median_bf") > 1)
    return annual_bf.groupBy(SITE).agg(
        F.count_if(outside).alias("n_outside"),
        F.when(F.bool_or(outside), F.lit("flag")).otherwise(F.lit("fine")).alias("flag"),
    )


def in_range_sites(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows of the sites that ``baseflow_out_of_range`` did not flag."""
    return df.join(flags.where(F.col("flag") == "flag"), SITE, "left_anti")


def low_flow_q5(daily: DataFrame, months: tuple[int, int] = (8, 10), q: float = 0.05, null_policy: str = "skip") -> DataFrame:
    """Low quantile of discharge over a season of each calendar year, and its min-max score.

    ``daily`` holds complete water years. A record that starts on 1 October gets its first value
    from October alone, as calendar year and water year differ there. With ``propagate`` a day without
    discharge leaves its season without a value, and such a season its site without scores.
    """
    annual = (
        daily.where(month_between("date", months))
        .groupBy(SITE, F.year("date").alias("year"))
        .agg(with_nulls(quantile("q", q), "q", null_policy).alias("q5"))
    )
    return annual.withColumn("norm_q5", _min_max("q5", null_policy))


def _min_max(column: str, null_policy: str = "skip") -> Column:
    site = Window.partitionBy(SITE)
    low, high = (with_nulls(end(column), column, null_policy, site) for end in (F.min, F.max))
    return F.try_divide(F.col(column) - low, high - low)


def site_year_stats(annual_bf: DataFrame, q5: DataFrame) -> DataFrame:
    """Annual baseflow with the low flow of the calendar year of the same number."""
    flow = q5.select(SITE, F.col("year").alias("water_year"), "q5", "norm_q5")
    return annual_bf.withColumnRenamed("median_bf", "bf_prop").join(flow, [SITE, "water_year"], "left")


def low_flow_normalised(annual_bf: DataFrame, q5: DataFrame) -> DataFrame:
    """Low flow per site-year relative to the site: mean, deviation, min-max and z-score.

    Years without both values are dropped before anything is computed.
    """
    flow = q5.select(SITE, F.col("year").alias("water_year"), F.col("q5").alias("lowflow"))
    rows = annual_bf.join(flow, [SITE, "water_year"], "left").dropna(subset=["median_bf", "lowflow"])
    site = Window.partitionBy(SITE)
    mean = F.avg("lowflow").over(site)
    return rows.select(
        SITE,
        "water_year",
        "median_bf",
        "lowflow",
        mean.alias("mean_lowflow"),
        F.try_divide(F.col("lowflow") - mean, mean).alias("diff_mean_lowflow"),
        _min_max("lowflow").alias("norm_minmax"),
        F.try_divide(F.col("lowflow") - mean, F.stddev_samp("lowflow").over(site)).alias("norm_zscore"),
        F.min("water_year").over(site).alias("min_year"),
    )


def driest_year_tally(normalised: DataFrame) -> DataFrame:
    """How many sites have their lowest low flow in each year."""
    return normalised.where(F.col("norm_minmax") == 0).groupBy("water_year").agg(F.count(F.lit(1)).alias("n"))
