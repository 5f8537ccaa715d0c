"""Site screening and record selection before the concentration model."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.aggregates import bounded_rank, with_nulls
from ..functions.columns import water_year
from ..functions.quantiles import quantile
from ..functions.series import DEAL, SITE, by_site, date_bounds, dealt, for_dealt, gap_days, longest_missing_run, segment_id


def site_screen_coavailable(
    catalog: DataFrame,
    sample_params: Sequence[str] = ("00094", "00095"),
    flow_param: str = "00060",
    site_type: str = "ST",
) -> DataFrame:
    """Sites of one type that have a sample parameter and discharge, one row per site.

    The discharge entry may be of any site type. Both conditions and the row to keep (lowest
    parameter code) come from one aggregation of the catalogue instead of an intersect and a join.
    """
    sampled = (F.col("site_tp_cd") == site_type) & F.col("parameter_cd").isin(*sample_params)
    rest = [c for c in catalog.columns if c not in (SITE, "parameter_cd")]
    picked = (
        catalog.where(sampled | (F.col("parameter_cd") == flow_param))
        .groupBy(SITE)
        .agg(
            F.min(F.when(sampled, F.struct("parameter_cd", *rest))).alias("_row"),
            F.bool_or(F.col("parameter_cd") == flow_param).alias("_flow"),
        )
        .where(F.col("_row").isNotNull() & F.col("_flow"))
    )
    return picked.select(SITE, "_row.*").select(*catalog.columns)


def site_screen_counts(samples: DataFrame, daily: DataFrame, min_dates: int = 60) -> DataFrame:
    """Sites with more than ``min_dates`` distinct sample dates and at least one daily row."""
    dates = samples.groupBy(SITE).agg(F.count_distinct("sample_dt").alias("n_sample_dates"))
    days = daily.groupBy(SITE).agg(F.count(F.lit(1)).alias("n_daily_rows"))
    return dates.where(F.col("n_sample_dates") > min_dates).join(days, SITE)


def site_screen_continuity(samples: DataFrame, daily: DataFrame, max_gap: int = 30) -> DataFrame:
    """Good or Bad per sampled site: longest run without discharge between first and last sample.

    The daily series is cropped to the sampled period; days that are absent or null count alike.
    A site with nothing left is Bad, a site without a gap is Good.
    """
    bounds = date_bounds(samples.where(F.col("sample_dt").isNotNull()), "sample_dt", "_first", "_last")
    days = daily.select(F.col(SITE).alias("_site"), "date", "q")
    inside = (F.col(SITE) == F.col("_site")) & F.col("date").between(F.col("_first"), F.col("_last"))
    cropped = bounds.join(days, inside, "left").select(SITE, "date", "q")
    runs = longest_missing_run(cropped, F.col("q").isNotNull())
    return runs.select(
        SITE,
        "max_run",
        F.when(F.col("max_run") <= max_gap, F.lit("Good")).otherwise(F.lit("Bad")).alias("keep"),
    )


def sample_segments(
    samples: DataFrame, break_days: int = 730, min_obs: int = 60, keep_edges: bool = False
) -> DataFrame:
    """Samples that lie in long stretches without a gap of more than ``break_days``.

    Repeated sample dates collapse to one (the lowest value is kept, so that reruns agree). By
    default the first date of a site is lost, having no gap to its predecessor, and so is the
    last row, which only closes the last segment; ``keep_edges`` repairs both. The gap of the
    first remaining row still counts from the lost date.
    """
    once = samples.where(F.col("sample_dt").isNotNull()).groupBy(SITE, "sample_dt").agg(
        F.min("result_va").alias("result_va")
    )
    gaps = once.withColumn("gap_days", gap_days("sample_dt"))
    if not keep_edges:
        gaps = gaps.where(F.col("gap_days").isNotNull())
    ordered = by_site("sample_dt")
    starts = (F.row_number().over(ordered) == 1) | (F.col("gap_days") > break_days)
    marked = gaps.withColumns({"_start": starts, "_last": F.lead("sample_dt").over(ordered).isNull()})
    if not keep_edges:
        marked = marked.where(~F.col("_last"))
    segments = marked.withColumn("segment", segment_id(F.col("_start"), "sample_dt"))
    size = F.count(F.lit(1)).over(Window.partitionBy(SITE, "segment"))
    return (
        segments.withColumn("segment_obs", size)
        .where(F.col("segment_obs") >= min_obs)
        .select(SITE, "sample_dt", "result_va", "gap_days", water_year("sample_dt").alias("water_year"), "segment", "segment_obs")
    )


def segment_classes(samples: DataFrame, break_days: int = 730, min_obs: int = 60) -> DataFrame:
    """Class of each site by its number of long segments: no_break, one_break or many_breaks.

    Usually takes the result of ``sample_segments``; repeated dates count once, which needs no
    exchange for rows already placed by site. Gaps are computed anew, so a segment that was dropped before shows as one gap. The last row of a site
    closes its last segment and is not counted in it. A site with a single row is many_breaks.
    """
    ordered = by_site("sample_dt")
    marked = samples.select(SITE, "sample_dt").distinct().select(
        SITE,
        "sample_dt",
        ((F.row_number().over(ordered) == 1) | F.coalesce(gap_days("sample_dt") > break_days, F.lit(False))).alias("_start"),
        F.lead("sample_dt").over(ordered).isNull().alias("_last"),
    ).withColumn("segment", segment_id(F.col("_start"), "sample_dt"))
    sizes = marked.groupBy(SITE, "segment").agg(
        F.count_if(~F.col("_last")).alias("_obs"), F.count(F.lit(1)).alias("_rows")
    )
    sites = sizes.groupBy(SITE).agg(
        F.sum("_rows").alias("n_obs"), F.count_if(F.col("_obs") >= min_obs).alias("n_long_segments")
    )
    label = (
        F.when((F.col("n_obs") == 1) | (F.col("n_long_segments") > 2), "many_breaks")
        .when(F.col("n_long_segments") == 2, "one_break")
        .otherwise("no_break")
    )
    return sites.withColumn("segment_class", label)


def _lead_days(lead_years: float, inclusive: bool) -> int:
    """Whole days allowed before the first sample when the bound is lead_years * 365.25 + 1 days."""
    bound = lead_years * 365.25 + 1
    return math.floor(bound) if inclusive else math.ceil(bound) - 1


def model_window_inputs(
    samples: DataFrame, daily: DataFrame, lead_years: float = 10, months: int = 12, inclusive: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Discharge and samples of the sites sampled in ``months`` different calendar months.

    Discharge starts ``lead_years`` and a day before the first sample. Samples lie between the
    first discharge day of the whole record and the last one, bounds excluded unless ``inclusive``.
    Returns (daily, samples).
    """
    sampled = samples.groupBy(SITE).agg(
        F.min("sample_dt").alias("_first"), F.count_distinct(F.month("sample_dt")).alias("_months")
    ).where(F.col("_months") >= months)
    starts = sampled.select(SITE, F.date_sub("_first", _lead_days(lead_years, inclusive)).alias("_from"))
    kept_daily = daily.join(starts, SITE).where(F.col("date") >= F.col("_from")).select(*daily.columns)
    ends = date_bounds(daily, "date", "_lo", "_hi")
    recorded = ends.join(starts, SITE).where(F.col("_hi") >= F.col("_from"))
    day = F.col("sample_dt")
    inside = day.between(F.col("_lo"), F.col("_hi")) if inclusive else (day > F.col("_lo")) & (day < F.col("_hi"))
    kept_samples = samples.join(recorded, SITE).where(inside).select(*samples.columns)
    return kept_daily, kept_samples


def final_record_filter(
    samples: DataFrame,
    daily: DataFrame,
    sd_k: float = 4,
    min_obs: int = 60,
    min_years: int = 10,
    lead_years: float = 10,
    more_samples: Sequence[DataFrame] = (),
    more_daily: Sequence[DataFrame] = (),
) -> tuple[DataFrame, DataFrame]:
    """Last crop before the model: discharge window, outliers, then short records.

    Inputs prepared apart (records with one break) are added with ``more_*``. Samples above mean
    plus ``sd_k`` standard deviations of their site go; the date crop of samples is deliberately
    not applied, only this one. Sites left with fewer than ``min_obs`` samples or ``min_years``
    distinct water years go from both tables. Returns (samples, daily). Where rows meet their site's
    one row they are dealt to many tasks by day and value, so a site with most of the rows is spread.
    Samples without further columns move once for both meetings, others twice, the first time without those.
    """
    for extra in more_samples:
        samples = samples.unionByName(extra, allowMissingColumns=True)
    for extra in more_daily:
        daily = daily.unionByName(extra, allowMissingColumns=True)
    sites = samples.groupBy(SITE).agg(
        F.min("sample_dt").alias("_first"),
        F.max("sample_dt").alias("_last"),
        (F.avg("result_va") + sd_k * F.stddev_samp("result_va")).alias("_cutoff"),
    )
    met = [SITE, DEAL]
    rows = dealt(samples, "sample_dt", "result_va")
    usual = rows.join(for_dealt(sites), met).where(F.col("result_va") <= F.col("_cutoff"))
    # A site has as many cells as years, so distinct years need no rows of their own.
    cells = usual.groupBy(SITE, water_year("sample_dt").alias("_year")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("_first", "_last", "_cutoff")]
    )
    long_enough = (
        cells.groupBy(SITE)
        .agg(F.sum("_n").alias("_n"), F.count("_year").alias("_years"), *[F.first(c).alias(c) for c in ("_first", "_last", "_cutoff")])
        .where((F.col("_n") >= min_obs) & (F.col("_years") >= min_years))
    )
    kept_samples = rows.join(for_dealt(long_enough.select(SITE, "_cutoff")), met).where(F.col("result_va") <= F.col("_cutoff"))
    in_window = F.col("date").between(F.date_sub("_first", _lead_days(lead_years, True)), F.col("_last"))
    kept_daily = dealt(daily, "date").join(for_dealt(long_enough), met).where(in_window)
    return kept_samples.select(*samples.columns), kept_daily.select(*daily.columns)


def record_summary(samples: DataFrame, daily: DataFrame, null_policy: str = "skip") -> DataFrame:
    """First and last sample, years of record, median discharge, display rank by first date."""
    spans = date_bounds(samples, "sample_dt", "min_date", "max_date").withColumn(
        "num_years", F.datediff("max_date", "min_date") / 7 / 52.25
    )
    flow = daily.groupBy(SITE).agg(with_nulls(quantile("q", 0.5), "q", null_policy).alias("median_q"))
    summary = spans.join(flow, SITE).withColumn("ln_median_q", F.when(F.col("median_q") > 0, F.ln("median_q")))
    return bounded_rank(summary, "min_date").select(
        SITE, "min_date", "max_date", "num_years", "median_q", "ln_median_q", "display_rank"
    )
