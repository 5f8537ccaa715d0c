"""Every registered query: result shape, Spark plan, and its SQL twin.

A shape lists ``column:kind`` with kind s (text), i (whole number), d (date as text) or f<n>
(double rounded to n digits). It is applied to both sides, so that they agree in names, types and
rounding. Thresholds that differ from the defaults are the scaled ones of ``FIXTURES.md``, chosen
so that each filter keeps some rows and drops some.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import operators as op
from ..functions.aggregates import bind_map, error_summary, null_counts
from ..functions.columns import site_year_key, sort_key
from ..operators.harmonise import CLIMATE_DRIVERS, DRIVER_SETS, rows_per_site
from ..operators.report import DRIVER_LABELS, flow_condition_counts, gain_histogram
from ..session import cut_lineage, new_folder
from ..sources.readers import SAMPLES, read_many, read_per_site_files, read_table
from ..sources.writers import write_by_site, write_csv, write_parquet
from .oracle import with_ctes, wy
from .views import KEYS, LAND_CLASSES, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _spark_shape(df: DataFrame, shape: str) -> DataFrame:
    kinds = {"s": lambda c: c.cast("string"), "i": lambda c: c.cast("bigint"), "d": lambda c: c.cast("string")}
    out = []
    for item in shape.split():
        name, kind = item.split(":")
        column = F.col(name)
        out.append((F.round(column.cast("double"), int(kind[1:])) + 0.0 if kind[0] == "f" else kinds[kind](column)).alias(name))
    return df.select(*out)


def _sql_shape(select: str, shape: str) -> str:
    forms = {"s": "cast({0} as varchar)", "i": "cast({0} as bigint)", "d": "cast(cast({0} as date) as varchar)"}
    out = []
    for item in shape.split():
        name, kind = item.split(":")
        quoted = f'"{name}"'
        form = f"round(cast({quoted} as double), {kind[1:]}) + 0.0" if kind[0] == "f" else forms[kind].format(quoted)
        out.append(f"{form} as {quoted}")
    return f"select {', '.join(out)} from ({select})"


def query(shape: str, sql: str | None = None):
    def add(plan: Callable[[Views], DataFrame]):
        name = plan.__name__
        QUERIES[name] = lambda spark, sf_dir: _spark_shape(plan(Views(spark, sf_dir)), shape)
        if sql is not None:
            ORACLE[name] = with_ctes(_sql_shape(sql, shape))
        return plan

    return add


# --- screening -----------------------------------------------------------------------------------


@query(
    "site_no:s site_tp_cd:s parameter_cd:s",
    """select site_no, any_value(site_tp_cd) as site_tp_cd, min(parameter_cd) as parameter_cd from site_catalog
    where site_tp_cd = 'ST' and parameter_cd in ('00094', '00095')
      and site_no in (select site_no from site_catalog where parameter_cd = '00060') group by site_no""",
)
def site_screen_coavailable(v: Views) -> DataFrame:
    return op.site_screen_coavailable(v.site_catalog)


@query(
    "site_no:s n_sample_dates:i n_daily_rows:i",
    """select s.site_no, n_sample_dates, n_daily_rows from (select site_no, count(distinct sample_dt) as n_sample_dates from samples group by 1) s
    join (select site_no, count(*) as n_daily_rows from daily_q group by 1) d on s.site_no = d.site_no where n_sample_dates > 696""",
)
def site_screen_counts(v: Views) -> DataFrame:
    v.fan_out("q", "a_ratio")
    return op.site_screen_counts(v.samples, v.daily_q, min_dates=696)


@query(
    "site_no:s max_run:i keep:s",
    """select b.site_no, max_run, case when max_run <= 8 then 'Good' else 'Bad' end as keep from screen_bounds b left join (
    select site_no, max(coalesce(date - prev - 1, 0)) as max_run from (
    select d.site_no, date, lag(date) over (partition by d.site_no order by date) as prev from daily_q d
    join screen_bounds s on d.site_no = s.site_no where date between lo and hi) group by 1) r on b.site_no = r.site_no""",
)
def site_screen_continuity(v: Views) -> DataFrame:
    v.fan_out("q", "a_ratio")
    return op.site_screen_continuity(v.samples, v.daily_q, max_gap=8)


@query("site_no:s sample_dt:d result_va:f4 gap_days:i water_year:i segment:i segment_obs:i", f"select *, {wy('sample_dt')} as water_year from segmented")
def sample_segments(v: Views) -> DataFrame:
    return op.sample_segments(v.samples, break_days=18)


@query(
    "site_no:s n_obs:i n_long_segments:i segment_class:s",
    """select *, case when n_obs = 1 or n_long_segments > 2 then 'many_breaks' when n_long_segments = 2 then 'one_break' else 'no_break' end as segment_class from reclassed""",
)
def segment_classes(v: Views) -> DataFrame:
    return op.segment_classes(op.sample_segments(v.samples, break_days=18), break_days=18)


@query(
    "kind:s site_no:s day:d value:f4",
    """select 'discharge' as kind, d.site_no, d.date as day, q as value from daily_q d join (select site_no, min(sample_dt) as f from samples
        group by 1 having count(distinct month(sample_dt)) >= 12) s on d.site_no = s.site_no where date >= f - 366
    union all select 'sample', p.site_no, p.sample_dt, p.result_va from samples p join (
        select d.site_no, min(date) as lo, max(case when date >= f - 366 then date end) as hi from daily_q d join (select site_no, min(sample_dt) as f from samples
        group by 1 having count(distinct month(sample_dt)) >= 12) s on d.site_no = s.site_no group by 1) w
        on p.site_no = w.site_no where p.sample_dt > lo and p.sample_dt < hi""",
)
def model_window_inputs(v: Views) -> DataFrame:
    v.fan_out("q", "a_ratio")
    daily, samples = op.model_window_inputs(v.samples, v.daily_q, lead_years=1)
    return daily.select(F.lit("discharge").alias("kind"), "site_no", F.col("date").alias("day"), F.col("q").alias("value")).union(
        samples.select(F.lit("sample"), "site_no", "sample_dt", "result_va")
    )


_FINAL = f"""(select s.site_no, lo, hi, cut from (select site_no, min(sample_dt) as lo, max(sample_dt) as hi, avg(result_va) + 4 * stddev_samp(result_va) as cut
    from samples group by 1) s join samples p on p.site_no = s.site_no and p.result_va <= cut group by 1, 2, 3, 4
    having count(*) >= 700 and count(distinct {wy('sample_dt')}) >= 5)"""


@query(
    "kind:s site_no:s day:d value:f4",
    f"""select 'sample' as kind, p.site_no, sample_dt as day, result_va as value from samples p join {_FINAL} f on p.site_no = f.site_no where result_va <= cut
    union all select 'discharge', d.site_no, date, q from daily_q d join {_FINAL} f on d.site_no = f.site_no where date between lo - 3653 and hi""",
)
def final_record_filter(v: Views) -> DataFrame:
    v.fan_out("q", "a_ratio")
    samples, daily = op.final_record_filter(v.samples, v.daily_q, min_obs=700, min_years=5)
    return samples.select(F.lit("sample").alias("kind"), "site_no", F.col("sample_dt").alias("day"), F.col("result_va").alias("value")).union(
        daily.select(F.lit("discharge"), "site_no", "date", "q")
    )


@query(
    "site_no:s min_date:d max_date:d num_years:f6 median_q:f4 ln_median_q:f6 display_rank:i",
    """select s.site_no, lo as min_date, hi as max_date, (hi - lo) / 7.0 / 52.25 as num_years, m as median_q, ln(m) as ln_median_q,
    dense_rank() over (order by lo) as display_rank from screen_bounds s join (select site_no, median(q) as m from daily_q group by 1) d on s.site_no = d.site_no""",
)
def record_summary(v: Views) -> DataFrame:
    v.fan_out("q", "a_ratio")
    return op.record_summary(v.samples, v.daily_q)


# --- daily records -------------------------------------------------------------------------------


@query(
    "site_no:s n_rows:i n_days:i",
    "select site_no, count(*) as n_rows, max(date) - min(date) + 1 as n_days from daily_q group by 1 having count(*) <> max(date) - min(date) + 1",
)
def missing_day_sites(v: Views) -> DataFrame:
    return op.missing_day_sites(v.daily_q)


@query("site_no:s date:d q:f4 filled_q:f6 interp_flag:s", "select * from filled")
def fill_daily_gaps(v: Views) -> DataFrame:
    return v.filled


@query("site_no:s max_run:i", "select * from all_runs")
def interpolated_runs(v: Views) -> DataFrame:
    return op.interpolated_runs(v.filled)


@query(
    "site_no:s date:d q:f6",
    """select f.site_no, f.date, filled_q as q from filled f join all_runs r on f.site_no = r.site_no left join screen_bounds b on f.site_no = b.site_no
    where f.site_no <> 'Brand#3' and (max_run <= 8 or f.date > lo)""",
)
def resolve_long_gaps(v: Views) -> DataFrame:
    v.fan_out("q", "a_ratio")
    return op.resolve_long_gaps(v.filled, v.samples, max_run=8, exclude=["Brand#3"])[0]


@query(
    "site_no:s date:d filled_q:f6 interp_flag:s cond:f4",
    """select f.site_no, f.date, filled_q, interp_flag, result_va as cond from filled f join all_runs r on f.site_no = r.site_no and max_run > 8
    left join samples s on f.site_no = s.site_no and f.date = s.sample_dt""",
)
def sample_overlay(v: Views) -> DataFrame:
    v.fan_out("q", "a_ratio")
    return op.sample_overlay(v.filled, v.samples, max_run=8)


# --- separation and low flow ---------------------------------------------------------------------


@query("site_no:s runoff:f4 gw:f4", "select * from members")
def end_members(v: Views) -> DataFrame:
    return op.end_members(v.fan_out("a_ratio").samples)


@query("site_no:s date:d q:f4 gen_conc:f4 bf:f4 bf_percent:f6", "select * from separated")
def baseflow_separation(v: Views) -> DataFrame:
    v.fan_out("q", "ratio", "a_ratio")
    return op.baseflow_separation(v.daily_est, op.end_members(v.samples))


@query("site_no:s date:d q:f6 water_year:i", "select * from complete")
def complete_water_years(v: Views) -> DataFrame:
    return v.complete


@query(
    "site_no:s water_year:i median_bf:f6",
    "select * from annual_bf",
)
def annual_baseflow(v: Views) -> DataFrame:
    v.fan_out("q", "ratio", "a_ratio")
    return v.annual_bf


def _mid_annual(v: Views) -> DataFrame:
    v.fan_out("q", "ratio", "a_ratio")
    return v.annual(v.members(0.4, 0.6), min_years=1)


@query("site_no:s n_outside:i flag:s", "select * from mid_flags")
def baseflow_out_of_range(v: Views) -> DataFrame:
    return op.baseflow_out_of_range(_mid_annual(v))


@query(
    "site_no:s water_year:i median_bf:f6",
    "select * from annual_mid where site_no in (select site_no from mid_flags where flag = 'fine')",
)
def in_range_sites(v: Views) -> DataFrame:
    annual = _mid_annual(v)
    return op.in_range_sites(annual, op.baseflow_out_of_range(annual))


@query("site_no:s year:i q5:f4 norm_q5:f6", "select * from q5")
def low_flow_q5(v: Views) -> DataFrame:
    return v.q5


@query(
    "site_no:s year:i q5:f4 norm_q5:f6",
    """select site_no, year, q5, case when count(*) over s = count(q5) over s then (q5 - min(q5) over s) / nullif(max(q5) over s - min(q5) over s, 0) end as norm_q5
    from (select site_no, year(date) as year, case when count(*) = count(m) then quantile_cont(m, 0.05) end as q5
        from (select site_no, date, case when q > 1 then q end as m from daily_q) where month(date) between 8 and 10 group by 1, 2)
    window s as (partition by site_no)""",
)
def low_flow_q5_whole_seasons(v: Views) -> DataFrame:
    """A day of one unit or less counts as not measured, and leaves its season without a low flow."""
    measured = v.daily_q.withColumn("q", F.when(F.col("q") > 1, F.col("q")))
    return op.low_flow_q5(measured, null_policy="propagate")


@query(
    "site_no:s year:i q5:f4",
    "select * from q5_long",
)
def low_flow_q5_long_season(v: Views) -> DataFrame:
    return v.q5_long


@query(
    "site_no:s water_year:i median_bf:f6 lowflow:f4 mean_lowflow:f4 diff_mean_lowflow:f6 norm_minmax:f6 norm_zscore:f6 min_year:i",
    "select * from normalised",
)
def low_flow_normalised(v: Views) -> DataFrame:
    v.fan_out("q", "ratio", "a_ratio")
    return op.low_flow_normalised(v.annual_bf, v.q5_long)


@query("water_year:i n:i", "select water_year, count(*) as n from normalised where norm_minmax = 0 group by 1")
def driest_year_tally(v: Views) -> DataFrame:
    v.fan_out("q", "ratio", "a_ratio")
    return op.driest_year_tally(op.low_flow_normalised(v.annual_bf, v.q5_long))


@query("site_no:s water_year:i bf_prop:f6 q5:f4 norm_q5:f6", "select * from site_years")
def site_year_stats(v: Views) -> DataFrame:
    v.fan_out("q", "ratio", "a_ratio")
    return op.site_year_stats(v.annual_bf, v.q5)


# --- recession and storage -----------------------------------------------------------------------


@query(
    "site_no:s recession_curve_slope:f6 intercept:f4 r2:f6 t_stat:f4 n:i",
    "select *, sign(recession_curve_slope) * sqrt(r2 * (n - 2) / (1 - r2)) as t_stat from slopes",
)
def recession_slope(v: Views) -> DataFrame:
    return op.recession_slope(v.daily_q)


@query("site_no:s date:d ln_q:f6 ln_recession:f6", "select site_no, date, ln(q) as ln_q, ln(recession) as ln_recession from recession")
def recession_points(v: Views) -> DataFrame:
    return op.recession_points(v.daily_q)


@query(
    "site_no:s rbfi:f6",
    """select site_no, sum(a) / sum(q) as rbfi from (select site_no, q, abs(q - lag(q) over (partition by site_no order by date)) as a from changes)
    where a is not null group by 1""",
)
def flashiness_index(v: Views) -> DataFrame:
    return op.flashiness_index(v.daily_q)


@query(
    "site_no:s rbfi:f6",
    """select site_no, sum(a) / sum(q) as rbfi from (select site_no, q, abs(q - lag(q) over (partition by site_no order by date)) as a from daily_q)
    where a is not null group by 1""",
)
def flashiness_index_standard(v: Views) -> DataFrame:
    return op.flashiness_index(v.daily_q, standard=True)


@query(
    "site_no:s date:d water_year:i wy_day:i q_mm:f4 ds:f4 ds_sum:f4",
    f"""select site_no, date, water_year, date - make_date(cast(water_year - 1 as integer), 10, 1) + 1 as wy_day, q_mm, ds,
        sum(ds) over (partition by site_no, water_year order by date) as ds_sum from (
    select x.site_no, x.date, water_year, q * 86400 * 1000 / (drain_area_va * 2.59e6) as q_mm,
        p.value * 1000 - q * 86400 * 1000 / (drain_area_va * 2.59e6) - e.value * -1000 as ds from (
    select *, max(case when smooth = top then 1 else 0 end) over (partition by site_no, water_year order by date) as seen from (
    select *, max(smooth) over (partition by site_no, water_year) as top from (
    select *, cum / max(cum) over (partition by site_no, water_year) as share from (
    select *, sum(q) over (partition by site_no, water_year order by date) as cum,
        case when count(q) over k = 7 then avg(q) over k end as smooth from (
    select site_no, date, filled_q as q, {wy('date')} as water_year, count(*) over (partition by site_no, {wy('date')}) as n from filled)
    where n = 365 window k as (partition by site_no order by date rows between 6 preceding and current row))) where share > 0.4)) x
    left join site_info i on x.site_no = i.site_no left join et e on x.site_no = e.site_no and x.date = e.dates
    left join precip p on x.site_no = p.site_no and x.date = p.dates where seen = 1)""",
)
def storage_drawdown(v: Views) -> DataFrame:
    v.fan_out("q", "tax", "discount")
    return op.storage_drawdown(v.filled_q, v.area, v.et, v.precip)


# --- climate and landscape -----------------------------------------------------------------------


@query(
    "site_no:s dates:d value:f6",
    """select case when length(b) < 8 then '0' || b else b end as site_no, d.dates, e.value from (select distinct dates from et) d
    cross join (select distinct site_no as b from et) s left join et e on e.dates = d.dates and e.site_no = s.b""",
)
def climate_wide_to_long(v: Views) -> DataFrame:
    return op.climate_wide_to_long(v.wide(v.et))


@query(
    "site_no:s dates:d value:f6",
    """select case when length(site_no) < 8 then '0' || site_no else site_no end as site_no, dates, value from (
    select b as site_no, d.dates, e.value from (select distinct dates from et) d cross join (select distinct site_no as b from et) s
    left join et e on e.dates = d.dates and e.site_no = s.b
    union all select b, d.dates, p.value from (select distinct dates from precip) d cross join (select distinct site_no as b from precip) s
    left join precip p on p.dates = d.dates and p.site_no = s.b)""",
)
def climate_files_merge(v: Views) -> DataFrame:
    """Two whole files; the second has two-digit years and a column name that drifted."""
    first, second = v.wide(v.et), v.wide(v.precip)
    second = second.withColumn("dates", F.date_format("dates", "M/d/yy")).withColumnRenamed("XBrand#7..", "drifted")
    fixes = {1: {"rename": {"drifted": "XBrand#7.."}, "date_format": "M/d/yy"}}
    # Two-digit years read as 20xx; the century fix moves those past 2023 back.
    merged = op.two_digit_year_fix(op.climate_files_merge([first, second], fixes))
    return op.climate_wide_to_long(merged)


_REGION = "cast(regexp_extract(site_no, '(\\d+)', 1) as int) % 3"


@query(
    "site_no:s dates:d value:f6",
    f"""select case when length(b) < 8 then '0' || b else b end as site_no, d.dates, p.value from (select distinct {_REGION} as g, dates from precip) d
    join (select distinct {_REGION} as g, site_no as b from precip) s on s.g = d.g left join precip p on p.dates = d.dates and p.site_no = s.b""",
)
def climate_folder(v: Views) -> DataFrame:
    """Wide CSV files of three regions, each with its own sites, date format and drift, from one folder."""
    v.fan_out("discount")
    path = new_folder(v.spark)
    for region, (form, date) in enumerate([("yyyy-MM-dd", "dates"), ("M/d/yy", "Date"), ("dd.MM.yyyy", "dates")]):
        wide = v.wide(v.precip.where(v.number() % 3 == region))
        wide = wide.withColumn("dates", F.date_format("dates", form)).withColumnRenamed("dates", date)
        write_csv(wide, f"{path}/region{region}")
    formats = ("yyyy-MM-dd", "M/d/yy", "dd.MM.yyyy")
    return op.two_digit_year_fix(op.climate_folder(v.spark, f"{path}/*", formats=formats, rename={"Date": "dates"}))


_ID = "regexp_extract(site_no, '(\\d+)', 1)"


@query(
    "kind:s site_no:s date:d value:f4",
    f"""select kind, '0' || {_ID} as site_no, date, value from (select 'sample' as kind, site_no, sample_dt as date, result_va as value from samples
    union all select 'daily', site_no, date, q from daily_q) union all
    select 'site file' as kind, {_ID} as site_no, date, q as value from daily_q union all
    select 'bucket' as kind, {_ID} as site_no, date, q as value from daily_q""",
)
def landed_files(v: Views) -> DataFrame:
    """Samples and daily values written as files (whole, by site, by bucket of sites) and read back."""
    v.fan_out("q", "a_ratio")
    path, own = new_folder(v.spark), v.number().cast("string")
    daily = v.daily_q.withColumn("site_no", own)
    write_csv(v.samples.withColumn("site_no", own), f"{path}/samples")
    write_parquet(daily, f"{path}/daily")
    write_by_site(daily, f"{path}/sites", fmt="csv")
    write_by_site(daily, f"{path}/buckets", buckets=8, fmt="csv")
    samples = read_table(v.spark, f"{path}/samples", SAMPLES, fmt="csv")
    whole = read_table(v.spark, f"{path}/daily")
    by_site = read_per_site_files(v.spark, f"{path}/sites/*/*.csv", r"/site_no=([^/]+)/[^/]+$", "date DATE, q DOUBLE")
    buckets = read_many(v.spark, [f"{path}/buckets/*/*.csv"])
    parts = [
        samples.select(F.lit("sample").alias("kind"), "site_no", F.col("sample_dt").alias("date"), F.col("result_va").alias("value")),
        whole.select(F.lit("daily").alias("kind"), "site_no", "date", F.col("q").alias("value")),
        by_site.select(F.lit("site file").alias("kind"), "site_no", "date", F.col("q").alias("value")),
        buckets.select(F.lit("bucket").alias("kind"), "site_no", F.to_date("date").alias("date"), F.col("q").cast("double").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("site_no:s water_year:i annual_evap_mm:f4", "select * from evap")
def annual_evaporation(v: Views) -> DataFrame:
    return op.annual_evaporation(v.et)


@query("site_no:s water_year:i annual_precip_mm:f4", "select * from prec")
def annual_precipitation(v: Views) -> DataFrame:
    return op.annual_precipitation(v.precip)


@query("site_no:s water_year:i mean_temp_c:f4", "select * from tair")
def annual_temperature(v: Views) -> DataFrame:
    return op.annual_temperature(v.temp)


@query(
    "site_no:s dates:d value:f6",
    "select site_no, case when year(dates) > 1999 then dates - interval 100 year else dates end as dates, value from precip",
)
def two_digit_year_fix(v: Views) -> DataFrame:
    return op.two_digit_year_fix(v.precip, pivot=1999)


@query("site_no:s water_year:i peak_swe_day:i peak_swe_mm:f4", "select * from peak")
def peak_snow(v: Views) -> DataFrame:
    return op.peak_snow(v.swe)


@query(
    "site_no:s water_year:i peak_swe_day:i peak_swe_mm:f4 sdd:i melt_days:i melt_rate:f6",
    "select *, sdd - peak_swe_day as melt_days from snow",
)
def snow_disappearance(v: Views) -> DataFrame:
    swe = v.fan_out("r_q").swe
    return op.snow_disappearance(swe, op.peak_snow(swe))


_CLASS_SHARES = ", ".join(f"sum(area) filter (where class = '{c}') / sum(area) as \"{c}\"" for c in LAND_CLASSES)


_OTHER = f"class is null or class not in ({', '.join(repr(c) for c in LAND_CLASSES)})"


@query(
    "site_no:s year:i " + " ".join(f"{c}:f6" for c in LAND_CLASSES) + " other:f6",
    f"select site_no, year, {_CLASS_SHARES}, sum(area) filter (where {_OTHER}) / sum(area) as other from land_cover group by 1, 2",
)
def class_proportions(v: Views) -> DataFrame:
    cover = v.land_cover
    coarse = F.col("year").isin(1995, 2000)
    return op.class_proportions([cover.where(coarse), cover.where(~coarse)], LAND_CLASSES, other="other")


@query("site_no:s year:i class:s share:f6", "select site_no, year, class, sum(area) / sum(sum(area)) over (partition by site_no, year) as share from land_cover group by 1, 2, 3")
def class_shares(v: Views) -> DataFrame:
    """Every class that occurs, as rows."""
    return op.class_proportions([v.land_cover])


@query("site_no:s lith:s proportion:f6", "select site_no, lith, sum(proportion) as proportion from geology group by 1, 2")
def geology_shares(v: Views) -> DataFrame:
    """Every lithology that occurs, as rows."""
    return op.geology_proportions(v.geology)


@query(
    "site_no:s year:i class:s share:f6",
    """select q.site_no, q.year, c.class, first_value(area / total ignore nulls) over (partition by q.site_no, c.class order by q.year rows between current row and unbounded following) as share
    from q5 q join (select distinct class from land_cover) c on true
    left join (select *, sum(area) over (partition by site_no, year) as total from land_cover) l on l.site_no = q.site_no and l.year = q.year and l.class = c.class
    qualify share is not null""",
)
def cover_of_site_years(v: Views) -> DataFrame:
    """Every class of every site-year of the low-flow table, carried through the panel join as one map and filled from later years."""
    v.fan_out("q")
    cover = op.class_maps([v.land_cover]).withColumnRenamed("year", "water_year")
    facts = v.q5.withColumnRenamed("year", "water_year").withColumn("bf_prop", F.lit(None).cast("double"))
    panel = op.backfill_maps(op.harmonise(facts, annual=[cover]), "shares")
    return panel.select("site_no", F.col("water_year").alias("year"), F.explode("shares").alias("class", "share"))


@query(
    "site_no:s year:i " + " ".join(f"{c}:f6" for c in LAND_CLASSES[:2]) + " other:f6",
    f"""select site_no, year, {_CLASS_SHARES.split(", sum")[0]}, sum{_CLASS_SHARES.split(", sum")[1]},
    sum(area) filter (where class is null or class not in ({", ".join(repr(c) for c in LAND_CLASSES[:2])})) / sum(area) as other from land_cover group by 1, 2""",
)
def cover_bound_late(v: Views) -> DataFrame:
    """Two classes as columns bound from the map; all that the list does not name is in ``other``."""
    return bind_map(op.class_maps([v.land_cover]), "shares", LAND_CLASSES[:2], other="other")


_LITHS = ", ".join(f"sum(proportion) filter (where lith = '{c}') as \"{c}\"" for c in LAND_CLASSES)
_LITH_SUM = " + ".join(f'coalesce("{c}", 0)' for c in LAND_CLASSES)


@query(
    "site_no:s total:f6 " + " ".join(f"{c}:f6" for c in LAND_CLASSES),
    f"select *, {_LITH_SUM} as total from (select site_no, {_LITHS} from geology group by 1) where {_LITH_SUM} > 0.99",
)
def geology_proportions(v: Views) -> DataFrame:
    return op.complete_composition(op.geology_proportions(v.geology, LAND_CLASSES), LAND_CLASSES)


@query("site_no:s lat:f2 lon:f2 zone:s", "select i.site_no, lat, lon, zone from site_info i join zones z on i.site_no = z.site_no")
def climate_zone_lookup(v: Views) -> DataFrame:
    return op.climate_zone_lookup(v.site_info.select("site_no", "lat", "lon"), v.zone_grid, v.zone_names)


@query("zone:s n_sites:i", "select zone, count(distinct site_no) as n_sites from zones group by 1")
def sites_per_zone(v: Views) -> DataFrame:
    return op.sites_per_zone(v.zones)


@query("site_no:s a1:f2 a2:f2", "select site_no, nullif(a1, -999) as a1, nullif(a2, -999) as a2 from attributes")
def sentinel_to_null(v: Views) -> DataFrame:
    return op.sentinel_to_null(v.attributes, ["a1", "a2"])


@query(
    "site_no:s mean_elevation:f4 mean_slope:f4",
    "select site_no, mean_elevation, mean_slope from site_info where site_no is not null",
)
def basin_attribute(v: Views) -> DataFrame:
    """Two one-row tables with a decorated column per site, turned into rows and joined."""
    decorated = v.site_info.where("site_no is not null").withColumn("column", F.concat(F.lit("X"), "site_no", F.lit(".1")))
    elevation, slope = (op.basin_attribute(decorated.groupBy().pivot("column").agg(F.first(c)), c) for c in ("mean_elevation", "mean_slope"))
    return elevation.join(slope, "site_no")


_KNOWN = 0.16  # a share below this counts as not known, so that there is something to fill
_BACK = ", ".join(
    f"first_value(case when \"{c}\" >= {_KNOWN} then \"{c}\" end ignore nulls) over (partition by site_no order by year rows between current row and unbounded following) as \"{c}\""
    for c in LAND_CLASSES
)


@query(
    "site_no:s water_year:i " + " ".join(f"{c}:f6" for c in LAND_CLASSES),
    f"select site_no, year as water_year, {_BACK} from (select site_no, year, {_CLASS_SHARES} from land_cover group by 1, 2)",
)
def backfill_series(v: Views) -> DataFrame:
    shares = op.class_proportions([v.land_cover], LAND_CLASSES).withColumnRenamed("year", "water_year")
    known = shares.withColumns({c: F.when(F.col(c) >= _KNOWN, F.col(c)) for c in LAND_CLASSES})
    return op.backfill_series(known, LAND_CLASSES)


# --- panel and models ----------------------------------------------------------------------------

_PANEL = (
    "site_no:s water_year:i bf_prop:f6 q5:f4 norm_q5:f6 annual_evap_mm:f4 annual_precip_mm:f4 mean_temp_c:f4 peak_swe_day:i peak_swe_mm:f4 sdd:i "
    "melt_rate:f6 mean_bf:f6 drain_area_va:f4 mean_elevation:f4 mean_slope:f4 zone:s recession_curve_slope:f6"
)


_LITH_COLUMNS = ", ".join(f"sum(proportion) filter (where lith = '{c}') as \"lith_{c}\"" for c in LAND_CLASSES)
_COVER_COLUMNS = ", ".join(f"sum(area) filter (where class = '{c}') / sum(area) as \"cover_{c}\"" for c in LAND_CLASSES)
_COVER_BACK = ", ".join(
    f"first_value(\"cover_{c}\" ignore nulls) over (partition by p.site_no order by p.water_year rows between current row and unbounded following) as \"cover_{c}\""
    for c in LAND_CLASSES
)


@query(
    _PANEL + " a1:f2 a2:f2 " + " ".join(f"lith_{c}:f6" for c in LAND_CLASSES) + " " + " ".join(f"cover_{c}:f6" for c in LAND_CLASSES),
    f"""select p.*, nullif(a1, -999) as a1, nullif(a2, -999) as a2, g.* exclude (site_no), {_COVER_BACK} from panel p left join attributes t on p.site_no = t.site_no
    left join (select site_no, {_LITH_COLUMNS} from geology group by 1 having sum(proportion) > 0.99) g on p.site_no = g.site_no
    left join (select site_no, year, {_COVER_COLUMNS} from land_cover group by 1, 2) l on p.site_no = l.site_no and p.water_year = l.year""",
)
def harmonise(v: Views) -> DataFrame:
    """The panel with every land-cover class and lithology; land cover is filled from the next year that has it."""
    v.fan_out()
    names = [f"lith_{c}" for c in LAND_CLASSES]
    geology = op.complete_composition(op.geology_proportions(v.geology, LAND_CLASSES, prefix="lith_"), names).drop("total")
    cover = op.class_proportions([v.land_cover], LAND_CLASSES, prefix="cover_").withColumnRenamed("year", "water_year")
    attributes = op.sentinel_to_null(v.attributes, ["a1", "a2"])
    return op.harmonise(v.panel.drop("mean_bf"), annual=[cover], static=[attributes, geology], backfill=[f"cover_{c}" for c in LAND_CLASSES])


_DRIVERS = {
    "recession_curve_slope": "f6", "annual_evap_mm": "f4", "annual_precip_mm": "f4", "mean_temp_c": "f4", "peak_swe_day": "i",
    "peak_swe_mm": "f4", "sdd": "i", "melt_rate": "f6", "mean_elevation": "f4", "mean_slope": "f4", "mean_bf": "f6",
}


def _frame_shape(names) -> str:
    return "site_no:s water_year:i q5_norm:f4 " + " ".join(f"{c}:{_DRIVERS[c]}" for c in names)


@query(_frame_shape(DRIVER_SETS["full"]), "select * from frame where site_no not in ('Brand#1', 'Brand#2')")
def model_frame(v: Views) -> DataFrame:
    return op.model_frame(v.fan_out().panel, exclude=["Brand#1", "Brand#2"])


@query(
    _frame_shape(CLIMATE_DRIVERS).replace("q5_norm:f4", "q5_norm:f6"),
    "select * exclude (q5_norm), q5 / drain_area_va as q5_norm from frame",
)
def model_frame_climate(v: Views) -> DataFrame:
    return op.model_frame(v.fan_out().panel, drivers="climate", units="per_area")


@query("site_no:s n:i", "select site_no, count(*) as n from frame group by 1")
def model_rows_per_site(v: Views) -> DataFrame:
    return rows_per_site(op.model_frame(v.fan_out().panel))


@query(
    "column_name:s n_null:i",
    " union all ".join(f"select '{c}' as column_name, count(*) filter (where {c} is null) as n_null from panel" for c in ("q5", "sdd", "melt_rate", "annual_evap_mm")),
)
def panel_null_counts(v: Views) -> DataFrame:
    return null_counts(v.fan_out().panel, ["q5", "sdd", "melt_rate", "annual_evap_mm"])


def _stored_frame(v: Views, drivers: str = "full") -> DataFrame:
    return cut_lineage(op.model_frame(v.fan_out().panel, drivers=drivers))


@query("feature:s importance:f6 mse_increase:f9 mse_increase_sd:f9 mse_increase_scaled:f6")
def forest_fit(v: Views) -> DataFrame:
    """Importance of the drivers in a forest of 400 trees: share of the gain and rise of the out-of-bag error."""
    found = op.exact_forest(_stored_frame(v)).importance()
    total = F.sum("node_purity").over(Window.partitionBy(F.lit(0)))  # one row per driver
    return found.withColumn("importance", F.try_divide(F.col("node_purity"), total))


@query("site_no:s water_year:i q5_norm:f4 pred:f4 residual:f4 n_trees:i")
def forest_residuals(v: Views) -> DataFrame:
    """Out-of-bag predictions of one forest."""
    return op.out_of_bag_residuals(op.exact_forest(_stored_frame(v)))


@query("site_no:s water_year:i q5_norm:f4 pred:f4 residual:f4 fold:i")
def cross_validated_residuals(v: Views) -> DataFrame:
    """Predictions of binned forests that have not seen a row's fold."""
    return op.forest_residuals(_stored_frame(v), folds=3, trees=100)


@query("part:s n:i rmse:f4 relative_rmse:f6 r2:f6")
def train_test_eval(v: Views) -> DataFrame:
    return op.train_test_errors(_stored_frame(v))


@query("site_no:s water_year:i feature:s phi:f6 phi_var:f6 feature_value:f4")
def shapley_sampling(v: Views) -> DataFrame:
    frame = _stored_frame(v)
    return op.shapley_sampling(op.forest_fit(frame), frame)


@query("feature:s class_a:s mean_abs_shap:f4 mean_abs_shap_all:f4 display_rank:i class:s")
def attribution_report(v: Views) -> DataFrame:
    """Attributions of the fitted forest by driver and class of its out-of-bag residuals."""
    frame = _stored_frame(v)
    residuals = cut_lineage(op.out_of_bag_residuals(op.exact_forest(frame)))
    means = residuals.groupBy("site_no").agg(F.avg("q5_norm").alias("pred"))
    plain = residuals.drop("pred", "residual").join(means, "site_no").withColumn("residual", F.col("q5_norm") - F.col("pred"))
    columns = ["site_no", "water_year", "q5_norm", "pred", "residual"]
    classes = op.residual_classes(residuals.select(columns), plain.select(columns))
    shap = op.shapley_sampling(op.forest_fit(frame), frame)
    kinds = v.spark.createDataFrame([(c, "Climate" if c in CLIMATE_DRIVERS else "Site") for c in DRIVER_SETS["full"]], "feature string, class string")
    return op.mean_abs_shap(shap, kinds, classes)


@query(
    "feature:s class_a:s mean_abs_shap:f4 mean_abs_shap_all:f4 display_rank:i class:s",
    """select f.feature, class_a, m as mean_abs_shap, m_all as mean_abs_shap_all, dense_rank() over (order by m_all) as display_rank,
        case when f.feature = 'mean_temp_c' then 'Climate' end as class from (
    select feature, class_a, avg(abs(phi)) as m from shap_stub s left join classes c on s.site_no = c.site_no and s.water_year = c.water_year group by 1, 2) f
    join (select feature, avg(abs(phi)) as m_all from shap_stub group by 1) a on f.feature = a.feature""",
)
def mean_abs_shap(v: Views) -> DataFrame:
    v.fan_out()
    shap = v.shap_stub
    climate = shap.select("feature").distinct().where(F.col("feature") == "mean_temp_c").withColumn("class", F.lit("Climate"))
    return op.mean_abs_shap(shap, climate, v.classes)


@query(
    "site_no:s water_year:i feature:s phi:f6 feature_value:f4 zone:s",
    """select s.site_no, s.water_year, feature, phi, annual_precip_mm as feature_value, z.zone from shap_stub s
    left join panel p on s.site_no = p.site_no and s.water_year = p.water_year left join (select distinct site_no, zone from panel) z on s.site_no = z.site_no
    where feature = 'annual_precip_mm'""",
)
def shap_dependence(v: Views) -> DataFrame:
    v.fan_out()
    return op.shap_dependence(v.shap_stub, v.panel, "annual_precip_mm")


@query("site_no:s site_mean:f4", "select site_no, avg(mean_slope) as site_mean from panel group by 1 having avg(mean_slope) > 25")
def site_mean_filter(v: Views) -> DataFrame:
    return op.site_mean_filter(v.fan_out().panel, "mean_slope", 25)


# --- reports -------------------------------------------------------------------------------------


@query(
    "site_no:s water_year:i q5_norm:f4 pred_a:f4 residual_a:f4 pred_b:f4 residual_b:f4 res_diff:f4 class_a:s class_b:s pos_neg:s",
    "select * from classes",
)
def residual_classes(v: Views) -> DataFrame:
    return v.fan_out("q").classes


_COUNTS = {
    "a poor": "class_a = 'poor prediction'", "a good": "class_a = 'good prediction'", "b poor": "class_b = 'poor prediction'",
    "b good": "class_b = 'good prediction'", "positive": "pos_neg = 'positive'", "negative": "pos_neg = 'negative'",
    "in range": "res_diff between -0.2 and 0.5",
}


@query(
    "label:s n:i share:f6",
    " union all ".join(f"select '{k}' as label, count(*) filter (where {c}) as n, count(*) filter (where {c}) / count(*) as share from classes" for k, c in _COUNTS.items()),
)
def residual_class_counts(v: Views) -> DataFrame:
    return op.residual_class_counts(v.fan_out("q").classes)


@query(
    "class_a:s place:i n:i rmse:f4 relative_rmse:f6 r2:f6",
    """select class_a, case class_a when 'good prediction' then 1 when 'poor prediction' then 2 end as place, count(*) as n,
    sqrt(avg(pow(q5_norm - pred_b, 2))) as rmse, sqrt(avg(pow(q5_norm - pred_b, 2))) / avg(q5_norm) as relative_rmse, regr_r2(pred_b, q5_norm) as r2
    from classes group by 1, 2""",
)
def errors_by_class(v: Views) -> DataFrame:
    """Error summary of the second model in each class of the first, with the place of the class in display order."""
    rows = v.fan_out("q").classes.withColumn("place", sort_key("class_a", ["good prediction", "poor prediction"]))
    return rows.groupBy("class_a", "place").agg(*error_summary("q5_norm", "pred_b"))


@query(
    "site_year:s place:i residual_a:f4",
    """select site_no || '_' || water_year as site_year, case pos_neg when 'positive' then 1 when 'negative' then 2 end as place, residual_a from classes""",
)
def keyed_residuals(v: Views) -> DataFrame:
    """Residuals under the composite key of site and year, with the place of their sign in display order."""
    rows = v.fan_out("q").classes
    return rows.select(site_year_key().alias("site_year"), sort_key("pos_neg", ["positive", "negative"]).alias("place"), "residual_a")


@query(
    "model:s mean_abs_residual:f4",
    """select 'a' as model, avg(abs(residual_a)) filter (where class_a = 'poor prediction') as mean_abs_residual from classes
    union all select 'b', avg(abs(residual_b)) filter (where class_b = 'poor prediction') from classes""",
)
def poor_residual_means(v: Views) -> DataFrame:
    return op.poor_residual_means(v.fan_out("q").classes)


@query("site_no:s water_year:i q5:f4 median_q5:f4 flow:s", "select * from joined")
def flow_condition(v: Views) -> DataFrame:
    return op.flow_condition(v.q5.withColumnRenamed("year", "water_year"))


@query("flow:s n:i share:f6", "select flow, count(*) as n, count(*) / sum(count(*)) over () as share from joined group by 1")
def flow_condition_shares(v: Views) -> DataFrame:
    return flow_condition_counts(op.flow_condition(v.q5))


@query(
    "site_no:s n_obs:i n_improved:i improved_share:f6",
    """select site_no, count(*) as n_obs, count(*) filter (where class_a = 'poor prediction' and pos_neg = 'positive') as n_improved,
    count(*) filter (where class_a = 'poor prediction' and pos_neg = 'positive') / count(*) as improved_share from joined group by 1""",
)
def site_improvement(v: Views) -> DataFrame:
    return op.site_improvement(v.fan_out("q", "tax", "discount", "r_q").joined)


@query(
    "zone:s n:i poor_share:f6 low_share:f6 median_share:f6 high_share:f6",
    """select zone, count(*) as n, count(*) filter (where class_a = 'poor prediction') / nullif(count(class_a), 0) as poor_share,
    count(*) filter (where flow = 'low') / count(*) as low_share, count(*) filter (where flow = 'median') / count(*) as median_share,
    count(*) filter (where flow = 'high') / count(*) as high_share from joined group by 1""",
)
def zone_class_shares(v: Views) -> DataFrame:
    return op.zone_class_shares(v.fan_out("q", "tax", "discount", "r_q").joined)


def _level(level: str, zone: str, flow: str, group: str) -> str:
    imp = "count(*) filter (where class_a = 'poor prediction' and pos_neg = 'positive')"
    poor = "count(*) filter (where class_a = 'poor prediction')"
    having = f" having {imp} > 0" if level == "zone_flow" else ""
    return f"""select '{level}' as level, {zone} as zone, {flow} as flow, {imp} as n_improved, {poor} as n_poor, count(*) as n_total,
        {imp} / count(*) as improved_share, {imp} / nullif({poor}, 0) as share_of_poor from joined{group}{having}"""


@query(
    "level:s zone:s flow:s n_improved:i n_poor:i n_total:i improved_share:f6 share_of_poor:f6",
    _level("zone_flow", "zone", "case flow when 'low' then 'Low Flow' when 'median' then 'Median Flow' else 'High Flow' end", " group by zone, flow")
    + " union all " + _level("zone", "zone", "null", " group by zone") + " union all " + _level("all", "null", "null", ""),
)
def improvement_by_zone_flow(v: Views) -> DataFrame:
    return op.improvement_by_zone_flow(v.fan_out("q", "tax", "discount", "r_q").joined)


@query(
    "zone:s mean_ratio:f6 median_rel_gain:f6",
    """select r.zone, mean_ratio, median_rel_gain from (select zone, avg(res_diff) / avg(q5_norm) as mean_ratio from joined group by 1) r
    left join (select zone, median(res_diff / q5_norm) as median_rel_gain from improved group by 1) m on r.zone = m.zone""",
)
def relative_improvement(v: Views) -> DataFrame:
    return op.relative_improvement(v.fan_out("q", "tax", "discount", "r_q").joined)


@query(
    "site_no:s water_year:i zone:s snow_frac:f6 aridity:f6 ln_rel_gain:f6",
    """select site_no, water_year, zone, peak_swe_mm / nullif(annual_precip_mm, 0) as snow_frac, annual_precip_mm / nullif(annual_evap_mm, 0) as aridity,
    case when res_diff / nullif(q5_norm, 0) > 0 then ln(res_diff / q5_norm) end as ln_rel_gain from joined where class_a = 'poor prediction'""",
)
def snow_aridity_residual(v: Views) -> DataFrame:
    return op.snow_aridity_residual(v.fan_out("q", "tax", "discount", "r_q").joined)


_GRID_COLUMNS = ["q5", "bf_prop", "melt_rate", "annual_evap_mm"]


@query(
    "site_no:s water_year:i q5:f4 first_year:i is_first_row:i display_rank:i",
    f"""select *, case when water_year = first_year then 1 else 0 end as is_first_row, dense_rank() over (order by first_year) as display_rank from (
    select site_no, water_year, q5, min(water_year) over (partition by site_no) as first_year from panel
    where water_year > 1995 and {' and '.join(f'{c} is not null' for c in _GRID_COLUMNS)})""",
)
def record_grid(v: Views) -> DataFrame:
    return op.record_grid(v.fan_out().panel, after=1995, columns=_GRID_COLUMNS)


@query(
    "site_no:s area:f4 num_years:i min_year:i max_year:i",
    "select site_no, avg(drain_area_va) as area, count(distinct water_year) as num_years, min(water_year) as min_year, max(water_year) as max_year from panel group by 1",
)
def site_profile(v: Views) -> DataFrame:
    return op.site_profile(v.fan_out().panel)


def _hist(column: str, source: str, label: str) -> str:
    return f"""select '{label}' as variable, bin, count(*) as n from (select least(coalesce(floor((x - lo) / nullif((hi - lo) / 29, 0) + 0.5), 0), 29) as bin
        from (select cast({column} as double) as x, min(cast({column} as double)) over () as lo, max(cast({column} as double)) over () as hi from {source} where {column} is not null)) group by bin"""


_SITE_ROWS = "(select * from frame qualify row_number() over (partition by site_no order by water_year) = 1)"
_PROFILE = """(select ln(avg(drain_area_va)) as ln_area, count(distinct water_year) as num_years, min(water_year) as min_year, max(water_year) as max_year from frame group by site_no)"""


@query(
    "variable:s bin:i n:i",
    " union all ".join(
        [_hist(c, "frame", DRIVER_LABELS[c]) for c in CLIMATE_DRIVERS]
        + [_hist(c, _SITE_ROWS, DRIVER_LABELS[c]) for c in ("recession_curve_slope", "mean_elevation", "mean_slope", "mean_bf")]
        + [_hist(c, _PROFILE, c) for c in ("ln_area", "num_years", "min_year", "max_year")]
    ),
)
def driver_histograms(v: Views) -> DataFrame:
    panel = v.fan_out().panel
    return op.driver_histograms(cut_lineage(panel.dropna(subset=["q5", "bf_prop", *DRIVER_SETS["full"]])))


@query(
    "class_b:s bin:i bin_start:f4 n:i",
    "select class_b, floor(res_diff / 0.5 + 0.5) as bin, (floor(res_diff / 0.5 + 0.5) - 0.5) * 0.5 as bin_start, count(*) as n from classes group by 1, 2, 3",
)
def residual_gain_histogram(v: Views) -> DataFrame:
    return gain_histogram(v.fan_out("q").classes, width=0.5)


_PAIRS = [(a, b) for i, a in enumerate(DRIVER_SETS["full"]) for b in DRIVER_SETS["full"][i:]]


@query(
    "var_1:s var_2:s r:f6",
    " union all ".join(f"select '{a}' as var_1, '{b}' as var_2, corr({a}, {b}) as r from {_SITE_ROWS}" for a, b in _PAIRS),
)
def driver_correlation(v: Views) -> DataFrame:
    panel = v.fan_out().panel
    return op.driver_correlation(panel.dropna(subset=["q5", "bf_prop", *DRIVER_SETS["full"]]))


# --- concentration model -------------------------------------------------------------------------


@query("site_no:s date:d q:f4 y_hat:f4 se:f4 conc:f2")
def concentration_surface(v: Views) -> DataFrame:
    v.fan_out("q", "a_ratio")
    return op.concentration_surface(v.samples, v.daily_q)


@query("site_no:s date:d q:f4 y_hat:f4 se:f4 conc:f2 n_obs:i growth:i leverage:f4")
def held_out_estimates(v: Views) -> DataFrame:
    v.fan_out("q", "a_ratio")
    return op.held_out_estimates(v.samples, v.daily_q)


@query("site_no:s n:i r2_log_conc:f4 r2_log_flux:f4 rmse_log:f4 sep_percent:f3 flux_bias:f4 flux_bias_of_estimate:f4")
def held_out_errors(v: Views) -> DataFrame:
    """Errors of estimates that have not seen the sample they are held against."""
    v.fan_out("q", "a_ratio")
    return op.estimate_errors(op.held_out_estimates(v.samples, v.daily_q), v.samples, "conc")


_BRIDGE_EST = "(select site_no, date, q, ln(ratio) as y_hat, 0.25 as se from days)"
_BRIDGE = f"""select site_no, date, q, y_hat, se, case when z is not null then exp(y)
        else exp(y_hat + se * (case when za is not null and zb is not null then (pow(0.9, s) * (1 - pow(0.9, 2 * u)) * za + pow(0.9, u) * (1 - pow(0.9, 2 * s)) * zb) / (1 - pow(0.9, 2 * (s + u)))
            when za is not null then pow(0.9, s) * za when zb is not null then pow(0.9, u) * zb else 0 end)
        + se * se * (case when za is not null and zb is not null then (1 - pow(0.9, 2 * s)) * (1 - pow(0.9, 2 * u)) / (1 - pow(0.9, 2 * (s + u)))
            when za is not null then 1 - pow(0.9, 2 * s) when zb is not null then 1 - pow(0.9, 2 * u) else 1 end) / 2) end as gen_conc from (
    select *, date - last_value(zd ignore nulls) over b as s, first_value(zd ignore nulls) over f - date as u,
        last_value(z ignore nulls) over b as za, first_value(z ignore nulls) over f as zb from (
    select e.*, ln(result_va) as y, (ln(result_va) - y_hat) / se as z, case when result_va is not null then e.date end as zd
    from {_BRIDGE_EST} e left join samples p on e.site_no = p.site_no and e.date = p.sample_dt)
    window b as (partition by site_no order by date rows between unbounded preceding and current row),
           f as (partition by site_no order by date rows between current row and unbounded following))"""


@query("site_no:s date:d q:f4 ln_gen_conc:f6", f"select *, ln(gen_conc) as ln_gen_conc from ({_BRIDGE})")
def residual_bridge(v: Views) -> DataFrame:
    v.fan_out("q", "ratio", "a_ratio")
    estimate = v.days.select("site_no", "date", "q", F.ln("ratio").alias("y_hat"), F.lit(0.25).alias("se"))
    return op.residual_bridge(estimate, v.samples).withColumn("ln_gen_conc", F.ln("gen_conc"))


@query(
    "site_no:s n:i r2_log_conc:f6 r2_log_flux:f6 rmse_log:f6 sep_percent:f4 flux_bias:f6 flux_bias_of_estimate:f6",
    """select site_no, count(*) as n, 1 - avg(res * res) / var_pop(y) as r2_log_conc, 1 - avg(res * res) / var_pop(y + ln(q)) as r2_log_flux,
    sqrt(avg(res * res)) as rmse_log, 100 * sqrt(exp(avg(res * res)) - 1) as sep_percent, (sum(est * q) - sum(obs * q)) / sum(obs * q) as flux_bias,
    (sum(est * q) - sum(obs * q)) / sum(est * q) as flux_bias_of_estimate from (
    select d.site_no, d.q, ratio as est, result_va as obs, ln(result_va) as y, ln(result_va) - ln(ratio) as res from days d
    join samples s on d.site_no = s.site_no and d.date = s.sample_dt) group by 1""",
)
def estimate_errors(v: Views) -> DataFrame:
    v.fan_out("q", "ratio", "a_ratio")
    return op.estimate_errors(v.daily_est, v.samples, "gen_conc")
