"""Gridded climate tables: wide to long, annual values, snow."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.aggregates import with_nulls
from ..functions.columns import (
    century_fix,
    clip_negative,
    normalise_site_id,
    parse_date,
    strip_decoration,
    water_year,
    water_year_day,
)
from ..functions.series import SITE
from ..sources.readers import read_csv, repair_columns, wide_file_rows

MM_PER_M = 1000
KELVIN_OFFSET = 273.15
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yy")


def climate_wide_to_long(
    wide: DataFrame,
    date: str = "dates",
    head: int = 1,
    tail: int = 2,
    formats: Sequence[str] = DATE_FORMATS,
    drop: Iterable[str] = (),
) -> DataFrame:
    """One row per (site, day) from a table with one column per site.

    The decoration around ids (``head`` characters in front, ``tail`` behind) is cut from the
    column names while the plan is built, so no row pays for it.
    """
    sites = [c for c in wide.columns if c != date and c not in set(drop)]
    renamed = wide.select(
        _as_date(wide, date, formats).alias("dates"),
        *[F.col(f"`{c}`").cast("double").alias(strip_decoration(c, head, tail)) for c in sites],
    )
    long = renamed.unpivot(["dates"], [f"`{strip_decoration(c, head, tail)}`" for c in sites], SITE, "value")
    return long.select(normalise_site_id(SITE).alias(SITE), "dates", "value")


def _as_date(df: DataFrame, date: str, formats: Sequence[str]) -> Column:
    if dict(df.dtypes)[date] == "date":
        return F.col(date)
    return parse_date(date, formats)


def climate_files_merge(
    parts: Sequence[DataFrame] | Sequence[str],
    fixes: Mapping[int, Mapping] | None = None,
    date: str = "dates",
    spark: SparkSession | None = None,
    drop: Iterable[str] = (),
) -> DataFrame:
    """Union of regional wide tables by column name; columns a region lacks become null.

    ``parts`` are tables or paths of CSV files. ``fixes`` repairs single parts by position:
    ``names_from`` takes all column names from another part, ``rename`` maps old to new names,
    ``date_format`` re-reads the dates of a part written in another format.
    """
    frames = [read_csv(spark, p) if isinstance(p, str) else p for p in parts]
    fixes = fixes or {}
    names = [list(f.columns) for f in frames]
    merged = None
    for i, frame in enumerate(frames):
        fix = fixes.get(i, {})
        given = names[fix["names_from"]] if "names_from" in fix else None
        frame = repair_columns(frame, names=given, rename=fix.get("rename"))
        formats = (fix["date_format"],) if "date_format" in fix else DATE_FORMATS
        frame = frame.withColumn(date, _as_date(frame, date, formats)).drop(*drop)
        merged = frame if merged is None else merged.unionByName(frame, allowMissingColumns=True)
    return merged


def climate_folder(
    spark: SparkSession,
    path: str | Sequence[str],
    date: str = "dates",
    head: int = 1,
    tail: int = 2,
    formats: Sequence[str] = DATE_FORMATS,
    rename: Mapping[str, str] | None = None,
    names_from: Mapping[str, str] | None = None,
    drop: Iterable[str] = (),
) -> DataFrame:
    """One row per (site, day) of all wide CSV files of a folder, pattern or list, however many.

    Files may differ in sites, column order, index columns and date format. Names that drifted are
    repaired by ``rename`` and ``names_from`` (see ``wide_file_rows``). A file's date format is the
    first of ``formats`` that reads most of its dates: ``3/4/01`` alone says nothing, but the other days of
    its file do. The plan has the same size for any number of files. A file without a date column is
    an error; a date or value that cannot be read is null.
    """
    rows = wide_file_rows(spark, path, rename, names_from)
    at = F.array_position("names", F.lit(date)).cast("int")
    missing = F.raise_error(F.concat(F.lit(f"no column {date} in "), F.col("file")))
    rows = rows.withColumn("_date", F.get("cells", F.when(at > 0, at - 1).otherwise(missing)))
    if len(formats) > 1:
        votes = rows.groupBy("file").agg(F.array(*[F.count(F.try_to_date("_date", f)) for f in formats]).alias("_votes"))
        chosen = votes.select("file", F.array_position("_votes", F.array_max("_votes")).alias("_format"))
        rows = rows.join(chosen, "file")
        parsed = F.coalesce(*[F.when(F.col("_format") == k, F.try_to_date("_date", f)) for k, f in enumerate(formats, 1)])
    else:
        parsed = F.try_to_date("_date", formats[0])
    cells = rows.select(parsed.alias("dates"), F.inline(F.arrays_zip("names", "cells")))
    cells = cells.where(F.col("names").isNotNull() & ~F.col("names").isin([date, *drop]))
    site = F.substring("names", F.lit(head + 1), F.greatest(F.length("names") - (head + tail), F.lit(0)))
    return cells.select(normalise_site_id(site).alias(SITE), "dates", F.col("cells").try_cast("double").alias("value"))


def _annual(long: DataFrame, agg: Column, name: str, null_policy: str) -> DataFrame:
    return long.groupBy(SITE, water_year("dates").alias("water_year")).agg(
        with_nulls(agg, "value", null_policy).alias(name)
    )


def annual_evaporation(long: DataFrame, null_policy: str = "skip") -> DataFrame:
    """Evaporation in mm per water year; losses are negative metres in the source."""
    return _annual(long, F.sum("value") * -MM_PER_M, "annual_evap_mm", null_policy)


def annual_precipitation(long: DataFrame, null_policy: str = "skip") -> DataFrame:
    """Precipitation in mm per water year."""
    return _annual(long, F.sum("value") * MM_PER_M, "annual_precip_mm", null_policy)


def annual_temperature(long: DataFrame, null_policy: str = "skip") -> DataFrame:
    """Mean temperature in degrees Celsius per water year."""
    return _annual(long, F.avg("value") - KELVIN_OFFSET, "mean_temp_c", null_policy)


def annual_climate(evaporation: DataFrame, precipitation: DataFrame, temperature: DataFrame, null_policy: str = "skip") -> DataFrame:
    """The three annual tables side by side from one aggregation of the stacked daily tables.

    A (site, water year) that a table lacks is null there. Daily tables meet in one exchange of partial
    sums in place of an exchange each and two joins.
    """
    tables = {"annual_evap_mm": evaporation, "annual_precip_mm": precipitation, "mean_temp_c": temperature}
    stacked = reduce(DataFrame.unionByName, [t.select(SITE, "dates", "value", F.lit(name).alias("_measure")) for name, t in tables.items()])
    own = {name: F.when(F.col("_measure") == name, F.col("value")) for name in tables}
    values = {
        "annual_evap_mm": F.sum(own["annual_evap_mm"]) * -MM_PER_M,
        "annual_precip_mm": F.sum(own["annual_precip_mm"]) * MM_PER_M,
        "mean_temp_c": F.avg(own["mean_temp_c"]) - KELVIN_OFFSET,
    }
    if null_policy != "skip":
        values = {name: with_nulls(agg, F.coalesce(own[name], F.when(F.col("_measure") != name, 0.0)), null_policy) for name, agg in values.items()}
    return stacked.groupBy(SITE, water_year("dates").alias("water_year")).agg(*[agg.alias(name) for name, agg in values.items()])


def two_digit_year_fix(df: DataFrame, date: str = "dates", pivot: int = 2023) -> DataFrame:
    """Dates past ``pivot`` move back a century."""
    return df.withColumn(date, century_fix(date, pivot))


def peak_snow(swe: DataFrame) -> DataFrame:
    """Day and depth of the highest snow water equivalent per (site, water year), earliest on ties.

    Negative values count as 0. The peak is a struct maximum, which combines map-side.
    """
    ranked = F.struct(clip_negative("value").alias("v"), (-F.unix_date("dates")).alias("d"))
    peak = (
        swe.where(F.col("value").isNotNull())
        .groupBy(SITE, water_year("dates").alias("water_year"))
        .agg(F.max(ranked).alias("_p"))
    )
    day = F.date_from_unix_date(-F.col("_p.d"))
    return peak.select(
        SITE, "water_year", water_year_day(day).alias("peak_swe_day"), (F.col("_p.v") * MM_PER_M).alias("peak_swe_mm")
    )


def snow_disappearance(swe: DataFrame, peak: DataFrame, min_zero: int = 7) -> DataFrame:
    """First snow-free day after the peak that opens a block of at least ``min_zero`` zero days.

    Blocks are numbered over the whole water year and counted after the days up to the peak are
    gone, so a block cut by the peak counts its rest. Years without such a block give no row.
    """
    year = Window.partitionBy(SITE, "water_year").orderBy("dates")
    days = swe.withColumns({"value": clip_negative("value"), "water_year": water_year("dates")})
    days = days.join(peak, [SITE, "water_year"])
    opens = (F.col("value") == 0) & (F.lag("value", 1, 1.0).over(year) != 0)
    blocks = days.withColumns({
        "block": F.sum(F.coalesce(opens.cast("int"), F.lit(0))).over(year.rowsBetween(Window.unboundedPreceding, 0)),
        "wy_day": water_year_day("dates"),
    }).where((F.col("value") == 0) & (F.col("wy_day") > F.col("peak_swe_day")))
    free = blocks.groupBy(SITE, "water_year", "peak_swe_day", "peak_swe_mm", "block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("wy_day").alias("_day")
    ).where(F.col("_n") >= min_zero)
    first = free.groupBy(SITE, "water_year", "peak_swe_day", "peak_swe_mm").agg(F.min("_day").alias("sdd"))
    melt_days = F.col("sdd") - F.col("peak_swe_day")
    return first.select(
        "*", melt_days.alias("melt_days"), F.try_divide(F.col("peak_swe_mm"), melt_days).alias("melt_rate")
    )
