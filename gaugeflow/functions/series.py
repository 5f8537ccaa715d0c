"""Helpers for daily series.

Contract of every function here: (site_no, date) is unique, so one site has at most one row per
calendar day (about 55,000 in 150 years). Windows per site are bounded by the calendar, not by
the size of the table; raw readings are brought to that form with ``one_row_per_day`` first,
which combines map-side and so spreads a site that holds a large part of all readings.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window

SITE = "site_no"
DEAL = "_deal"
DEALS = 32  # tasks that the rows of one site are dealt to where they meet its one row


def by_site(date: str = "date") -> WindowSpec:
    return Window.partitionBy(SITE).orderBy(date)


def one_row_per_day(df: DataFrame, date: str = "date", value: str = "q") -> DataFrame:
    """Mean of the readings of a day."""
    return df.groupBy(SITE, date).agg(F.avg(value).alias(value))


def date_bounds(df: DataFrame, date: str, first: str, last: str) -> DataFrame:
    """First and last date per site."""
    return df.groupBy(SITE).agg(F.min(date).alias(first), F.max(date).alias(last))


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with the number of their deal, a hash of columns that vary inside a site."""
    return rows.withColumn(DEAL, F.pmod(F.xxhash64(*by), F.lit(DEALS)).cast("int"))


def for_dealt(sites: DataFrame) -> DataFrame:
    """One row per site, repeated for every deal; joined on (site_no, deal) it meets every row of the site once."""
    return sites.withColumn(DEAL, F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))


def gap_days(date: str) -> Column:
    """Days since the previous row of the site, null on its first row."""
    return F.datediff(F.col(date), F.lag(date).over(by_site(date)))


def segment_id(is_start: Column, date: str) -> Column:
    """Running number of the segment a row belongs to."""
    return F.sum(is_start.cast("int")).over(by_site(date).rowsBetween(Window.unboundedPreceding, 0))


def longest_missing_run(df: DataFrame, present: Column, date: str = "date", name: str = "max_run") -> DataFrame:
    """Longest run of calendar days without a present value, between the first and last row of a site.

    A run between two present days is the distance of their dates minus one, so neither a dense
    calendar nor run-length encoding is needed. Runs at either end count from the first or to the
    last row. Null for a site whose rows have no date.
    """
    day = F.when(present, F.col(date))
    before = F.last(day, ignorenulls=True).over(by_site(date).rowsBetween(Window.unboundedPreceding, -1))
    rows = df.select(SITE, date, day.alias("_day"), before.alias("_before"))
    found = rows.groupBy(SITE).agg(
        F.max(F.datediff("_day", "_before") - 1).alias("_inner"),
        F.datediff(F.min("_day"), F.min(date)).alias("_head"),
        F.datediff(F.max(date), F.max("_day")).alias("_tail"),
        (F.datediff(F.max(date), F.min(date)) + 1).alias("_all"),
        F.count("_day").alias("_n"),
    )
    run = F.when(F.col("_n") == 0, F.col("_all")).otherwise(F.greatest("_inner", "_head", "_tail"))
    return found.select(SITE, run.alias(name))


def with_longest_run(df: DataFrame, present: Column, date: str = "date", name: str = "max_run") -> DataFrame:
    """The same longest run as a column of every row, without reading the table a second time."""
    site = Window.partitionBy(SITE)
    day = F.when(present, F.col(date))
    before = F.last(day, ignorenulls=True).over(by_site(date).rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumns({"_day": day, "_before": before})
    first, last = F.min("_day").over(site), F.max("_day").over(site)
    lo, hi = F.min(date).over(site), F.max(date).over(site)
    inner = F.max(F.datediff("_day", "_before") - 1).over(site)
    run = F.when(first.isNull(), F.datediff(hi, lo) + 1).otherwise(F.greatest(inner, F.datediff(first, lo), F.datediff(hi, last)))
    return rows.withColumn(name, run).drop("_day", "_before")


def align_daily(tables: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Full alignment of several daily tables on (site_no, date) with a single shuffle.

    ``tables`` maps the output column to (table, date column, value column). Tables are stacked,
    placed by site and folded per day, so that windows per site that follow need no exchange.
    """
    names = list(tables)
    stacked = None
    for name, (table, date, value) in tables.items():
        part = table.select(
            SITE,
            F.col(date).alias("date"),
            *[(F.col(value).cast("double") if n == name else F.lit(None).cast("double")).alias(n) for n in names],
            F.lit(name).alias("_from"),
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    folded = stacked.repartition(SITE).groupBy(SITE, "date").agg(
        *[F.max(n).alias(n) for n in names],
        *[F.bool_or(F.col("_from") == n).alias(f"has_{n}") for n in names],
    )
    return folded
