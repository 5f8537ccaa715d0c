"""Repair of daily discharge records."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.columns import drop_sites
from ..functions.series import SITE, by_site, date_bounds, longest_missing_run, with_longest_run


def missing_day_sites(daily: DataFrame) -> DataFrame:
    """Sites whose number of rows differs from the length of their calendar."""
    return (
        daily.groupBy(SITE)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            (F.datediff(F.max("date"), F.min("date")) + 1).alias("n_days"),
        )
        .where(F.col("n_rows") != F.col("n_days"))
    )


def fill_daily_gaps(daily: DataFrame) -> DataFrame:
    """Complete calendar per site with discharge interpolated linearly between known days.

    Each known day carries the next one (one window) and expands into the days up to it, so the
    calendar is never joined. Nulls before the first or after the last known value stay null.
    """
    ordered = by_site()
    edge = F.lag("date").over(ordered).isNull() | F.lead("date").over(ordered).isNull()
    anchors = daily.select(SITE, "date", "q", edge.alias("_edge")).where(F.col("q").isNotNull() | F.col("_edge"))
    spans = anchors.select(
        SITE, "date", "q", F.lead("date").over(ordered).alias("_next"), F.lead("q").over(ordered).alias("_next_q")
    )
    length = F.greatest(F.datediff("_next", "date"), F.lit(1))
    steps = spans.select("*", length.alias("_len"), F.explode(F.sequence(F.lit(0), length - 1)).alias("_k"))
    between = F.col("q") + (F.col("_next_q") - F.col("q")) * F.col("_k") / F.col("_len")
    own = F.when(F.col("_k") == 0, F.col("q"))
    return steps.select(
        SITE,
        F.date_add("date", F.col("_k")).alias("date"),
        own.alias("q"),
        F.when(F.col("_k") == 0, F.col("q")).otherwise(between).alias("filled_q"),
        F.when(own.isNull(), F.lit("yes")).otherwise(F.lit("no")).alias("interp_flag"),
    )


def fill_daily_columns(daily: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Complete calendar per site with several columns interpolated, each between its own known days.

    The same values as ``fill_daily_gaps`` gives for each column alone, from one placement by site: every
    row carries the known days around it and expands into the days up to the next row. Frames
    grow from the front in both directions, so a long record costs two sorts and no rescan.
    """
    past = by_site().rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(SITE).orderBy(F.col("date").desc())
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("date").alias("d"), F.col(c).alias("v"))) for c in columns}
    rows = daily.select(
        SITE,
        "date",
        *[F.last(k, ignorenulls=True).over(past).alias(f"_p{n}") for n, k in enumerate(known.values())],
        *[F.last(k, ignorenulls=True).over(later).alias(f"_n{n}") for n, k in enumerate(known.values())],
        F.coalesce(F.date_sub(F.lag("date").over(back), 1), F.col("date")).alias("_until"),
    )
    days = rows.withColumn("_day", F.explode(F.sequence("date", "_until")))

    def value(n: int) -> Column:
        p, q = F.col(f"_p{n}"), F.col(f"_n{n}")
        steps = F.datediff("_day", p["d"])
        return F.when(steps == 0, p["v"]).otherwise(p["v"] + (q["v"] - p["v"]) * steps / F.datediff(q["d"], p["d"]))

    return days.select(SITE, F.col("_day").alias("date"), *[value(n).alias(c) for n, c in enumerate(columns)])


def interpolated_runs(filled: DataFrame) -> DataFrame:
    """Longest run of interpolated days per site; 0 for a complete record."""
    return longest_missing_run(filled, F.col("interp_flag") == "no")


def resolve_long_gaps(
    filled: DataFrame,
    samples: DataFrame,
    max_run: int = 49,
    exclude: Iterable[str] = (),
    complete: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Final discharge after the long-gap policy, and the samples that go with it.

    Sites with a longest run above ``max_run`` keep only the days after their first sample;
    listed sites go altogether. ``complete`` holds records that never needed filling, with
    columns site_no, date, q. Returns (discharge, samples).
    """
    exclude = list(exclude)
    filled, samples = drop_sites(filled, exclude), drop_sites(samples, exclude)
    runs = with_longest_run(filled, F.col("interp_flag") == "no")
    starts = date_bounds(samples, "sample_dt", "_first", "_last")
    kept = runs.join(starts, SITE, "left").where((F.col("max_run") <= max_run) | (F.col("date") > F.col("_first")))
    discharge = kept.select(SITE, "date", F.col("filled_q").alias("q"))
    if complete is not None:
        untouched = drop_sites(complete, exclude).join(filled.select(SITE).distinct(), SITE, "left_anti")
        discharge = discharge.unionByName(untouched.select(SITE, "date", "q"))
    return discharge, samples


def sample_overlay(filled: DataFrame, samples: DataFrame, max_run: int = 49) -> DataFrame:
    """Samples laid over the filled series of the sites with a long interpolated run."""
    days = with_longest_run(filled, F.col("interp_flag") == "no").where(F.col("max_run") > max_run).drop("max_run")
    values = samples.select(SITE, F.col("sample_dt").alias("date"), F.col("result_va").alias("cond"))
    return days.join(values, [SITE, "date"], "left")
