"""Exact quantiles with linear interpolation between order statistics."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .columns import as_column


def quantile(c: str | Column, p: float, accuracy: int | None = None) -> Column:
    """Plain aggregate for groups bounded by the calendar (days of a year, years of a site).

    Exact unless ``accuracy`` asks for the sketch.
    """
    if accuracy is not None:
        return F.percentile_approx(as_column(c), F.lit(p), F.lit(accuracy))
    return F.percentile(as_column(c), F.lit(p))


RANGES = 4096  # parts into which a pass divides the range that holds a wanted rank
PASSES = 2  # such passes before the rest is ordered
SALTS = 32  # tasks that the rows of one group are dealt to where they meet its ranges


def _meet(data: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows joined to the one row of their group; the rows of a group are dealt to many tasks."""
    named = groups.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    spread = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_row_salt") == F.col("_salt"))
    dealt = data.withColumn("_row_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, on).drop("_row_salt", "_salt", *[f"_k_{k}" for k in keys])


def _part(value: Column, low: Column, high: Column, ranges: int) -> Column:
    """Number of the part of a range that holds a value; never falls as the value grows."""
    share = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
    return F.least(F.floor(share * ranges), F.lit(ranges - 1)).cast("int")


def _narrowed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Of counted parts those that hold the wanted rank: keys, _rank in the part, its ends."""
    order = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.withColumn("_end", F.sum("_c").over(order))
    inside = F.col("_rank") - (F.col("_end") - F.col("_c"))
    return ends.where((inside >= 0) & (F.col("_rank") < F.col("_end"))).select(*keys, inside.alias("_rank"), "_low", "_high")


def unbounded_quantiles(df: DataFrame, keys: list[str], value: str, probs: Mapping[str, float], ranges: int = RANGES) -> DataFrame:
    """Exact quantiles for groups of any size, without holding or ordering a group in one task.

    A group's range is cut into ``ranges`` parts of equal width, whose counts and ends come from sums
    that combine map-side; the part that holds a wanted rank is cut again. Only what is left after
    ``PASSES`` such passes, about a sixteen-millionth of a smooth group, is ordered, one row per distinct
    value. Where rows meet the range of their group they are dealt to ``SALTS`` tasks by value, so a group
    that holds nearly all rows is spread. Parts follow the data's own ends, so outliers cost one pass.
    NaN counts as null here: it has no place in a range.
    """
    v = F.col("_v")
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    data = data.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    whole = data.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # Two ranks per quantile, _i says which: the ones below and above it.
    places = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs.values()]
    ranks = [r.cast("long") for h in places for r in (F.floor(h), F.ceil(h))]
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), r.alias("_rank")) for i, r in enumerate(ranks)]))
    sums = [F.sum("_c").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    parts = _meet(data, whole, keys).withColumn("_part", _part(v, F.col("_low"), F.col("_high"), ranges))
    parts = parts.groupBy(*keys, "_part").agg(*sums, F.first("_n").alias("_n")).withColumn("_w", wanted)
    parts = parts.select(*keys, "_part", "_c", "_low", "_high", "_w._i", "_w._rank")
    targets = _narrowed(parts, [*keys, "_i"])

    def held() -> DataFrame:
        """Rows in a range that is left, once for each of its ranks."""
        left = targets.groupBy(*keys).agg(F.collect_list(F.struct("_i", "_rank", "_low", "_high")).alias("_left"))  # two per quantile
        within = F.filter("_left", lambda r: (v >= r["_low"]) & (v <= r["_high"]))
        return _meet(data, left, keys).select(*keys, "_v", "_c", F.inline(within))

    for _ in range(PASSES - 1):
        parts = held().withColumn("_part", _part(v, F.col("_low"), F.col("_high"), ranges))
        targets = _narrowed(parts.groupBy(*keys, "_i", "_rank", "_part").agg(*sums), [*keys, "_i"])
    order = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rest = held().withColumn("_end", F.sum("_c").over(order))
    rest = rest.where((F.col("_end") > F.col("_rank")) & (F.col("_end") - F.col("_c") <= F.col("_rank")))
    found = rest.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, v)).alias(f"_x{i}") for i in range(len(ranks))])
    named = whole.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    met = found.join(named, on)
    return met.select(*keys, *[
        (F.col(f"_x{2 * i}") + (F.col(f"_x{2 * i + 1}") - F.col(f"_x{2 * i}")) * (h - F.floor(h))).alias(name)
        for i, (name, h) in enumerate(zip(probs, places))
    ])
