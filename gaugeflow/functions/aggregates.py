"""Aggregate helpers that combine map-side."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window

from .columns import as_column


def with_nulls(agg: Column, value: str | Column, null_policy: str = "skip", over: WindowSpec | None = None) -> Column:
    """``skip`` ignores nulls; ``propagate`` gives null as soon as one input value is null. ``over``: a whole window partition."""
    placed = (lambda c: c) if over is None else (lambda c: c.over(over))
    if null_policy == "skip":
        return placed(agg)
    if null_policy != "propagate":
        raise ValueError(f"null_policy must be 'skip' or 'propagate', not {null_policy!r}")
    return F.when(placed(F.count(as_column(value))) == placed(F.count(F.lit(1))), placed(agg))


def linear_fit(y: str, x: str) -> list[Column]:
    """Slope, intercept, R squared, t statistic of the slope and n of y on x."""
    n = F.regr_count(y, x)
    r2 = F.regr_r2(y, x)
    slope = F.regr_slope(y, x)
    return [
        slope.alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        r2.alias("r2"),
        (F.signum(slope) * F.sqrt(F.try_divide(r2 * (n - 2), 1 - r2))).alias("t_stat"),
        n.alias("n"),
    ]


def error_summary(observed: str, predicted: str) -> list[Column]:
    """RMSE, RMSE over the observed mean, and R squared of predicted on observed."""
    rmse = F.sqrt(F.avg(F.pow(F.col(observed) - F.col(predicted), 2)))
    return [
        F.count(F.lit(1)).alias("n"),
        rmse.alias("rmse"),
        F.try_divide(rmse, F.avg(observed)).alias("relative_rmse"),
        F.regr_r2(predicted, observed).alias("r2"),
    ]


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``; a struct minimum, so hot keys shrink map-side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return picked.select(*keys, *[F.col("_first")[c].alias(c) for c in order + rest]).select(*df.columns)


def null_counts(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Number of nulls per column, one row per column."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([], columns, "column_name", "n_null")


def share_table(df: DataFrame, column: str) -> DataFrame:
    """Frequency and share of each value; the window runs over one row per value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col("n") / total)


def bounded_rank(df: DataFrame, column: str, name: str = "display_rank", ascending: bool = True) -> DataFrame:
    """Dense rank over the whole table by a column with few distinct values (days, years, labels).

    Only the distinct values meet in one task: a century of days is 36,525 rows however many
    sites there are. Building the plan starts no job; the exchanges of ``df`` serve both readings.
    """
    order = F.col(column).asc() if ascending else F.col(column).desc()
    ranks = df.select(column).distinct().withColumn(name, F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(order)))
    return df.join(ranks, column, "left")


def fixed_bins(df: DataFrame, value: str, width: float, facet: list[str] | None = None, centred: bool = True) -> DataFrame:
    """Histogram with bins of fixed width, centred on the multiples of it or else starting there."""
    shift = 0.5 if centred else 0.0
    index = F.floor(F.col(value) / width + shift)
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*(facet or []), index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_start", (F.col("bin") - shift) * width)
    )


def equal_bins(df: DataFrame, columns: list[str], bins: int = 30, label: str = "variable", centred: bool = True) -> DataFrame:
    """Histogram of each column with ``bins`` equal bins over its own range.

    The first bin is centred on the minimum and the last on the maximum, so that a bin is the range
    over ``bins`` - 1 wide; else bins start at the minimum and end at the maximum.

    Two passes that both combine map-side. The bounds are one row per column, so that side of
    the join is bounded by the number of columns.
    """
    bounds = (
        df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in columns])
        .unpivot([], columns, label, "range")
        .select(label, "range.lo", "range.hi")
    )
    tall = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, label, "value")
    shift = 0.5 if centred and bins > 1 else 0.0
    width = (F.col("hi") - F.col("lo")) / (bins - 1 if shift else bins)
    index = F.least(F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("lo"), width) + shift), F.lit(0)), F.lit(bins - 1))
    return (
        tall.where(F.col("value").isNotNull())
        .join(F.broadcast(bounds), label)
        .groupBy(label, index.cast("int").alias("bin"), F.col("lo"), width.alias("width"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(label, "bin", (F.col("lo") + (F.col("bin") - shift) * F.col("width")).alias("bin_start"), "n")
    )


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every unordered column pair, long, from one aggregation.

    Taken over the rows complete in all columns; null where a column does not vary.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.dropna(subset=columns).agg(
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        *[F.covar_pop(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)],
    )
    rows = [F.struct(F.lit(c).alias("var_1"), F.lit(c).alias("var_2"), F.when(F.col(f"s_{c}") > 0, 1.0).alias("r")) for c in columns]
    rows += [
        F.struct(
            F.lit(a).alias("var_1"),
            F.lit(b).alias("var_2"),
            F.try_divide(F.col(f"c{k}"), F.col(f"s_{a}") * F.col(f"s_{b}")).alias("r"),
        )
        for k, (a, b) in enumerate(pairs)
    ]
    return wide.select(F.inline(F.array(*rows)))


def pivot_shares(
    df: DataFrame, keys: list[str], label: str, value: str, labels: list[str], prefix: str = "", other: str | None = None
) -> DataFrame:
    """Share of each label in the key's total, one column per label, from a single aggregation.

    ``other`` names a column for the share of all further labels and of null, so that a row adds up to 1.
    """
    total = F.sum(value)
    columns = [F.try_divide(F.sum(F.when(F.col(label) == v, F.col(value))), total).alias(prefix + v) for v in labels]
    if other is not None:
        rest = F.when(~F.coalesce(F.col(label).isin(list(labels)), F.lit(False)), F.col(value))
        columns.append(F.try_divide(F.sum(rest), total).alias(prefix + other))
    return df.groupBy(*keys).agg(*columns)


def vocabulary(df: DataFrame, label: str, most: int = 1000) -> list[str]:
    """The labels that occur, in order; an error beyond ``most``, where rows (``long_shares``) fit better than columns."""
    found = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} distinct values of {label}")
    return sorted(found)


def long_shares(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """Share of each label in the key's total as rows (keys, label, share), whatever the labels are."""
    sums = df.groupBy(*keys, label).agg(F.sum(value).alias("_part"))
    total = F.sum("_part").over(Window.partitionBy(*keys))
    return sums.select(*keys, label, F.try_divide(F.col("_part"), total).alias("share"))


def share_map(df: DataFrame, keys: list[str], label: str, value: str, name: str = "shares") -> DataFrame:
    """Share of each label in the key's total as one map per key, whatever the labels are.

    Sums combine map-side by (key, label), so a map is built from one entry per label. A null label is
    the entry ``""``; a share of an empty or null total is null.
    """
    sums = df.groupBy(*keys, F.coalesce(F.col(label), F.lit("")).alias("_label")).agg(F.sum(value).alias("_part"))
    entries = F.sort_array(F.collect_list(F.struct("_label", "_part")))
    whole = sums.groupBy(*keys).agg(entries.alias("_entries"), F.sum("_part").alias("_total"))
    share = lambda e: F.struct(e["_label"].alias("key"), F.try_divide(e["_part"], F.col("_total")).alias("value"))
    return whole.select(*keys, F.map_from_entries(F.transform("_entries", share)).alias(name))


def bind_map(df: DataFrame, column: str, names: list[str], prefix: str = "", other: str | None = None) -> DataFrame:
    """Entries of a map column as columns, bound as late as this; the map itself goes.

    A name that a map lacks is null. ``other`` names a column for the sum of all further entries, null where
    there is none, so that nothing the map holds is lost to a list that does not know it.
    """
    columns = [F.try_element_at(column, F.lit(n)).alias(prefix + n) for n in names]
    if other is not None:
        rest = F.map_values(F.map_filter(column, lambda k, v: ~k.isin(list(names)) & v.isNotNull()))
        total = F.aggregate(rest, F.lit(0.0), lambda a, v: a + v.cast("double"))
        columns.append(F.when(F.size(rest) > 0, total).alias(prefix + other))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], *columns)


def map_names(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The names that occur in a map column, in order; an error beyond ``most``."""
    return vocabulary(df.select(F.explode(F.map_keys(column)).alias("_name")), "_name", most)
