"""Land cover, geology, climate zones and static basin attributes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.aggregates import long_shares, pivot_shares, share_map, vocabulary
from ..functions.columns import strip_decoration
from ..functions.series import SITE


def class_proportions(
    parts: Sequence[DataFrame],
    classes: Sequence[str] | None = None,
    site: str = SITE,
    year: str = "year",
    label: str = "class",
    area: str = "area",
    prefix: str = "",
    other: str | None = None,
) -> DataFrame:
    """Share of each land-cover class per (basin, year).

    With ``classes`` one column each, from one aggregation; ``"all"`` takes those that occur in the data.
    Shares are of the whole total, so classes that are not named leave the rest to 1, which ``other``
    gives a column of its own. Without ``classes`` rows (basin, year, class, share) of every class.
    """
    cover = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if classes is None:
        return long_shares(cover, [site, year], label, area)
    named = vocabulary(cover, label) if classes == "all" else list(classes)
    return pivot_shares(cover, [site, year], label, area, named, prefix, other)


def class_maps(parts: Sequence[DataFrame], site: str = SITE, year: str = "year", label: str = "class", area: str = "area", name: str = "shares") -> DataFrame:
    """Shares of all classes of a (basin, year) as one map, so that a class no list knows stays in every join.

    Columns are bound where they are needed, with ``bind_map``.
    """
    return share_map(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), [site, year], label, area, name)


def backfill_maps(df: DataFrame, column: str, year: str = "water_year") -> DataFrame:
    """Each entry of a map column from its year or else the next year that has the entry, per site.

    Runs backwards in time over one value per class: the map so far is kept in the order of the years
    and an entry of an earlier year replaces that of a later one. A site has one row per year.
    """
    back = Window.partitionBy(SITE).orderBy(F.col(year).desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = F.collect_list(F.coalesce(F.col(column), F.create_map().cast("map<string,double>"))).over(back)

    def newer(held: Column, own: Column) -> Column:
        known = F.map_filter(own, lambda k, v: v.isNotNull())
        return F.map_concat(F.map_filter(held, lambda k, v: ~F.map_contains_key(known, k)), known)

    empty = F.create_map().cast("map<string,double>")
    return df.withColumn("_later", later).withColumn(column, F.aggregate("_later", empty, newer)).drop("_later")


def geology_proportions(
    geo: DataFrame, liths: Sequence[str] | None = None, site: str = SITE, label: str = "lith", value: str = "proportion", prefix: str = ""
) -> DataFrame:
    """Summed proportion per lithology: with ``liths`` one column each, null where absent; without, as rows.

    ``"all"`` takes the lithologies that occur in the data.
    """
    if liths is None:
        return geo.groupBy(site, label).agg(F.sum(value).alias(value))
    named = vocabulary(geo, label) if liths == "all" else list(liths)
    return geo.groupBy(site).agg(*[F.sum(F.when(F.col(label) == v, F.col(value))).alias(prefix + v) for v in named])


def complete_composition(wide: DataFrame, columns: Sequence[str], min_sum: float = 0.99) -> DataFrame:
    """Rows whose proportions add up to more than ``min_sum``; nulls count as 0."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    return wide.withColumn("total", total).where(F.col("total") > min_sum)


def climate_zone_lookup(sites: DataFrame, zone_grid: DataFrame, names: DataFrame, cell: float = 0.5) -> DataFrame:
    """Climate zone and its name for each site, by the grid cell its coordinates lie in.

    ``zone_grid`` has lat, lon (anywhere in the cell) and zone_code; ``names`` has zone_code and
    zone. Cells are matched by integer index, which makes it an equi-join.
    """

    def indexed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_y": F.floor(F.col("lat") / cell), "_x": F.floor(F.col("lon") / cell)})

    grid = indexed(zone_grid).select("_y", "_x", "zone_code").distinct()
    found = indexed(sites).join(grid, ["_y", "_x"]).drop("_y", "_x")
    return found.join(names, "zone_code")


def sites_per_zone(df: DataFrame, zone: str = "zone") -> DataFrame:
    """Number of distinct sites in each climate zone."""
    return df.groupBy(zone).agg(F.count_distinct(SITE).alias("n_sites"))


def sentinel_to_null(df: DataFrame, columns: Sequence[str], sentinel: float = -999) -> DataFrame:
    """A sentinel value becomes null in the given columns."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel).cast(dict(df.dtypes)[c])) for c in columns})


def backfill_series(df: DataFrame, columns: Sequence[str], year: str = "water_year") -> DataFrame:
    """Fill nulls from the next year that has a value, per site; later nulls stay null.

    Runs backwards in time, where "next known" is the last value seen: one growing frame per
    column instead of a rescan of the rest of the site for every row.
    """
    back = Window.partitionBy(SITE).orderBy(F.col(year).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in columns})


def basin_attribute(wide: DataFrame, name: str, head: int = 1, tail: int = 2) -> DataFrame:
    """(site, value) rows from a one-row table with one decorated column per site."""
    sites = {c: strip_decoration(c, head, tail) for c in wide.columns}
    renamed = wide.select(*[F.col(f"`{c}`").cast("double").alias(s) for c, s in sites.items()])
    return renamed.unpivot([], [f"`{s}`" for s in sites.values()], SITE, name)
