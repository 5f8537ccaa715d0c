"""The joined site-by-year panel and the model table cut from it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.aggregates import with_nulls
from ..functions.columns import drop_sites, to_double
from ..functions.series import SITE
from .landscape import backfill_series

# Driver columns in the order of the harmonised panel.
CLIMATE_DRIVERS = (
    "annual_evap_mm",
    "annual_precip_mm",
    "mean_temp_c",
    "peak_swe_day",
    "peak_swe_mm",
    "sdd",
    "melt_rate",
)
SITE_DRIVERS = ("recession_curve_slope", "mean_elevation", "mean_slope", "mean_bf")
DRIVER_SETS = {
    "climate": CLIMATE_DRIVERS,
    "no_baseflow": SITE_DRIVERS[:1] + CLIMATE_DRIVERS + SITE_DRIVERS[1:3],
    "full": SITE_DRIVERS[:1] + CLIMATE_DRIVERS + SITE_DRIVERS[1:],
}

# Square metres per square mile and millimetre-seconds per day.
AREA_FACTOR = 2.58999e6
DEPTH_FACTOR = 86400000


def harmonise(
    facts: DataFrame,
    annual: Sequence[DataFrame] = (),
    static: Sequence[DataFrame] = (),
    backfill: Sequence[str] = (),
    null_policy: str = "skip",
) -> DataFrame:
    """Site-year facts left-joined to annual tables and to site attributes.

    ``annual`` tables are keyed (site_no, water_year), ``static`` ones site_no; both are unique
    on their key. The mean baseflow of a site over its years is added as ``mean_bf``. Annual
    tables go first and share one placement by (site, year); the mean and the attributes share the
    one by site. Broadcasting attributes is left to the planner, which broadcasts those it knows to be small and no others.
    Columns named in ``backfill`` take, where null, the value of the site's next year that has one.
    With ``null_policy='propagate'`` a year without baseflow leaves its site without a mean.
    """
    panel = facts
    for table in annual:
        panel = panel.join(table, [SITE, "water_year"], "left")
    panel = panel.withColumn("mean_bf", with_nulls(F.avg("bf_prop"), "bf_prop", null_policy, Window.partitionBy(SITE)))
    if backfill:
        panel = backfill_series(panel, backfill)
    for table in static:
        panel = panel.join(table, SITE, "left")
    return panel


def model_frame(
    harmonised: DataFrame,
    drivers: str | Sequence[str] = "full",
    units: str = "mm_day",
    exclude: Iterable[str] = (),
    area_factor: float = AREA_FACTOR,
    complete_on: Sequence[str] | None = None,
) -> DataFrame:
    """Response and drivers per site-year, complete cases only.

    ``units='mm_day'`` turns the low flow into depth over the basin; ``'per_area'`` divides by
    the area as given. Completeness is judged on all drivers of the full set, the baseflow
    proportion and the zone where the panel has one, unless ``complete_on`` says otherwise, so
    that the driver sets see the same rows.
    """
    names = list(DRIVER_SETS[drivers]) if isinstance(drivers, str) else list(drivers)
    flow, area = F.col("q5"), F.col("drain_area_va")
    if units == "mm_day":
        response = F.try_divide(flow, area * area_factor) * DEPTH_FACTOR
    elif units == "per_area":
        response = F.try_divide(flow, area)
    else:
        raise ValueError(f"units must be 'mm_day' or 'per_area', not {units!r}")
    judged = list(complete_on) if complete_on is not None else [*DRIVER_SETS["full"], "bf_prop"]
    if complete_on is None and "zone" in harmonised.columns:
        judged.append("zone")
    rows = drop_sites(harmonised, exclude).withColumn("q5_norm", response)
    rows = rows.dropna(subset=["q5_norm", *judged])
    return rows.select(SITE, "water_year", "q5_norm", *[to_double(c).alias(c) for c in names])


def rows_per_site(df: DataFrame) -> DataFrame:
    """Number of rows of each site."""
    return df.groupBy(SITE).agg(F.count(F.lit(1)).alias("n"))
