"""Two-component separation of discharge by conductivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantile, unbounded_quantiles
from ..functions.series import SITE


def end_members(samples: DataFrame, lo: float = 0.01, hi: float = 0.99, one_per_day: bool = False) -> DataFrame:
    """Runoff and groundwater end members: a low and a high quantile of a site's samples.

    A site can hold any share of the samples, so no task ever receives a whole site. Samples
    known to be folded to one per day are bounded by the calendar; ``one_per_day`` then takes the
    same quantiles with one plain aggregation.
    """
    if one_per_day:
        return samples.groupBy(SITE).agg(quantile("result_va", lo).alias("runoff"), quantile("result_va", hi).alias("gw"))
    return unbounded_quantiles(samples, [SITE], "result_va", {"runoff": lo, "gw": hi})


def baseflow_separation(daily_est: DataFrame, members: DataFrame) -> DataFrame:
    """Baseflow and its proportion of discharge from a daily conductivity estimate, not clamped."""
    share = F.try_divide(F.col("gen_conc") - F.col("runoff"), F.col("gw") - F.col("runoff"))
    bf = F.col("q") * share
    return daily_est.join(members, SITE).select(
        *daily_est.columns, bf.alias("bf"), F.try_divide(bf, F.col("q")).alias("bf_percent")
    )
