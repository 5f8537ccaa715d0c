"""Attribution of predictions to drivers and the tables made from it."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.aggregates import bounded_rank
from ..functions.series import SITE
from ..session import task_count
from .model import KEYS, drivers_of


def background_rows(frame: DataFrame, drivers: list[str], seed: int) -> tuple[DataFrame, int]:
    """All rows of the frame numbered from 0 in the order of a key hash (_i, _z), and their number.

    The number has two levels, rows before the hash bucket and place inside it, with about as many
    buckets as rows in one.
    """
    size = frame.count()
    hashed = frame.select(F.xxhash64(*KEYS, F.lit(seed)).alias("_h"), *KEYS, F.array(*drivers).alias("_z"))
    hashed = hashed.withColumn("_bucket", F.pmod("_h", F.lit(max(1, math.isqrt(size)))))
    counts = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", *KEYS)) - 1
    return hashed.withColumn("_place", inside).join(counts, "_bucket").select((F.col("_before") + F.col("_place")).alias("_i"), "_z"), size


def shapley_sampling(
    model, frame: DataFrame, samples: int = 100, seed: int = 123, background: int | None = None, label: str = "q5_norm"
) -> DataFrame:
    """Sampling Shapley values (Strumbelj & Kononenko 2014), one row per (site, year, driver).

    Draw k of a row orders the drivers at random and takes a random background row z. Walking
    along the order, z turns into the row one driver at a time; a driver's contribution is the
    change of the prediction at its step. p drivers need p + 1 predictions per draw, not 2 p.
    Orders and background picks are hashes of the keys, so reruns agree.

    The background is the whole frame, or the first ``background`` rows in the order of a key hash.
    Its rows are numbered, a draw is a number, and the two meet in an equi-join: no size of frame or
    background is broadcast or refused.
    """
    drivers = drivers_of(frame, label)
    p = len(drivers)
    pool, size = background_rows(frame, drivers, seed)
    if not size:
        raise ValueError("the frame has no rows")
    size = size if background is None else min(size, background)
    rows = frame.select(*KEYS, F.array(*drivers).alias("_x")).repartition(task_count(frame.sparkSession), *KEYS)
    draws = rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    draws = draws.withColumn("_i", F.pmod(F.xxhash64(*KEYS, "_k", F.lit(seed)), F.lit(size)))
    draws = draws.join(pool, "_i")
    shuffled = F.array_sort(F.array(*[
        F.struct(F.xxhash64(*KEYS, "_k", F.lit(seed), F.lit(name)).alias("h"), F.lit(j).alias("j")) for j, name in enumerate(drivers)
    ]))
    draws = draws.withColumn("_order", F.transform(shuffled, lambda s: s["j"]))
    steps = draws.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(p))))
    taken = F.slice("_order", F.lit(1), F.col("_s"))
    mixed = F.array(*[F.when(F.array_contains(taken, j), F.col("_x")[j]).otherwise(F.col("_z")[j]) for j in range(p)])
    scored = model.transform(steps.withColumn("features", array_to_vector(mixed)))
    # Step s adds the driver at position s and is the baseline of the driver at position s + 1.
    effects = F.array(
        F.struct(F.try_element_at("_order", F.nullif(F.col("_s"), F.lit(0))).alias("j"), F.col("prediction").alias("f")),
        F.struct(F.try_element_at("_order", F.col("_s") + 1).alias("j"), (-F.col("prediction")).alias("f")),
    )
    signed = scored.select(*KEYS, "_k", "_x", F.inline(effects)).where(F.col("j").isNotNull())
    signed = signed.select(*KEYS, "_k", "j", "f", F.element_at("_x", F.col("j") + 1).alias("x"))
    per_draw = signed.groupBy(*KEYS, "_k", "j").agg(F.sum("f").alias("d"), F.max("x").alias("x"))
    values = per_draw.groupBy(*KEYS, "j").agg(
        F.avg("d").alias("phi"), F.var_samp("d").alias("phi_var"), F.max("x").alias("feature_value")
    )
    names = F.array(*[F.lit(d) for d in drivers])
    return values.select(
        F.element_at(names, F.col("j") + 1).alias("feature"),
        "phi",
        "phi_var",
        "feature_value",
        *KEYS,
    )


def mean_abs_shap(shap: DataFrame, feature_classes: DataFrame | None = None, residual_labels: DataFrame | None = None) -> DataFrame:
    """Mean absolute attribution per driver, overall and by prediction class, with display rank.

    ``feature_classes`` has feature and class; ``residual_labels`` has site_no, water_year and
    class_a. The overall mean is put together from the class sums, so rows are read once.
    """
    rows = shap
    if residual_labels is not None:
        rows = rows.join(residual_labels.select(*KEYS, "class_a"), list(KEYS), "left")
    else:
        rows = rows.withColumn("class_a", F.lit(None).cast("string"))
    parts = rows.groupBy("feature", "class_a").agg(F.sum(F.abs("phi")).alias("_s"), F.count("phi").alias("_n"))
    whole = Window.partitionBy("feature")
    parts = parts.select(
        "feature",
        "class_a",
        F.try_divide("_s", "_n").alias("mean_abs_shap"),
        F.try_divide(F.sum("_s").over(whole), F.sum("_n").over(whole)).alias("mean_abs_shap_all"),
    )
    ranked = bounded_rank(parts, "mean_abs_shap_all")
    if feature_classes is not None:
        ranked = ranked.join(feature_classes, "feature", "left")
    return ranked


def shap_dependence(shap: DataFrame, panel: DataFrame, feature: str, zone: str | None = "zone") -> DataFrame:
    """Attribution of one driver next to its value in the panel, by site and year, and the zone of the site."""
    values = panel.select(*KEYS, F.col(feature).alias("feature_value"))
    rows = shap.where(F.col("feature") == feature).select(*KEYS, "feature", "phi").join(values, list(KEYS), "left")
    if zone is None:
        return rows
    return rows.join(panel.groupBy(SITE).agg(F.min_by(zone, "water_year").alias(zone)), SITE, "left")


def site_mean_filter(frame: DataFrame, column: str = "mean_slope", minimum: float = 13) -> DataFrame:
    """Sites whose mean of a driver is above ``minimum``."""
    return frame.groupBy(SITE).agg(F.avg(column).alias("site_mean")).where(F.col("site_mean") > minimum)
