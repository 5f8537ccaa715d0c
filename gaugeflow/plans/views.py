"""Gauge-like views derived from the given order tables.

A site is a part brand and a day is a ship date: discharge is the quantity shipped that day,
conductivity the price per unit. ``FIXTURES.md`` lists the mapping. Everything is derived from
whole tables by Spark.

Measures are kept as whole numbers or binary fractions, whose sums are exact in any order: two
engines, or two runs with other partitions, then agree to the last bit before rounding.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from ..functions.aggregates import vocabulary
from ..functions.series import by_site
from ..session import cut_lineage

KEYS = ["site_no", "water_year"]
# Columns of the registered composition tables; what a table holds besides goes into a column of its own.
LAND_CLASSES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


class Views:
    """Lazily built views of one folder of tables; each is a plan, nothing is read before use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def number(column: str = "site_no"):
        return F.regexp_extract(column, r"(\d+)", 1).cast("int")

    # --- daily tables --------------------------------------------------------------------------

    @cached_property
    def shipments(self) -> DataFrame:
        part = self.table("part").select("p_partkey", F.col("p_brand").alias("site_no"), "p_type")
        lines = self.table("lineitem").withColumn("date", F.col("l_shipdate").cast("date"))
        return lines.join(part, F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def days(self) -> DataFrame:
        """All daily measures of a site from one aggregation; unused ones are pruned per query."""
        ratio = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 1024) / 1024
        a, r = F.col("l_returnflag") == "A", F.col("l_returnflag") == "R"
        return self.shipments.groupBy("site_no", "date").agg(
            F.sum("l_quantity").alias("q"),
            F.avg(ratio).alias("ratio"),
            F.avg(F.when(a, ratio)).alias("a_ratio"),
            F.sum(F.floor(F.col("l_tax") * 100 + 0.5)).alias("tax"),
            F.sum(F.floor(F.col("l_discount") * 100 + 0.5)).alias("discount"),
            F.avg("l_quantity").alias("mean_q"),
            F.sum(F.when(r, F.col("l_quantity"))).alias("r_q"),
        )

    def fan_out(self, *measures: str) -> "Views":
        """Views that share one daily table, written once with the measures the plan needs."""
        self.days = cut_lineage(self.days.select("site_no", "date", *measures) if measures else self.days)
        return self

    @property
    def daily_q(self) -> DataFrame:
        return self.days.select("site_no", "date", "q")

    @property
    def samples(self) -> DataFrame:
        return self.days.where(F.col("a_ratio").isNotNull()).select(
            "site_no", F.col("date").alias("sample_dt"), F.col("a_ratio").alias("result_va")
        )

    @property
    def daily_est(self) -> DataFrame:
        return self.days.select("site_no", "date", "q", F.col("ratio").alias("gen_conc"))

    @property
    def et(self) -> DataFrame:
        return self.days.select("site_no", F.col("date").alias("dates"), (-F.col("tax") / 131072).alias("value"))

    @property
    def precip(self) -> DataFrame:
        return self.days.select("site_no", F.col("date").alias("dates"), (F.col("discount") / 131072).alias("value"))

    @property
    def temp(self) -> DataFrame:
        return self.days.select("site_no", F.col("date").alias("dates"), (F.floor(F.col("mean_q") * 1024) / 1024 + 253.125).alias("value"))

    @property
    def swe(self) -> DataFrame:
        """Every day of a site's calendar; days without a value in the cold months are 0."""
        until = F.coalesce(F.date_sub(F.lead("date").over(by_site()), 1), F.col("date"))
        spans = self.days.select("site_no", "date", "r_q", until.alias("until"))
        days = spans.select("site_no", "date", "r_q", F.explode(F.sequence("date", "until")).alias("dates"))
        own = (F.col("dates") == F.col("date")) & F.month("dates").isin(11, 12, 1, 2, 3, 4)
        value = F.coalesce(F.when(own, F.col("r_q") / 1000), F.lit(0.0))
        return days.select("site_no", "dates", value.alias("value"))

    # --- site tables ---------------------------------------------------------------------------

    @property
    def site_info(self) -> DataFrame:
        sites = self.table("part").groupBy(F.col("p_brand").alias("site_no")).agg(
            F.sum("p_size").cast("double").alias("drain_area_va"),
            F.avg(F.floor("p_retailprice")).alias("mean_elevation"),
            F.avg("p_size").alias("mean_slope"),
        )
        return sites.withColumns({"lat": 30.0 + self.number() % 20, "lon": -120.0 + self.number() % 15})

    @property
    def area(self) -> DataFrame:
        return self.site_info.select("site_no", "drain_area_va")

    @property
    def zones(self) -> DataFrame:
        region = self.table("region").select(F.col("r_regionkey").alias("_k"), F.col("r_name").alias("zone"))
        sites = self.site_info.select("site_no", (self.number() % 5).alias("_k"))
        return sites.join(region, "_k").select("site_no", "zone")

    @property
    def zone_grid(self) -> DataFrame:
        """Zone of each grid cell that has a site; coordinates lie off the cell's corner."""
        return self.site_info.select(
            (F.col("lat") + 0.25).alias("lat"), (F.col("lon") + 0.25).alias("lon"), (self.number() % 5).alias("zone_code")
        )

    @property
    def zone_names(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").alias("zone_code"), F.col("r_name").alias("zone"))

    @property
    def land_cover(self) -> DataFrame:
        return self.shipments.groupBy("site_no", F.year("date").alias("year"), F.col("p_type").alias("class")).agg(
            F.sum("l_extendedprice").alias("area")
        )

    @property
    def geology(self) -> DataFrame:
        part = self.table("part").select(F.col("p_brand").alias("site_no"), "p_type", "p_size")
        total = part.groupBy("site_no").agg(F.sum("p_size").alias("total"))
        liths = part.groupBy("site_no", F.col("p_type").alias("lith")).agg(F.sum("p_size").alias("size"))
        return liths.join(total, "site_no").select("site_no", "lith", (F.col("size") / F.col("total")).alias("proportion"))

    @property
    def attributes(self) -> DataFrame:
        sites = self.table("part").groupBy(F.col("p_brand").alias("site_no")).agg(
            F.sum("p_size").alias("s"), F.count(F.lit(1)).alias("n")
        )
        return sites.select(
            "site_no",
            F.when(F.col("s") % 7 == 0, -999).otherwise(F.col("s")).cast("double").alias("a1"),
            F.when(F.col("n") % 3 == 0, -999).otherwise(F.col("n")).cast("double").alias("a2"),
        )

    @property
    def site_catalog(self) -> DataFrame:
        site_type = F.when(F.col("c_mktsegment") == "MACHINERY", "LK").otherwise("ST")
        customers = self.table("customer").select("c_custkey", site_type.alias("site_tp_cd"))
        urgent, partial = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "P"
        codes = F.array_compact(F.array(F.when(urgent, F.lit("00060")), F.when(partial, F.lit("00095"))))
        orders = self.table("orders").where(urgent | partial)
        measured = orders.select("o_custkey", F.explode(codes).alias("parameter_cd")).distinct()
        return measured.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_custkey").cast("string").alias("site_no"), "site_tp_cd", "parameter_cd"
        )

    def wide(self, long: DataFrame) -> DataFrame:
        """One column per site of the table with decorated names, as the gridded product has it."""
        brands = vocabulary(long, "site_no", most=10_000)
        return long.groupBy("dates").agg(*[
            F.max(F.when(F.col("site_no") == b, F.col("value"))).alias(f"X{b}..") for b in brands
        ])

    # --- results that later steps start from ----------------------------------------------------

    @property
    def filled(self) -> DataFrame:
        return op.fill_daily_gaps(self.daily_q)

    @property
    def filled_q(self) -> DataFrame:
        return self.filled.select("site_no", "date", F.col("filled_q").alias("q"))

    @property
    def complete(self) -> DataFrame:
        return op.complete_water_years(self.filled_q)

    @property
    def q5(self) -> DataFrame:
        return op.low_flow_q5(self.complete)

    @property
    def q5_long(self) -> DataFrame:
        """Low flow of the long season, May to November."""
        return op.low_flow_q5(self.complete, months=(5, 11))

    def members(self, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
        return op.end_members(self.samples, lo, hi, one_per_day=True)

    @property
    def est_filled(self) -> DataFrame:
        """Estimate on the whole calendar of a site: discharge and concentration between known days."""
        return op.fill_daily_columns(self.daily_est, ["q", "gen_conc"])

    def annual(self, members: DataFrame, min_years: int) -> DataFrame:
        """Annual baseflow over complete water years of the filled estimate."""
        separated = op.complete_water_years(op.baseflow_separation(self.est_filled, members)).drop("water_year")
        return op.annual_baseflow(separated, min_years=min_years)

    @property
    def annual_bf(self) -> DataFrame:
        return self.annual(self.members(), min_years=5)

    @property
    def snow(self) -> DataFrame:
        swe = self.swe
        return op.snow_disappearance(swe, op.peak_snow(swe)).drop("melt_days")

    @property
    def panel(self) -> DataFrame:
        return op.harmonise(
            op.site_year_stats(self.annual_bf, self.q5),
            annual=[op.annual_climate(self.et, self.precip, self.temp), self.snow],
            static=[
                self.site_info,
                self.zones,
                op.recession_slope(self.daily_q).select("site_no", "recession_curve_slope"),
            ],
        )

    def _residuals(self, key: str) -> DataFrame:
        q5 = self.q5.select("site_no", F.col("year").alias("water_year"), F.col("q5").alias("q5_norm"))
        means = q5.groupBy(key).agg(F.avg("q5_norm").alias("pred"))
        return q5.join(means, key).withColumn("residual", F.col("q5_norm") - F.col("pred"))

    @property
    def residuals_a(self) -> DataFrame:
        return self._residuals("site_no")

    @property
    def residuals_b(self) -> DataFrame:
        return self._residuals("water_year")

    @property
    def classes(self) -> DataFrame:
        return op.residual_classes(self.residuals_a, self.residuals_b)

    @property
    def joined(self) -> DataFrame:
        """Residual classes with zone, climate and flow condition of each site-year."""
        rows = self.classes.join(self.zones, "site_no", "left")
        for table in (op.annual_evaporation(self.et), op.annual_precipitation(self.precip), op.peak_snow(self.swe)):
            rows = rows.join(table, KEYS, "left")
        return op.flow_condition(rows.withColumn("q5", F.col("q5_norm")))

    @property
    def shap_stub(self) -> DataFrame:
        """Attribution-like rows: annual metrics minus their overall mean."""
        metrics = op.annual_evaporation(self.et).join(op.annual_precipitation(self.precip), KEYS).join(
            op.annual_temperature(self.temp), KEYS
        )
        names = ["annual_evap_mm", "annual_precip_mm", "mean_temp_c"]
        long = metrics.unpivot(KEYS, names, "feature", "value")
        means = metrics.agg(*[F.avg(n).alias(n) for n in names]).unpivot([], names, "feature", "mean")
        return long.join(means, "feature").select(*KEYS, "feature", (F.col("value") - F.col("mean")).alias("phi"))
