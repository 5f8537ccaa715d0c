"""Writers. One table per result, split by site or year on disk where readers prune by it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_by_site(df: DataFrame, path: str, buckets: int | None = None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per site (``site_no=...``) in place of one file per site.

    With very many sites, folders become the cost: ``buckets`` groups sites by hash into that many
    folders instead and keeps the id as a column. The rebalance gathers a folder's rows into few
    files and splits what is too large for one.
    """
    key = "site_no"
    if buckets:
        df, key = df.withColumn("site_bucket", F.pmod(F.xxhash64("site_no"), F.lit(buckets))), "site_bucket"
    writer = df.hint("rebalance", key).write.mode(mode).partitionBy(key)
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)
