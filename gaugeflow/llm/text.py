"""What several operators of this subpackage share: the word pattern and table access."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.session import cut_lineage, task_count

# Fixed by the contract of the queries: what separates words.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

__all__ = ["SPACE", "WORD", "cut_lineage", "hash_parts", "table", "task_count", "word_count"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_parts(rows: int) -> int:
    """Number of parts for a two-level running sum: as many parts as rows in a part."""
    return max(1, math.isqrt(rows))
