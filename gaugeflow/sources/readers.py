"""Readers: CSV and parquet tables, many files by pattern, one file per site."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from ..functions.columns import normalise_site_id

# Schemas of the landed gauge-service tables. Ids are text: a number would lose leading zeros.
SITE_CATALOG = "site_no STRING, site_tp_cd STRING, state_cd STRING, parameter_cd STRING"
SAMPLES = "site_no STRING, sample_dt DATE, result_va DOUBLE"
DAILY_Q = "site_no STRING, date DATE, q DOUBLE"
DAILY_EST = "site_no STRING, date DATE, q DOUBLE, gen_conc DOUBLE"
SITE_INFO = "site_no STRING, drain_area_va DOUBLE, dec_lat_va DOUBLE, dec_long_va DOUBLE"


def header_groups(spark: SparkSession, path: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files of a path, pattern or list of paths by their header line; one job for all of them."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "place").alias("header"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("file").collect():  # one short row per file
        names = next(csv.reader([row.header.removeprefix("\ufeff")]), [])
        groups.setdefault(tuple(n.strip() for n in names), []).append(row.file)
    return groups


def _fields(schema: str | StructType | None) -> dict[str, DataType] | None:
    if schema is None:
        return None
    return {f.name: f.dataType for f in (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields}


def _read_group(spark: SparkSession, names: Sequence[str], files: list[str], wanted: dict[str, DataType] | None, more: Sequence[Column]) -> DataFrame:
    """One scan of files with one header; columns by name, an unnamed index column is left out."""
    named = [n for n in names if n]
    if len(set(named)) != len(named):
        raise ValueError(f"{files[0]}: a column name occurs twice in {list(names)}")
    if wanted is not None and (missing := [n for n in wanted if n not in named]):
        raise ValueError(f"{files[0]}: no column {', '.join(missing)} in {list(names)}")
    kinds = wanted or {}
    layout = StructType([StructField(n or f"_unnamed_{k}", kinds.get(n, StringType())) for k, n in enumerate(names)])
    df = spark.read.option("header", True).option("nullValue", "NA").schema(layout).csv(files)
    return df.select(*more, *[F.col(f"`{n}`") for n in (wanted or named)])


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | StructType | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """CSV files with a header line, columns taken by name.

    Files may have their columns in any order and further ones; a column of ``schema`` that a file
    lacks is an error. A leading index column without a name is left out. Without a schema every
    column is text (inference would turn ids into numbers), and a file without a column has nulls
    there. Files are scanned in one plan branch per distinct header, whatever their number.
    """
    wanted = _fields(schema)
    parts = [_read_group(spark, names, files, wanted, more) for names, files in header_groups(spark, path).items()]
    if not parts:
        if schema is None:
            raise ValueError(f"no header line in {path}")
        empty = spark.createDataFrame([], schema)
        return empty.select(*[F.lit(None).cast("string").alias(f"_more_{k}") for k in range(len(more))], *empty.columns)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Landed table (catalogue, samples, daily values, site info) in either format, ids normalised."""
    df = read_csv(spark, path, schema) if fmt == "csv" else spark.read.parquet(path)
    if "site_no" in df.columns:
        df = df.withColumn("site_no", normalise_site_id("site_no"))
    return df


def read_many(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union by name of CSV files whose columns may differ; thousands of files are one job and few scans."""
    return read_csv(spark, list(paths))


def read_per_site_files(
    spark: SparkSession, glob: str, pattern: str = r"_([^_/]+)\.csv$", schema: str | None = None
) -> DataFrame:
    """Files named by site; the id comes from the path of the file, the columns are taken by name."""
    return read_csv(spark, glob, schema, [F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("site_no")])


def wide_file_rows(
    spark: SparkSession,
    path: str | Sequence[str],
    rename: Mapping[str, str] | None = None,
    names_from: Mapping[str, str] | None = None,
    salts: int = 32,
) -> DataFrame:
    """file, names, cells of every line of CSV files with a header line each, whatever their columns.

    Headers are data: they sit in a table with a row per file that the lines meet on the file, so that
    the plan has the same size for three files or thousands, with one header or all different. ``cells``
    and ``names`` are as long as the widest header and null past the end of a line; an unnamed column
    has a null name. ``rename`` maps drifted names to the right ones in every file; ``names_from`` maps the name of
    a file with a broken header to that of the file in the same folder whose names it takes by position.
    A name that occurs twice in a header is an error. Lines of a file meet its header dealt to ``salts``
    tasks, so a file with most of the lines is spread. Files without a line give nothing.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
        F.regexp_replace("value", "^\ufeff", "").alias("value"),
    )
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "place").alias("header"))
    width = first.agg(F.max(F.size(F.split("header", ",")))).first()[0] or 1  # quoted commas only make it larger
    layout = StructType([StructField(f"c{k}", StringType()) for k in range(width)])
    cells = [F.col(f"c{k}") for k in range(width)]
    named = F.from_csv("header", ", ".join(f"c{k} STRING" for k in range(width)), {"nullValue": ""})
    right = _lookup(rename or {})
    headers = first.select("file", F.array(*[F.trim(named[f"c{k}"]) for k in range(width)]).alias("names"))
    headers = headers.withColumn("names", F.transform("names", lambda n: F.when(n != "", right(n))))
    if names_from:
        folder, own = F.regexp_extract("file", "^(.*/)[^/]*$", 1), F.regexp_extract("file", "([^/]*)$", 1)
        given = headers.select(F.col("file").alias("_like"), F.col("names").alias("_given"))
        headers = headers.withColumn("_like", F.concat(folder, _lookup(names_from)(own)))
        headers = headers.join(given, "_like", "left").select("file", F.coalesce("_given", "names").alias("names"))
    once = F.size(F.array_distinct(F.array_compact("names"))) == F.size(F.array_compact("names"))
    twice = F.raise_error(F.concat(F.lit("a column name occurs twice in "), F.col("file")))
    headers = headers.withColumn("names", F.when(once, F.col("names")).otherwise(twice))
    scan = spark.read.option("header", True).option("nullValue", "NA").schema(layout).csv(path)
    rows = scan.select(F.col("_metadata.file_path").alias("file"), F.array(*cells).alias("cells"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("cells"), F.lit(salts)))
    dealt = headers.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.join(dealt, ["file", "_salt"]).select("file", "names", "cells")


def _lookup(names: Mapping[str, str]):
    """Function from a name to the one it maps to, itself where it maps to none."""
    if not names:
        return lambda name: name
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return lambda name: F.coalesce(F.try_element_at(known, name), name)


def repair_columns(
    df: DataFrame, names: Sequence[str] | None = None, rename: Mapping[str, str] | None = None
) -> DataFrame:
    """Take column names from a sibling table, or rename single columns that drifted."""
    if names is not None:
        if len(names) != len(df.columns):
            raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
        df = df.toDF(*names)
    return df.withColumnsRenamed(dict(rename)) if rename else df
