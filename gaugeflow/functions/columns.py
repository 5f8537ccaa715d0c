"""Column-level helpers: ids, water years, labels, guarded arithmetic."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- ids ---------------------------------------------------------------------------------------


def normalise_site_id(c: str | Column, width: int = 8) -> Column:
    """Prefix exactly one zero to ids shorter than ``width`` (a lost leading zero, not a pad)."""
    s = as_column(c).cast("string")
    return F.when(F.length(s) < width, F.concat(F.lit("0"), s)).otherwise(s)


def drop_sites(df: DataFrame, ids: Iterable[str], column: str = "site_no") -> DataFrame:
    """Remove a listed set of ids; an empty list removes nothing."""
    ids = list(ids)
    return df.where(~F.col(column).isin(ids)) if ids else df


def strip_decoration(name: str, head: int = 1, tail: int = 2) -> str:
    """Site id inside a wide-table column name such as ``X.09380000..`` or ``X09380000.1``."""
    return name[head : len(name) - tail]


def site_year_key(site: str | Column = "site_no", year: str | Column = "water_year") -> Column:
    """``site_year`` text for output; joins use the two columns."""
    return F.concat_ws("_", as_column(site), as_column(year))


# --- dates -------------------------------------------------------------------------------------


def water_year(d: str | Column) -> Column:
    """Water year: the year that starts on 1 October of the calendar year before."""
    d = as_column(d)
    return F.year(d) + F.when(F.month(d) >= 10, 1).otherwise(0)


def water_year_day(d: str | Column) -> Column:
    """Day of the water year, 1 on 1 October."""
    d = as_column(d)
    return F.datediff(d, F.make_date(water_year(d) - 1, F.lit(10), F.lit(1))) + 1


def decimal_year(d: str | Column) -> Column:
    """Year plus the fraction elapsed at noon of the day."""
    d = as_column(d)
    start = F.make_date(F.year(d), F.lit(1), F.lit(1))
    length = F.datediff(F.make_date(F.year(d) + 1, F.lit(1), F.lit(1)), start)
    return F.year(d) + (F.datediff(d, start) + 0.5) / length


def month_between(d: str | Column, months: tuple[int, int]) -> Column:
    return F.month(as_column(d)).between(*months)


def century_fix(d: str | Column, pivot: int = 2023) -> Column:
    """Dates whose year is past ``pivot`` came from a two-digit year; move them back 100 years."""
    d = as_column(d)
    return F.when(F.year(d) > pivot, F.add_months(d, -1200)).otherwise(d)


def parse_date(c: str | Column, formats: Iterable[str]) -> Column:
    """First format that parses; null when none does."""
    text = as_column(c).cast("string")
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


# --- values ------------------------------------------------------------------------------------


def clip_negative(c: str | Column) -> Column:
    """Negative values become 0, null stays null."""
    c = as_column(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def safe_ln(c: str | Column) -> Column:
    """Natural log, null for values that have none."""
    c = as_column(c)
    return F.when(c > 0, F.ln(c))


def nan_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Not-a-number and infinities become null, so that aggregates see one kind of missing."""
    bad = [F.lit(float("inf")), F.lit(float("-inf"))]
    return df.withColumns({c: F.when(F.isnan(c) | F.col(c).isin(*bad), None).otherwise(F.col(c)) for c in columns})


def relabel(c: str | Column, labels: Mapping[str, str], otherwise: Column | None = None) -> Column:
    """Value to label; values without a label become ``otherwise`` (null by default)."""
    c = as_column(c)
    out = None
    for value, label in labels.items():
        out = (F if out is None else out).when(c == value, F.lit(label))
    return out.otherwise(otherwise if otherwise is not None else F.lit(None))


def sort_key(c: str | Column, order: Iterable[str]) -> Column:
    """Position of a category in a fixed order, 1 first."""
    return relabel(c, {v: str(i) for i, v in enumerate(order, 1)}).cast("int")


def to_double(c: str | Column) -> Column:
    return as_column(c).try_cast("double")


def round_to_cell(c: str | Column, cell: float = 0.5) -> Column:
    """Centre of the grid cell a coordinate lies in (.25 and .75 for half-degree cells)."""
    return F.floor(as_column(c) / cell) * cell + cell / 2
