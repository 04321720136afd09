"""Column helpers: null-safe recodes, centring, rounding, small vector algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_even(col, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(col, digits)


def is_member(col, values) -> Column:
    """Membership flag that is false, not null, where the value is missing."""
    return F.coalesce(F.col(col).isin(list(values)), F.lit(False))


def differs(col, value) -> Column:
    """Inequality that keeps rows whose value is missing."""
    return ~F.col(col).eqNullSafe(value)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing floats become null, so that aggregates skip them."""
    fix = {
        c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`"))
        for c, t in df.dtypes
        if t in ("double", "float")
    }
    return df.withColumns(fix) if fix else df


def zscore(col, mean, sd) -> Column:
    return F.try_divide(F.col(col) - mean, sd)


def from_zscore(col, mean, sd) -> Column:
    return F.col(col) * sd + mean


def dot(a, b) -> Column:
    """Inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def matvec(m, v) -> Column:
    """Product of an array of rows with an array."""
    return F.transform(m, lambda row: dot(row, v))


def quad(v, m) -> Column:
    """v' M v."""
    return dot(v, matvec(m, v))


def by_stratum(rows: DataFrame, by: list[str], value: Column) -> Column:
    """``value`` of the row's stratum, from a map with one entry per stratum that is read as a scalar: no join on a key of few values."""
    entry = F.struct(F.struct(*by).alias("k"), value.alias("v"))
    return F.try_element_at(rows.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar(), F.struct(*by))
