"""The aggregates of point values, as columns over nulls-are-missing doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("count", "mean", "sum", "prod", "std", "var", "min", "max", "median", "mode", "majority", "nunique", "range")
#: Aggregates that need the values' counts; they are computed in a second level.
BY_VALUE = ("mode", "majority")


def rounded(value: Column, decimals: int | None) -> Column:
    """Half to even; whole numbers are longs; None leaves the value as it is."""
    if decimals is None:
        return value
    out = F.bround(value.cast("double"), decimals)
    return out if decimals > 0 else out.cast("long")


def aggregate(name: str, band: Column) -> Column:
    plain = {
        "count": lambda c: F.count(c),
        "mean": F.avg,
        "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
        "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
        "std": F.stddev_samp,
        "var": F.var_samp,
        "min": F.min,
        "max": F.max,
        "median": F.median,
        "nunique": F.count_distinct,
        "range": lambda c: F.max(c) - F.min(c),
    }
    if name not in plain:
        raise ValueError(f"{name!r} is not an aggregate of one pass")
    return plain[name](band)


def log2_product(band: Column) -> Column:
    """The logarithm of the product's magnitude, summed, as the product of a large cell is too large for a double; null for no values, minus infinity with a zero."""
    return F.sum(F.when(band == 0, float("-inf")).otherwise(F.log2(F.abs(band))))


def by_cell(df: DataFrame, keys: list[str], bands: tuple[str, ...], names: tuple[str, ...], decimals: int | None = None) -> DataFrame:
    """One row a cell: for each band a column if one aggregate is asked for, else a struct of all.

    Plain aggregates are one grouped pass with partial sums.  Mode and majority
    count each value first (also combined before the shuffle) and take the best,
    so a cell's values are never gathered: most often, then the smallest; null
    takes part and wins only with a larger count.
    """
    unknown = [n for n in names if n not in NAMES]
    if unknown or not names:
        raise ValueError(f"unknown aggregates {unknown}")
    rows = df.dropna(subset=keys)
    single = [n for n in names if n not in BY_VALUE]
    frames = []
    if single:
        frames.append(rows.groupBy(*keys).agg(*[aggregate(n, F.col(b)).alias(f"{b}__{n}") for b in bands for n in single]))
    if len(single) < len(names):
        for b in bands:
            value = F.bround(F.col(b), decimals) if decimals is not None else F.col(b)
            counted = rows.select(*keys, value.alias("v")).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
            first = F.max(F.struct(F.col("n"), F.col("v").isNotNull().alias("there"), (-F.col("v")).alias("least")))
            best = counted.groupBy(*keys).agg(first.alias("best"), F.sum("n").alias("all"))
            mode = -F.col("best.least")
            columns = {"mode": mode, "majority": F.when((2 * F.col("best.n") > F.col("all")) & F.col("best.there"), mode)}
            frames.append(best.select(*keys, *[columns[n].alias(f"{b}__{n}") for n in names if n in BY_VALUE]))
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys)
    exact = ("count", "nunique")
    shaped = []
    for b in bands:
        values = [(F.col(f"{b}__{n}") if n in exact and decimals is None else rounded(F.col(f"{b}__{n}"), decimals)).alias(n) for n in names]
        shaped.append((values[0] if len(values) == 1 else F.struct(*values)).alias(b))
    return out.select(*keys, *shaped)


def lists(df: DataFrame, keys: list[str], bands: tuple[str, ...], decimals: int | None = None) -> DataFrame:
    """The sorted values of each band of a cell."""
    return df.groupBy(*keys).agg(*[F.array_sort(F.collect_list(rounded(F.col(b), decimals))).alias(b) for b in bands])
