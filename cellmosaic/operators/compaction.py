"""Compaction: complete groups of equal siblings become one row of their ancestor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.operators.grids import Grid, parent


def compact(cells: DataFrame, grid: Grid, res: int, parent_res: int, bands: tuple[str, ...]) -> DataFrame:
    """``cells`` (parent, cell, bands), each cell once; coarsest complete groups first.

    A level is a grouped count and two extremes of the row of bands, which are
    combined before the shuffle; a group is uniform if they are equal (null equals
    null).  Every level looks at the cells alone, so the plan has one scan a level
    and one for the result: a cell goes to its coarsest ancestor that qualifies.
    """
    up, own = grid.index_column(parent_res), grid.index_column(res)
    rows = cells.where(F.col(own).isNotNull()).select(up, own, *bands)
    value = F.struct(*[F.col(b) for b in bands])
    out, levels = rows, range(parent_res, res)
    for level in levels:
        at: Column = parent(grid, F.col(own), res, level)
        grouped = rows.select(at.alias(f"_at{level}"), value.alias("_v")).groupBy(f"_at{level}").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        whole = grouped.where((F.col("n") == F.lit(grid.children(level, res))) & F.col("lo").eqNullSafe(F.col("hi"))).select(f"_at{level}", F.lit(True).alias(f"_whole{level}"))
        out = out.withColumn(f"_at{level}", at).join(whole, f"_at{level}", "left")
    target = F.coalesce(*[F.when(F.col(f"_whole{level}"), F.col(f"_at{level}")) for level in levels], F.col(own))
    # The rows of a group are equal, so it does not matter which one stays.
    return out.select(up, target.alias(own), *bands).groupBy(up, own).agg(*[F.first(b).alias(b) for b in bands])
