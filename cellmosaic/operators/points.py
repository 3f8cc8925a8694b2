"""Pixels to cells by their centres: assign, group, write.

One shuffle: rows are grouped by (parent, cell), which is also what the output is
partitioned by.  Partial aggregates are combined before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.functions import aggregates
from cellmosaic.operators.grids import S2, Grid, Lattice, RHealPix, parent
from cellmosaic.sources.raster import apply_policy, mask_bands


def assign(pixels: DataFrame, grid: Grid, res: int, parent_res: int, lon: str | Column = "lon", lat: str | Column = "lat", keep: tuple[str, ...] = ()) -> DataFrame:
    """(parent, cell, kept columns) of each row."""
    lon, lat = (F.col(x) if isinstance(x, str) else x for x in (lon, lat))
    if isinstance(grid, Lattice):  # places first, so that the digits do not each repeat their arithmetic
        ix, iy = grid.indices(lon, lat, res)
        placed = pixels.select(ix.alias("_ix"), iy.alias("_iy"), *keep)
        cell = placed.select(grid.encode(F.col("_ix"), F.col("_iy"), res).alias(grid.index_column(res)), *keep)
    elif isinstance(grid, RHealPix):
        f, x, y = grid.indices(lon, lat, res)
        placed = pixels.select(f.alias("_f"), x.alias("_x"), y.alias("_y"), *keep)
        cell = placed.select(grid.encode(F.col("_f"), F.col("_x"), F.col("_y"), res).alias(grid.index_column(res)), *keep)
    elif isinstance(grid, S2):
        cell = grid.staged(pixels, lon, lat, res, grid.index_column(res), keep)
    else:
        cell = pixels.select(grid.assign(lon, lat, res).alias(grid.index_column(res)), *keep)
    return cell.select(parent(grid, F.col(grid.index_column(res)), res, parent_res).alias(grid.index_column(parent_res)), grid.index_column(res), *keep)


def index_points(pixels: DataFrame, grid: Grid, res: int, bands: tuple[str, ...], *, parent_res: int | None = None, aggs: tuple[str, ...] = ("mean",), decimals: int | None = 1, nodata: float | None = None, policy: str = "omit", fill: float | None = None) -> DataFrame:
    """One row a cell with the aggregates of its pixels; pixels without data are emitted with the nodata value unless there is a fill."""
    up = grid.default_parent(res) if parent_res is None else parent_res
    grid.check(res, up)
    clean = apply_policy(mask_bands(pixels, bands, nodata), bands, policy, missing="all", fill=nodata if fill is None else fill)
    keys = [grid.index_column(up), grid.index_column(res)]
    return aggregates.by_cell(assign(clean, grid, res, up, keep=bands), keys, bands, aggs, decimals)
