"""Rasters sampled at cell centres: nearest, bilinear, bicubic and Lanczos.

A cell's stencil is a fixed list of pixel offsets, so the lookup is an equi-join
on (row, col) and a grouped sum, never a range join.  Pixels outside the raster
do not match and count as missing; weights are divided by those of valid pixels.
A bilinear stencil that leaves the raster gives no value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.sources.raster import Raster, apply_policy, mask_bands

#: First and last offset of a stencil and the valid pixels that it needs.
STENCILS = {"nn": (0, 0, 1), "bilinear": (0, 1, 2), "bicubic": (-1, 2, 4), "lanczos": (-2, 3, 4)}


def kernel(name: str, t: Column) -> Column:
    """Weight at a distance of ``t`` pixels."""
    x = F.abs(t)
    if name == "nn":
        return F.lit(1.0)
    if name == "bilinear":
        return F.greatest(1 - x, F.lit(0.0))
    if name == "bicubic":  # Keys, a = -1/2
        near = (1.5 * x - 2.5) * x * x + 1
        far = ((-0.5 * x + 2.5) * x - 4) * x + 2
        return F.when(x <= 1, near).when(x < 2, far).otherwise(0.0)
    p = x * math.pi
    return F.when(x < 1e-12, 1.0).when(x < 3, 3 * F.sin(p) * F.sin(p / 3) / (p * p)).otherwise(0.0)


def sample(cells: DataFrame, pixels: DataFrame, raster: Raster, bands: tuple[str, ...], how: str, *, policy: str = "omit", fill: float | None = None) -> DataFrame:
    """``cells`` (any columns, lon, lat in the raster's system) with a value per band."""
    if how not in STENCILS:
        raise ValueError(f"unknown interpolation {how!r}")
    low, high, needed = STENCILS[how]
    r, c = raster.fractional(F.col("lon"), F.col("lat"))
    shift = 0.5 if how == "nn" else 0.0
    keys = cells.columns
    within = F.lit(True)
    if how == "bilinear":
        within = (F.col("_row") >= 0) & (F.col("_row") + 1 < raster.height) & (F.col("_col") >= 0) & (F.col("_col") + 1 < raster.width)
    placed = cells.select("*", r.alias("_r"), c.alias("_c")).select("*", F.floor(F.col("_r") + shift).alias("_row"), F.floor(F.col("_c") + shift).alias("_col"))
    reach = F.sequence(F.lit(low), F.lit(high))
    placed = placed.where((F.floor(F.col("_r") + 0.5) >= 0) & (F.floor(F.col("_r") + 0.5) < raster.height) & (F.floor(F.col("_c") + 0.5) >= 0) & (F.floor(F.col("_c") + 0.5) < raster.width))
    stencil = placed.select("*", F.explode(reach).alias("_i")).select("*", F.explode(reach).alias("_j"))
    weighted = stencil.select(*keys, within.alias("_within"), (F.col("_row") + F.col("_i")).cast("int").alias("row"), (F.col("_col") + F.col("_j")).cast("int").alias("col"), (kernel(how, F.col("_r") - F.col("_row") - F.col("_i")) * kernel(how, F.col("_c") - F.col("_col") - F.col("_j"))).alias("_w"))
    values = mask_bands(pixels.select("row", "col", *bands), bands, raster.nodata)
    joined = weighted.join(values, ["row", "col"], "left")
    sums = []
    for b in bands:
        valid = F.col(b).isNotNull()
        total = F.sum(F.when(valid, F.col("_w")))
        sums.append(F.when(F.col("_within") & (F.count(b) >= needed) & (total != 0), F.sum(F.col("_w") * F.col(b)) / total).alias(b))
    out = joined.groupBy(*keys, "_within").agg(*sums).drop("_within")
    return apply_policy(out, bands, policy, missing="any", fill=raster.nodata if fill is None else fill)
