"""Cells laid over pixels by area, for grids of boxes over rasters without rotation.

Candidate pixels of a cell follow from its box, so the join is an equi-join on
(row, col); the covered share of a pixel is a product of two overlaps.  Methods
are grouped sums over the joined rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.functions.histograms import Bins, histogram
from cellmosaic.operators.grids import Lattice, box_area
from cellmosaic.sources.raster import Raster, mask_bands

METHODS = ("weighted", "mode", "mass_preserve", "density_preserve", "fractions", "list")
#: Methods that the least valid share does not apply to.
SUMS = ("mass_preserve",)


def coverage(cells: DataFrame, grid: Lattice, res: int, raster: Raster, pixels: DataFrame, bands: tuple[str, ...], geodesic: bool = True) -> DataFrame:
    """(cell columns, share of the cell that the raster has rf, row, col, covered share c, pixel area w, bands) of all touched pixels."""
    a, b, c0, d, e, f0 = raster.affine
    if b or d:
        raise ValueError("the raster is rotated")
    if "ix" not in cells.columns:
        x, y = grid.place(F.col("cell"), res)
        cells = cells.select("*", x.alias("ix"), y.alias("iy"))
    own = [k for k in cells.columns if k not in ("ix", "iy")]
    w, s, east, n = grid.box(F.col("cell"), res, (F.col("ix"), F.col("iy")))
    cols, rows = sorted_ends((w - c0) / a, (east - c0) / a), sorted_ends((n - f0) / e, (s - f0) / e)
    span = lambda lo, hi, size: F.sequence(F.greatest(F.floor(lo), F.lit(0)).cast("int"), F.least(F.ceil(hi) - 1, F.lit(size - 1)).cast("int"))
    inside = (cols[1] > 0) & (cols[0] < raster.width) & (rows[1] > 0) & (rows[0] < raster.height)
    clipped = lambda lo, hi, size: (F.least(hi, F.lit(float(size))) - F.greatest(lo, F.lit(0.0))) / (hi - lo)
    rf = F.least(clipped(*cols, raster.width) * clipped(*rows, raster.height), F.lit(1.0))
    ends = cells.where(inside).select(*own, rf.alias("rf"), cols[0].alias("_x0"), cols[1].alias("_x1"), rows[0].alias("_y0"), rows[1].alias("_y1"))
    touched = ends.select("*", F.explode(span(F.col("_y0"), F.col("_y1"), raster.height)).alias("row"))
    touched = touched.select("*", F.explode(span(F.col("_x0"), F.col("_x1"), raster.width)).alias("col"))
    part = lambda lo, hi, k: F.greatest(F.least(F.col(hi), F.col(k) + 1) - F.greatest(F.col(lo), F.col(k)), F.lit(0.0))
    share = part("_x0", "_x1", "col") * part("_y0", "_y1", "row")
    area = box_area(F.lit(c0), f0 + F.col("row") * e, F.lit(c0 + a), f0 + (F.col("row") + 1) * e) if geodesic else F.lit(abs(a * e))
    ready = touched.select(*own, "rf", "row", "col", share.alias("c"), area.alias("w")).where("c > 0")
    return ready.join(mask_bands(pixels.select("row", "col", *bands), bands, raster.nodata), ["row", "col"])


def sorted_ends(p: Column, q: Column) -> tuple[Column, Column]:
    return F.least(p, q), F.greatest(p, q)


def valid_share(valid: Column) -> Column:
    """Of a cell the share that is inside the raster and has data."""
    return F.sum(F.when(valid, F.col("c")).otherwise(0.0)) / F.sum("c") * F.first("rf")


def overlay(covered: DataFrame, keys: list[str], band: str, method: str, *, geodesic: bool = True, threshold: float = 0.0, decimals: int | None = None, bins: Bins | None = None, cell_area: Column | None = None) -> DataFrame:
    """One row a cell; ``threshold`` is the least valid share of a cell, which the total of ``mass_preserve`` ignores."""
    v, c, w = F.col(band), F.col("c"), F.col("w")
    valid = v.isNotNull()
    cells = covered.groupBy(*keys)
    if method == "weighted":
        weight = c * w if geodesic else c
        value = F.sum(weight * v) / F.sum(F.when(valid, weight))
    elif method == "mass_preserve":
        value = F.sum(c * v)
    elif method == "density_preserve":
        value = F.sum(c * v * w)
    elif method == "list":
        out = F.transform(F.array_sort(F.collect_list(v)), lambda x: F.bround(x, decimals)) if decimals is not None else F.array_sort(F.collect_list(v))
        value = F.when(F.size(out) > 0, out)
    elif method == "histogram":
        # A touched pixel counts as one, whatever its share; by area it counts as what is covered of it.
        spec = bins or Bins()
        made = histogram(covered, keys, band, spec, weight=c * w if spec.weight == "area" else None, cell_area=cell_area, decimals=decimals)
        if threshold <= 0:
            return made
        shares = cells.agg(valid_share(valid).alias("_vf"))
        return made.join(shares, keys).select(*keys, F.when(F.col("_vf") >= threshold, F.col(band)).alias(band))
    elif method in ("mode", "fractions"):
        by_value = covered.groupBy(*keys, v.alias("v")).agg(F.sum("c").alias("c"), F.first("rf").alias("rf"))
        there = F.col("v").isNotNull()
        enough = valid_share(there) >= threshold
        if method == "mode":
            # Shares to nine decimals, so that the order of summing does not decide ties.
            best = F.max(F.when(there, F.struct(F.round("c", 9).alias("c"), "v")))["v"]
            return by_value.groupBy(*keys).agg(F.when(enough, best).alias(band))
        pairs = F.sort_array(F.collect_list(F.when(there, F.struct(F.col("v").cast("long").alias("v"), "c"))))
        out = by_value.groupBy(*keys).agg(pairs.alias("p"), (F.first("rf") / F.sum("c")).alias("scale"), enough.alias("enough"))
        each = lambda x: F.bround(x["c"] * F.col("scale"), decimals) if decimals is not None else x["c"] * F.col("scale")
        return out.select(*keys, F.when((F.size("p") > 0) & F.col("enough"), F.struct(F.transform("p", lambda x: x["v"]).alias("classes"), F.transform("p", each).alias("fractions"))).alias(band))
    else:
        raise ValueError(f"unknown method {method!r}")
    if method in SUMS or threshold <= 0:
        return cells.agg(value.alias(band))
    return cells.agg(F.when(valid_share(valid) >= threshold, value).alias(band))


def apply_overlay_policy(cells: DataFrame, bands: tuple[str, ...], policy: str, fill: float | None = None) -> DataFrame:
    """Cells where any band has nothing: ``omit`` drops them; ``emit`` gives numbers the fill (NaN if there is none) and lists and structs null."""
    policy = policy.lower()
    if policy not in ("omit", "emit"):
        raise ValueError(f"nodata policy must be omit or emit, not {policy!r}")
    if policy == "omit":
        return cells.dropna(how="any", subset=list(bands))
    some = F.lit(False)
    for b in bands:
        some = some | F.col(b).isNull()
    plain = {b: cells.schema[b].dataType.typeName() == "double" for b in bands}
    value = lambda b: F.lit(float("nan") if fill is None else float(fill)) if plain[b] else F.lit(None).cast(cells.schema[b].dataType)
    return cells.withColumns({b: F.when(some, value(b)).otherwise(F.col(b)) for b in bands})
