"""Runs a setting over a pixel table: one lazy plan, and its written result.

    python -m cellmosaic geohash 6 pixels.parquet out --width 64 --height 512 --affine 0.015625 0 174 0 -0.001953125 -36
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cellmosaic.functions import aggregates, histograms
from cellmosaic.operators import compaction, overlay, points, sampling
from cellmosaic.operators.grids import Lattice, parent
from cellmosaic.plans.config import MODES, IndexConfig, choose_resolution, pixel_area
from cellmosaic.sources.raster import Raster, apply_policy, mask_bands, read, select_bands
from cellmosaic.sources.sinks import with_geometry, write_cells


def resolution(cfg: IndexConfig, raster: Raster) -> int:
    """The number that was given, or that of the mode for this raster's pixels."""
    if isinstance(cfg.resolution, int):
        return cfg.resolution
    area, lat = pixel_area(raster)
    res = choose_resolution(cfg.grid, area, lat, cfg.resolution)
    cfg.grid.check(res, cfg.parent(res))
    return res


def plan(spark: SparkSession, cfg: IndexConfig, pixels: DataFrame, raster: Raster, bands: tuple[str, ...] | None = None, *, seen: Observation | None = None) -> DataFrame:
    """(parent, cell, bands) of a pixel table (row, col, bands); ``seen`` counts pixels read and rows indexed of point runs."""
    if raster.crs != "EPSG:4326":
        raise ValueError(f"rasters are in degrees (EPSG:4326), not {raster.crs}")
    wanted, res = bands or raster.bands, resolution(cfg, raster)
    up = cfg.parent(res)
    made = _sampled if cfg.sample else _overlaid if cfg.overlay else _points
    out = made(spark, cfg, pixels, raster, wanted, res, up, seen)
    return compaction.compact(out, cfg.grid, res, up, wanted) if cfg.compact else out


def _points(spark: SparkSession, cfg: IndexConfig, pixels: DataFrame, raster: Raster, bands: tuple[str, ...], res: int, up: int, seen: Observation | None) -> DataFrame:
    lon, lat = raster.centre()
    rows = mask_bands(pixels.select("row", "col", *bands), bands, raster.nodata)
    if seen is not None:
        some = F.greatest(*[F.col(b).isNotNull() for b in bands]) if len(bands) > 1 else F.col(bands[0]).isNotNull()
        kept = F.lit(True) if cfg.nodata.lower() == "emit" else some
        rows = rows.observe(seen, F.count(F.lit(1)).alias("pixels_read"), F.count_if(kept).alias("rows_indexed"))
    fill = raster.nodata if cfg.nodata_fill is None else cfg.nodata_fill
    clean = apply_policy(rows, bands, cfg.nodata, missing="all", fill=fill)
    cells = points.assign(clean, cfg.grid, res, up, lon, lat, keep=bands)
    keys = [cfg.grid.index_column(up), cfg.grid.index_column(res)]
    if cfg.point == "list":
        return aggregates.lists(cells, keys, bands, cfg.decimals)
    if cfg.point == "histogram":
        return _joined([histograms.histogram(cells, keys, b, cfg.bins or histograms.Bins(), decimals=cfg.decimals) for b in bands], keys)
    return aggregates.by_cell(cells, keys, bands, cfg.aggs, cfg.decimals)


def _sampled(spark: SparkSession, cfg: IndexConfig, pixels: DataFrame, raster: Raster, bands: tuple[str, ...], res: int, up: int, seen: Observation | None) -> DataFrame:
    cells = cfg.grid.cells_in_box(spark, res, *raster.bounds()).select("cell", "lon", "lat")
    out = sampling.sample(cells, pixels, raster, bands, cfg.sample, policy=cfg.nodata, fill=cfg.nodata_fill)
    return _keyed(out, cfg, res, up, [aggregates.rounded(F.col(b), cfg.decimals).alias(b) for b in bands])


def _overlaid(spark: SparkSession, cfg: IndexConfig, pixels: DataFrame, raster: Raster, bands: tuple[str, ...], res: int, up: int, seen: Observation | None) -> DataFrame:
    g = cfg.grid
    if not isinstance(g, Lattice):
        raise ValueError(f"overlays need cells that are boxes, which those of {g.name} are not")
    cells = g.cells_touching_box(spark, res, *raster.bounds())
    covered = overlay.coverage(cells, g, res, raster, pixels, bands)
    nested = cfg.overlay in ("list", "fractions", "histogram")
    area = g.area(F.col("cell"), res)
    if cfg.bins and cfg.bins.normalize == "cell":
        covered = covered.withColumn("_area", area)
    keys = ["cell", "_area"] if "_area" in covered.columns else ["cell"]
    each = [overlay.overlay(covered, keys, b, cfg.overlay, threshold=cfg.threshold, decimals=cfg.decimals if nested else None, bins=cfg.bins, cell_area=F.col("_area") if len(keys) > 1 else None) for b in bands]
    out = overlay.apply_overlay_policy(_joined(each, keys), bands, cfg.nodata, cfg.nodata_fill)
    return _keyed(out, cfg, res, up, [F.col(b) if nested else aggregates.rounded(F.col(b), cfg.decimals).alias(b) for b in bands])


def _joined(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys)
    return out


def _keyed(cells: DataFrame, cfg: IndexConfig, res: int, up: int, bands: list[Column]) -> DataFrame:
    g = cfg.grid
    return cells.select(parent(g, F.col("cell"), res, up).alias(g.index_column(up)), F.col("cell").alias(g.index_column(res)), *bands)


def finished(cells: DataFrame, cfg: IndexConfig, res: int, geometry: str | None = None) -> DataFrame:
    """With outlines or centres, then ids as text or as unsigned numbers."""
    g = cfg.grid
    if geometry and cfg.compact:
        raise ValueError("compacted cells have several resolutions, so they get no geometry")
    out = with_geometry(cells, g, res, geometry) if geometry else cells
    ids = [g.index_column(cfg.parent(res)), g.index_column(res)]
    if g.text_ids:
        return out
    unsigned = lambda c: F.conv(F.hex(c), 16, 10).cast("decimal(20,0)")
    shown = unsigned if cfg.cell_id == "uint64" else g.text
    # Ids of the parent are text always, as they become folder names.
    return out.withColumns({ids[0]: g.text(F.col(ids[0])), ids[1]: shown(F.col(ids[1]))})


def index(spark: SparkSession, cfg: IndexConfig, source: str | DataFrame, raster: Raster, out: str, *, bands: list[str | int] | None = None, geometry: str | None = None, compression: str = "snappy", overwrite: bool = False) -> dict[str, float]:
    """Writes the cells of a pixel table; gives seconds and, for point runs, pixels read and rows indexed."""
    began, wanted = time.time(), select_bands(raster, bands)
    pixels = read(spark, source, wanted) if isinstance(source, str) else source
    counted = Observation() if not (cfg.sample or cfg.overlay) else None
    res = resolution(cfg, raster)
    cells = finished(plan(spark, cfg, pixels, raster, wanted, seen=counted), cfg, res, geometry)
    planned = time.time()
    write_cells(cells, out, cfg.grid.index_column(cfg.parent(res)), compression=compression, overwrite=overwrite)
    report = {"resolution": res, "plan_seconds": planned - began, "write_seconds": time.time() - planned}
    return report | (counted.get if counted is not None else {})


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("cellmosaic", description="Pixel tables to tables of grid cells.")
    add = p.add_argument
    add("dggs"), add("resolution", help=f"a number or one of {', '.join(MODES)}"), add("source"), add("out")
    add("--width", type=int, required=True), add("--height", type=int, required=True)
    add("--affine", type=float, nargs=6, required=True, metavar=tuple("abcdef"))
    add("--labels", nargs="+", default=["band_1"], help="all bands of the raster, in order")
    add("--raster-nodata", type=float), add("--crs", default="EPSG:4326")
    add("-pr", "--parent-res", type=int), add("-b", "--band", action="append")
    kind = p.add_mutually_exclusive_group()
    kind.add_argument("--point", choices=("value", "list", "histogram")), kind.add_argument("--sample", choices=tuple(sampling.STENCILS))
    kind.add_argument("--overlay", choices=(*overlay.METHODS, "histogram"))
    add("--agg", action="append", choices=aggregates.NAMES)
    add("--nodata", default="omit", type=str.lower, choices=("omit", "emit")), add("--nodata-fill", type=float)
    add("-vct", "--valid-coverage-threshold", type=float, default=0.0)
    add("--hist-bins", type=lambda s: tuple(float(x) for x in s.split(","))), add("--hist-width", type=float), add("--hist-origin", type=float, default=0.0)
    add("--hist-weight", choices=("count", "area"), default="count"), add("--hist-normalize", choices=("valid", "cell"))
    add("-d", "--decimals", default=1, type=lambda s: None if s == "none" else int(s))
    add("--compression", default="snappy"), add("--overwrite", action="store_true"), add("--compact", action="store_true")
    add("--geo", choices=("point", "polygon")), add("--cell-id", choices=("string", "uint64"), default="string")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, float]:
    a = arguments().parse_args(argv)
    hist = a.hist_bins or a.hist_width or a.hist_weight != "count" or a.hist_normalize
    bins = histograms.Bins(a.hist_bins, a.hist_width, a.hist_origin, a.hist_weight, a.hist_normalize) if hist else None
    res = int(a.resolution) if a.resolution.isdigit() else a.resolution
    cfg = IndexConfig(a.dggs, res, a.parent_res, a.point, a.sample, a.overlay, tuple(a.agg or ("mean",)), a.nodata, a.nodata_fill, a.valid_coverage_threshold, bins, a.decimals, a.compact, a.cell_id)
    raster = Raster(a.width, a.height, tuple(a.affine), tuple(a.labels), a.crs, a.raster_nodata)
    session = spark or SparkSession.builder.appName("cellmosaic").getOrCreate()
    report = index(session, cfg, a.source, raster, a.out, bands=a.band, geometry=a.geo, compression=a.compression, overwrite=a.overwrite)
    print(" ".join(f"{k}={v:.3f}" if isinstance(v, float) else f"{k}={v}" for k, v in report.items()))
    return report
