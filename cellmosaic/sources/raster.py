"""Rasters as pixel tables: one row per pixel, plus a small description.

A pixel table has ``row``, ``col`` and a column per band; reading it is a plain
Parquet scan, so column pruning and filters reach the files.  Windows do not
exist: a shuffle on the cell replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Raster:
    """The affine map (a, b, c, d, e, f), size, reference system, nodata value and bands of a pixel table."""

    width: int
    height: int
    affine: tuple[float, float, float, float, float, float]
    bands: tuple[str, ...]
    crs: str = "EPSG:4326"
    nodata: float | None = None
    dtypes: dict[str, str] = field(default_factory=dict)

    def centre(self, row: Column | None = None, col: Column | None = None) -> tuple[Column, Column]:
        """x and y of pixel centres."""
        a, b, c, d, e, f = self.affine
        i, j = (F.col("row") if row is None else row) + 0.5, (F.col("col") if col is None else col) + 0.5
        return F.lit(c) + j * a + i * b, F.lit(f) + j * d + i * e

    def fractional(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Fractional row and col of a place; whole numbers are pixel centres."""
        a, b, c, d, e, f = self.affine
        det = a * e - b * d
        if det == 0:
            raise ValueError("the affine map cannot be inverted")
        dx, dy = x - c, y - f
        return (dx * (-d / det) + dy * (a / det)) - 0.5, (dx * (e / det) + dy * (-b / det)) - 0.5

    def bounds(self) -> tuple[float, float, float, float]:
        a, b, c, d, e, f = self.affine
        xs = [c + j * a + i * b for i in (0, self.height) for j in (0, self.width)]
        ys = [f + j * d + i * e for i in (0, self.height) for j in (0, self.width)]
        return min(xs), min(ys), max(xs), max(ys)


def read(spark: SparkSession, path: str, bands: tuple[str, ...] | list[str], keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Only the wanted columns of a pixel table; any path that Spark reads."""
    return spark.read.parquet(path).select(*keys, *bands)


def select_bands(raster: Raster, wanted: list[str | int] | None) -> tuple[str, ...]:
    """Bands by label or 1-based number, each once, in the order asked for."""
    if not wanted:
        return raster.bands
    found: list[str] = []
    for w in wanted:
        if isinstance(w, int) or str(w).isdigit():
            number = int(w)
            if not 1 <= number <= len(raster.bands):
                raise ValueError(f"band {number} is not among 1..{len(raster.bands)}")
            name = raster.bands[number - 1]
        elif w in raster.bands:
            name = w
        else:
            raise ValueError(f"no band is named {w!r}")
        if name not in found:
            found.append(name)
    return tuple(found)


def masked(band: Column, nodata: float | None) -> Column:
    """The band as a double in which NaN and the nodata value are null."""
    value = band.cast("double")
    gone = F.isnan(value)
    if nodata is not None and nodata == nodata:
        gone = gone | (value == F.lit(float(nodata)))
    return F.when(~gone, value)


def mask_bands(pixels: DataFrame, bands: tuple[str, ...], nodata: float | None) -> DataFrame:
    return pixels.withColumns({b: masked(F.col(b), nodata) for b in bands})


def apply_policy(df: DataFrame, bands: tuple[str, ...], policy: str, *, missing: str, fill: float | None) -> DataFrame:
    """Rows without data: ``omit`` drops them, ``emit`` keeps them with ``fill``.

    ``missing`` says when a row counts as one: if "all" bands are null (points)
    or if "any" is (samples and overlays, where all bands then get the fill).
    """
    policy = policy.lower()
    if policy not in ("omit", "emit"):
        raise ValueError(f"nodata policy must be omit or emit, not {policy!r}")
    if policy == "omit":
        return df.dropna(how=missing, subset=list(bands))
    if missing == "all":
        return df if fill is None else df.fillna(float(fill), subset=list(bands))
    some = F.lit(False)
    for b in bands:
        some = some | F.col(b).isNull()
    return df.withColumns({b: F.when(some, F.lit(fill).cast("double")).otherwise(F.col(b)) for b in bands})
