"""The settings of an indexing run and their checks."""

from __future__ import annotations

from dataclasses import dataclass

from cellmosaic.functions.aggregates import NAMES
from cellmosaic.functions.histograms import Bins
from cellmosaic.operators.grids import Grid, ellipsoid_box, grid
from cellmosaic.operators.overlay import METHODS
from cellmosaic.operators.sampling import STENCILS
from cellmosaic.sources.raster import Raster

MODES = ("smaller-than-pixel", "larger-than-pixel", "min-diff")


@dataclass(frozen=True)
class IndexConfig:
    dggs: str
    resolution: int | str
    parent_res: int | None = None
    point: str | None = None
    sample: str | None = None
    overlay: str | None = None
    aggs: tuple[str, ...] = ("mean",)
    nodata: str = "omit"
    nodata_fill: float | None = None
    threshold: float = 0.0
    bins: Bins | None = None
    decimals: int | None = 1
    compact: bool = False
    cell_id: str = "string"

    def __post_init__(self):
        chosen = [x for x in (self.point, self.sample, self.overlay) if x]
        if len(chosen) > 1:
            raise ValueError("point, sample and overlay exclude each other")
        if self.sample and self.sample not in STENCILS:
            raise ValueError(f"unknown interpolation {self.sample!r}")
        if self.overlay and self.overlay not in (*METHODS, "histogram"):
            raise ValueError(f"unknown overlay {self.overlay!r}")
        if self.point and self.point not in ("value", "list", "histogram"):
            raise ValueError(f"unknown point output {self.point!r}")
        if any(a not in NAMES for a in self.aggs):
            raise ValueError(f"aggregates are {', '.join(NAMES)}")
        if self.nodata.lower() not in ("omit", "emit"):
            raise ValueError("nodata must be omit or emit")
        if not 0 <= self.threshold <= 1:
            raise ValueError("the valid share is between 0 and 1")
        if self.bins and self.bins.weight == "area" and self.overlay != "histogram":
            raise ValueError("area weights need an overlay histogram")
        if self.cell_id == "uint64" and self.grid.text_ids:
            raise ValueError(f"{self.dggs} has text ids only")
        if isinstance(self.resolution, str) and self.resolution not in MODES:
            raise ValueError(f"the resolution is a number or one of {', '.join(MODES)}")
        if isinstance(self.resolution, int):
            self.grid.check(self.resolution, self.parent(self.resolution))

    @property
    def grid(self) -> Grid:
        return grid(self.dggs)

    def parent(self, res: int) -> int:
        return self.grid.default_parent(res) if self.parent_res is None else self.parent_res


def pixel_area(raster: Raster) -> tuple[float, float]:
    """The mean area on the ellipsoid of a pixel of a raster in degrees, and the latitude of its centre."""
    w, s, e, n = raster.bounds()
    return ellipsoid_box(e - w, s, n) / (raster.width * raster.height), (s + n) / 2


def choose_resolution(g: Grid, area: float, lat: float, mode: str) -> int:
    """The resolution whose cells are just smaller or larger than ``area``, or nearest to it; without one, the coarsest."""
    sizes = [(r, g.area_at(r, lat)) for r in range(g.low, g.high + 1)]
    if mode == "smaller-than-pixel":
        return next((r for r, a in sizes if a <= area), g.low)
    if mode == "larger-than-pixel":
        return max((r for r, a in sizes if a >= area), default=g.low)
    if mode == "min-diff":
        return min(sizes, key=lambda x: abs(x[1] - area))[0]
    raise ValueError(f"unknown mode {mode!r}")
