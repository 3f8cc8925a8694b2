"""Histograms per cell: distinct values, explicit edges or equal widths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the weight field by (weight, normalisation).
FIELDS = {("count", None): "counts", ("count", "valid"): "count_frac", ("area", None): "area", ("area", "valid"): "area_frac", ("area", "cell"): "area_share"}


@dataclass(frozen=True)
class Bins:
    """``edges``: half-open bins, the last one closed; ``width`` and ``origin``: bins without end; neither: values."""

    edges: tuple[float, ...] | None = None
    width: float | None = None
    origin: float = 0.0
    weight: str = "count"
    normalize: str | None = None

    def __post_init__(self):
        if self.edges is not None and self.width is not None:
            raise ValueError("edges and width exclude each other")
        if self.edges is not None and (len(self.edges) < 2 or any(a >= b for a, b in zip(self.edges, self.edges[1:]))):
            raise ValueError("edges must ascend")
        if self.width is not None and not self.width > 0:
            raise ValueError("width must be positive")
        if (self.weight, self.normalize) not in FIELDS:
            raise ValueError(f"weight {self.weight} cannot be normalised by {self.normalize}")

    @property
    def field(self) -> str:
        return FIELDS[self.weight, self.normalize]

    def limits(self, value: Column) -> tuple[Column, Column]:
        """Left and right end of a value's bin; null outside all bins."""
        if self.width is not None:
            k = F.floor((value - self.origin) / self.width)
            left = F.lit(self.origin) + k * F.lit(self.width)
            return left, left + F.lit(self.width)
        left = right = F.lit(None).cast("double")
        last = len(self.edges) - 2
        for i in range(last, -1, -1):
            a, b = float(self.edges[i]), float(self.edges[i + 1])
            inside = (value >= a) & ((value <= b) if i == last else (value < b))
            left, right = F.when(inside, F.lit(a)).otherwise(left), F.when(inside, F.lit(b)).otherwise(right)
        return left, right


def histogram(df: DataFrame, keys: list[str], band: str, bins: Bins, *, weight: Column | None = None, cell_area: Column | None = None, decimals: int | None = None) -> DataFrame:
    """One row a cell with a struct of arrays in the order of values or bins; cells without values have null.

    Weights are summed per cell and bin before cells are put together, so a cell
    holds one entry a bin.  ``valid`` divides by all valid weight, that outside
    the bins included; ``cell`` by the cell's area.
    """
    w = F.lit(1.0) if weight is None else weight
    value = F.bround(F.col(band), decimals) if decimals is not None and bins.edges is None and bins.width is None else F.col(band)
    rows = df.select(*keys, value.alias("v"), F.when(F.col(band).isNotNull(), w).alias("w"))
    total = F.sum("w").alias("all")
    if bins.edges is None and bins.width is None:
        binned = rows.groupBy(*keys, "v").agg(total).withColumnRenamed("v", "a").withColumn("b", F.col("a"))
    else:
        left, right = bins.limits(F.col("v"))
        binned = rows.select(*keys, left.alias("a"), right.alias("b"), "w").groupBy(*keys, "a", "b").agg(total)
    entry = F.sort_array(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "b", F.col("all").alias("w")))))
    cells = binned.groupBy(*keys).agg(entry.alias("h"), F.sum("all").alias("valid"))
    scale = {None: F.lit(1.0), "valid": F.col("valid"), "cell": cell_area}[bins.normalize]
    if bins.weight == "count" and bins.normalize is None:
        weights = F.transform("h", lambda x: x["w"].cast("long"))
    else:
        weights = F.transform("h", lambda x: F.bround(x["w"] / scale, decimals) if decimals is not None else x["w"] / scale)
    values = F.transform("h", lambda x: x["a"])
    if bins.edges is None and bins.width is None:
        out = F.struct(values.alias("values"), weights.alias(bins.field))
    else:
        out = F.struct(values.alias("left"), F.transform("h", lambda x: x["b"]).alias("right"), weights.alias(bins.field))
    return cells.select(*keys, F.when((F.size("h") > 0) & (scale > 0), out).alias(band))
