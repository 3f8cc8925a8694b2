"""Cell tables as Hive-partitioned Parquet, with or without geometry."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmosaic.operators.grids import Faces, Lattice, let


def _hex(x: Column) -> Column:
    """A double's eight bytes, the lowest first, as hexadecimal digits."""
    return let(F.lpad(F.hex(_bits(x)), 16, "0"), lambda h: F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)]))


def wkb_polygon(corners: Column) -> Column:
    """Well-known binary of one ring of structs (lon, lat), little-endian, with built-in functions."""
    head = F.lit(struct.pack("<BII", 1, 3, 1))

    def ring(c: Column) -> Column:
        body = F.unhex(F.array_join(F.transform(c, lambda p: F.concat(_hex(p["lon"]), _hex(p["lat"]))), ""))
        size = F.unhex(F.concat(F.lpad(F.hex(F.size(c).cast("long")), 2, "0"), F.lit("000000")))
        return F.concat(head, size, body)

    return let(corners, ring)


def wkb_point(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit(struct.pack("<BI", 1, 1)), F.unhex(F.concat(_hex(lon), _hex(lat))))


def _bits(x: Column) -> Column:
    """The bits of a double as a long, from its sign, exponent and fraction."""

    def exponent(v: Column) -> Column:
        a = F.abs(v)
        guess = F.floor(F.log2(a))
        return let(guess, lambda e: F.when(a / F.pow(F.lit(2.0), e) >= 2, e + 1).when(a / F.pow(F.lit(2.0), e) < 1, e - 1).otherwise(e))

    def whole(v: Column, e: Column) -> Column:
        fraction = ((F.abs(v) / F.pow(F.lit(2.0), e) - 1) * float(1 << 52)).cast("long")
        return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.shiftleft((e + 1023).cast("long"), 52).bitwiseOR(fraction))

    def signed(v: Column) -> Column:
        return let(let(exponent(v), lambda e: whole(v, e)), lambda m: F.when(v < 0, m.bitwiseOR(F.lit(-(1 << 63)))).otherwise(m))

    return let(x, signed)


def with_geometry(cells: DataFrame, grid: Lattice | Faces, res: int, kind: str = "polygon") -> DataFrame:
    """Adds ``geometry`` as WKB of the cell's outline or centre."""
    cell = F.col(grid.index_column(res))
    if kind == "polygon":
        return cells.withColumn("geometry", wkb_polygon(grid.polygon(cell, res)))
    x, y = grid.center(cell, res)
    return cells.withColumn("geometry", wkb_point(x, y))


def write_cells(cells: DataFrame, path: str, partition: str, *, compression: str = "snappy", overwrite: bool = False) -> None:
    """Partitioned by the parent cell.  Rows are brought together by parent and large parents are split, so that files are neither many nor huge."""
    tidy = cells.hint("rebalance", partition)
    tidy.write.mode("overwrite" if overwrite else "append").option("compression", compression).partitionBy(partition).parquet(path)
