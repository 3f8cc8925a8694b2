"""Discrete global grids as columns.

A grid turns lon and lat into cell ids, ids into parents, centres, boundaries and
areas, and lists the cells of a box.  Geohash, Maidenhead, S2, HEALPix and
rHEALPix are written with built-in functions only, so assignment stays inside generated code.
Ids are longs (bit patterns of unsigned ones) or strings.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_000.0
_A, _F = 6_378_137.0, 1 / 298.257223563
_E2 = _F * (2 - _F)
_B = _A * (1 - _F)


def zone_area(lat: Column) -> Column:
    """Area on the ellipsoid from the equator to a latitude, per radian of longitude."""
    e = math.sqrt(_E2)
    s = F.sin(F.radians(lat))
    return F.lit(_B * _B / 2) * (s / (1 - _E2 * s * s) + F.atanh(F.lit(e) * s) / e)


def box_area(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Area in square metres of a box of degrees on the ellipsoid."""
    return F.abs(zone_area(north) - zone_area(south)) * F.radians(F.abs(east - west))


def ellipsoid_box(width: float, south: float, north: float) -> float:
    """The same of a box that is ``width`` degrees wide, as a number."""
    e = math.sqrt(_E2)

    def zone(lat: float) -> float:
        s = math.sin(math.radians(lat))
        return _B * _B / 2 * (s / (1 - _E2 * s * s) + math.atanh(e * s) / e)

    return abs(zone(north) - zone(south)) * math.radians(width)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is named; keeps generated code small."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def record(**fields: Column) -> Column:
    """A struct whose names hold inside aggregates too, where those of aliases are cleared away."""
    return F.named_struct(*[c for name, value in fields.items() for c in (F.lit(name), value)])


def power(base: int, exponent: int) -> float:
    return float(base**exponent)


@dataclass(frozen=True)
class Grid:
    name: str
    low: int
    high: int
    offset: int
    text_ids: bool

    def index_column(self, res: int) -> str:
        return f"{self.name}_{res:0{len(str(self.high))}d}"

    def default_parent(self, res: int) -> int:
        return max(self.low, res - self.offset)

    def check(self, res: int, parent: int) -> None:
        if not self.low <= res <= self.high:
            raise ValueError(f"{self.name} has resolutions {self.low} to {self.high}")
        if not self.low <= parent < res:
            raise ValueError(f"the parent resolution {parent} must be below {res}")

    def text(self, cell: Column) -> Column:
        return cell

    def assign(self, lon: Column, lat: Column, res: int) -> Column:
        raise NotImplementedError

    def parent(self, cell: Column, res: int) -> Column:
        raise NotImplementedError


class Lattice(Grid):
    """Grids whose cells are boxes of equal steps in degrees: a cell is a pair (ix, iy)."""

    def steps(self, res: int) -> tuple[int, int]:
        """Cells around the globe and from pole to pole."""
        raise NotImplementedError

    def encode(self, ix: Column, iy: Column, res: int) -> Column:
        raise NotImplementedError

    def place(self, cell: Column, res: int) -> tuple[Column, Column]:
        """ix and iy of a cell."""
        raise NotImplementedError

    def indices(self, lon: Column, lat: Column, res: int) -> tuple[Column, Column]:
        nx, ny = self.steps(res)
        at = lambda v, span, n: F.least(F.greatest(F.floor((v + span / 2) * n / span), F.lit(0)), F.lit(n - 1)).cast("long")
        return at(lon, 360.0, nx), at(lat, 180.0, ny)

    def assign(self, lon: Column, lat: Column, res: int) -> Column:
        return self.encode(*self.indices(lon, lat, res), res)

    def box(self, cell: Column, res: int, place: tuple[Column, Column] | None = None) -> tuple[Column, Column, Column, Column]:
        """West, south, east and north of a cell, whose place may be known."""
        (nx, ny), (ix, iy) = self.steps(res), place or self.place(cell, res)
        return ix * 360.0 / nx - 180.0, iy * 180.0 / ny - 90.0, (ix + 1) * 360.0 / nx - 180.0, (iy + 1) * 180.0 / ny - 90.0

    def center(self, cell: Column, res: int) -> tuple[Column, Column]:
        (nx, ny), (ix, iy) = self.steps(res), self.place(cell, res)
        return (ix + 0.5) * 360.0 / nx - 180.0, (iy + 0.5) * 180.0 / ny - 90.0

    def area(self, cell: Column, res: int) -> Column:
        return box_area(*self.box(cell, res))

    def area_at(self, res: int, lat: float) -> float:
        nx, ny = self.steps(res)
        row = min(ny - 1, max(0, math.floor((lat + 90) * ny / 180)))
        return ellipsoid_box(360 / nx, row * 180 / ny - 90, (row + 1) * 180 / ny - 90)

    def cells_in_box(self, spark: SparkSession, res: int, west: float, south: float, east: float, north: float) -> DataFrame:
        """(cell, ix, iy, lon, lat) of all cells whose centre is in the closed box; rows of the lattice are made in parallel."""
        nx, ny = self.steps(res)
        first = lambda v, span, n: math.ceil((v + span / 2) * n / span - 0.5)
        last = lambda v, span, n: math.floor((v + span / 2) * n / span - 0.5)
        x0, x1 = max(0, first(west, 360, nx)), min(nx - 1, last(east, 360, nx))
        y0, y1 = max(0, first(south, 180, ny)), min(ny - 1, last(north, 180, ny))
        lines = spark.range(y0, max(y0, y1 + 1)).withColumnRenamed("id", "iy")
        wide = F.explode(F.sequence(F.lit(x0).cast("long"), F.lit(x1).cast("long"))) if x1 >= x0 else F.explode(F.array().cast("array<bigint>"))
        both = lines.select(wide.alias("ix"), "iy")
        return both.select(self.encode(F.col("ix"), F.col("iy"), res).alias("cell"), "ix", "iy", ((F.col("ix") + 0.5) * 360.0 / nx - 180.0).alias("lon"), ((F.col("iy") + 0.5) * 180.0 / ny - 90.0).alias("lat"))

    def cells_touching_box(self, spark: SparkSession, res: int, west: float, south: float, east: float, north: float) -> DataFrame:
        """(cell, ix, iy) of all cells that share area with the box, wherever their centre is."""
        nx, ny = self.steps(res)
        x0, x1 = max(0, math.floor((west + 180) * nx / 360)), min(nx - 1, math.ceil((east + 180) * nx / 360) - 1)
        y0, y1 = max(0, math.floor((south + 90) * ny / 180)), min(ny - 1, math.ceil((north + 90) * ny / 180) - 1)
        lines = spark.range(y0, max(y0, y1 + 1)).withColumnRenamed("id", "iy")
        wide = F.explode(F.sequence(F.lit(x0).cast("long"), F.lit(x1).cast("long"))) if x1 >= x0 else F.explode(F.array().cast("array<bigint>"))
        return lines.select(wide.alias("ix"), "iy").select(self.encode(F.col("ix"), F.col("iy"), res).alias("cell"), "ix", "iy")

    def polygon(self, cell: Column, res: int) -> Column:
        w, s, e, n = self.box(cell, res)
        return F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])


#: The digits of geohashes (fixed values).
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


class Geohash(Lattice):
    def __init__(self):
        super().__init__("geohash", 1, 12, 4, True)

    def steps(self, res: int) -> tuple[int, int]:
        return 1 << -(-5 * res // 2), 1 << (5 * res // 2)

    def encode(self, ix: Column, iy: Column, res: int) -> Column:
        bits = 5 * res
        nx = -(-bits // 2)
        out = []
        for c in range(res):
            digit = F.lit(0).cast("long")
            for k in range(5):
                at = 5 * c + k  # even bits from the left are of the longitude
                source, index = (ix, nx - 1 - at // 2) if at % 2 == 0 else (iy, bits // 2 - 1 - at // 2)
                digit = digit + F.shiftleft(F.shiftright(source, index).bitwiseAND(F.lit(1).cast("long")), 4 - k)
            out.append(F.substring(F.lit(_BASE32), (digit + 1).cast("int"), F.lit(1)))
        return F.concat(*out)

    def place(self, cell: Column, res: int) -> tuple[Column, Column]:
        ix = iy = F.lit(0).cast("long")
        for c in range(res):
            digit = (F.instr(F.lit(_BASE32), F.substring(cell, c + 1, 1)) - 1).cast("long")
            for k in range(5):
                bit = F.shiftright(digit, 4 - k).bitwiseAND(F.lit(1).cast("long"))
                if (5 * c + k) % 2 == 0:
                    ix = ix * 2 + bit
                else:
                    iy = iy * 2 + bit
        return ix, iy

    def parent(self, cell: Column, res: int) -> Column:
        return F.substring(cell, 1, res)

    def children(self, parent: int, res: int) -> float:
        return power(32, res - parent)


class Maidenhead(Lattice):
    """Pairs of letters and digits: fields of 20 by 10 degrees, then tenths and 24ths in turn."""

    _PARTS = (18, 10, 24, 10, 24, 10)

    def __init__(self):
        super().__init__("maidenhead", 1, 6, 3, True)

    def steps(self, res: int) -> tuple[int, int]:
        n = math.prod(self._PARTS[:res])
        return n, n

    def encode(self, ix: Column, iy: Column, res: int) -> Column:
        out = []
        for level in range(res):
            below = math.prod(self._PARTS[level + 1 : res])
            base = 48 if level % 2 else 65 if level == 0 else 97
            out += [F.char((F.floor(v / below) % self._PARTS[level] + base).cast("int")) for v in (ix, iy)]
        return F.concat(*out)

    def place(self, cell: Column, res: int) -> tuple[Column, Column]:
        ix = iy = F.lit(0).cast("long")
        for level in range(res):
            base = 48 if level % 2 else 65 if level == 0 else 97
            x, y = (F.ascii(F.substring(cell, 2 * level + k, 1)) - base for k in (1, 2))
            ix, iy = ix * self._PARTS[level] + x, iy * self._PARTS[level] + y
        return ix, iy

    def parent(self, cell: Column, res: int) -> Column:
        return F.substring(cell, 1, 2 * res)

    def children(self, parent: int, res: int) -> float:
        return float(math.prod(self._PARTS[parent:res]) ** 2)


class Faces(Grid):
    """Grids of square faces that are cut into ``base`` by ``base`` over and over: a cell is a place (face, x, y)."""

    faces = 6
    base = 2
    #: Cells of resolution r are within ``reach / base**r`` radians of their centre.
    reach = 2.45

    def spot(self, face: Column, u: Column, v: Column) -> Column:
        """(lon, lat) of a place (0 to 1 each way) on a face."""
        raise NotImplementedError

    def place(self, cell: Column, res: int) -> Column:
        """(f, x, y) of a cell."""
        raise NotImplementedError

    def encode(self, face: Column, x: Column, y: Column, res: int) -> Column:
        raise NotImplementedError

    def on(self, place: Column, res: int, dx: float, dy: float) -> Column:
        n = float(self.base**res)
        at = record(f=place["f"], u=(place["x"] + F.lit(dx)) / n, v=(place["y"] + F.lit(dy)) / n)
        return let(at, lambda p: self.spot(p["f"], p["u"], p["v"]))

    def center(self, cell: Column, res: int) -> tuple[Column, Column]:
        at = let(self.place(cell, res), lambda p: self.on(p, res, 0.5, 0.5))
        return at["lon"], at["lat"]

    def polygon(self, cell: Column, res: int) -> Column:
        """The four corners and the first again.  East and west are told from the centre, so outlines over the antimeridian go beyond 180 degrees."""
        corners = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))

        def ring(p: Column, middle: Column) -> Column:
            near = lambda q: record(lon=q["lon"] - 360.0 * F.floor((q["lon"] - middle + 180.0) / 360.0), lat=q["lat"])
            return F.array(*[let(self.on(p, res, dx, dy), near) for dx, dy in corners])

        return let(self.place(cell, res), lambda p: let(self.on(p, res, 0.5, 0.5)["lon"], lambda m: ring(p, m)))

    def children(self, parent: int, res: int) -> float:
        return power(self.base**2, res - parent)

    def area_at(self, res: int, lat: float) -> float:
        return 4 * math.pi * EARTH_RADIUS**2 / (self.faces * self.base ** (2 * res))

    def area(self, cell: Column, res: int) -> Column:
        return F.when(cell.isNotNull(), F.lit(self.area_at(res, 0.0)))

    def cells_in_box(self, spark: SparkSession, res: int, west: float, south: float, east: float, north: float) -> DataFrame:
        """(cell, lon, lat) of all cells whose centre is in the closed box.

        Cells are opened a few levels at a time, and only those near enough to the
        box; so the work follows the number of cells that are found.  Cells of the
        first step are dealt to tasks before they are opened further.
        """
        step = 4 if self.base == 2 else 2
        level = min(step, res)
        n = self.base**level
        number = F.col("id")
        cells = spark.range(self.faces * n * n).select(F.floor(number / (n * n)).cast("long").alias("f"), F.floor(number / n).cast("long").alias("_q"), (number % n).alias("y")).select("f", (F.col("_q") % n).alias("x"), "y")
        near = self._near(cells, level, west, south, east, north)
        if level < res:
            near = near.repartition("f", "x", "y")
        while level < res:
            more = min(step, res - level)
            wide, level = self.base**more, level + more
            inner = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide * wide - 1).cast("long")))
            opened = near.select("f", "x", "y", inner.alias("k"))
            near = self._near(opened.select("f", (F.col("x") * wide + F.floor(F.col("k") / wide)).alias("x"), (F.col("y") * wide + F.col("k") % wide).alias("y")), level, west, south, east, north)
        inside = near.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
        return inside.select(self.encode(F.col("f"), F.col("x"), F.col("y"), res).alias("cell"), "lon", "lat")

    def _near(self, cells: DataFrame, level: int, west: float, south: float, east: float, north: float) -> DataFrame:
        reach = min(self.reach / self.base**level, math.pi)
        pad = math.degrees(reach)

        def within(c: Column) -> Column:
            phi = F.radians(F.abs(c["lat"]))
            side = F.degrees(F.asin(F.least(F.lit(math.sin(min(reach, math.pi / 2))) / F.cos(phi), F.lit(1.0))))
            beside = phi + reach >= math.pi / 2
            for turn in (-360.0, 0.0, 360.0):
                beside = beside | ((c["lon"] + turn >= west - side) & (c["lon"] + turn <= east + side))
            return c["lat"].between(south - pad, north + pad) & beside

        at = cells.select("f", "x", "y", self.on(F.struct("f", "x", "y"), level, 0.5, 0.5).alias("c"))
        return at.where(let(F.col("c"), within)).select("f", "x", "y", F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"))


def wrapped(lon: Column) -> Column:
    """Degrees from -180 on, below 180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


class S2(Faces):
    """Six faces of a cube with quadratic projection; ids follow the Hilbert curve, as 64 bits."""

    def __init__(self):
        super().__init__("s2", 0, 30, 8, False)

    def text(self, cell: Column) -> Column:
        return F.regexp_replace(F.lower(F.lpad(F.hex(cell), 16, "0")), "0+$", "")

    def staged(self, rows: DataFrame, lon: Column, lat: Column, res: int, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
        """``rows`` with ``keep`` and the cell as ``name``; each step is a projection of its own, so that no arithmetic is repeated."""
        phi, theta = F.radians(lat), F.radians(lon)
        flat = rows.select(F.cos(phi).alias("_r"), F.sin(phi).alias("_z"), F.cos(theta).alias("_a"), F.sin(theta).alias("_b"), *keep)
        x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
        point = flat.select((F.col("_r") * F.col("_a")).alias("_x"), (F.col("_r") * F.col("_b")).alias("_y"), "_z", *keep)
        ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
        on_x, on_y = (ax > ay) & (ax > az), ay > az
        side = F.when(on_x, F.when(x < 0, 3).otherwise(0)).when(~on_x & on_y & (ay >= ax), F.when(y < 0, 4).otherwise(1)).otherwise(F.when(z < 0, 5).otherwise(2))
        faced, face = point.select(side.alias("_f"), "_x", "_y", "_z", *keep), F.col("_f")
        # The two other axes over the face's own, as the curve runs on that face.
        u = F.when(face == 0, y / x).when(face == 1, -x / y).when(face == 2, -x / z).when(face == 3, z / x).when(face == 4, z / y).otherwise(-y / z)
        v = F.when(face == 0, z / x).when(face == 1, z / y).when(face == 2, -y / z).when(face == 3, y / x).when(face == 4, -x / y).otherwise(-x / z)
        uv = faced.select("_f", u.alias("_u"), v.alias("_v"), *keep)
        square = lambda c: F.when(c >= 0, 0.5 * F.sqrt(1 + 3 * c)).otherwise(1 - 0.5 * F.sqrt(1 - 3 * c))
        size = 1 << 30
        cell = lambda c: F.least(F.greatest(F.floor(square(c) * size), F.lit(0)), F.lit(size - 1)).cast("long")
        placed = uv.select(F.col("_f").cast("long").alias("_f"), cell(F.col("_u")).alias("_i"), cell(F.col("_v")).alias("_j"), *keep)
        return placed.select(self.curve(F.col("_f"), F.col("_i"), F.col("_j"), res).alias(name), *keep)

    def curve(self, face: Column, i: Column, j: Column, res: int) -> Column:
        """The id of a place on a face."""
        size = 1 << 30
        state = record(turn=face.bitwiseAND(F.lit(1).cast("long")), id=face, i=i, j=j)
        # Of each orientation (1: axes swapped, 2: both inverted), the place on the curve of quadrant (i, j).
        position = F.array(*[F.lit(p).cast("long") for p in (0, 1, 3, 2, 0, 3, 1, 2, 2, 3, 1, 0, 2, 1, 3, 0)])
        turn = F.array(*[F.lit(t).cast("long") for t in (1, 0, 0, 3)])

        def step(s: Column, k: Column) -> Column:
            i, j = (F.shiftright(s[n], 29).bitwiseAND(F.lit(1).cast("long")) for n in ("i", "j"))
            p = F.get(position, (s["turn"] * 4 + i * 2 + j).cast("int"))
            return record(turn=s["turn"].bitwiseXOR(F.get(turn, p.cast("int"))), id=F.shiftleft(s["id"], 2).bitwiseOR(p), i=(s["i"] * 2).bitwiseAND(F.lit(size - 1)), j=(s["j"] * 2).bitwiseAND(F.lit(size - 1)))

        if res == 0:
            curve = face
        else:
            curve = F.aggregate(F.sequence(F.lit(1), F.lit(res)), state, step)["id"]
        return F.shiftleft(F.shiftleft(curve, 1).bitwiseOR(F.lit(1).cast("long")), 60 - 2 * res)

    def encode(self, face: Column, x: Column, y: Column, res: int) -> Column:
        scale = 1 << (30 - res)
        return self.curve(face, x * scale, y * scale, res)

    def place(self, cell: Column, res: int) -> Column:
        """Walks the curve of :meth:`curve` back."""
        face = F.shiftrightunsigned(cell, 61)
        zero = F.lit(0).cast("long")
        state = record(turn=face.bitwiseAND(F.lit(1).cast("long")), x=zero, y=zero)
        quadrant = F.array(*[F.lit(t[p]).cast("long") for t in self._QUADRANTS for p in range(4)])
        turn = F.array(*[F.lit(t).cast("long") for t in (1, 0, 0, 3)])

        def step(s: Column, k: Column) -> Column:
            p = F.call_function("shiftrightunsigned", cell, (F.lit(61) - 2 * k).cast("int")).bitwiseAND(F.lit(3).cast("long"))
            q = F.get(quadrant, (s["turn"] * 4 + p).cast("int"))
            return record(turn=s["turn"].bitwiseXOR(F.get(turn, p.cast("int"))), x=s["x"] * 2 + F.shiftright(q, 1), y=s["y"] * 2 + q.bitwiseAND(F.lit(1).cast("long")))

        if res == 0:
            return record(f=face, x=zero, y=zero)
        end = F.aggregate(F.sequence(F.lit(1), F.lit(res)), state, step)
        return let(end, lambda e: record(f=face, x=e["x"], y=e["y"]))

    #: Of each orientation, the quadrant (2 i + j) of each place on the curve.
    _QUADRANTS = ((0, 1, 3, 2), (0, 2, 3, 1), (3, 2, 0, 1), (3, 1, 0, 2))

    def _point(self, face: Column, u: Column, v: Column) -> Column:
        """The direction (x, y, z) of a place on a face."""
        flat = lambda s: F.when(s >= 0.5, (4 * s * s - 1) / 3).otherwise((1 - 4 * (1 - s) * (1 - s)) / 3)

        def side(p: Column) -> Column:
            a, b, one = p["a"], p["b"], F.lit(1.0)
            made = [record(x=x, y=y, z=z) for x, y, z in ((one, a, b), (-a, one, b), (-a, -b, one), (-one, -b, -a), (b, -one, -a), (b, a, -one))]
            return F.get(F.array(*made), p["f"].cast("int"))

        return let(record(f=face, a=flat(u), b=flat(v)), side)

    def spot(self, face: Column, u: Column, v: Column) -> Column:
        return let(self._point(face, u, v), lambda p: record(lon=F.degrees(F.atan2(p["y"], p["x"])), lat=F.degrees(F.atan2(p["z"], F.hypot(p["x"], p["y"])))))

    def area(self, cell: Column, res: int) -> Column:
        """The spherical area of the cell, as two triangles."""
        n = float(1 << res)

        def unit(p: Column) -> Column:
            long = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"])
            return record(x=p["x"] / long, y=p["y"] / long, z=p["z"] / long)

        dot = lambda p, q: p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]
        less = lambda p, q: {k: p[k] - q[k] for k in "xyz"}
        cross = lambda p, q: {"x": p["y"] * q["z"] - p["z"] * q["y"], "y": p["z"] * q["x"] - p["x"] * q["z"], "z": p["x"] * q["y"] - p["y"] * q["x"]}
        # Edges instead of corners in the triple product keep the digits of small cells.
        part = lambda p, q, r: 2 * F.atan2(F.abs(dot(p, cross(less(q, p), less(r, p)))), 1 + dot(p, q) + dot(q, r) + dot(r, p))
        corners = lambda p: F.array(*[let(self._point(p["f"], (p["x"] + F.lit(dx)) / n, (p["y"] + F.lit(dy)) / n), unit) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))])
        whole = lambda c: part(c[0], c[1], c[2]) + part(c[0], c[2], c[3])
        return let(let(self.place(cell, res), corners), whole) * F.lit(EARTH_RADIUS**2)

    def parent(self, cell: Column, res: int) -> Column:
        lowest = 1 << (60 - 2 * res)
        return cell.bitwiseAND(F.lit(-lowest)).bitwiseOR(F.lit(lowest))


class HealPix(Faces):
    """Twelve equal-area base cells cut into four over and over.

    Ids number them along nested quadrants from 4 * 4**res on, so that ids of
    different resolutions differ.
    """

    def __init__(self):
        super().__init__("healpix", 0, 26, 5, False)

    faces = 12
    reach = 1.5

    def spot(self, face: Column, u: Column, v: Column) -> Column:
        ring = F.floor(face / 4)
        down = ring + 2 - u - v  # 0 at the north pole, 4 at the south pole

        def made(p: Column) -> Column:
            north, south = p["down"] < 1, p["down"] > 3
            belt = F.degrees(F.asin((2 - p["down"]) * (2 / 3)))
            cap = 90 - 2 * F.degrees(F.asin(p["r"] / math.sqrt(6)))
            lon = F.when(p["r"] < 1e-15, 0.0).otherwise((p["first"] * p["r"] + p["across"]) * 45.0 / F.greatest(p["r"], F.lit(1e-15)))
            return record(lon=wrapped(lon), lat=F.when(north, cap).when(south, -cap).otherwise(belt))

        first = F.when(ring == 1, 2 * (face % 4)).otherwise(2 * (face % 4) + 1)
        parts = lambda d: record(down=d, r=F.when(d < 1, d).when(d > 3, 4 - d).otherwise(1.0), first=first, across=u - v)
        return let(let(down, parts), made)

    def place(self, cell: Column, res: int) -> Column:
        one, x, y = F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")
        for k in range(res):
            x = x + F.shiftleft(F.shiftright(cell, 2 * k).bitwiseAND(one), k)
            y = y + F.shiftleft(F.shiftright(cell, 2 * k + 1).bitwiseAND(one), k)
        return record(f=F.shiftright(cell, 2 * res) - 4, x=x, y=y)

    def encode(self, face: Column, x: Column, y: Column, res: int) -> Column:
        nested, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        for k in range(res):
            nested = nested + F.shiftleft(F.shiftright(x.cast("long"), k).bitwiseAND(one), 2 * k) + F.shiftleft(F.shiftright(y.cast("long"), k).bitwiseAND(one), 2 * k + 1)
        return (face.cast("long") + 4) * F.lit(1 << 2 * res).cast("long") + nested

    def assign(self, lon: Column, lat: Column, res: int) -> Column:
        n = 1 << res
        z = F.sin(F.radians(lat))
        t = F.pmod(lon, F.lit(360.0)) / 90.0
        up, down = n * (0.5 + t), n * z * 0.75
        high, low = F.floor(up - down).cast("long"), F.floor(up + down).cast("long")
        a, b = F.floor(high / n), F.floor(low / n)
        belt_face = F.when(a == b, F.pmod(a, F.lit(4)) + 4).when(a < b, F.pmod(a, F.lit(4))).otherwise(F.pmod(b, F.lit(4)) + 8)
        belt_x, belt_y = F.pmod(low, F.lit(n)), n - F.pmod(high, F.lit(n)) - 1
        quarter = F.least(F.floor(t), F.lit(3)).cast("long")
        r = n * F.sqrt(3 * (1 - F.abs(z)))
        inner = lambda c: F.least(F.floor(c), F.lit(n - 1)).cast("long")
        p, q = inner((t - quarter) * r), inner((1 - (t - quarter)) * r)
        north = z >= 0
        cap_face = F.when(north, quarter).otherwise(quarter + 8)
        cap_x, cap_y = F.when(north, n - q - 1).otherwise(p), F.when(north, n - p - 1).otherwise(q)
        belt = F.abs(z) <= 2 / 3
        face, x, y = F.when(belt, belt_face).otherwise(cap_face), F.when(belt, belt_x).otherwise(cap_x), F.when(belt, belt_y).otherwise(cap_y)
        return self.encode(face, x, y, res)

    def text(self, cell: Column) -> Column:
        """The resolution and the number inside it."""
        res = (F.floor(F.log2(cell.cast("double") + 0.5) / 2) - 1).cast("int")
        return F.concat(res.cast("string"), F.lit("/"), (cell - F.call_function("shiftleft", F.lit(4).cast("long"), res * 2)).cast("string"))

    def parent_of(self, cell: Column, res: int, parent: int) -> Column:
        return F.shiftright(cell, 2 * (res - parent))


class RHealPix(Faces):
    """Six equal-area faces on the ellipsoid, four around the equator and two caps, cut into nine over and over.

    The caps' triangles meet over the first face (both squares 0).  Ids are the
    face's letter and a digit a level, by rows from the upper left.
    """

    base = 3
    reach = 2.5
    #: Half of the surface over b**2: the zone from the equator to a pole, per radian.
    _POLE = ellipsoid_box(math.degrees(1.0), 0.0, 90.0)

    def __init__(self):
        super().__init__("rhp", 0, 15, 5, True)

    def assign(self, lon: Column, lat: Column, res: int) -> Column:
        return self.encode(*self.indices(lon, lat, res), res)

    def indices(self, lon: Column, lat: Column, res: int) -> tuple[Column, Column, Column]:
        n = self.base**res
        s = F.greatest(F.least(zone_area(lat) / self._POLE, F.lit(1.0)), F.lit(-1.0))  # the sine of the authalic latitude
        t = F.pmod(lon + 180.0, F.lit(360.0)) / 90.0
        quarter = F.least(F.floor(t), F.lit(3))
        r = F.sqrt(3 * (1 - F.abs(s)))
        across, half = (t - quarter - 0.5) * r, r / 2
        u = 0.5 + F.when(quarter == 0, across).when(quarter == 1, half).when(quarter == 2, -across).otherwise(-half)
        v = 0.5 - F.when(quarter == 0, -half).when(quarter == 1, across).when(quarter == 2, half).otherwise(-across)
        belt, north = F.abs(s) <= 2 / 3, s > 0
        face = F.when(belt, quarter + 1).when(north, 0).otherwise(5).cast("long")
        at = lambda c: F.greatest(F.least(F.floor(c * n), F.lit(n - 1)), F.lit(0)).cast("long")
        return face, at(F.when(belt, t - quarter).otherwise(u)), at(F.when(belt, 0.5 - 0.75 * s).when(north, v).otherwise(1 - v))

    def spot(self, face: Column, u: Column, v: Column) -> Column:
        south, belt = face == 5, (face >= 1) & (face <= 4)

        def cap(p: Column) -> Column:
            a, b = p["a"], p["b"]
            # The triangle below the tip is of the first quarter, then counterclockwise.
            quarter = F.when(-b >= F.abs(a), 0).when(a >= F.abs(b), 1).when(b >= F.abs(a), 2).otherwise(3)
            across = F.when(-b >= F.abs(a), a).when(a >= F.abs(b), b).when(b >= F.abs(a), -a).otherwise(-b)
            r = 2 * F.greatest(F.abs(a), F.abs(b))
            lon = -180.0 + 90.0 * (quarter + 0.5 + F.when(r < 1e-15, 0.0).otherwise(across / F.greatest(r, F.lit(1e-15))))
            beta = math.pi / 2 - 2 * F.asin(r / math.sqrt(6))
            return record(lon=lon, beta=F.when(south, -beta).otherwise(beta))

        high = let(record(a=u - 0.5, b=0.5 - F.when(south, 1 - v).otherwise(v)), cap)
        low = record(lon=-180.0 + 90.0 * (face - 1 + u), beta=F.asin((0.5 - v) * (4 / 3)))
        return let(F.when(belt, low).otherwise(high), lambda p: record(lon=p["lon"], lat=F.degrees(self._geodetic(p["beta"]))))

    @staticmethod
    def _geodetic(beta: Column) -> Column:
        """Latitude from authalic latitude, by its series in the eccentricity (to about a centimetre)."""
        e2, e4, e6 = _E2, _E2**2, _E2**3
        return beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)

    def encode(self, face: Column, x: Column, y: Column, res: int) -> Column:
        digits = [(F.floor(y / 3 ** (res - 1 - k)) % 3 * 3 + F.floor(x / 3 ** (res - 1 - k)) % 3).cast("string") for k in range(res)]
        return F.concat(F.substring(F.lit("NOPQRS"), (face + 1).cast("int"), F.lit(1)), *digits)

    def place(self, cell: Column, res: int) -> Column:
        x = y = F.lit(0).cast("long")
        for k in range(res):
            digit = F.substring(cell, k + 2, 1).cast("long")
            x, y = x * 3 + digit % 3, y * 3 + F.floor(digit / 3)
        return record(f=F.ascii(F.substring(cell, 1, 1)).cast("long") - ord("N"), x=x, y=y)

    def parent(self, cell: Column, res: int) -> Column:
        return F.substring(cell, 1, res + 1)

    def area_at(self, res: int, lat: float) -> float:
        return 4 * math.pi * self._POLE / (6 * 9**res)


GRIDS: dict[str, Grid] = {g.name: g for g in (Geohash(), Maidenhead(), S2(), HealPix(), RHealPix())}


def grid(name: str) -> Grid:
    if name not in GRIDS:
        raise ValueError(f"no grid is named {name!r}; there are {', '.join(GRIDS)}")
    return GRIDS[name]


def parent(g: Grid, cell: Column, res: int, to: int) -> Column:
    """The ancestor at resolution ``to`` of a cell of resolution ``res``."""
    return g.parent_of(cell, res, to) if isinstance(g, HealPix) else g.parent(cell, to)
