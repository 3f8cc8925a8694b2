"""The raster engine's queries over pixel views of the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.functions import aggregates, histograms
from cellmosaic.operators import compaction, overlay, points, sampling
from cellmosaic.operators.grids import Lattice, grid, parent
from cellmosaic.plans.config import choose_resolution, pixel_area
from cellmosaic.sources.raster import Raster, apply_policy

Query = Callable[[SparkSession, str], DataFrame]

# --- pixel views ------------------------------------------------------------------------------

#: Scattered points over the globe, or over one degree.
POINTS = """SELECT event_id,
  CAST((event_id*7919)%10007 AS DOUBLE)*CAST({w} AS DOUBLE)/CAST(10007 AS DOUBLE)+CAST({x} AS DOUBLE) AS lon,
  CAST((event_id*104729)%5003 AS DOUBLE)*CAST({h} AS DOUBLE)/CAST(5003 AS DOUBLE)+CAST({y} AS DOUBLE) AS lat,
  CASE WHEN event_id%11=0 THEN NULL ELSE value END AS band_1, CAST(user_id%7 AS DOUBLE) AS band_2 FROM events"""
GLOBE = dict(w=360, x=-180, h=180, y=-90)
DEGREE = dict(w=1, x=174, h=1, y=-37)
#: A dense raster of 64 columns.
GRID_SQL = "SELECT CAST(vec_id AS INT) AS row, CAST(u.pos-1 AS INT) AS col, CASE WHEN (vec_id*64+u.pos-1)%17=0 THEN NULL ELSE CAST(embedding[u.pos] AS DOUBLE) END AS band_1, CAST(label AS DOUBLE) AS klass FROM embeddings, unnest(range(1,65)) AS u(pos)"
RASTER = Raster(64, 512, (1 / 64, 0.0, 174.0, 0.0, -1 / 512, -36.0), ("band_1", "klass"))


def raster_of(rows: int) -> Raster:
    """``RASTER``, as high as a table of ``rows`` rows needs; its rows get lower by halves where they would pass the pole."""
    height, step = max(rows, RASTER.height), -RASTER.affine[4]
    while RASTER.affine[5] - height * step < -90:
        step /= 2
    return replace(RASTER, height=height, affine=(*RASTER.affine[:4], -step, RASTER.affine[5]))


def _events(spark: SparkSession, sf_dir: str, where: dict) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(POINTS.format(**where))


def _raster(spark: SparkSession, sf_dir: str) -> Raster:
    last = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max("vec_id")).first()[0]
    return raster_of(0 if last is None else last + 1)


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    gap = (F.col("vec_id") * 64 + F.col("pos")) % 17 == 0
    return wide.select(F.col("vec_id").cast("int").alias("row"), F.col("pos").alias("col"), F.when(~gap, F.col("v").cast("double")).alias("band_1"), F.col("label").cast("double").alias("klass"))


# --- cells in SQL -----------------------------------------------------------------------------


def _steps(name: str, res: int) -> tuple[int, int]:
    g = grid(name)
    assert isinstance(g, Lattice)
    return g.steps(res)


def _indices_sql(name: str, res: int, lon: str = "lon", lat: str = "lat") -> tuple[str, str]:
    nx, ny = _steps(name, res)
    one = lambda v, span, n: f"least(greatest(CAST(floor(({v}+{span / 2}::DOUBLE)*{n}/{span}::DOUBLE) AS BIGINT),0),{n - 1})"
    return one(lon, 360.0, nx), one(lat, 180.0, ny)


def _encode_sql(name: str, ix: str, iy: str, res: int) -> str:
    out = []
    if name == "geohash":
        bits = 5 * res
        nx = -(-bits // 2)
        for c in range(res):
            terms = []
            for k in range(5):
                at = 5 * c + k
                v, i = (ix, nx - 1 - at // 2) if at % 2 == 0 else (iy, bits // 2 - 1 - at // 2)
                terms.append(f"((({v})>>{i})&1)*{1 << (4 - k)}")
            out.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz',CAST(1+{'+'.join(terms)} AS INT),1)")
    else:
        parts = (18, 10, 24, 10, 24, 10)
        for level in range(res):
            below = 1
            for p in parts[level + 1 : res]:
                below *= p
            base = 48 if level % 2 else 65 if level == 0 else 97
            out += [f"chr(CAST(({v})//{below}%{parts[level]}+{base} AS INT))" for v in (ix, iy)]
    return "||".join(out)


def _assigned_sql(view: str, name: str, res: int, up: int, keep: str) -> str:
    """(parent, cell, kept columns) of a view with lon and lat."""
    ix, iy = _indices_sql(name, res)
    cut = up if name == "geohash" else 2 * up
    return f"SELECT substr(cell,1,{cut}) AS parent, cell, {keep} FROM (SELECT {_encode_sql(name, 'ix', 'iy', res)} AS cell, {keep} FROM (SELECT {ix} AS ix, {iy} AS iy, {keep} FROM ({view})))"


# --- queries ----------------------------------------------------------------------------------

_GH, _MH = grid("geohash"), grid("maidenhead")
_KEYS = ["parent", "cell"]


def _cells(pixels: DataFrame, keep: tuple[str, ...], name: str = "geohash", res: int = 4, up: int = 2) -> DataFrame:
    g = grid(name)
    return points.assign(pixels, g, res, up, keep=keep).toDF("parent", "cell", *keep)


def _q(value: Column, name: str, places: int = 6) -> Column:
    return F.bround(value, places).alias(name)


#: DuckDB's form of each aggregate; all skip nulls.
_AGG_SQL = {
    "count": "count(x)::BIGINT", "mean": "round_even(avg(x),6)", "sum": "round_even(coalesce(sum(x),0),6)", "std": "round_even(stddev_samp(x),6)", "var": "round_even(var_samp(x),6)",
    "min": "min(x)", "max": "max(x)", "median": "round_even(median(x),6)", "nunique": "count(DISTINCT x)::BIGINT", "range": "round_even(max(x)-min(x),6)",
}


def _agg(name: str) -> tuple[Query, str | None]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = apply_policy(_events(spark, sf_dir, DEGREE), ("band_1",), "omit", missing="all", fill=None)
        out = aggregates.by_cell(_cells(rows, ("band_1",)), _KEYS, ("band_1",), (name,))
        exact = name in ("count", "nunique", "min", "max", "mode", "majority")
        return out.select(*_KEYS, (F.col("band_1") if exact else F.bround("band_1", 6)).alias("value"))

    inner = _assigned_sql(f"SELECT lon, lat, band_1 AS x FROM ({POINTS.format(**DEGREE)}) WHERE band_1 IS NOT NULL", "geohash", 4, 2, "x")
    return run, f"SELECT parent, cell, {_AGG_SQL[name]} AS value FROM ({inner}) GROUP BY parent, cell" if name in _AGG_SQL else None


def agg_prod(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, DEGREE).withColumn("band_2", F.col("band_2") % 2 + 1)
    cells = _cells(rows, ("band_2",), res=5, up=2).dropna(subset=_KEYS)
    return cells.groupBy(*_KEYS).agg(F.bround(aggregates.log2_product(F.col("band_2")), 6).alias("log2_product"))


AGG_PROD = f"SELECT parent, cell, round_even(sum(ln(v)/ln(2)),6) AS log2_product FROM ({_assigned_sql(f'SELECT lon, lat, band_2%2+1 AS v FROM ({POINTS.format(**DEGREE)})', 'geohash', 5, 2, 'v')}) GROUP BY 1,2"


def _by_value(name: str) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _events(spark, sf_dir, DEGREE).withColumn("band_1", F.when(F.col("event_id") % 5 != 0, F.col("band_2")))
        return aggregates.by_cell(_cells(rows, ("band_1",), res=5, up=2), _KEYS, ("band_1",), (name,)).select(*_KEYS, F.col("band_1").alias("value"))

    inner = _assigned_sql(f"SELECT lon, lat, CASE WHEN event_id%5<>0 THEN band_2 END AS x FROM ({POINTS.format(**DEGREE)})", "geohash", 5, 2, "x")
    counted = f"SELECT parent, cell, x, count(*) AS n FROM ({inner}) GROUP BY 1,2,3"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY parent, cell ORDER BY n DESC, x ASC NULLS LAST) AS place, sum(n) OVER (PARTITION BY parent, cell) AS total FROM ({counted})"
    value = "x" if name == "mode" else "CASE WHEN 2*n>total THEN x END"
    return run, f"SELECT parent, cell, {value} AS value FROM ({ranked}) WHERE place=1"


def agg_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.by_cell(_cells(_events(spark, sf_dir, DEGREE), ("band_1",)), _KEYS, ("band_1",), ("min", "max", "mean", "count"), decimals=2)
    return out.select(*_KEYS, "band_1.min", "band_1.max", "band_1.mean", "band_1.count")


_DEGREE_1 = _assigned_sql(f"SELECT lon, lat, band_1 AS x FROM ({POINTS.format(**DEGREE)})", "geohash", 4, 2, "x")
AGG_MULTI = f'SELECT parent, cell, round_even(min(x),2) AS "min", round_even(max(x),2) AS "max", round_even(avg(x),2) AS "mean", round_even(count(x)::DOUBLE,2) AS "count" FROM ({_DEGREE_1}) GROUP BY 1,2'


def point_maidenhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(_events(spark, sf_dir, GLOBE), ("band_2",), "maidenhead", 2, 1)
    return aggregates.by_cell(cells, _KEYS, ("band_2",), ("sum",)).withColumnRenamed("band_2", "total")


POINT_MAIDENHEAD = f"SELECT parent, cell, sum(band_2) AS total FROM ({_assigned_sql(POINTS.format(**GLOBE), 'maidenhead', 2, 1, 'band_2')}) GROUP BY 1,2"


def nodata_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(_events(spark, sf_dir, GLOBE), ("band_1",), "emit", missing="all", fill=-1.0)
    return aggregates.by_cell(_cells(rows, ("band_1",), res=2, up=1), _KEYS, ("band_1",), ("count",)).select(*_KEYS, F.col("band_1").alias("n"))


NODATA_EMIT = f"SELECT parent, cell, count(coalesce(band_1,-1))::BIGINT AS n FROM ({_assigned_sql(POINTS.format(**GLOBE), 'geohash', 2, 1, 'band_1')}) GROUP BY 1,2"


def out_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.lists(_cells(_events(spark, sf_dir, DEGREE), ("band_2",), res=5), _KEYS, ("band_2",), 0)
    return out.select(*_KEYS, F.array_join(F.transform("band_2", lambda x: x.cast("string")), ",").alias("values"))


OUT_LIST = f"SELECT parent, cell, string_agg(CAST(CAST(band_2 AS BIGINT) AS VARCHAR), ',' ORDER BY band_2) AS values FROM ({_assigned_sql(POINTS.format(**DEGREE), 'geohash', 5, 2, 'band_2')}) GROUP BY 1,2"


def _flat_histogram(bins: histograms.Bins) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = histograms.histogram(_cells(_events(spark, sf_dir, DEGREE), ("band_2",)), _KEYS, "band_2", bins)
        left = "band_2.values" if bins.edges is None and bins.width is None else "band_2.left"
        both = out.select(*_KEYS, F.explode(F.arrays_zip(F.col(left).alias("l"), F.col(f"band_2.{bins.field}").alias("w"))).alias("e"))
        return both.select(*_KEYS, F.col("e.l").alias("bin_left"), F.bround(F.col("e.w").cast("double"), 6).alias("weight"))

    return run


def _histogram_sql(left: str, weight: str, where: str = "TRUE") -> str:
    inner = f"SELECT parent, cell, {left} AS bin_left, count(*) OVER (PARTITION BY parent, cell) AS total FROM ({_assigned_sql(POINTS.format(**DEGREE), 'geohash', 4, 2, 'band_2')})"
    return f"SELECT parent, cell, bin_left, round_even({weight}, 6) AS weight FROM (SELECT parent, cell, bin_left, count(*)::DOUBLE AS n, max(total)::DOUBLE AS total FROM ({inner}) WHERE {where} GROUP BY 1,2,3)"


_SAMPLE_RES = 6


def _sampled(how: str) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raster = _raster(spark, sf_dir)
        cells = _GH.cells_in_box(spark, _SAMPLE_RES, *raster.bounds()).select("cell", "lon", "lat")
        out = sampling.sample(cells, _grid(spark, sf_dir), raster, ("band_1",), how)
        return out.select("cell", F.bround("band_1", 6).alias("value"))

    low, high, needed = sampling.STENCILS[how]
    nx, ny = _steps("geohash", _SAMPLE_RES)
    x0, x1 = -(-(174 + 180) * nx // 360), (175 + 180) * nx // 360
    w, s, e, n = RASTER.bounds()
    lattice = f"SELECT ix, iy, (ix+0.5::DOUBLE)*360/{nx}-180 AS lon, (iy+0.5::DOUBLE)*180/{ny}-90 AS lat FROM range({x0 - 2},{x1 + 3}) a(ix), range({int((s + 90) * ny / 180) - 2},{int((n + 90) * ny / 180) + 3}) b(iy)"
    inside = f"SELECT {_encode_sql('geohash', 'ix', 'iy', _SAMPLE_RES)} AS cell, (-36-lat)*512-0.5::DOUBLE AS r, (lon-174)*64-0.5::DOUBLE AS c FROM ({lattice}) WHERE lon BETWEEN {w} AND {e} AND lat BETWEEN {s} AND {n}"
    shift = "+0.5::DOUBLE" if how == "nn" else ""
    stencil = f"SELECT cell, r, c, CAST(floor(r{shift}) AS INT)+i AS prow, CAST(floor(c{shift}) AS INT)+j AS pcol FROM ({inside}), range({low},{high + 1}) p(i), range({low},{high + 1}) q(j) WHERE floor(r+0.5::DOUBLE) BETWEEN 0 AND 511 AND floor(c+0.5::DOUBLE) BETWEEN 0 AND 63"
    if how == "bilinear":  # the four pixels around a place are all there
        stencil += " AND r >= 0 AND r < 511 AND c >= 0 AND c < 63"

    def weight(t: str) -> str:
        x = f"abs({t})"
        if how == "nn":
            return "1.0::DOUBLE"
        if how == "bilinear":
            return f"greatest(1-{x},0)"
        if how == "bicubic":
            return f"CASE WHEN {x}<=1 THEN (1.5::DOUBLE*{x}-2.5::DOUBLE)*{x}*{x}+1 WHEN {x}<2 THEN ((-0.5::DOUBLE*{x}+2.5::DOUBLE)*{x}-4)*{x}+2 ELSE 0 END"
        return f"CASE WHEN {x}<1e-12 THEN 1 WHEN {x}<3 THEN 3*sin({x}*pi())*sin({x}*pi()/3)/({x}*{x}*pi()*pi()) ELSE 0 END"

    joined = f"SELECT s.cell, {weight('s.r-s.prow')}*{weight('s.c-s.pcol')} AS w, g.band_1 AS v FROM ({stencil}) s JOIN ({GRID_SQL}) g ON s.prow=g.row AND s.pcol=g.col WHERE g.band_1 IS NOT NULL"
    return run, f"SELECT cell, round_even(sum(w*v)/sum(w),6) AS value FROM ({joined}) GROUP BY cell HAVING count(*)>={needed} AND sum(w)<>0"


_OVER_RES = 6


def _covered(spark: SparkSession, sf_dir: str, bands: tuple[str, ...]) -> DataFrame:
    raster = _raster(spark, sf_dir)
    cells = _GH.cells_touching_box(spark, _OVER_RES, *raster.bounds())
    return overlay.coverage(cells, _GH, _OVER_RES, raster, _grid(spark, sf_dir), bands)


def _covered_sql() -> str:
    nx, ny = _steps("geohash", _OVER_RES)
    w, s, e, n = RASTER.bounds()
    lattice = f"SELECT ix, iy FROM range({int((w + 180) * nx / 360) - 2},{int((e + 180) * nx / 360) + 3}) a(ix), range({int((s + 90) * ny / 180) - 2},{int((n + 90) * ny / 180) + 3}) b(iy) WHERE (ix+1)*360.0::DOUBLE/{nx}-180 > {w} AND ix*360.0::DOUBLE/{nx}-180 < {e} AND (iy+1)*180.0::DOUBLE/{ny}-90 > {s} AND iy*180.0::DOUBLE/{ny}-90 < {n}"
    box = f"SELECT {_encode_sql('geohash', 'ix', 'iy', _OVER_RES)} AS cell, (ix*360.0::DOUBLE/{nx}-180-174)*64 AS x0, ((ix+1)*360.0::DOUBLE/{nx}-180-174)*64 AS x1, (-36-((iy+1)*180.0::DOUBLE/{ny}-90))*512 AS y0, (-36-(iy*180.0::DOUBLE/{ny}-90))*512 AS y1 FROM ({lattice})"
    zone = lambda lat: f"(sin(radians({lat}))/(1-0.0066943799901413165::DOUBLE*sin(radians({lat}))*sin(radians({lat})))+atanh(sqrt(0.0066943799901413165::DOUBLE)*sin(radians({lat})))/sqrt(0.0066943799901413165::DOUBLE))"
    area = f"abs({zone('-36-(g.row+1)/512.0::DOUBLE')}-{zone('-36-g.row/512.0::DOUBLE')})*6356752.314245179::DOUBLE*6356752.314245179::DOUBLE/2*radians(1/64.0::DOUBLE)"
    return f"SELECT * FROM (SELECT b.cell, (least(x1,64)-greatest(x0,0))*(least(y1,512)-greatest(y0,0))/((x1-x0)*(y1-y0)) AS rf, (least(x1,g.col+1)-greatest(x0,g.col))*(least(y1,g.row+1)-greatest(y0,g.row)) AS c, {area} AS w, g.band_1, g.klass FROM ({box}) b JOIN ({GRID_SQL}) g ON g.col<x1 AND g.col+1>x0 AND g.row<y1 AND g.row+1>y0 AND g.row<512) WHERE c>0"


def _overlaid(method: str, threshold: float = 0.0) -> tuple[Query, str | None]:
    band = "klass" if method in ("mode", "fractions", "histogram") else "band_1"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = overlay.overlay(_covered(spark, sf_dir, (band,)), ["cell"], band, method, threshold=threshold, bins=histograms.Bins(weight="area"))
        if method == "histogram":
            each = out.select("cell", F.explode(F.arrays_zip(F.col(f"{band}.values").alias("k"), F.col(f"{band}.area").alias("a"))).alias("e"))
            return each.select("cell", F.col("e.k").alias("value"), F.bround(F.col("e.a") * 1e-6, 6).alias("km2"))
        if method == "fractions":
            each = out.select("cell", F.explode(F.arrays_zip(F.col(f"{band}.classes").alias("k"), F.col(f"{band}.fractions").alias("f"))).alias("e"))
            return each.select("cell", F.col("e.k").alias("class"), F.bround("e.f", 6).alias("fraction"))
        if method == "list":
            return out.where(F.col(band).isNotNull()).select("cell", F.size(band).alias("n"), F.bround(F.aggregate(band, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
        scale = F.lit(1e-6) if method == "density_preserve" else F.lit(1.0)
        return out.where(F.col(band).isNotNull()).select("cell", F.bround(F.col(band) * scale, 6).alias("value"))

    base = _covered_sql()
    sql = {
        "weighted": f"SELECT cell, round_even(sum(c*w*band_1)/sum(CASE WHEN band_1 IS NOT NULL THEN c*w END),6) AS value FROM ({base}) GROUP BY cell HAVING count(band_1)>0",
        "mass_preserve": f"SELECT cell, round_even(sum(c*band_1),6) AS value FROM ({base}) GROUP BY cell HAVING count(band_1)>0",
        "density_preserve": f"SELECT cell, round_even(sum(c*band_1*w)*1e-6::DOUBLE,6) AS value FROM ({base}) GROUP BY cell HAVING count(band_1)>0",
        "fractions": f'SELECT cell, CAST(klass AS BIGINT) AS "class", round_even(sum(c)/max(total)*max(rf),6) AS fraction FROM (SELECT *, sum(c) OVER (PARTITION BY cell) AS total FROM ({base})) GROUP BY 1,2',
        "list": f"SELECT cell, CAST(count(band_1) AS INT) AS n, round_even(sum(band_1),6) AS total FROM ({base}) GROUP BY cell HAVING count(band_1)>0",
    }
    sql["mode"] = f"SELECT cell, klass AS value FROM (SELECT cell, klass, row_number() OVER (PARTITION BY cell ORDER BY round(sum(c),9) DESC, klass DESC) AS place FROM ({base}) WHERE klass IS NOT NULL GROUP BY 1,2) WHERE place=1"
    sql["histogram"] = f"SELECT cell, klass AS value, round_even(sum(c*w)*1e-6::DOUBLE,6) AS km2 FROM ({base}) GROUP BY 1,2"
    text = sql.get(method)
    if threshold and text:
        # Only "weighted" is queried with a threshold.
        text = text.replace("HAVING count(band_1)>0", f"HAVING count(band_1)>0 AND sum(CASE WHEN band_1 IS NOT NULL THEN c ELSE 0 END)/sum(c)*max(rf)>={threshold}")
    return run, text


def compact_single_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a box at precision 4, banded so that many siblings are equal."""
    cells = _GH.cells_in_box(spark, 4, 170.0, -45.0, 178.0, -34.0)
    made = cells.select(F.substring("cell", 1, 2).alias(_GH.index_column(2)), F.col("cell").alias(_GH.index_column(4)), F.floor(F.col("ix") / 64).cast("double").alias("band_1"))
    out = compaction.compact(made, _GH, 4, 2, ("band_1",))
    return out.toDF("parent", "cell", "band_1")


def _compact_sql() -> str:
    nx, ny = _steps("geohash", 4)
    lattice = f"SELECT ix, iy FROM range(0,{nx}) a(ix), range(0,{ny}) b(iy) WHERE (ix+0.5::DOUBLE)*360/{nx}-180 BETWEEN 170 AND 178 AND (iy+0.5::DOUBLE)*180/{ny}-90 BETWEEN -45 AND -34"
    cells = f"SELECT {_encode_sql('geohash', 'ix', 'iy', 4)} AS cell, floor(ix/64.0::DOUBLE) AS band_1 FROM ({lattice})"
    counted = f"SELECT *, count(*) OVER (PARTITION BY substr(cell,1,2)) AS n2, count(*) OVER (PARTITION BY substr(cell,1,3)) AS n3, min(band_1) OVER (PARTITION BY substr(cell,1,2)) AS a2, max(band_1) OVER (PARTITION BY substr(cell,1,2)) AS b2, min(band_1) OVER (PARTITION BY substr(cell,1,3)) AS a3, max(band_1) OVER (PARTITION BY substr(cell,1,3)) AS b3 FROM ({cells})"
    return f"SELECT DISTINCT substr(cell,1,2) AS parent, CASE WHEN n2=1024 AND a2=b2 THEN substr(cell,1,2) WHEN n3=32 AND a3=b3 THEN substr(cell,1,3) ELSE cell END AS cell, band_1 FROM ({counted})"


def cell_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _MH.cells_in_box(spark, 3, 172.0, -42.0, 174.0, -40.0)
    return found.select("cell", F.bround("lon", 6).alias("lon"), F.bround("lat", 6).alias("lat"))


def _enumerate_sql() -> str:
    nx, ny = _steps("maidenhead", 3)
    return f"SELECT {_encode_sql('maidenhead', 'ix', 'iy', 3)} AS cell, round_even(lon,6) AS lon, round_even(lat,6) AS lat FROM (SELECT ix, iy, (ix+0.5::DOUBLE)*360/{nx}-180 AS lon, (iy+0.5::DOUBLE)*180/{ny}-90 AS lat FROM range(0,{nx}) a(ix), range(0,{ny}) b(iy)) WHERE lon BETWEEN 172 AND 174 AND lat BETWEEN -42 AND -40"


def cell_s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid("s2")
    cells = points.assign(_events(spark, sf_dir, GLOBE), g, 8, 2, keep=("band_2",)).toDF("parent", "cell", "band_2")
    return cells.groupBy(g.text(F.col("parent")).alias("parent"), g.text(F.col("cell")).alias("cell")).agg(F.sum("band_2").alias("total"))


def cell_healpix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid("healpix")
    made = _events(spark, sf_dir, GLOBE).select(g.assign(F.col("lon"), F.col("lat"), 4).alias("cell"), "band_2")
    return made.select(parent(g, F.col("cell"), 4, 1).alias("parent"), "cell", "band_2").groupBy("parent", "cell").agg(F.sum("band_2").alias("total"))


def _healpix_sql() -> str:
    """Cells of resolution 4 (16 parts a side): face and place first, then their bits in turn."""
    at = f"SELECT band_2, sin(radians(lat)) AS z, (CASE WHEN lon<0 THEN lon+360 ELSE lon END)/90 AS t FROM ({POINTS.format(**GLOBE)})"
    lines = f"SELECT *, CAST(floor(16*(0.5::DOUBLE+t)-16*z*0.75::DOUBLE) AS BIGINT) AS hi, CAST(floor(16*(0.5::DOUBLE+t)+16*z*0.75::DOUBLE) AS BIGINT) AS lo, least(CAST(floor(t) AS BIGINT),3) AS quarter, 16*sqrt(3*(1-abs(z))) AS r FROM ({at})"
    cap = f"SELECT *, abs(z)<=2.0::DOUBLE/3 AS belt, least(CAST(floor((t-quarter)*r) AS BIGINT),15) AS p, least(CAST(floor((1-(t-quarter))*r) AS BIGINT),15) AS q FROM ({lines})"
    face = "CASE WHEN NOT belt THEN CASE WHEN z>=0 THEN quarter ELSE quarter+8 END WHEN hi//16=lo//16 THEN (hi//16)%4+4 WHEN hi//16<lo//16 THEN (hi//16)%4 ELSE (lo//16)%4+8 END"
    x = "CASE WHEN belt THEN lo%16 WHEN z>=0 THEN 15-q ELSE p END"
    y = "CASE WHEN belt THEN 15-hi%16 WHEN z>=0 THEN 15-p ELSE q END"
    bits = "+".join(f"((x>>{k})&1)*{1 << 2 * k}+((y>>{k})&1)*{2 << 2 * k}" for k in range(4))
    cells = f"SELECT (f+4)*256+{bits} AS cell, band_2 FROM (SELECT {face} AS f, {x} AS x, {y} AS y, band_2 FROM ({cap}))"
    return f"SELECT cell>>6 AS parent, cell, sum(band_2) AS total FROM ({cells}) GROUP BY cell"


def cell_rhp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(_events(spark, sf_dir, GLOBE), ("band_2",), "rhp", 3, 1).groupBy(*_KEYS).agg(F.sum("band_2").alias("total"))


def _rhp_sql() -> str:
    """Cells of resolution 3 (27 parts a side); caps are turned about their tip a quarter at a time."""
    e2 = "0.0066943799901413165::DOUBLE"
    zone = lambda v: f"({v}/(1-{e2}*{v}*{v})+atanh(sqrt({e2})*{v})/sqrt({e2}))"
    at = f"SELECT band_2, {zone('sin(radians(lat))')}/{zone('1.0::DOUBLE')} AS s, (lon+180)/90 AS t FROM ({POINTS.format(**GLOBE)})"
    cap = f"SELECT *, least(floor(t),3) AS k, sqrt(3*(1-abs(s))) AS r FROM ({at})"
    turned = f"SELECT *, [(t-k-0.5::DOUBLE)*r, r/2, -(t-k-0.5::DOUBLE)*r, -r/2] AS side, abs(s)<=2.0::DOUBLE/3 AS belt FROM ({cap})"
    # Up is one quarter behind sideways.
    places = f"SELECT band_2, CASE WHEN belt THEN CAST(k+1 AS INT) WHEN s>0 THEN 0 ELSE 5 END AS f, CASE WHEN belt THEN t-k ELSE 0.5::DOUBLE+side[CAST(k+1 AS INT)] END AS u, CASE WHEN belt THEN 0.5::DOUBLE-0.75::DOUBLE*s ELSE 0.5::DOUBLE-sign(s)*side[CAST((k+3)%4+1 AS INT)] END AS v FROM ({turned})"
    cells = f"SELECT band_2, f, least(CAST(floor(u*27) AS INT),26) AS x, least(CAST(floor(v*27) AS INT),26) AS y FROM ({places})"
    digits = "||".join(f"CAST((y//{d})%3*3+(x//{d})%3 AS VARCHAR)" for d in (9, 3, 1))
    return f"SELECT substr(cell,1,2) AS parent, cell, sum(band_2) AS total FROM (SELECT substr('NOPQRS',f+1,1)||{digits} AS cell, band_2 FROM ({cells})) GROUP BY 1,2"


def cell_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance in degrees of latitude of the points from the centre of their cell, by S2 face."""
    g = grid("s2")
    own = points.assign(_events(spark, sf_dir, GLOBE), g, 8, 0, keep=("lat",)).toDF("parent", "cell", "lat")
    return own.select(g.text(F.col("parent")).alias("parent"), (F.col("lat") - g.center(F.col("cell"), 8)[1]).alias("d")).groupBy("parent").agg(F.count("d").alias("n"), F.bround(F.max(F.abs("d")), 6).alias("furthest"))


def res_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    area, lat = pixel_area(RASTER)
    rows = [(m, name, choose_resolution(grid(name), area, lat, m)) for m in ("smaller-than-pixel", "larger-than-pixel", "min-diff") for name in ("geohash", "s2", "healpix")]
    return spark.createDataFrame(rows, "mode string, dggs string, resolution int")


def _res_sql() -> str:
    """Areas of all resolutions in SQL, and the three choices among them."""
    zone = lambda lat: f"(sin(radians({lat}))/(1-0.0066943799901413165::DOUBLE*pow(sin(radians({lat})),2))+atanh(sqrt(0.0066943799901413165::DOUBLE)*sin(radians({lat})))/sqrt(0.0066943799901413165::DOUBLE))"
    box = lambda wide, south, north: f"abs({zone(north)}-{zone(south)})*pow(6356752.314245179::DOUBLE,2)/2*radians({wide})"
    # The centre of the raster is at 36.5 degrees south; its pixels are 1/64 by 1/512 degree.
    geohash = f"SELECT 'geohash' AS dggs, r, {box('360.0::DOUBLE/pow(2,ceil(5*r/2.0))', 'y*180/ny-90', '(y+1)*180/ny-90')} AS area FROM (SELECT r, pow(2,floor(5*r/2.0)) AS ny, floor((90-36.5::DOUBLE)*pow(2,floor(5*r/2.0))/180) AS y FROM range(1,13) t(r))"
    equal = lambda name, top, first: f"SELECT '{name}' AS dggs, r, 4*pi()*pow(6371000.0::DOUBLE,2)/({first}*pow(4,r)) AS area FROM range(0,{top + 1}) t(r)"
    areas = f"{geohash} UNION ALL {equal('s2', 30, 6)} UNION ALL {equal('healpix', 26, 12)}"
    pixel = f"({box('1.0::DOUBLE', '-37.0::DOUBLE', '-36.0::DOUBLE')})/(64*512)"
    base = f"SELECT dggs, r, area, {pixel} AS pixel FROM ({areas})"
    picks = {"smaller-than-pixel": "coalesce(min(CASE WHEN area<=pixel THEN r END),min(r))", "larger-than-pixel": "coalesce(max(CASE WHEN area>=pixel THEN r END),min(r))", "min-diff": "arg_min(r,abs(area-pixel))"}
    return " UNION ALL ".join(f"SELECT '{mode}' AS mode, dggs, CAST({pick} AS INT) AS resolution FROM ({base}) GROUP BY dggs" for mode, pick in picks.items())


def _made() -> tuple[dict[str, Query], dict[str, str]]:
    runs: dict[str, Query] = {}
    sql: dict[str, str | None] = {}

    def add(name: str, run: Query, text: str | None = None) -> None:
        runs[name], sql[name] = run, text

    for n in aggregates.NAMES:
        if n in ("mode", "majority"):
            add(f"agg_{n}", *_by_value(n))
        elif n != "prod":
            add(f"agg_{n}", *_agg(n))
    add("agg_prod", agg_prod, AGG_PROD)
    add("agg_multi", agg_multi, AGG_MULTI)
    add("point_maidenhead", point_maidenhead, POINT_MAIDENHEAD)
    add("nodata_emit", nodata_emit, NODATA_EMIT)
    add("out_list", out_list, OUT_LIST)
    add("out_hist_categorical", _flat_histogram(histograms.Bins()), _histogram_sql("band_2", "n"))
    add("out_hist_norm_valid", _flat_histogram(histograms.Bins(normalize="valid")), _histogram_sql("band_2", "n/total"))
    edges = "CASE WHEN band_2>=0 AND band_2<2 THEN 0.0::DOUBLE WHEN band_2>=2 AND band_2<=5 THEN 2.0::DOUBLE END"
    add("out_hist_edges", _flat_histogram(histograms.Bins(edges=(0.0, 2.0, 5.0))), _histogram_sql(edges, "n", "bin_left IS NOT NULL"))
    add("out_hist_width", _flat_histogram(histograms.Bins(width=2.5, origin=0.5)), _histogram_sql("0.5::DOUBLE+floor((band_2-0.5::DOUBLE)/2.5::DOUBLE)*2.5::DOUBLE", "n"))
    for how in sampling.STENCILS:
        add(f"sample_{how}", *_sampled(how))
    for method in (*overlay.METHODS, "histogram"):
        add(f"overlay_{method}", *_overlaid(method))
    add("overlay_vct", *_overlaid("weighted", 0.93))
    add("compact_single_parent", compact_single_parent, _compact_sql())
    add("cell_enumerate_bbox", cell_enumerate, _enumerate_sql())
    add("cell_s2", cell_s2)
    add("cell_healpix", cell_healpix, _healpix_sql())
    add("cell_rhp", cell_rhp, _rhp_sql())
    add("cell_centres", cell_centres)
    add("res_choice", res_choice, _res_sql())
    return runs, {k: v for k, v in sql.items() if v}


QUERIES, ORACLE = _made()
