"""The raster engine against small brute-force results and against its SQL."""

import math
import struct

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellmosaic.functions.aggregates import by_cell
from cellmosaic.functions.histograms import Bins, histogram
from cellmosaic.operators.grids import grid, parent
from cellmosaic.operators import compaction, overlay, points, sampling
from cellmosaic.plans import queries
from cellmosaic.plans.config import IndexConfig, choose_resolution
from cellmosaic.plans.run import main, plan
from cellmosaic.sources.raster import Raster, select_bands
from cellmosaic.sources.sinks import with_geometry, write_cells

SF = "/root/testdata/sf0.001"
TABLES = "events embeddings documents pages labels".split()


def test_known_geohashes(spark):
    g = grid("geohash")
    rows = spark.createDataFrame([(-5.6, 42.6), (10.40744, 57.64911)], "lon double, lat double")
    assert [r[0] for r in rows.select(g.assign(F.col("lon"), F.col("lat"), 5)).collect()] == ["ezs42", "u4pru"]


@pytest.mark.parametrize("name,res", [("geohash", 5), ("maidenhead", 3)])
def test_centres_lie_in_their_cells(spark, name, res):
    g = grid(name)
    cells = g.cells_in_box(spark, res, 10.0, 50.0, 10.5, 50.5)
    x, y = g.center(F.col("cell"), res)
    assert cells.count() > 0
    assert cells.where((g.assign(x, y, res) != F.col("cell")) | (F.abs(x - F.col("lon")) > 1e-9)).count() == 0


def test_parents_hold_their_children(spark):
    for name in ("s2", "healpix", "rhp"):
        g = grid(name)
        at = spark.range(500).select((F.col("id") * 0.7 - 175).alias("lon"), (F.col("id") * 7919 % 179 - 89.0).alias("lat"))
        own = points.assign(at, g, 9, 4, keep=("lon", "lat"))
        again = points.assign(own.withColumnRenamed(g.index_column(4), "up"), g, 4, 3, keep=("up",))
        assert again.where(F.col("up") != F.col(g.index_column(4))).count() == 0 and again.count() == 500


@pytest.mark.parametrize("name,res", [("s2", 5), ("healpix", 5), ("rhp", 3), ("s2", 0)])
def test_faces_hold_their_centres_and_corners(spark, name, res):
    g = grid(name)
    every = g.cells_in_box(spark, res, -180.0, -90.0, 180.0, 90.0).cache()
    assert every.count() == every.select("cell").distinct().count() == g.faces * g.base ** (2 * res)
    x, y = g.center(F.col("cell"), res)
    assert every.select(F.max(F.abs(y - F.col("lat"))), F.max(F.abs(F.sin(F.radians(x)) - F.sin(F.radians("lon"))))).where("greatest(*) < 1e-9").count() == 1
    if res > 0:
        again = points.assign(every, g, res, res - 1, keep=("cell",))
        assert again.where(F.col("cell") != F.col(g.index_column(res))).count() == 0
    # All cells within a box, and none else, without looking at the others.
    for w, s, e, n in ((170.0, 60.0, 180.0, 88.0), (-20.0, -90.0, 31.0, -70.0)):
        wanted = {r.cell for r in every.where(F.col("lon").between(w, e) & F.col("lat").between(s, n)).collect()}
        assert {r.cell for r in g.cells_in_box(spark, res, w, s, e, n).collect()} == wanted
    # A point between the centre and a corner is in the cell; areas add up to the globe.
    if res > 0:
        corner = every.where("abs(lat) < 60").select("cell", "lon", "lat", g.polygon(F.col("cell"), res).alias("p"), F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k")).cache()
        between = corner.select("cell", (0.1 * F.col("lon") + 0.9 * F.get("p", F.col("k"))["lon"]).alias("lon"), (0.1 * F.col("lat") + 0.9 * F.get("p", F.col("k"))["lat"]).alias("lat")).cache()
        missed = points.assign(between, g, res, res - 1, keep=("cell",)).where(F.col("cell") != F.col(g.index_column(res)))
        assert missed.count() <= 0.02 * between.count()
    total = 5.10065621724088e14 if name == "rhp" else 4 * math.pi * 6_371_000.0**2
    assert abs(every.agg(F.sum(g.area(F.col("cell"), res))).first()[0] / total - 1) < 1e-9


def test_known_rhealpix_cells(spark):
    g = grid("rhp")
    # Latitude 90 is the middle of the northern face; the poles and the equator are told apart; longitude -180 begins O.
    rows = spark.createDataFrame([(0.0, 90.0), (0.0, -90.0), (-180.0, 0.0), (-90.0, 0.0), (0.0, 0.0), (174.0, -37.0), (-135.0, 45.0), (135.0, 80.0)], "lon double, lat double")
    assert [r[0] for r in rows.select(g.assign(F.col("lon"), F.col("lat"), 1)).collect()] == ["N4", "S4", "O3", "P3", "Q3", "R8", "N7", "N4"]
    assert abs(4 * math.pi * g._POLE - 5.10065621724088e14) < 1e3


def test_mode_ties_and_nulls(spark):
    rows = spark.createDataFrame([("p", "a", 2.0), ("p", "a", 1.0), ("p", "b", None), ("p", "b", None), ("p", "b", 3.0), ("p", "c", None)], "parent string, cell string, v double")
    got = {r.cell: r.v for r in by_cell(rows, ["parent", "cell"], ("v",), ("mode",)).collect()}
    assert got == {"a": 1.0, "b": None, "c": None}
    sums = {r.cell: (r.v["sum"], r.v["prod"], r.v["count"], r.v["std"]) for r in by_cell(rows, ["parent", "cell"], ("v",), ("sum", "prod", "count", "std")).collect()}
    assert sums["c"] == (0.0, 1.0, 0, None)


def test_products_beyond_a_double(spark, tmp_path):
    # 3,000 twos in one cell; their product is 2 to the power of 3,000.
    made = spark.range(3000).select((F.col("id") * 10007 * 5003).alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.lit(1.0).alias("value"))
    made.write.parquet(str(tmp_path / "events.parquet"))
    assert [r.log2_product for r in entry.queries()["agg_prod"](spark, str(tmp_path)).collect()] == [3000.0]


def test_histogram_of_nothing_is_null(spark):
    rows = spark.createDataFrame([("a", None), ("b", 5.0), ("b", 7.0)], "cell string, v double")
    got = {r.cell: r.v for r in histogram(rows, ["cell"], "v", Bins(edges=(0.0, 5.0, 6.0))).collect()}
    assert got["a"] is None and (got["b"]["left"], got["b"]["counts"]) == ([5.0], [1])


def test_settings_are_checked():
    with pytest.raises(ValueError):
        IndexConfig("geohash", 4, point="value", sample="nn")
    with pytest.raises(ValueError):
        IndexConfig("geohash", 3, parent_res=3)
    with pytest.raises(ValueError):
        IndexConfig("geohash", 4, cell_id="uint64")
    raster = Raster(2, 2, (1, 0, 0, 0, -1, 0), ("x", "y"))
    assert select_bands(raster, [2, "x", "y"]) == ("y", "x")
    with pytest.raises(ValueError):
        select_bands(raster, [3])


def test_geometry_and_sink(spark, tmp_path):
    g = grid("geohash")
    cells = spark.createDataFrame([("ez", "ezs42", 1.5)], ["geohash_02", "geohash_05", "v"])
    shape = with_geometry(cells, g, 5).first()["geometry"]
    kind, rings, size = struct.unpack("<xIII", shape[:13])
    corners = struct.unpack(f"<{2 * size}d", shape[13:])
    assert (kind, rings, size) == (3, 1, 5) and corners[:2] == corners[-2:]
    assert abs(corners[0] + 5.625) < 1e-9 and abs(corners[1] - 42.5830078125) < 1e-9
    write_cells(cells, str(tmp_path / "out"), "geohash_02")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def _same(a, b):
    key = lambda rows: sorted(tuple("" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    return key(a) == key(b)


@pytest.mark.parametrize("name", ["agg_mean", "agg_mode", "agg_multi", "point_maidenhead", "out_list", "out_hist_edges", "sample_bicubic", "sample_bilinear", "overlay_weighted", "overlay_fractions", "overlay_mass_preserve", "overlay_mode", "overlay_histogram", "overlay_vct", "compact_single_parent", "res_choice", "cell_healpix", "cell_rhp"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made = entry.queries()[name](spark, SF)
    columns = sorted(made.columns)
    wanted = con.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({entry.oracle_sql()[name]})").fetchall()
    assert _same([tuple(r) for r in made.select(*columns).collect()], wanted)


@pytest.mark.parametrize("name", ["overlay_list", "overlay_weighted"])
def test_cells_without_values_against_sql(spark, tmp_path, name):
    import duckdb

    # The first 40 of 60 rows have no data, so some cells have none.
    made = spark.range(60).select(F.col("id").alias("vec_id"), F.array_repeat(F.when(F.col("id") >= 40, F.col("id").cast("float")), 64).alias("embedding"), F.lit(1).alias("label"))
    made.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    made = entry.queries()[name](spark, str(tmp_path))
    wanted = con.execute("SELECT " + ", ".join(f'"{c}"' for c in made.columns) + f" FROM ({entry.oracle_sql()[name]})").fetchall()
    assert len(wanted) > 0 and _same([tuple(r) for r in made.collect()], wanted)


def test_rasters_are_as_high_as_their_table(spark, tmp_path):
    rows = 700
    made = spark.range(rows).select(F.col("id").alias("vec_id"), F.array_repeat(F.col("id").cast("float"), 64).alias("embedding"), F.lit(1).alias("label"))
    made.write.parquet(str(tmp_path / "embeddings.parquet"))
    g = grid("geohash")
    for name in ("sample_nn", "sample_bilinear", "overlay_weighted"):
        got = entry.queries()[name](spark, str(tmp_path))
        _, lat = g.center(F.col("cell"), 6)
        away = F.abs(F.col("value") - ((-36 - lat) * 512 - 0.5))
        # Values are row numbers; gaps in a stencil move them a little.
        assert got.select(F.max("value")).first()[0] > rows - 8 and got.where(away > 2).count() == 0
    for n in (500, 2000, 27_648, 27_649, 51_282, 10**7):
        assert queries.raster_of(n).bounds()[1] >= -90 and queries.raster_of(n).height >= n
    assert queries.raster_of(500) == queries.RASTER


def _ones(spark, rows=10, cols=10):
    return spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"), F.lit(1.0).alias("v"), F.lit(3.0).alias("k"))


def test_overlays_keep_the_total(spark):
    raster = Raster(10, 10, (0.01, 0.0, 174.0, 0.0, -0.01, -41.0), ("v",))
    g = grid("geohash")
    for res in (4, 5, 6):
        covered = overlay.coverage(g.cells_touching_box(spark, res, *raster.bounds()), g, res, raster, _ones(spark), ("v", "k"))
        got = overlay.overlay(covered, ["cell"], "v", "mass_preserve", threshold=0.9)
        assert abs(got.agg(F.sum("v")).first()[0] - 100) < 1e-6
        # What of a cell lies outside the raster counts against it.
        parts = overlay.overlay(covered, ["cell"], "k", "fractions").select("cell", F.col("k.fractions")[0].alias("f"))
        share = {r.cell: r.f for r in parts.collect()}
        kept = {r.cell for r in overlay.overlay(covered, ["cell"], "v", "list", threshold=0.5).where("v IS NOT NULL").collect()}
        assert kept == {c for c, f in share.items() if f >= 0.5} and all(0 < f <= 1 + 1e-9 for f in share.values()) and min(share.values()) < 0.9
        counts = overlay.overlay(covered, ["cell"], "k", "histogram").select(F.sum(F.col("k.counts")[0])).first()[0]
        assert counts == covered.count()


def test_overlay_policy(spark):
    made = spark.createDataFrame([("a", 1.0, [1.0]), ("b", None, None)], "cell string, v double, l array<double>")
    assert [r.cell for r in overlay.apply_overlay_policy(made, ("v", "l"), "omit").collect()] == ["a"]
    got = {r.cell: (r.v, r.l) for r in overlay.apply_overlay_policy(made, ("v", "l"), "emit").collect()}
    assert got["a"] == (1.0, [1.0]) and got["b"][0] != got["b"][0] and got["b"][1] is None


def test_bilinear_needs_all_four_pixels(spark):
    raster = Raster(10, 10, (1.0, 0.0, 0.0, 0.0, -1.0, 10.0), ("v",))
    cells = spark.createDataFrame([("in", 5.2, 5.2), ("edge", 0.2, 5.2), ("last", 9.8, 5.2)], "cell string, lon double, lat double")
    assert {r.cell for r in sampling.sample(cells, _ones(spark), raster, ("v",), "bilinear").collect()} == {"in"}
    got = {r.cell: r.v for r in sampling.sample(cells, _ones(spark), raster, ("v",), "bilinear", policy="emit", fill=-5.0).collect()}
    assert got == {"in": 1.0, "edge": -5.0, "last": -5.0}


def test_emit_fills_with_nodata(spark):
    rows = spark.createDataFrame([(10.0, 50.0, -9999.0), (10.0, 50.0, 1.0)], "lon double, lat double, v double")
    got = points.index_points(rows, grid("geohash"), 4, ("v",), aggs=("min",), nodata=-9999.0, policy="emit")
    assert got.first()["v"] == -9999.0


def test_compaction_expands_to_its_input(spark):
    g = grid("healpix")
    cells = spark.range(4 * 4**3, 16 * 4**3).select(g.parent_of(F.col("id"), 3, 0).alias("healpix_00"), F.col("id").alias("healpix_03"), F.when(F.col("id") < 300, 1.0).when(F.col("id") == 700, None).otherwise(2.0).alias("v"))
    out = compaction.compact(cells, g, 3, 0, ("v",))
    back = {}
    for r in out.select("healpix_03", "v", g.text(F.col("healpix_03")).alias("t")).collect():
        level = int(r.t.split("/")[0])
        for k in range(4 ** (3 - level)):
            back[(r.healpix_03 << 2 * (3 - level)) + k] = r.v
    assert back == {r.healpix_03: r.v for r in cells.collect()} and out.count() < cells.count() / 4
    scans = compaction.compact(cells, g, 3, 0, ("v",))._jdf.queryExecution().optimizedPlan().toString().count("Range (")
    assert scans == 4


def test_resolutions_fall_back_to_the_coarsest():
    assert choose_resolution(grid("geohash"), 1e-9, 0.0, "smaller-than-pixel") == 1
    assert choose_resolution(grid("geohash"), 1e20, 0.0, "larger-than-pixel") == 1


AFFINE = ["--width", "10", "--height", "10", "--affine", "0.01", "0", "174", "0", "-0.01", "-41"]


def test_runs_are_written(spark, tmp_path):
    pixels, out = str(tmp_path / "pixels"), str(tmp_path / "out")
    _ones(spark).withColumn("v", F.when((F.col("row") == 0) & (F.col("col") == 0), -9999.0).otherwise(F.col("v"))).write.parquet(pixels)
    common = [*AFFINE, "--labels", "v", "k", "--raster-nodata", "-9999", "--overwrite"]
    back = lambda: spark.read.option("mergeSchema", "false").parquet(out)

    report = main(["geohash", "6", pixels, out, *common, "--agg", "count", "--agg", "sum", "-b", "v", "-d", "0"], spark)
    assert (report["pixels_read"], report["rows_indexed"]) == (100, 99)
    assert back().columns == ["geohash_06", "v", "geohash_02"] and back().select(F.sum("v.count"), F.sum("v.sum")).first() == (99, 99)
    main(["s2", "14", pixels, out, *common, "--agg", "count", "--cell-id", "uint64", "--geo", "polygon", "-b", "2", "-d", "0"], spark)
    row = back().first()
    assert back().schema["s2_14"].dataType.simpleString() == "decimal(20,0)" and len(row["geometry"]) == 93 and back().agg(F.sum("k")).first()[0] == 100
    main(["rhp", "8", pixels, out, *common, "--sample", "nn", "-b", "k", "--geo", "point"], spark)
    assert back().count() > 0 and back().where("k <> 3.0").count() == 0
    main(["maidenhead", "4", pixels, out, *common, "--overlay", "mass_preserve", "-b", "v", "-d", "none"], spark)
    assert abs(back().agg(F.sum("v")).first()[0] - 99) < 1e-6
    main(["geohash", "5", pixels, out, *common, "--overlay", "histogram", "-b", "k", "-d", "none", "--hist-weight", "area", "--hist-normalize", "cell"], spark)
    assert back().where("k.area_share[0] > 1.001 OR k.area_share[0] <= 0").count() == 0
    main(["healpix", "smaller-than-pixel", pixels, out, *common, "--point", "list", "-b", "k", "--compact"], spark)
    assert back().agg(F.sum(F.size("k"))).first()[0] <= 100
    main(["geohash", "5", pixels, out, *common, "--point", "histogram", "--hist-bins", "0,2,4"], spark)
    assert back().agg(F.sum(F.col("k.counts")[0]), F.sum(F.col("v.counts")[0])).first() == (100, 99)


def test_runs_that_cannot_be(spark, tmp_path):
    for extra in (["--overlay", "mode", "--sample", "nn"], ["--overlay", "nothing"]):
        with pytest.raises(SystemExit):
            main(["geohash", "6", "x", "y", *AFFINE, *extra], spark)
    with pytest.raises(ValueError):
        plan(spark, IndexConfig("s2", 10, overlay="weighted"), _ones(spark), Raster(10, 10, (0.01, 0, 174, 0, -0.01, -41), ("v",)))
    with pytest.raises(ValueError):
        plan(spark, IndexConfig("s2", 10), _ones(spark), Raster(10, 10, (30.0, 0, 0, 0, -30.0, 0), ("v",), "EPSG:32633"))
