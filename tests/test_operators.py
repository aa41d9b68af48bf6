import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn import queries, schema
from cairn.cloud import PointCloud
from cairn.functions import geometry, octree
from cairn.functions.geometry import Area
from cairn.operators import apply, areas, pyramid, stats, thinning, tiling
from cairn.operators.overlap import BOX, meeting
from cairn.operators.tiling import Grid
from cairn.plans.numbering import numbered, range_of
from cairn.schema import Order
from cairn.streaming import landing

ORDER = Order(("id",))


def points(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(k, r.uniform(-20, 20), r.uniform(-20, 20), r.uniform(0, 10), r.randint(1, 3), r.choice([1, 2, 7])) for k in range(n)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "id long, X double, Y double, Z double, ReturnNumber int, Classification int")


def test_numbers_follow_the_order(spark):
    df = points(spark).repartition(7)
    got = sorted((r.id, r.point_number) for r in numbered(df, ORDER, parts=5).collect())
    assert got == [(k, k + 1) for k in range(400)]
    same = spark.range(50).select(F.lit(1).alias("a"), F.col("id").alias("b"))
    assert sorted(r.point_number for r in numbered(same, Order(("a", "b")), parts=3).collect()) == list(range(1, 51))
    assert numbered(df.where("false"), ORDER).count() == 0


def test_numbers_of_rows_alike_in_the_first_column_are_dealt_out(spark):
    df = spark.range(4000).select(F.lit(1).alias("a"), (F.col("id") * 7 % 4000).alias("b"), F.lit("x").alias("part"), F.lit("y").alias("inner"))
    order = Order(("a", "b"))
    ranges = [r["count"] for r in df.groupBy(range_of(df, order, 8).alias("r")).count().collect()]
    assert len(ranges) == 8 and max(ranges) < 1000
    got = numbered(df, order, parts=8)
    assert got.columns == [*df.columns, "point_number"]
    assert all(r.point_number == r.b + 1 for r in got.collect())
    nulls = spark.createDataFrame([(None, 1), (2, 1), (None, 0), (1, 5)], "a int, b int")
    assert [(r.a, r.b) for r in numbered(nulls, order, parts=3).orderBy("point_number").collect()] == [(None, 0), (None, 1), (1, 5), (2, 1)]


def test_samples_and_caps_above_the_bound_are_numbered(spark, monkeypatch):
    df = points(spark).withColumn("key", F.lit(1)).withColumn("number", F.lit(2))
    few = [sorted(map(tuple, f(df, 50, ORDER).collect())) for f in (thinning.head, thinning.sample)]
    monkeypatch.setattr(thinning, "FEW", 10)
    many = [f(df, 50, ORDER) for f in (thinning.head, thinning.sample)]
    assert [sorted(map(tuple, m.collect())) for m in many] == few and all(m.columns == df.columns for m in many)
    assert "TakeOrdered" not in many[0]._jdf.queryExecution().executedPlan().toString()


def boxes(spark, n, seed, size, prefix=""):
    r = random.Random(seed)
    rows = [(k, x := r.choice([r.uniform(0, 100), float(r.randint(0, 10) * 10)]), y := r.uniform(0, 100), x + r.choice([0.0, 10.0, r.uniform(0, size)]), y + r.uniform(0, size)) for k in range(n)]
    return rows, spark.createDataFrame(rows, ", ".join(f"{prefix}{c} {t}" for c, t in (("id", "long"), ("xmin", "double"), ("ymin", "double"), ("xmax", "double"), ("ymax", "double"))))


@pytest.mark.parametrize("touching", [True, False])
def test_boxes_meet_as_in_a_nested_loop(spark, touching):
    (a, left), (b, right) = boxes(spark, 120, 1, 30), boxes(spark, 150, 2, 15, "o_")
    right = right.union(spark.createDataFrame([(900, -float("inf"), -1e9, float("inf"), 1e9), (901, None, 0.0, 1.0, 1.0)], right.schema))
    b = b + [(900, -float("inf"), -1e9, float("inf"), 1e9)]
    got = meeting(left, right, BOX, [f"o_{c}" for c in BOX], touching)
    le = (lambda p, q: p <= q) if touching else (lambda p, q: p < q)
    want = sorted((p[0], q[0]) for p in a for q in b if le(p[1], q[3]) and le(q[1], p[3]) and le(p[2], q[4]) and le(q[2], p[4]))
    assert sorted((r.id, r.o_id) for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_points_in_many_areas(spark):
    r = random.Random(8)
    shapes = []
    for _ in range(40):
        x, y, w = r.uniform(-20, 20), r.uniform(-20, 20), r.uniform(0.5, 6)
        shapes.append(Area.of({"type": "Polygon", "coordinates": [[(x - w, y), (x, y - w), (x + w, y), (x, y + w), (x - w, y)]]}))
    df = points(spark, 600).withColumn("cx", F.lit(1))
    one, few = areas.within_any(df, shapes), areas.within_any(df, shapes[:3])
    want = df.where(geometry.in_any_polygon([p for s in shapes for p in s.polygons]))
    assert one.columns == df.columns and sorted(x.id for x in one.collect()) == sorted(x.id for x in want.collect())
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "LeftSemi" in plan
    assert few.count() == df.where(geometry.in_any_polygon([p for s in shapes[:3] for p in s.polygons])).count() and areas.within_any(df, []).count() == 0


def test_metrics_of_tiles(spark):
    df = points(spark, 500).withColumn("tile_id", F.col("id") % 3).withColumn("Z", F.round("Z", 1))
    table = df.toPandas()
    for r in tiling.metrics(df).collect():
        z = table[table.tile_id == r.tile_id]["Z"]
        assert (r.n, r.z_max) == (len(z), z.max())
        assert (r.z_mean, r.z_p95, r.cover) == pytest.approx((z.mean(), z.quantile(0.95), (z > 2).mean()))


def test_no_plan_gathers_or_nests(spark):
    """Hulls, overviews, splits and overlaps shuffle; none runs a nested loop or all in one task before it."""
    df = points(spark, 2000)
    hull = stats.convex_hull(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange RoundRobin" in hull or "Exchange SinglePartition" in hull
    level = pyramid.overview(df, (-20, -20, 20, 20), 0, ORDER)
    assert "NestedLoop" not in level._jdf.queryExecution().executedPlan().toString()
    (_, chunks), (_, files) = boxes(spark, 50, 3, 20), boxes(spark, 60, 4, 20)
    pairs = tiling.chunks_with_files(chunks.withColumnRenamed("id", "chunk"), files)
    nodes = files.withColumn("point_count", F.lit(5).cast("long"))
    sums = tiling.estimate(nodes, chunks.withColumnRenamed("id", "window_id"))
    assert not any("NestedLoop" in d._jdf.queryExecution().executedPlan().toString() for d in (pairs, sums))


def test_hull_of_awkward_points(spark):
    make = lambda rows: spark.createDataFrame(rows, "X double, Y double")
    corners = lambda df: [(r.X, r.Y) for r in stats.convex_hull(df).orderBy("corner").collect()]
    assert corners(make([])) == [] and corners(make([(1.0, 2.0)] * 5)) == [(1.0, 2.0)]
    assert corners(make([(float(k), 2.0 * k) for k in range(9)])) == [(0.0, 0.0), (8.0, 16.0)]
    r = random.Random(6)
    rows = [(r.gauss(0, 5), r.gauss(0, 5)) for _ in range(700)] + [(None, 1.0)]
    assert corners(make(rows).repartition(6)) == stats.hull_of([p for p in rows if p[0] is not None])


def test_splits_by_files_and_paths(spark):
    df = points(spark, 3000)
    cube = octree.Cube.of(df)
    parts = [df.where(f"id % 3 = {k}") for k in range(3)]
    nodes = octree.nodes(parts[0], cube, 5).union(octree.nodes(parts[1], cube, 5)).union(octree.nodes(parts[2], cube, 5))
    leaves = tiling.adaptive_split(nodes, (-20.0, -20.0, 20.0, 20.0), 300, 5.0).collect()
    assert [r.path for r in leaves] == sorted(r.path for r in leaves) and len(leaves) > 10
    table = nodes.toPandas()
    for r in leaves:
        meets = (table.xmin <= r.xmax) & (table.xmax >= r.xmin) & (table.ymin <= r.ymax) & (table.ymax >= r.ymin)
        assert r.estimated_points == table[meets].point_count.sum()
        assert r.estimated_points <= 300 or r.xmax - r.xmin <= 5
        assert r.depth == len(r.path) and r.i == sum((int(q) & 1) << (r.depth - 1 - k) for k, q in enumerate(r.path))
    assert sum((r.xmax - r.xmin) * (r.ymax - r.ymin) for r in leaves) == pytest.approx(1600)


def test_chunks_that_are_split(spark):
    df = points(spark, 1500)
    nodes = octree.nodes(df, octree.Cube.of(df), 5)
    grid = Grid.aligned((-20, -20, 20, 20), 20)
    kept = lambda t, c, add=0: t[["X", "Y"]].assign(n=len(t) + add)
    out = apply.chunk_apply(df, kept, "X double, Y double, n long", grid, 2, clip=True, nodes=nodes, max_points_per_chunk=150, min_split_size=4, extras={"add": 1000})
    assert out.columns == ["tile_id", "path", "X", "Y", "n"] and out.count() == 1500
    rows = out.collect()
    assert max(r.n for r in rows) < 1400 and len({(r.tile_id, r.path) for r in rows}) > 4
    with pytest.raises(ValueError):
        apply.chunk_apply(df, kept, "X double", grid, max_points_per_chunk=10)


def test_automerge(spark):
    a, b = (spark.createDataFrame([(k, 0, float(v))], "cx int, cy int, z double") for k, v in ((1, 2), (1, 4)))
    assert apply.automerge([None, None]) is None and apply.automerge([None, a]) is a
    assert [tuple(r) for r in apply.automerge([a, None, b]).collect()] == [(1, 0, 3.0)]
    rows = apply.automerge([a.select("z"), b.select("z", "cx")])
    assert rows.count() == 2 and set(rows.columns) == {"z", "cx"}
    assert isinstance(apply.automerge([a, a.withColumn("z", F.lit("text"))]), list)
    tagged = a.union(b).withColumn("tile_id", F.lit(1))
    assert [tuple(r) for r in apply.automerge(tagged).collect()] == [(1, 0, 3.0)]


def test_every_nth(spark):
    df = points(spark, 10)
    assert sorted(r.id + 1 for r in thinning.every_nth(df, 3, ORDER).collect()) == [1, 4, 7, 10]
    assert thinning.every_nth(df, 1, ORDER).count() == 10
    with pytest.raises(ValueError):
        thinning.every_nth(df, 0, ORDER)


def test_voxel_centre(spark):
    df = spark.createDataFrame([(k, x, x, z) for k, (x, z) in enumerate([(0.1, 0.1), (0.4, 0.4), (0.9, 0.1), (1.1, 0.1)])], "id long, X double, Y double, Z double")
    assert sorted(r.id for r in thinning.voxel_thin(df, 1.0, ORDER).collect()) == [1, 3]
    with pytest.raises(ValueError):
        thinning.voxel_thin(df, 0, ORDER)
    with pytest.raises(ValueError):
        thinning.voxel_thin(df, 1, ORDER, "best")


def test_voxels_near_zero_and_ties(spark):
    df = spark.createDataFrame([(1, -0.5, 0.5, 0.5), (2, 0.5, 0.5, 0.5), (3, 0.5, 0.5, 0.5)], "id long, X double, Y double, Z double")
    assert sorted(r.id for r in thinning.voxel_thin(df, 1.0, ORDER).collect()) == [1, 2]


@pytest.mark.parametrize("mode", thinning.MODES)
def test_one_point_of_each_voxel(spark, mode):
    df = points(spark)
    got = thinning.voxel_thin(df, 5.0, ORDER, mode)
    assert got.columns == df.columns and got.exceptAll(df).count() == 0
    cells = [F.floor(F.col(c) / 5) for c in "XYZ"]
    assert got.count() == df.select(*cells).distinct().count() == got.select(*cells).distinct().count()


def test_samples(spark):
    df = points(spark)
    assert thinning.sample(df, 37, ORDER).count() == 37 and thinning.sample(df, 1000, ORDER).count() == 400
    one, two = (sorted(r.id for r in thinning.sample(d, 20, ORDER, 4).collect()) for d in (df, df.repartition(9)))
    assert one == two != sorted(r.id for r in thinning.sample(df, 20, ORDER, 5).collect())
    assert 60 < thinning.random_fraction(df, 0.25, ORDER).count() < 140
    assert thinning.random_fraction(df, 1, ORDER).count() == 400 and thinning.random_fraction(df, 0, ORDER).count() == 0
    assert [r.id for r in thinning.head(df, 3, ORDER).collect()] == [0, 1, 2]
    assert all(thinning.head(df, n, ORDER).count() == 400 for n in (None, 0, -1, float("inf")))


def test_the_fixed_order_of_a_query(spark):
    cloud = PointCloud(points(spark), ORDER)
    triangle = {"type": "Polygon", "coordinates": [[[-20, -20], [20, -20], [-20, 20], [-20, -20]]]}
    every = cloud.query(aoi=triangle, filter="-keep_first").df.count()
    capped = cloud.query(aoi=triangle, filter="-keep_first", max_points=50).df.count()
    assert 0 < capped < 50 < every  # the cap comes before the polygon
    assert cloud.query(bbox=(-5, -5, 5, 5), aoi=(0, 0, 1, 1)).df.count() == cloud.bbox(-5, -5, 5, 5).df.count()
    assert cloud.query(filter="-keep_voxel 5").df.count() == cloud.thin(5).df.count()
    assert cloud.query(zrange=(2, 3), select="xyz").df.columns == ["X", "Y", "Z", "id"]


def test_pages(spark):
    pages = PointCloud(points(spark), ORDER).pages(150)
    assert pages.has_next() and [r.id for r in pages.yield_page()] == list(range(150))
    assert pages.progress() == {"total_points": 400, "yielded": 150, "remaining": 250, "page_rows": 150}
    assert [len(p) for p in pages] == [150, 100] and not pages.has_next() and pages.yield_page() is None
    pages.reset()
    assert sum(len(p) for p in pages) == 400 and pages.collect(7).count() == 7 and "400" in repr(pages)
    with pytest.raises(ValueError):
        PointCloud(points(spark), ORDER).pages(0)


def test_pruning_reaches_the_scan(spark, tmp_path):
    points(spark).write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = PointCloud(spark.read.parquet(str(tmp_path / "p")), ORDER).query(bbox=(0, 0, 5, 5), filter="-keep_first").df.select("X", "Z")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(X,0.0)" in plan and "EqualTo(ReturnNumber,1)" in plan and "Classification" not in plan.split("ReadSchema")[1]


def test_chunks(spark):
    df = points(spark)
    grid = Grid.aligned((-20, -20, 20, 20), 10)
    n = apply.chunk_apply(df, lambda t, c: pd.DataFrame({"n": [len(t)]}), "n long", grid)
    assert sum(r.n for r in n.collect()) >= 400
    back = apply.chunk_apply(df, lambda t, c: t[["X", "Y"]], "X double, Y double", grid, buffer=4, clip=True)
    assert back.count() == 400
    assert apply.chunk_apply(df, lambda t, c: None, "n long", grid).count() == 0

    def fails(t, c):
        if c["tile_id"] == 1:
            raise ValueError("no")
        return pd.DataFrame({"n": [1]})

    assert apply.chunk_apply(df, fails, "n long", grid, keep_going=True).count() == n.count() - 1
    with pytest.raises(Exception, match="no"):
        apply.chunk_apply(df, fails, "n long", grid).count()


def test_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 100, 2)], "x double, y double, z double, intensity int, Classification int")
    assert schema.with_standard_names(df).columns == ["X", "Y", "Z", "Intensity", "Classification"]
    both = spark.createDataFrame([(1.0, 2)], "ScanAngleRank double, scan_angle int")
    assert schema.with_standard_names(both).columns == ["ScanAngleRank", "scan_angle"]
    assert all(schema.ALIASES[a] == c for a, c in {"pointsourceid": "PointSourceID", "point_source_id": "PointSourceID", "scan_direction_flag": "ScanDirectionFlag", "edge_of_flight_line": "EdgeOfFlightline", "withheld_flag": "Withheld_flag", "gps_time": "gpstime", "number_of_returns": "NumberOfReturns", "b": "B", "easting": "X", "psid": "PointSourceID", "infrared": "NIR"}.items())
    assert [schema.point_format(c) for c in (["X"], ["R", "G", "B"], ["NIR"])] == [6, 7, 8]
    assert schema.struct_type(6).names[-1] == "ScannerChannel"
    merged = schema.merged([df.select("x"), df.select("y")])
    assert merged.columns == ["x", "y"] and merged.count() == 2


def test_streams(spark, tmp_path):
    df = points(spark).withColumn("gpstime", F.col("id").cast("double"))
    df.limit(200).write.parquet(str(tmp_path / "in"))
    live = landing.cell_counts(landing.arriving(spark, str(tmp_path / "in"), df.schema, "-drop_noise"), 10.0)
    query = live.writeStream.format("memory").queryName("cells").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    kept = spark.read.parquet(str(tmp_path / "in")).where("Classification <> 7")
    assert spark.table("cells").agg(F.sum("n")).first()[0] == kept.count()
    assert landing.timed_counts(df).agg(F.sum("n")).first()[0] == 400
    with pytest.raises(ValueError):
        landing.arriving(spark, str(tmp_path / "in"), df.schema, "-keep_voxel 2")


def test_catalog_apply_as_its_sql(spark, tmp_path):
    """Means whose fifth decimal is a 5, and points on the edge of a chunk's buffer, as SQL has them."""
    duckdb = pytest.importorskip("duckdb")
    tie = [(6, 1000.0, 25.0 + (k < 339)) for k in range(800)]  # the mean is 25.42375
    edges = [(1, price, 10.0) for price in (12286.74, 35286.74, 38000.0)]  # X of the second is 2 * 120 - 10 above that of the first
    rows = [(k, supplier, price, z) for k, (supplier, price, z) in enumerate(tie + edges)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_extendedprice double, l_quantity double")
    lines = lines.selectExpr("*", "0L AS l_partkey", "1 AS l_linenumber", "0D AS l_discount", "0D AS l_tax", "'N' AS l_returnflag", "'O' AS l_linestatus", "TIMESTAMP_NTZ'1995-01-01' AS l_shipdate")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in queries.queries()["catalog_apply"](spark, str(tmp_path)).select("file", "chunk_id", "n", "z_mean").collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == set(c.execute(f"SELECT file, chunk_id, n, z_mean FROM ({queries.oracle_sql()['catalog_apply']})").fetchall())
    assert ("0", 1, 800, 25.4237) in got and ("1", 3, 2, 10.0) in got
