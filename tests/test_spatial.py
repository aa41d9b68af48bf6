import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import crs, geometry, octree
from cairn.functions.geometry import Area
from cairn.functions.octree import Cube
from cairn.operators import stats, tiling
from cairn.operators.tiling import Grid


def cloud(spark, points):
    return spark.createDataFrame([tuple(map(float, p)) for p in points], "X double, Y double")


def inside(rings, x, y):
    """Even-odd by angles of a ray, borders by distance."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (x1, y1) == (x2, y2):
                continue
            t = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            if math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)) == 0:
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


RINGS = [[(0, 0), (8, 0), (8, 8), (4, 4), (0, 8)], [(2, 1), (3, 1), (3, 2), (2, 2)]]


@pytest.mark.parametrize("written", [200, 0])
def test_polygons(spark, monkeypatch, written):
    monkeypatch.setattr(geometry, "WRITTEN_EDGES", written)
    points = [(x / 2, y / 2) for x in range(-2, 20) for y in range(-2, 20)]
    got = {(r.X, r.Y) for r in cloud(spark, points).where(geometry.in_polygon(RINGS)).collect()}
    assert got == {p for p in points if inside(RINGS, *p)}
    assert (0.0, 0.5) in got and (2.0, 1.5) in got and (4.0, 5.0) not in got


def test_boxes_are_closed(spark):
    df = cloud(spark, [(0, 0), (5, 0), (10, 0)])
    assert df.where(geometry.box(0, -1, 5, 1)).count() == 2 and df.where(geometry.box(5, -1, 10, 1)).count() == 2
    assert df.where(geometry.box(0, -1, 5, 1, half_open=True)).count() == 1


def test_corridors(spark):
    df = cloud(spark, [(0, 2), (5, 2), (5, 2.01), (-1.5, 0), (12, 0), (12.1, 0)])
    assert [r.X for r in df.where(geometry.near_line([(0, 0), (10, 0)], 2)).orderBy("X", "Y").collect()] == [-1.5, 0, 5, 12]
    assert df.where(geometry.near_line([(5, 2)], 0.005)).count() == 1


def test_areas():
    assert Area.of((0, 1, 2, 3)).bounds() == (0, 1, 2, 3)
    for bad in ((0, 0, 0, 1), (0, 0, math.inf, 1), (1, 2, 3), {"type": "Polygon", "coordinates": []}, {"type": "Circle", "coordinates": [1]}):
        with pytest.raises(ValueError):
            Area.of(bad)
    with pytest.raises(ValueError, match="width"):
        Area.of({"type": "Point", "coordinates": [1, 2]})
    line = Area.of({"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [4, 0]]}}, 1)
    assert line.bounds() == (-1, -1, 5, 1)
    many = Area.of({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": Area.of((0, 0, 1, 1)).geojson()}, {"type": "Feature", "geometry": Area.of((5, 5, 6, 7)).geojson()}]})
    assert many.bounds() == (0, 0, 6, 7) and len(many.polygons) == 2


def test_several_areas_are_one(spark):
    df = cloud(spark, [(1, 1), (2, 2), (9, 9)])
    both = geometry.in_any_polygon([Area.of((0, 0, 2, 2)).polygons[0], Area.of((1, 1, 3, 3)).polygons[0]])
    assert df.where(both).count() == 2


def test_node_bounds():
    assert Cube(0, 0, 0, 8).bounds(2, 3, 0, 1) == (4, -8, -4, 8, -4, 0)
    for bad in (-1, 31):
        with pytest.raises(ValueError):
            Cube(0, 0, 0, 8).bounds(bad, 0, 0, 0)
    assert Cube.around((0, 0, 0), (10, 4, 2)) == Cube(5, 2, 1, 5 * 1.001)
    assert Cube.around((1, 1, 1), (1, 1, 1)).half == 1.001


def test_depths():
    assert [octree.depth_for(n) for n in (1, 10_000, 10_001, 79_000, 80_001, 10**12)] == [0, 0, 1, 1, 2, 8]
    assert [octree.depth_of_resolution(10, r) for r in (10, 2, 20)] == [0, 2, 0]
    with pytest.raises(ValueError):
        octree.depth_of_resolution(10, 0)


def test_points_to_nodes(spark):
    df = spark.createDataFrame([(0.0, -1.0, 8.5)], "X double, Y double, Z double")
    r = octree.with_keys(df, Cube(0, 0, 0, 8), 1).first()
    assert (r.kx, r.ky, r.kz) == (1, 0, 1)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 6), st.lists(st.tuples(*[st.floats(-10, 10)] * 3), min_size=1, max_size=1))
def test_keys_lie_in_their_bounds(level, points):
    cube = Cube(0, 0, 0, 8)
    (p,) = points
    side = 16 / 2**level
    key = [min(max(math.floor((v + 8) / side), 0), 2**level - 1) for v in p]
    b = cube.bounds(level, *key)
    assert all(low - 1e-9 <= v < high + 1e-9 or abs(v) >= 8 for v, low, high in zip(p, b[:3], b[3:], strict=True))


def test_grids(spark):
    g = Grid((0, 0, 100, 100), 50)
    tiles = g.tiles(spark).orderBy("tile_id").collect()
    assert len(tiles) == 9 and tiles[2].xmin == tiles[2].xmax == 100
    a = Grid.aligned((5, 5, 95, 45), 50)
    assert [(t.xmin, t.ymin, t.xmax, t.ymax) for t in a.tiles(spark).orderBy("tile_id").collect()] == [(0, 0, 50, 50), (50, 0, 100, 50)]
    with pytest.raises(ValueError):
        Grid((0, 0, 1, 1), 0)


@pytest.mark.parametrize("overlap", [0.0, 3.0, 25.0])
def test_points_of_tiles(spark, overlap):
    r = random.Random(1)
    points = [(r.uniform(-5, 105), r.uniform(-5, 105)) for _ in range(300)] + [(20, 20), (40, 60), (100, 100), (0, 0)]
    g = Grid((0, 0, 100, 100), 20, overlap)
    tiles = g.tiles(spark).collect()
    want = sorted((t.tile_id, float(x), float(y)) for x, y in points for t in tiles if t.rxmin <= x <= t.rxmax and t.rymin <= y <= t.rymax)
    assert sorted((q.tile_id, q.X, q.Y) for q in g.assign(cloud(spark, points)).collect()) == want


def test_half_open_tiles_share_nothing(spark):
    points = [(x, y) for x in range(0, 101, 5) for y in range(0, 101, 5)]
    assert Grid((0, 0, 100, 100), 20).assign(cloud(spark, points), core=True).count() == len(points)


def test_adaptive_split(spark):
    node = lambda x, y, n: (n, float(x), float(y), float(x + 10), float(y + 10))
    nodes = spark.createDataFrame([node(0, 0, 900), node(150, 30, 500)], "point_count long, xmin double, ymin double, xmax double, ymax double")
    one = tiling.adaptive_split(nodes, (0, 0, 200, 60), 300, 50).collect()
    assert sorted((r.depth, r.i, r.j) for r in one) == [(1, i, j) for i in (0, 1) for j in (0, 1)]
    many = tiling.adaptive_split(nodes, (0, 0, 200, 60), 300, 5, collar=1).collect()
    assert sum((r.xmax - r.xmin) * (r.ymax - r.ymin) for r in many) == pytest.approx(12_000)
    assert all(r.rxmin == r.xmin - 1 and r.rymax == r.ymax + 1 for r in many)


def test_estimates(spark):
    nodes = spark.createDataFrame([(0, 5, 0.0, 0.0, 1.0, 1.0), (3, 7, 1.0, 1.0, 2.0, 2.0)], "level int, point_count long, xmin double, ymin double, xmax double, ymax double")
    w = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 6.0, 6.0), (3, 1.0, 1.0, 1.0, 2.0)], "window_id int, xmin double, ymin double, xmax double, ymax double")
    got = {r.window_id: (r.estimated_points, r.num_nodes, r.density) for r in tiling.estimate(nodes, w).collect()}
    assert got == {1: (12, 2, 12.0), 2: (0, 0, 0.0), 3: (12, 2, math.inf)}
    assert {r.window_id: r.estimated_points for r in tiling.estimate(nodes, w, max_depth=0).collect()} == {1: 5, 2: 0, 3: 5}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(-5, 5)), min_size=1, max_size=25))
def test_hull(points):
    h = stats.hull_of([(float(x), float(y)) for x, y in points])
    assert set(h) <= {(float(x), float(y)) for x, y in points}
    if len(h) >= 3:
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        for a, b in zip(h, h[1:] + h[:1], strict=True):
            assert all(turn(a, b, p) >= 0 for p in points)


def test_hull_of_partitions(spark):
    r = random.Random(2)
    points = [(r.gauss(0, 5), r.gauss(0, 5)) for _ in range(400)]
    got = [(q.X, q.Y) for q in stats.convex_hull(cloud(spark, points).repartition(5)).orderBy("corner").collect()]
    assert got == stats.hull_of(points)


def test_utm():
    x, y = crs.to_utm(9.0, 0.0, 32)
    assert x == pytest.approx(500_000) and y == pytest.approx(0, abs=1e-6)
    # Half a degree of the central meridian from 48 N: its scaled length of arc.
    assert crs.to_utm(9.0, 48.0, 32)[1] == pytest.approx(5_316_300.4, abs=0.5)
    for lon, lat in ((-111.9, 40.7), (-108.5, -33.3)):
        back = crs.from_utm(*crs.to_utm(lon, lat, 12, lat > 0), 12, lat > 0)
        assert back == pytest.approx((lon, lat), abs=1e-9)
    a = crs.area_to(Area.of((-111.0, 40.0, -110.9, 40.1)), 4326, 26912)
    assert crs.area_to(a, 26912, 4326).bounds() == pytest.approx((-111.0, 40.0, -110.9, 40.1), abs=1e-9)
    with pytest.raises(ValueError):
        crs.area_to(a, 2154, 4326)


def test_wkt():
    utm = 'PROJCS["NAD83 / UTM zone 12N",GEOGCS["NAD83",AUTHORITY["EPSG","4269"]],AUTHORITY["EPSG","26912"]]'
    assert crs.epsg_of(utm) == 26912 and not crs.is_compound(utm) and crs.epsg_of(None) is None
    both = f'COMPD_CS["x",{utm},VERT_CS["NAVD88",AUTHORITY["EPSG","5703"]]]'
    assert crs.is_compound(both) and crs.epsg_of(both) == 26912


def test_statistics(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (3, None, "b"), (5, 4.0, "c")], "i int, d double, s string")
    got = {r.name: r for r in stats.attributes(df).collect()}
    assert list(got) == ["i", "d"] and got["i"].average == 3 and got["i"].variance == 4
    assert (got["d"]["count"], got["d"].minimum, got["d"].maximum) == (2, 2, 4)
    assert stats.attributes(df.where(F.lit(False))).count() == 2
