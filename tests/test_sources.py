import http.server
import io
import json
import os
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.cloud import PointCloud
from cairn.functions.geometry import Area
from cairn.operators import catalog
from cairn.schema import Order
from cairn.sources import datasource, las, ranges, stac, store, vpc

UTM = 'PROJCS["NAD83 / UTM zone 12N",AUTHORITY["EPSG","26912"]]'


def columns(n=30_000, seed=1, x0=500_000.0):
    r = np.random.default_rng(seed)
    return {
        "X": x0 + r.uniform(0, 100, n).round(3), "Y": 4_400_000 + r.uniform(0, 60, n).round(3), "Z": r.uniform(0, 20, n).round(3), "gpstime": r.uniform(0, 1e5, n),
        "Intensity": r.integers(0, 65536, n), "ReturnNumber": r.integers(1, 4, n), "NumberOfReturns": np.full(n, 3), "Classification": r.integers(0, 19, n),
        "ScanAngleRank": r.integers(-5000, 5001, n) * 0.006, "Withheld_flag": r.integers(0, 2, n), "ScannerChannel": r.integers(0, 4, n), "R": r.integers(0, 65536, n), "G": r.integers(0, 65536, n), "B": r.integers(0, 65536, n),
        "hag": r.normal(size=n),
    }


def file(path, c=None, **options):
    with open(path, "w+b") as f:
        return las.write(f, c or columns(), wkt=UTM, **options)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    file(path / "a.copc.las")
    file(path / "b.copc.las", columns(5000, 2, 500_100.0), layout="lod", max_depth=2)
    return str(path)


@pytest.mark.parametrize("codec", ["raw", "zlib"])
@pytest.mark.parametrize("layout", ["leaf", "lod"])
def test_round_trip(codec, layout):
    c, f = columns(), io.BytesIO()
    h = las.write(f, c, codec=codec, layout=layout, wkt=UTM)
    f.seek(0)
    g = las.read_header(f)
    assert (g.points, g.point_format, g.wkt, g.cube, g.version) == (30_000, 7, UTM, h.cube, (1, 4))
    assert sum(g.by_return) == 30_000 and g.flags()["wkt"] and g.record_bytes == 44
    parts = list(las.read_points(f, g, las.select_nodes(f, g), codec))
    got = {k: np.concatenate([p[k] for p in parts]) for k in c}
    a, b = np.argsort(got["hag"]), np.argsort(c["hag"])
    assert all(np.allclose(got[k][a], np.asarray(c[k])[b]) for k in c)


def test_node_selection():
    c, f = columns(), io.BytesIO()
    las.write(f, c, layout="lod", max_depth=3)
    h = las.read_header(io.BytesIO(f.getvalue()))
    nodes = las.select_nodes(f, h)
    assert nodes == sorted(nodes, key=lambda e: (e["level"], e["x"], e["y"], e["z"])) and sum(e["point_count"] for e in nodes) == 30_000
    counts = [sum(e["point_count"] for e in las.select_nodes(f, h, max_depth=d)) for d in range(4)]
    assert counts == sorted(counts) and 0 < counts[0] < counts[3] == 30_000
    assert len(las.select_nodes(f, h, box=(500_000, 4_400_000, 500_010, 4_400_010))) < len(nodes)
    assert las.select_nodes(f, h, z=(500, 600)) == []
    leaf = io.BytesIO()
    las.write(leaf, c)
    assert las.select_nodes(leaf, las.read_header(io.BytesIO(leaf.getvalue())), max_depth=0) == []


def test_pages_of_pages():
    f = io.BytesIO()
    h = las.write(f, columns(100))
    far = f.seek(0, 2)
    f.write(np.array([(1, 0, 0, 0, 999, 40, 7)], las.NODE).tobytes())
    f.seek(h.root_at)
    f.write(np.array([(1, 0, 0, 0, far, las.NODE.itemsize, -1)], las.NODE).tobytes())
    assert [e["point_count"] for e in las.select_nodes(f, h)] == [7]


def test_defaults():
    f = io.BytesIO()
    h = las.write(f, {"X": np.array([100.1, 100.2, 100.3]), "Y": np.array([200.1, 200.2, 200.3]), "Z": np.array([10.1, 10.2, 10.3])})
    assert (h.scale, h.offset, h.point_format) == ((0.001,) * 3, (100.0, 200.0, 0.0), 6)
    with pytest.raises(las.LasError, match="0 points"):
        las.write(io.BytesIO(), {"X": [], "Y": [], "Z": []})
    with pytest.raises(las.LasError, match="X, Y, Z"):
        las.write(io.BytesIO(), {"X": np.zeros(1)})


def test_bad_headers():
    f = io.BytesIO()
    las.write(f, columns(10))
    raw = bytearray(f.getvalue())
    for at, value in ((0, b"NOPE"), (25, b"\2"), (94, struct.pack("<H", 100)), (104, b"\3")):
        bad = bytearray(raw)
        bad[at : at + len(value)] = value
        with pytest.raises(las.LasError):
            las.read_header(io.BytesIO(bytes(bad)))
    raw[104] |= 0x80
    h = las.read_header(io.BytesIO(bytes(raw)))
    with pytest.raises(las.UnsupportedCodec):
        list(las.read_points(io.BytesIO(bytes(raw)), h, las.select_nodes(io.BytesIO(bytes(raw)), h)))
    assert list(las.read_points(io.BytesIO(bytes(raw)), h, las.select_nodes(io.BytesIO(bytes(raw)), h), permissive=True)) == []


def test_paths(tmp_path):
    (tmp_path / "x.las").touch()
    with pytest.raises(ValueError, match="standard LAS/LAZ"):
        ranges.checked(str(tmp_path / "x.las"))
    with pytest.raises(FileNotFoundError, match="not found"):
        ranges.checked(str(tmp_path / "no.copc.laz"))


def test_data_source(spark, folder):
    c = columns()
    cloud = PointCloud.read(spark, f"{folder}/a.copc.las")
    assert cloud.df.count() == 30_000 and cloud.df.columns[-2:] == ["hag", "level"]
    box = PointCloud.read(spark, f"{folder}/a.copc.las", bbox="500010,4400010,500030,4400020", zrange="2,9", select="ic").df
    inside = (c["X"] >= 500_010) & (c["X"] <= 500_030) & (c["Y"] >= 4_400_010) & (c["Y"] <= 4_400_020) & (c["Z"] >= 2) & (c["Z"] <= 9)
    assert box.count() == inside.sum() and box.columns == ["X", "Y", "Z", "Intensity", "Classification", "hag", "level"]
    assert cloud.df.agg(F.sum("Intensity")).first()[0] == c["Intensity"].sum()
    both = PointCloud.read(spark, f"{folder}/a.copc.las,{folder}/b.copc.las", partitionPoints=4000).df
    assert both.count() == 35_000 and both.rdd.getNumPartitions() > 2


def test_pushed_filters_narrow_the_nodes(spark, folder):
    source = datasource.OctreeSource({"path": f"{folder}/a.copc.las"})
    reader = source.reader(source.schema())
    every = sum(len(p.nodes) for p in reader.partitions())
    pushed = [datasource.LessThanOrEqual(("X",), 500_020.0), datasource.GreaterThan(("Z",), 15.0), datasource.EqualTo(("hag",), 1.0)]
    assert list(reader.pushFilters(pushed)) == pushed
    assert sum(len(p.nodes) for p in reader.partitions()) < every
    low = PointCloud.read(spark, f"{folder}/b.copc.las").df.where("level <= 1 AND X < 500120")
    assert 0 < low.count() < 5000 and low.agg(F.max("X")).first()[0] < 500_120


def test_writing_through_spark(spark, folder, tmp_path):
    df = PointCloud.read(spark, f"{folder}/b.copc.las").df.drop("level")
    datasource.register(spark)
    df.repartition(3).write.format("cairn_octree").mode("append").option("path", str(tmp_path / "out")).save()
    paths = sorted(str(p) for p in (tmp_path / "out").iterdir())
    assert len(paths) == 3 and PointCloud.read(spark, ",".join(paths)).df.count() == 5000


def test_catalogs(spark, folder, tmp_path):
    (tmp_path / "bad.copc.las").write_bytes(b"no")
    k = catalog.Catalog.of(spark, [f"{folder}/a.copc.las", f"{folder}/b.copc.las", str(tmp_path / "bad.copc.las")], filter="-keep_first", select="r")
    t = k.totals().first()
    assert (t.files, t.points) == (2, 35_000) and "35000 points" in repr(k)
    assert k.meeting((500_000, 4_400_000, 500_050, 4_400_060)).files.count() == 1
    assert set(r.ReturnNumber for r in k.points().select("ReturnNumber").distinct().collect()) == {1}
    assert catalog.info(spark, f"{folder}/a.copc.las").first().points == 30_000
    assert catalog.cache_stats()["headers"] > 0
    catalog.cache_clear()
    assert catalog.cache_stats()["headers"] == 0
    with pytest.raises(ValueError):
        catalog.Catalog.of(spark, [str(tmp_path / "bad.copc.las")])
    assert catalog.resolution_depth(f"{folder}/a.copc.las", 10_000) == 0


def test_functions_over_a_catalog(spark, folder, monkeypatch):
    import pandas as pd

    paths = [f"{folder}/a.copc.las", f"{folder}/b.copc.las"]
    k = catalog.Catalog.of(spark, paths, chunk_size=60.0, chunk_buffer=0.0)
    count = lambda t, c, add=0: pd.DataFrame({"n": [len(t) + add], "x0": [c["xmin"]]})
    out = k.apply_files(count, "n long, x0 double").collect()
    files = {r.file: r for r in k.files.collect()}
    assert {r.file for r in out} == set(files) and sum(r.n for r in out) >= 35_000
    assert all(r.x0 == pytest.approx(files[r.file].xmin + (r.x0 - files[r.file].xmin) // 60 * 60) for r in out)
    whole = k.with_options(chunk_size=0.0).apply_files(lambda t, c, add: pd.DataFrame({"n": [len(t) + add]}), "n long", add=1).collect()
    assert sorted((r.file, r.chunk_id, r.n) for r in whole) == [(paths[0], 1, 30_001), (paths[1], 1, 5001)]
    tagged = k.apply(lambda t, c: t[["X", "Y"]], "X double, Y double", chunk_size=50, chunk_buffer=5, max_points_per_chunk=4000, min_split_size=10, merge=False)
    assert tagged.columns == ["tile_id", "path", "X", "Y"] and 35_000 <= tagged.count() < 35_200
    assert k.apply(lambda t, c: t[["X", "Y"]], "X double, Y double", chunk_size=50).columns == ["X", "Y"]

    def fails(t, c):
        raise ValueError("no")

    assert k.apply(fails, "n long").count() == 0
    with pytest.raises(Exception, match="no"):
        k.apply(fails, "n long", keep_going=False).count()
    assert k.apply(count, "n long", area=Area.of((0.0, 0.0, 10.0, 10.0))) is None
    with pytest.raises(ValueError):
        k.apply(count, "n long", chunk_size=0)
    leaves = k.adaptive_split(8000, 5.0)
    sums = k.nodes().groupBy("file").agg(F.sum("point_count").alias("n")).collect()
    assert sorted(r.n for r in sums) == [5000, 30_000] and leaves.count() > 3
    monkeypatch.setattr(catalog, "HERE", 1)
    again = catalog.Catalog.of(spark, [*paths, f"{folder}/none.copc.las"])
    assert sorted(map(tuple, again.files.collect())) == sorted(map(tuple, k.files.collect()))


def test_kept_headers_and_bounds(spark, folder):
    path = f"{folder}/a.copc.las"
    assert catalog.bounds(path)["xmin"] == catalog.header(path).low[0] and "epsg" in catalog.bounds(path)
    try:
        assert catalog.cache_config(headers=1, enabled=True) == {"headers": 1, "enabled": True}
        catalog.cache_clear()
        for p in (path, f"{folder}/b.copc.las", path, path):
            catalog.header(p)
        assert catalog.cache_stats() == {"headers": 1, "hits": 1, "misses": 3}
        catalog.cache_config(enabled=False)
        catalog.header(path)
        assert catalog.cache_stats()["misses"] == 3
        with pytest.raises(ValueError):
            catalog.cache_config(headers=0)
    finally:
        catalog.cache_config(headers=256, enabled=True)
    df = spark.range(1000).persist()
    df.count()
    assert catalog.cache_stats(spark)["tables"] >= 1
    catalog.cache_clear(spark)
    assert catalog.cache_stats(spark)["tables"] == 0


def test_what_a_record_has_no_room_for_is_an_error(tmp_path):
    for c, v in (("X", 1e12), ("Intensity", 70_000), ("Classification", 300), ("UserData", -1)):
        bad = columns(20)
        bad[c] = np.asarray(bad.get(c, np.zeros(20))).astype(float)
        bad[c][3] = v
        with pytest.raises(las.LasError, match=c):
            las.pack(bad, las.Header(offset=(500_000.0, 4_400_000.0, 0.0)))


def test_files_by_their_scheme(tmp_path):
    folder = f"file://{tmp_path}/new/folder"
    assert ranges.listed(folder) == [] and not ranges.exists(f"{folder}/a")
    with ranges.created(f"{folder}/a") as f:
        f.write(b"12345")
        f.seek(1)
        f.write(b"x")
    with ranges.opened(f"{folder}/a") as f:
        f.seek(1)
        assert f.read(2) == b"x3"
    assert ranges.listed(folder) == [f"{folder}/a"] and ranges.stamp(f"{folder}/a")[1] == 5
    ranges.removed(f"{folder}/a")
    assert ranges.listed(folder) == []


def test_paths_with_commas_and_files_of_a_few_points(spark, folder, tmp_path):
    df = PointCloud.read(spark, f"{folder}/b.copc.las").df.drop("level")
    out = tmp_path / "with, comma"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.coalesce(1).write.format("cairn_octree").mode("append").option("path", str(out)).option("filePoints", "1500").save()  # batches of rows stay together
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    paths = sorted(str(p) for p in out.iterdir())
    assert len(paths) > 1
    back = spark.read.format("cairn_octree").option("path", json.dumps(paths)).option("fileColumn", "from").load()
    assert back.count() == 5000 and {r["from"] for r in back.select("from").distinct().collect()} == set(paths)


def test_headers_are_read_again_when_a_file_changes(tmp_path):
    path = str(tmp_path / "x.copc.las")
    file(path, columns(50))
    assert catalog.header(path).points == 50
    file(path, columns(70))
    assert catalog.header(path).points == 70


def test_virtual_point_clouds(spark, folder):
    out = f"{folder}/all.vpc"
    vpc.write(spark, [f"{folder}/a.copc.las", f"{folder}/b.copc.las"], out, boundary=True, statistics=True)
    with open(out) as f:
        items = json.load(f)["features"]
    p = items[0]["properties"]
    assert items[0]["id"] == "a.copc" and p["pc:count"] == 30_000 and p["proj:epsg"] == 26912 and items[0]["assets"]["data"]["href"] == "./a.copc.las"
    assert [s["name"] for s in p["pc:schemas"]][-4:] == ["Red", "Green", "Blue", "hag"] and len(p["pc:statistics"]) > 10
    lon, lat = items[0]["geometry"]["coordinates"][0][0]
    assert -111.1 < lon < -110.9 and 39 < lat < 41
    said, read = (vpc.read(spark, out, trust=t).files.orderBy("xmin").collect() for t in (True, False))
    for a, b in zip(said, read, strict=True):
        assert os.path.basename(a.file) == os.path.basename(b.file) and (a.xmin, a.ymax, a.points, a.point_format) == (b.xmin, b.ymax, b.points, b.point_format)
    assert vpc.items(spark, out).select("href", "points").orderBy("points").collect()[1] == ("./a.copc.las", 30_000)
    items[0]["assets"] = {"thumbnail": {"href": "x.png"}}
    items[1]["bbox"], items[1]["properties"]["proj:bbox"] = None, [0, 1, 2, 3]
    with open(out, "w") as f:
        json.dump({"type": "FeatureCollection", "features": items}, f)
    (r,) = vpc.read(spark, out).files.collect()
    assert (r.xmin, r.ymin, r.xmax, r.ymax, r.zmin) == (0, 1, 2, 3, None)
    with open(out, "w") as f:
        json.dump({"type": "FeatureCollection", "features": items[:1]}, f)
    with pytest.raises(ValueError):
        vpc.read(spark, out)


def test_overviews(spark, folder, tmp_path):
    out = str(tmp_path / "o.vpc")
    paths = [f"{folder}/a.copc.las", f"{folder}/b.copc.las"]
    vpc.write(spark, paths, out, overview=True, overview_levels=2)
    with open(out) as f:
        assets = json.load(f)["features"][0]["assets"]
    assert {"data", "overview", "overview-L1_0_0"} <= set(assets) and assets["overview"]["href"] == "./o_overviews/o-overview-L0_0_0.copc.las"
    assert catalog.header(str(tmp_path / assets["overview"]["href"])).points == 35
    finer = sum(catalog.header(str(tmp_path / a["href"])).points for k, a in assets.items() if k.startswith("overview-L1"))
    assert 140 <= finer <= 144
    assert vpc.read(spark, out).files.count() == 2


def test_clouds_of_anything(spark, folder, tmp_path):
    c = columns(100)
    cloud = PointCloud.of(spark, {"data": {"x": c["X"], "y": c["Y"], "z": c["Z"], "classification": c["Classification"]}})
    assert cloud.df.columns == ["X", "Y", "Z", "Classification"] and PointCloud.of(spark, cloud) is cloud
    cloud.write(str(tmp_path / "out"), filter="-keep_class 2 3 4 5")
    paths = ",".join(str(p) for p in (tmp_path / "out").iterdir())
    assert PointCloud.read(spark, paths).df.count() == np.isin(c["Classification"], (2, 3, 4, 5)).sum()
    with pytest.raises(ValueError, match="X, Y, Z"):
        PointCloud.of(spark, {"x": [1.0]}).write(str(tmp_path / "no"))
    with pytest.raises(ValueError, match="0 points"):
        cloud.write(str(tmp_path / "no"), filter="-keep_z_above 1000")


@pytest.fixture(scope="module")
def server(folder):
    """Files by range, and a search of two pages."""
    fails = {"left": 1}

    class Handler(http.server.BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def _file(self, body):
            raw = open(os.path.join(folder, os.path.basename(self.path.split("?")[0])), "rb").read()
            if fails["left"]:
                fails["left"] -= 1
                self.send_error(503)
                return
            low, _, high = self.headers.get("Range", "bytes=0-").removeprefix("bytes=").partition("-")
            part = raw[int(low) : int(high) + 1 if high else None]
            self.send_response(206 if part else 416)
            self.send_header("Content-Length", str(len(part) if body else len(raw)))
            self.end_headers()
            if body:
                self.wfile.write(part)

        def do_HEAD(self):
            self._file(False)

        def do_GET(self):
            if self.path.startswith("/token"):
                return self._json({"token": "sig=1"})
            self._file(True)

        def _json(self, what, status=200):
            raw = json.dumps(what).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if "intersects" not in body:
                return self._json({"detail": "no area"}, 400)
            page = body.get("page", 0)
            host = f"http://127.0.0.1:{self.server.server_port}"
            item = {"id": "ab"[page], "properties": {"proj:epsg": 26912}, "assets": {"data": {"href": f"{host}/{'ab'[page]}.copc.las"}}}
            links = [{"rel": "next", "href": f"{host}/search", "method": "POST", "merge": True, "body": {"page": 1}}] if page == 0 else []
            self._json({"features": [item], "links": links})

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_ranges_over_http(server, folder, monkeypatch):
    monkeypatch.setattr(ranges, "PAUSE", 0)
    f = ranges.opened(f"{server}/a.copc.las")
    raw = open(f"{folder}/a.copc.las", "rb").read()
    assert f.read(10) == raw[:10] and f.read(5) == raw[10:15] and f.tell() == 15
    f.seek(-20, 2)
    assert f.read() == raw[-20:] and f.read(5) == b""
    with pytest.raises(OSError):
        ranges.opened("http://127.0.0.1:9/x.copc.laz").read(1)


def test_search_and_read(spark, server, tmp_path):
    area = Area.of((-111.0, 39.7, -110.9, 39.8))
    items = list(stac.search(server, area))
    assert [i["id"] for i in items] == ["a", "b"] and len(list(stac.search(server, area, limit=1))) == 1
    df = stac.read_items(spark, items, Area.of((-112.0, 39.0, -110.0, 41.0)), letters="i", filter="-keep_first", signature=stac.token(f"{server}/token", "x"))
    assert {r.item_id for r in df.select("item_id").distinct().collect()} == {"a", "b"} and df.count() > 10_000
    assert stac.read_items(spark, items, Area.of((-112.0, 39.0, -110.0, 41.0)), max_points=10).count() == 10
    done = stac.download(spark, items[1:], Area.of((-112.0, 39.0, -110.0, 41.0)), str(tmp_path))
    r = done.first()
    assert (r.item_id, r.n_points, r.written) == ("b", 5000, True)
    assert not stac.download(spark, items[1:], area, str(tmp_path)).first().written
    with pytest.raises(OSError, match="no area"):
        stac._posted(f"{server}/search", {})
    with pytest.raises(ValueError):
        stac.read_items(spark, [{"id": "x", "assets": {}}], area)


def test_stac_words():
    assert stac.is_search("https://x.org/api/stac/v1") and stac.is_search("https://x.org/search?a=1")
    assert not stac.is_search("https://x.org/stac/a.copc.laz") and not stac.is_search("/data/stac/x")
    assert stac.signed("a?b=1", "s=2") == "a?b=1&s=2" and stac.signed("a", None) == "a"
    assert stac.epsg({"properties": {"proj:projjson": {"components": [{"id": {"code": 6341}}]}}}) == 6341
    assert stac.epsg({"properties": {"proj:wkt2": UTM}}) == 26912 and stac.epsg({"properties": {"proj:code": "EPSG:32612"}}) == 32612
    assert vpc.href({"assets": {"x": {"href": "a.png"}, "y": {"href": "b.copc.laz"}}}) == "b.copc.laz"


@pytest.mark.parametrize("layout", ["leaf", "lod"])
def test_store(spark, folder, tmp_path, layout):
    df = PointCloud.read(spark, f"{folder}/a.copc.las").df.drop("level").withColumn("id", F.xxhash64("X", "Y", "Z", "hag"))
    path = str(tmp_path / "s")
    store.write(df, path, Order(("id",)), max_depth=2, layout=layout, partitions=3)
    back = store.read(spark, path)
    assert back.drop("level").exceptAll(df).count() == 0 and back.count() == 30_000
    nodes = store.nodes(spark, path)
    assert nodes.agg(F.sum("point_count")).first()[0] == 30_000
    few = store.read(spark, path, max_depth=0).count()
    assert few == 0 if layout == "leaf" else 0 < few < 30_000
    plan = store.read(spark, path, max_depth=0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "level" in plan.split("PartitionFilters")[1].split("]")[0]
    assert store.read(spark, path, resolution=1e9).count() == few


def test_no_task_holds_a_tile(spark, tmp_path, monkeypatch):
    """Files of tiles are packed as their points stream by, in several parts, and are those that one write of a tile gives."""
    from pyspark.sql import GroupedData

    from cairn import queries, schema

    grouped, apply = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, *a: grouped.append(self._df.columns) or apply(self, *a))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        p = queries.points(spark, "/root/testdata/sf0.001")
        paths = queries._octree_files(p, str(tmp_path / "files"), 600)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not any({"X", "Y"} & set(columns) for columns in grouped)
    assert sorted(os.listdir(tmp_path / "files")) == [os.path.basename(f) for f in paths] and len(paths) == 2
    t = p.where(F.col("X") < 600).where(F.col("Y") < 600).toPandas().sort_values(list(queries.ORDER.columns))
    with open(tmp_path / "one.copc.las", "w+b") as f:
        las.write(f, {c: np.asarray(t[c]) for c in schema.CORE}, header=las.Header(scale=(0.0001,) * 3), wkt='PROJCS["local"]')
    assert (tmp_path / "one.copc.las").read_bytes() == open(paths[0], "rb").read()
