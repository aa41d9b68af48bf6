"""Virtual point clouds: STAC item collections that list files with their extents, counts, schemas and statistics."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs
from ..operators import pyramid, stats
from ..operators.catalog import SCHEMA, Catalog, header, row
from ..schema import Order
from . import datasource, las
from .ranges import created, is_url, opened, plain

STAC_VERSION = "1.0.0"
#: Assets in the order in which they are looked for; then any that is a point file.
ASSETS = ("data", "copc", "pointcloud", "lidar", "asset")
#: Names and sizes of dimensions as these files write them.
DIMENSIONS = (("X", 8, "floating"), ("Y", 8, "floating"), ("Z", 8, "floating"), ("Intensity", 2, "unsigned"), ("ReturnNumber", 1, "unsigned"), ("NumberOfReturns", 1, "unsigned"), ("ScanDirectionFlag", 1, "unsigned"), ("EdgeOfFlightLine", 1, "unsigned"), ("Classification", 1, "unsigned"), ("ScanAngleRank", 4, "floating"), ("UserData", 1, "unsigned"), ("PointSourceID", 2, "unsigned"), ("GpsTime", 8, "floating"))
COLOURS = (("Red", 2, "unsigned"), ("Green", 2, "unsigned"), ("Blue", 2, "unsigned"))


def schemas(h: las.Header) -> list[dict]:
    """The dimensions of a file."""
    own = list(DIMENSIONS) + (list(COLOURS) if h.point_format >= 7 else []) + ([("NIR", 2, "unsigned")] if h.point_format >= 8 else [])
    return [{"name": n, "size": s, "type": t} for n, s, t in own] + [{"name": n, "size": 8, "type": "floating"} for n, kind, _, _ in h.extras() if not kind.startswith("V")]


def _relative(path: str, folder: str) -> str:
    if is_url(path):
        return path
    r = os.path.relpath(plain(path), folder).replace(os.sep, "/")
    return r if r.startswith("..") else f"./{r}"


def overviews(spark: SparkSession, paths: Sequence[str], output: str, levels: int = 1, order: Order = Order(("X", "Y", "Z", "gpstime"))) -> dict[str, str]:
    """Writes thinned tiles of all files beside ``output``, a file each: the files by the names of their assets.

    Tiles go to tasks; each writes its own, so the folder must be one that all machines share."""
    heads = [header(p) for p in paths]
    extent = tuple(f(h_[k] for h_ in ([h.low for h in heads] if f is min else [h.high for h in heads])) for f in (min, max) for k in (0, 1))
    base = os.path.splitext(os.path.basename(output))[0]
    folder = os.path.join(os.path.dirname(plain(output)), f"{base}_overviews")
    datasource.register(spark)
    points = spark.read.format("cairn_octree").option("path", json.dumps(list(paths))).load().drop("level")
    out: dict[str, str] = {}

    def writer(level: int):
        def tile(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
            name = f"L{level}_{key[0] % 2**level}_{key[0] // 2**level}"
            path = os.path.join(folder, f"{base}-overview-{name}.copc.las")
            with created(path) as f:
                las.write(f, {c: t[c].to_numpy() for c in t.columns if c not in ("tile", "overview_level")})
            return pd.DataFrame({"name": [name], "path": [path]})

        return tile

    for level in range(levels):
        done = pyramid.overview(points, extent, level, order).groupBy("tile").applyInPandas(writer(level), "name string, path string")
        for r in done.collect():  # a row for each tile
            out["overview" if level == 0 else f"overview-{r['name']}"] = r["path"]
    return out


def write(spark: SparkSession, paths: Sequence[str], output: str, boundary: bool = False, statistics: bool = False, max_depth: int = -1, overview: bool | str = False, overview_levels: int = 1) -> str:
    """Lists files in ``output``; boundary is the hull of each file's points, else its box. Statistics are over all its points
    down to max_depth. overview makes thinned tiles, or names a file that has them."""
    folder = os.path.dirname(plain(output))
    features = []
    datasource.register(spark)
    hulls: dict[str, list] = {}
    about: dict[str, list[dict]] = {}
    if paths and (boundary or statistics):
        # One scan of all files for each of the two; what comes back is a few rows for each file.
        points = spark.read.format("cairn_octree").option("path", json.dumps(list(paths))).option("fileColumn", "file").option("maxDepth", str(max_depth)).load().drop("level")
        if boundary:
            for r in stats.convex_hulls(points, "file").orderBy("file", "corner").collect():
                hulls.setdefault(r["file"], []).append([r["X"], r["Y"]])
        if statistics:
            for r in stats.attributes(points, by="file").orderBy("file", "position").collect():
                about.setdefault(r["file"], []).append({k: v for k, v in r.asDict().items() if k != "file"})
    for path in paths:
        h = header(path)
        x0, y0, z0, x1, y1, z1 = *h.low, *h.high
        ring = [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
        corners = hulls.get(path, [])
        ring = corners + corners[:1] if len(corners) >= 3 else ring
        properties = {"datetime": "2024-01-01T00:00:00Z", "pc:count": h.points, "pc:type": "lidar", "pc:encoding": "copc", "pc:schemas": schemas(h), "proj:bbox": [x0, y0, z0, x1, y1, z1], "proj:geometry": {"type": "Polygon", "coordinates": [ring]}}
        if h.wkt:
            properties |= {"proj:wkt2": h.wkt}
            if (code := crs.epsg_of(h.wkt)) is not None:
                properties["proj:epsg"] = code
        geometry, box = properties["proj:geometry"], properties["proj:bbox"]
        zone = crs.utm_zone(properties.get("proj:epsg"))
        if zone:  # GeoJSON is in degrees
            geometry = {"type": "Polygon", "coordinates": [[list(crs.from_utm(*p, *zone)) for p in ring]]}
            lons, lats = zip(*geometry["coordinates"][0], strict=True)
            box = [min(lons), min(lats), z0, max(lons), max(lats), z1]
        if statistics:
            properties["pc:statistics"] = [{**r, "position": k} for k, r in enumerate(x for x in about.get(path, []) if x["count"])]
        features.append({"type": "Feature", "stac_version": STAC_VERSION, "stac_extensions": ["https://stac-extensions.github.io/pointcloud/v1.0.0/schema.json", "https://stac-extensions.github.io/projection/v1.1.0/schema.json"], "id": os.path.splitext(os.path.basename(path))[0], "geometry": geometry, "bbox": box, "properties": properties, "links": [], "assets": {"data": {"href": _relative(path, folder), "roles": ["data"]}}})
    if not features:
        raise ValueError("no files to list")
    made = overviews(spark, paths, output, overview_levels) if overview is True else {"overview": overview} if overview else {}
    for item in features:
        item["assets"] |= {key: {"href": _relative(path, folder), "roles": ["overview"]} for key, path in made.items()}
    with created(output) as f:
        f.write(json.dumps({"type": "FeatureCollection", "features": features}).encode())
    return output


def href(item: dict) -> str | None:
    """The point file of an item."""
    assets = item.get("assets") or {}
    for name in ASSETS:
        if (assets.get(name) or {}).get("href"):
            return assets[name]["href"]
    return next((a["href"] for a in assets.values() if ".laz" in str(a.get("href", "")).lower()), None)


def _resolved(link: str, folder: str) -> str:
    if "://" in link or os.path.isabs(link):
        return link
    return f"{folder}/{link.removeprefix('./')}" if "://" in folder else os.path.normpath(os.path.join(folder, link))


def _described(item: dict, path: str) -> tuple | None:
    """A catalog row from what the item says, without the file."""
    p = item.get("properties") or {}
    box = p.get("proj:bbox") or item.get("bbox")
    if not box or len(box) not in (4, 6):
        return None
    low, high = (tuple(box[:3]), tuple(box[3:])) if len(box) == 6 else ((box[0], box[1], None), (box[2], box[3], None))
    names = {s.get("name") for s in p.get("pc:schemas") or []}
    kind = 8 if names & {"Infrared", "NIR"} else 7 if names & {"Red", "R"} else 6
    return (path, *low, *high, p.get("pc:count"), kind, p.get("proj:wkt2"), None, None, None, None)


def read(spark: SparkSession, path: str, trust: bool = True, **options) -> Catalog:
    """The catalog that a file lists: from its own words, or (trust=False, or where it says too little) from the files' headers.

    Items without an octree file are left out with a warning; none at all is an error."""
    with opened(path) as f:
        collection = json.load(f)
    if collection.get("type") != "FeatureCollection":
        raise ValueError(f"{path} is no item collection")
    folder, rows, log = os.path.dirname(plain(path)), [], logging.getLogger(__name__)
    for item in collection.get("features") or []:
        link = href(item)
        if link is None or not any(x in link.lower() for x in (".copc.laz", ".copc.las")):
            log.warning("%s has no octree file", item.get("id"))
            continue
        file = _resolved(link, folder)
        said = _described(item, file) if trust else None
        try:
            rows.append(said or row(file, header(file)))
        except (OSError, ValueError) as e:
            log.warning("%s is left out: %s", file, e)
    if not rows:
        raise ValueError(f"{path} lists no octree files")
    return Catalog(spark.createDataFrame([tuple(float(v) if k in range(1, 7) and v is not None else v for k, v in enumerate(r)) for r in rows], SCHEMA), **options)


def items(spark: SparkSession, path: str) -> DataFrame:
    """A collection's items as a table: id, href, count, box; read by Spark, for collections of any size."""
    raw = spark.read.option("multiLine", True).json(path)
    f = raw.select(F.explode("features").alias("f"))
    links = F.coalesce(*(F.get_json_object(F.to_json("f.assets"), f"$.{a}.href") for a in ASSETS))
    box = F.col("f.properties.`proj:bbox`")
    six = F.size(box) >= 6
    at = lambda a, b: F.element_at(box, F.when(six, F.lit(a)).otherwise(F.lit(b)))
    return f.select("f.id", links.alias("href"), F.col("f.properties.`pc:count`").alias("points"), at(1, 1).alias("xmin"), at(2, 2).alias("ymin"), at(4, 3).alias("xmax"), at(5, 4).alias("ymax"))
