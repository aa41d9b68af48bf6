"""STAC search: items that meet an area, signed links, reads of many tiles as one table, downloads."""

from __future__ import annotations

import json
import os
import re
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs
from ..functions.geometry import Area
from ..operators.thinning import head, voxel_thin
from ..plans.filters import Filter
from ..schema import Order, merged, select
from . import datasource, vpc
from .ranges import listed

DEFAULT_COLLECTIONS = ("3dep-lidar-copc",)
POINT_ORDER = Order(("X", "Y", "Z", "gpstime"))


def is_search(url: str) -> bool:
    """Whether a URL is of a catalog to search rather than of a file."""
    low = url.lower()
    return low.startswith(("http://", "https://")) and not low.split("?")[0].endswith(".laz") and bool(re.search(r"/stac(?:/|$)|/search(?:$|\?)", low))


def _posted(url: str, body: dict | None) -> dict:
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=60) as r:
            return json.load(r)
    except urllib.error.HTTPError as e:
        raise OSError(f"{url}: {e.code} {e.read()[:500].decode('utf-8', 'replace')}") from e


def search(url: str, area: Area, collections: Sequence[str] = DEFAULT_COLLECTIONS, limit: int = 1000) -> Iterator[dict]:
    """Items that intersect an area in degrees, page after page, ``limit`` at most."""
    url = url.rstrip("/")
    url = url if url.endswith("/search") else f"{url}/search"
    body: dict | None = {"intersects": area.geojson(), "collections": list(collections), "limit": min(limit, 250)}
    found, first = 0, body
    while url and found < limit:
        page = _posted(url, body)
        for item in page.get("features") or []:
            if found == limit:
                return
            found += 1
            yield item
        more = next((x for x in page.get("links") or [] if x.get("rel") == "next"), None)
        if not more or not page.get("features"):
            return
        url = more["href"]
        posts = more.get("method", "GET").upper() == "POST"
        body = ((first if more.get("merge") else {}) | (more.get("body") or {}) or first) if posts else None


def token(url: str, collection: str) -> str:
    """A signature for the links of a collection."""
    return _posted(f"{url.rstrip('/')}/{collection}", None)["token"]


def signed(link: str, signature: str | None) -> str:
    return link if not signature else f"{link}{'&' if '?' in link else '?'}{signature}"


def epsg(item: dict) -> int | None:
    """The code of an item's coordinates, wherever it says so."""
    p = item.get("properties") or {}
    if p.get("proj:epsg"):
        return int(p["proj:epsg"])
    if m := re.fullmatch(r"EPSG:(\d+)", str(p.get("proj:code", ""))):
        return int(m[1])
    parts = (p.get("proj:projjson") or {}).get("components") or [p.get("proj:projjson") or {}]
    return ((parts[0].get("id") or {}).get("code")) or crs.epsg_of(p.get("proj:wkt2"))


def read_items(spark: SparkSession, items: Sequence[dict], area: Area, letters: str | None = None, filter: str | None = None, max_points: int = -1, signature: str | None = None, max_depth: int = -1, order: Order = POINT_ORDER) -> DataFrame:
    """The points of all items within an area given in degrees; voxels are thinned tile by tile. With max_points, the first so many
    points of the clipped items, item by item and in order within each."""
    datasource.register(spark)
    rule, parts, wanted = Filter.parse(filter), [], []
    for k, item in enumerate(items):
        link = vpc.href(item)
        if link is None:
            continue
        own = crs.area_to(area, 4326, code) if (code := epsg(item)) else area
        df = spark.read.format("cairn_octree").option("path", signed(link, signature)).option("bbox", ",".join(map(repr, own.bounds()))).option("maxDepth", str(max_depth)).load()
        df = rule.where(df).where(own.holds())
        df = voxel_thin(df, rule.voxel, order) if rule.voxel else df
        kept = select(df, letters)
        wanted += [c for c in kept.columns if c not in wanted]
        more = [c for c in order.columns if c in df.columns and c not in kept.columns] if max_points > 0 else []
        parts.append(df.select(*kept.columns, *more, F.lit(item.get("id")).alias("item_id"), F.lit(k).alias("item_number")))
    if not parts:
        raise ValueError("no item has a point file")
    df = merged(parts)
    if max_points > 0:
        df = head(df, max_points, Order(("item_number", *(c for c in order.columns if c in df.columns))))
    return df.select(*wanted, "item_id")


def download(spark: SparkSession, items: Sequence[dict], area: Area, folder: str, merge: bool = False, overwrite: bool = False, **options) -> DataFrame:
    """Writes the clipped points of each item (or of all as one) to a folder of its own, by the tasks that read them: item_id, file,
    n_points, written."""
    groups = [("merged", list(items))] if merge else [(i.get("id"), [i]) for i in items]
    rows = []
    for name, own in groups:
        path = os.path.join(folder, str(name))
        if listed(path) and not overwrite:
            rows.append((name, path, None, False))
            continue
        df = read_items(spark, own, area, **options).drop("item_id", "level").persist()
        n = df.count()
        if n:
            df.write.format("cairn_octree").mode("append").option("path", path).save()
        df.unpersist()
        rows.append((name, path, n, n > 0))
    return spark.createDataFrame(rows, "item_id string, file string, n_points long, written boolean")
