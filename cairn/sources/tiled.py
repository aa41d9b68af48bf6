"""Points of any number as octree files, one for each square tile: nodes are packed in parallel, files are put together from parts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import ExitStack
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.octree import Cube, depth_for
from ..schema import RECORD_BYTES, Order, point_format
from . import las
from .ranges import created, opened, removed_folder

TILE, KEYS = ("__tx", "__ty"), ("__kx", "__ky", "__kz")
#: Bytes of a part that are copied at a time, and tasks that put files together at most.
COPIED, MOST_TASKS = 8 << 20, 1024
_PART = "tx long, ty long, part long, path string, entries binary"


def _packer(folder: str, header: las.Header, columns: Sequence[str]):
    """Of rows in the order of tile and node: a file of point records for each tile met, and where its nodes lie in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tile, path, f, entries = None, "", None, []

        def done() -> pa.RecordBatch:
            raw = np.array([tuple(e) for e in entries], las.NODE).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*tile, part, path, raw), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["tx", "ty", "part", "path", "entries"])

        with ExitStack() as stack:
            for b in batches:
                if not b.num_rows:
                    continue
                own = {c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (*columns, *TILE, *KEYS, "__level")}
                keys = np.column_stack([own[c] for c in (*TILE, "__level", *KEYS)])
                records = las.pack({c: own[c] for c in columns}, header)
                cuts = np.flatnonzero(np.any(np.diff(keys, axis=0), 1)) + 1
                for i, j in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                    here, node = tuple(keys[i, :2].tolist()), keys[i, 2:].tolist()
                    if here != tile:
                        if tile is not None:
                            stack.close()
                            yield done()
                        tile, path, entries = here, f"{folder}/{part}-{uuid.uuid4().hex}", []
                        f = stack.enter_context(created(path, sequential=True))
                    raw = records[i:j].tobytes()
                    f.write(raw)
                    if entries and entries[-1][:4] == node:
                        entries[-1][5] += len(raw)
                        entries[-1][6] += j - i
                    else:
                        entries.append([*node, entries[-1][4] + entries[-1][5] if entries else 0, len(raw), j - i])
        if tile is not None:
            yield done()

    return run


def _joiner(folder: str, header: las.Header):
    """The parts of a tile, one after the other, as its file."""

    def run(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        entries = [np.frombuffer(raw, las.NODE).copy() for raw in parts["entries"]]
        sizes = [int(e["size"].astype(np.int64).sum()) for e in entries]
        for e, before in zip(entries, np.cumsum([0, *sizes]).tolist(), strict=False):
            e["offset"] += np.uint64(before)
        t = parts.iloc[0]
        low, high = (tuple(float(t[f"{c}{end}"]) for c in "XYZ") for end in ("min", "max"))
        h = replace(header, records=list(header.records), points=int(t["n"]), low=low, high=high, times=(float(t["tmin"]), float(t["tmax"])), by_return=tuple(int(v) for v in t["returns"]), cube=Cube.around(low, high))
        h.spacing = 2 * h.cube.half

        def data() -> Iterator[bytes]:
            for path in parts["path"]:
                with opened(path) as f:
                    while raw := f.read(COPIED):
                        yield raw

        path = f"{folder}/{key[0]}_{key[1]}.copc.las"
        with created(path, sequential=True) as f:
            las.put(f, h, np.concatenate(entries), data())
        return pd.DataFrame({"path": [path]})

    return run


def write(points: DataFrame, folder: str, size: float, order: Order, columns: Sequence[str], scale: tuple[float, float, float], wkt: str | None = None) -> list[str]:
    """All points as files ``x_y.copc.las`` in a folder that all machines share; the paths, in order.

    A first pass counts each tile and takes its box; the rest is a sort of all points by tile and node, whose ranges are packed as
    they stream by, so no task holds a tile. Then each tile's parts are copied into its file. The driver sees a row for each
    tile."""
    spark = points.sparkSession
    header = las.Header(scale=scale, point_format=point_format(list(columns)))
    header.record_bytes = RECORD_BYTES[header.point_format]
    if wkt:
        header.with_wkt(wkt)
    tx, ty = TILE
    tiled = points.select(*dict.fromkeys([*order.columns, *columns])).withColumns({t: F.floor(F.col(c) / size).cast("bigint") for t, c in zip(TILE, "XY", strict=True)})
    box = [f(c).cast("double").alias(f"{c}{end}") for end, f in (("min", F.min), ("max", F.max)) for c in "XYZ"]
    returns = F.array(*(F.count_if(F.col("ReturnNumber") == k) for k in range(1, 16))).alias("returns")
    about = tiled.groupBy(*TILE).agg(F.count(F.lit(1)).alias("n"), *box, F.min("gpstime").cast("double").alias("tmin"), F.max("gpstime").cast("double").alias("tmax"), returns)
    found = [r.asDict() for r in about.collect()]
    if not found:
        return []
    for r in found:
        cube, r["level"] = Cube.around(tuple(r[f"{c}min"] for c in "XYZ"), tuple(r[f"{c}max"] for c in "XYZ")), depth_for(r["n"])
        r |= {f"{c}low": o - cube.half for c, o in zip("XYZ", (cube.x, cube.y, cube.z), strict=True)} | {"side": 2 * cube.half / 2 ** r["level"]}
    doubles = [*(f"{c}{end}" for c in "XYZ" for end in ("min", "max", "low")), "tmin", "tmax", "side"]
    kinds = {tx: "long", ty: "long", "n": "long", "level": "int", "returns": "array<long>"} | {c: "double" for c in doubles}
    tiles = spark.createDataFrame([tuple(r[c] for c in kinds) for r in found], ", ".join(f"{c} {t}" for c, t in kinds.items()))
    cubes = tiles.select(*TILE, F.col("level").alias("__level"), *(F.col(f"{c}low").alias(f"__{c}low") for c in "XYZ"), F.col("side").alias("__side"))
    most = F.expr("shiftleft(1L, __level) - 1")
    keyed = tiled.join(F.broadcast(cubes), list(TILE)).withColumns({k: F.least(F.greatest(F.floor((F.col(c) - F.col(f"__{c}low")) / F.col("__side")), F.lit(0).cast("bigint")), most) for k, c in zip(KEYS, "XYZ", strict=True)})
    keyed = keyed.drop("__side", *(f"__{c}low" for c in "XYZ"))
    own = f"{folder}/parts-{uuid.uuid4().hex}"
    parts = keyed.repartitionByRange(*TILE, *KEYS).sortWithinPartitions(*TILE, *KEYS, *order.by()).mapInArrow(_packer(own, header, columns), _PART)
    whole = parts.withColumnsRenamed({"tx": tx, "ty": ty}).join(F.broadcast(tiles), list(TILE)).repartition(min(len(found), MOST_TASKS), *TILE)
    paths = sorted(r["path"] for r in whole.groupBy(*TILE).applyInPandas(_joiner(folder, header), "path string").collect())  # a row for each tile
    removed_folder(own)
    return paths
