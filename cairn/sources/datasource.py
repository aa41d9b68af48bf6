"""``spark.read.format("cairn_octree")``: octree files as a Spark data source.

The driver reads headers and hierarchy pages only, drops nodes that the options or pushed filters rule out, and deals the
rest into partitions of about equal size; executors read, unpack and filter them as Arrow batches.

Options: path (one, several joined by commas, or a JSON list), fileColumn (a name for a column of each point's file), bbox ("xmin,ymin,xmax,ymax"), zrange ("low,high"), maxDepth,
select (letters), codec, partitionPoints, mode (FAILFAST or PERMISSIVE). Writing: path, maxDepth, layout, codec, filePoints.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..schema import selected, struct_type
from . import las
from .ranges import checked, created, listed, opened, removed

PARTITION_POINTS, FILE_POINTS = 1_000_000, 5_000_000


class _Nodes(InputPartition):
    def __init__(self, path: str, nodes: list[dict]):
        super().__init__((path, len(nodes)))
        self.path, self.nodes = path, nodes


def _numbers(text: str | None, n: int) -> tuple[float, ...] | None:
    if not text:
        return None
    out = tuple(map(float, text.split(",")))
    if len(out) != n:
        raise ValueError(f"{n} numbers are needed, not {text!r}")
    return out


class OctreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cairn_octree"

    def paths(self) -> list[str]:
        given = self.options["path"]
        return [checked(p) for p in json.loads(given)] if given.startswith("[") else [checked(p.strip()) for p in given.split(",")]

    def schema(self) -> T.StructType:
        out: dict[str, T.StructField] = {}
        for path in self.paths():
            with opened(path) as f:
                h = las.read_header(f)
            whole = struct_type(h.point_format)
            for name, kind, _, _ in h.extras():
                if not kind.startswith("V"):
                    whole.add(name, T.DoubleType())
            out |= {f.name: f for f in whole if f.name not in out}
        whole = T.StructType(list(out.values())).add("level", T.IntegerType())
        out = T.StructType([whole[c] for c in selected(self.options.get("select"), whole.names)])
        return out.add(self.options["filecolumn"], T.StringType()) if self.options.get("filecolumn") else out

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return OctreeReader(self.paths(), schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return OctreeWriter(schema, dict(self.options), overwrite)


class OctreeReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: T.StructType, options: dict):
        self.paths, self.columns, self.options = paths, schema.names, options
        self.box = list(_numbers(options.get("bbox"), 4) or (-np.inf, -np.inf, np.inf, np.inf))
        self.z = list(_numbers(options.get("zrange"), 2) or (-np.inf, np.inf))
        self.depth = int(options.get("maxdepth", -1))
        self.exact = (tuple(self.box), tuple(self.z))

    def pushFilters(self, filters: list) -> Iterator:
        """Comparisons of coordinates and level narrow the nodes; Spark still applies all filters itself."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)) and len(f.attribute) == 1:
                name, low, high = f.attribute[0], isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)), isinstance(f, (LessThan, LessThanOrEqual, EqualTo))
                if name in ("X", "Y"):
                    k = "XY".index(name)
                    self.box[k] = max(self.box[k], f.value) if low else self.box[k]
                    self.box[k + 2] = min(self.box[k + 2], f.value) if high else self.box[k + 2]
                elif name == "Z":
                    self.z = [max(self.z[0], f.value) if low else self.z[0], min(self.z[1], f.value) if high else self.z[1]]
                elif name == "level" and high:
                    self.depth = f.value if self.depth < 0 else min(self.depth, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        most, out = int(self.options.get("partitionpoints", PARTITION_POINTS)), []
        for path in self.paths:
            with opened(path) as f:
                nodes = las.select_nodes(f, las.read_header(f), tuple(self.box), tuple(self.z), self.depth)
            own, n = [], 0
            for e in nodes:
                if own and n + e["point_count"] > most:
                    out.append(_Nodes(path, own))
                    own, n = [], 0
                own.append(e)
                n += e["point_count"]
            if own:
                out.append(_Nodes(path, own))
        return out

    def read(self, partition: _Nodes) -> Iterator[pa.RecordBatch]:
        (x0, y0, x1, y1), (z0, z1) = self.exact
        with opened(partition.path) as f:
            h = las.read_header(f)
            for c in las.read_points(f, h, partition.nodes, self.options.get("codec"), self.options.get("mode", "").upper() == "PERMISSIVE"):
                keep = (c["X"] >= x0) & (c["X"] <= x1) & (c["Y"] >= y0) & (c["Y"] <= y1) & (c["Z"] >= z0) & (c["Z"] <= z1)
                n = int(keep.sum())
                name = self.options.get("filecolumn")
                column = lambda k: pa.array([partition.path] * n, pa.string()) if k == name else pa.array(c[k][keep]) if k in c else pa.nulls(n, pa.float64() if k not in struct_type().names else pa.int32())
                yield pa.RecordBatch.from_arrays([column(k) for k in self.columns], self.columns)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class OctreeWriter(DataSourceArrowWriter):
    """Files of filePoints points at most, so many a task holds; ``part-NNNNN.copc.las`` in a folder. Points are written by
    node within a file."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.names, self.options = schema.names, options
        self.most = int(options.get("filepoints", FILE_POINTS))
        self.folder = options["path"].rstrip("/")
        self.old = listed(self.folder)
        if self.old and not overwrite:
            raise FileExistsError(f"{self.folder} isn't empty")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        held, n, files = [], 0, []
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= self.most:
                files.append(self._file(pa.Table.from_batches(held), len(files)))
                held, n = [], 0
        if held:
            files.append(self._file(pa.Table.from_batches(held), len(files)))
        return _Written(files)

    def _file(self, table: pa.Table, number: int) -> str:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{self.folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}{f'-{number}' if number else ''}.copc.las"
        columns = {c: table.column(k).to_numpy() for k, c in enumerate(self.names)}
        depth = self.options.get("maxdepth")
        with created(name) as f:
            las.write(f, columns, None if depth is None else int(depth), self.options.get("wkt"), codec=self.options.get("codec", "raw"), layout=self.options.get("layout", "leaf"))
        return name

    def commit(self, messages: list) -> None:
        for path in self.old:
            removed(path)

    def abort(self, messages: list) -> None:
        for m in messages:
            for path in m.files if m else []:
                removed(path)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it push filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OctreeSource)
