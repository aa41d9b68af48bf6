"""What the operators share: the shared folder, written cuts of lineage, and bounds on Arrow batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch at most; a batch with one longer row holds that row alone.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The characters that end a word: space and the controls 9 to 13.
BLANK, NOT_BLANK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\f\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is set, as in tests, a local master gets one of its own; a cluster,
    whose executors couldn't read it, is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and every executor can read it again.

    Its shuffle files go when it is written, as nothing reads them any more. The table goes with ``forget``, or when
    Python ends."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[path] = spark
    table._cairn_path = path
    return table


#: Paths of written tables, and the sessions that wrote them.
_tables: dict[str, SparkSession] = {}


def forget(*tables: DataFrame | None) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_cairn_path", None)
        if path in _tables:
            _delete(_tables.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@atexit.register
def _delete_all() -> None:
    while _tables:
        path, spark = _tables.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the JVM is gone before Python; its shared folder is left to the cluster
            return


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are held in memory whole, so their rows and bytes get a bound (a lower one stays)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.sub(r"b$", "", str(spark.conf.get(key)))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def text_of(column: str | Column = "text") -> Column:
    """A text column with null as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than blanks, as an array."""
    return F.array_remove(F.split(text, BLANK + "+"), "")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it from clashing with a column of docs."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` computed once, however often ``x`` stands in the body."""
    return F.transform(F.array(value), body)[0]
