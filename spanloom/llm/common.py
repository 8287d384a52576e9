"""What the text operators share: scratch tables, white space, sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of [\x20\x09-\x0D].
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: A run of anything else: one word.
WORD = r"[^\x20\x09-\x0D]+"
#: A side up to this many bytes, as counted, may be broadcast.
BROADCAST_BYTES = 16 << 20


#: A stored table's own query keeps its shuffle files no longer than it runs.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Spark's limit of an Arrow batch, and ours for texts.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: The scopes that are open in this thread or task of work, outermost first; each lists its tables.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scratch_scopes", default=())
#: Folders of local sessions that name none, by application.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without it (tests) gets a folder of its own; a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spanloom-")
    return _own_dirs[app]


def small_arrow_batches(spark: SparkSession) -> None:
    """From now on Arrow batches hold about BATCH_BYTES where the session sets no limit of its own: ten thousand texts of any length may not fit a worker."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings, for what is run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, but for those stored with keep; these belong to the scope around."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            drop_scratch(spark, path)


def scratch_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh path for a table of this run in the shared folder."""
    path = f"{shared_dir(spark)}/spanloom/{uuid.uuid4().hex}/{label}"
    scopes = _scopes.get()[:-1] if keep else _scopes.get()
    if scopes:
        scopes[-1].append(path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a table written to scratch_path once nothing reads it any more."""
    target, files = _of_path(spark, path)
    files.delete(target, True)
    files.cancelDeleteOnExit(target)


def _of_path(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here and survives lost executors. keep: see scratch_scope."""
    spark = df.sparkSession
    path = scratch_path(spark, label, keep)
    with settings(spark, LEAN):
        df.write.parquet(path)
    target, files = _of_path(spark, path)
    files.deleteOnExit(target)  # a result that its caller still reads goes with the session
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs as key, doc_id, text with a key of each row; whether the key is doc_id, which is so where that is unique and never null.

    Else the rows are numbered and written, so that every read gives the same numbers."""
    counts = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if counts["rows"] == counts["ids"]:
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text"), True
    return stored(rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "rows"), False


def without_white_space(text: Column) -> Column:
    """text (null: empty) without the characters of [\x20\x09-\x0D]."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A packed bitmap of 2**bits cells, in which those of the leading bits of a long column are set; gathered by 32,768 cells."""
    x = F.shiftrightunsigned(column, 64 - bits) + 1
    parts = rows.groupBy(F.bitmap_bucket_number(x).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits")).collect()
    packed = np.zeros(max(1 << bits >> 3, 4096), np.uint8)
    for r in parts:
        packed[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return packed


def in_bitmap(packed: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    """Whether the cells of values are set in a bitmap."""
    cells = (values >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def is_small(rows: int, row_bytes: int) -> bool:
    """Whether a counted side may be broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES
