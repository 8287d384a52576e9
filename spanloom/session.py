"""Session and table helpers shared by the library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def small_arrow_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From now on Arrow batches hold about `size` bytes where the session sets no limit of its own: rows here may be blocks of a megabyte."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(size))


#: Folders of local sessions that name none, by application.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without the setting gets a folder of its own; a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spanloom-")
    return _own_dirs[app]


def files_of(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, so that its lineage ends there; the table goes with the session, as its readers may live as long."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    target, files = files_of(spark, path)
    files.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; works for a file or a folder in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
