"""Session defaults and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Correct on one core and on a thousand executors: sizes are left to AQE, which
# merges small shuffle partitions, splits skewed ones and turns a join into a
# broadcast only after it has seen the real size of the side.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # the JVM does not compile methods beyond 8000 bytes: above that, per-operator
    # code in small methods is several times faster than one interpreted loop
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # a busy sensor's readings become sessions where they are read, not in one task
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_local_scratch: dict[str, str] = {}


def get_session(app_name: str = "skyledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the library depends on in a session someone else created; sizes stay as they are."""
    for key in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit",
                "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"):
        if spark.conf.get(key, None) != SESSION_CONF[key]:
            spark.conf.set(key, SESSION_CONF[key])
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, read from ``spark.checkpoint.dir``."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="skyledger-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{_app_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _app_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/skyledger-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results read from them must be consumed first."""
    delete_path(spark, _app_folder(spark))


def _folder(spark: SparkSession, path: str) -> tuple:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table; nothing happens if there is none."""
    folder, files = _folder(spark, path)
    files.delete(folder, True)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go when their job ends, not when the driver next collects garbage.

    For jobs whose result is stored: until they end nothing is released, so lost executors are made up for as ever.
    """
    with _setting(spark, _RELEASE, "true"):
        yield


@contextmanager
def open_writers(spark: SparkSession, count: int) -> Iterator[None]:
    """Tasks of the writes inside keep up to ``count`` partitions' files open instead of sorting all rows by partition.

    The sort takes rows with all their columns to memory and, where that is short, to disk.
    """
    with _setting(spark, _WRITERS, str(count)):
        yield


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder once and read it back.

    Used where a later step must see the very rows (and partition ids) an
    earlier one produced, also after an executor is lost. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with released_shuffles(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
