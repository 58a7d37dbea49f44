"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
#: Lets Spark delete a query's shuffle files as it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's bound on generated methods, and the size beyond which the virtual machine only interprets them.
_LONGEST, _COMPILED = "spark.sql.codegen.hugeMethodLimit", 8000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local one is set only where none is and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; what is written there is deleted when the process ends."""
    path = f"{shared_dir(spark)}/tallyloom/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def compiled(spark: SparkSession) -> None:
    """From now on the session runs no generated method that is too long to be compiled, as long expressions make them.

    A smaller limit of the session's own stays.
    """
    if int(spark.conf.get(_LONGEST)) > _COMPILED:
        spark.conf.set(_LONGEST, str(_COMPILED))


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside leave no shuffle files and run compiled(); the session's settings are as before afterwards."""
    before = {key: spark.conf.get(key) for key in (_CLEANUP, _LONGEST)}
    spark.conf.set(_CLEANUP, "true")
    compiled(spark)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again.

    The copy survives the loss of any executor, and what made it is never run twice. What it was shuffled by is deleted once
    it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with _tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyloom_path = path
    return out


def _delete(path: str) -> None:
    spark = _written.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*written: DataFrame) -> None:
    """Delete what materialize() wrote for them, once nothing reads it any more."""
    for df in written:
        path = getattr(df, "_tallyloom_path", None)
        if path in _written:
            _delete(path)


@atexit.register
def release() -> None:
    """Delete every intermediate table of this process."""
    for path in list(_written):
        with contextlib.suppress(Exception):  # the session may be gone already
            _delete(path)
    _written.clear()
