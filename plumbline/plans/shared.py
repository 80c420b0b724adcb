"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a parquet table below ``spark.checkpoint.dir``: unlike
a local checkpoint it survives the loss of any executor, and unlike a cached
frame its size is known to the planner, so later joins see true statistics.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_ENDING: set[str] = set()
_LOCK = threading.RLock()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only on a single machine, as in tests, may it be unset:
    then a temporary one is made and set. A cluster without it is an error, since a folder of one
    machine would lose what the others need."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _set_on_context(spark)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
        _OWN.append(base[len("file://"):])
    return base.rstrip("/")


def _set_on_context(spark: SparkSession) -> str | None:
    """The folder that the session's owner gave to the context instead of the settings."""
    get = getattr(spark.sparkContext, "getCheckpointDir", None)
    return get() if get else None


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` once into the shared folder, in folders by a column if asked, and reads it back."""
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/plumbline-{spark.sparkContext.applicationId}"
    path = f"{home}/{tag}-{uuid.uuid4().hex[:12]}"
    _delete_at_end(spark, home)
    # the plan is run once and never again, so its shuffle files can go at its end
    with _LOCK:  # the setting is read when the plan starts; threads that write take turns
        before = spark.conf.get(_CLEAN, None)
        spark.conf.set(_CLEAN, "true")
        try:
            (df.write if by is None else df.write.partitionBy(by)).parquet(path)
        finally:
            spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def _delete_at_end(spark: SparkSession, home: str) -> None:
    """Tables that nothing has discarded go when the driver ends, whatever folder they are in."""
    if home not in _ENDING:
        _ENDING.add(home)
        sc = spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(home)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(target)


def discard(df: DataFrame | None) -> None:
    """Deletes a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_plumbline_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)
