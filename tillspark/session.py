"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_recorders: list[list[str]] = []


def get_spark(app_name: str = "tillspark", master: str | None = None,
              **settings: str) -> SparkSession:
    """A session with the settings the library is written for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_settings(table_bytes: int, target_mb: int = 200) -> dict[str, str]:
    """Settings that keep a shuffled part of a table near ``target_mb``.

    Adaptive execution joins small parts again, so the number is an upper
    bound; it only has to be large enough for the parts to fit in memory.
    """
    parts = max(200, -(-table_bytes // (target_mb * 1024 * 1024)))
    return {"spark.sql.shuffle.partitions": str(parts),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{target_mb}m",
            "spark.sql.files.maxPartitionBytes": f"{target_mb}m"}


@cache
def _own_folder() -> str:
    """One temporary folder a process; a running session's setting is fixed."""
    return tempfile.mkdtemp(prefix="tillspark-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that every executor can reach.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a local
    session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a shared folder")
        root = _own_folder()
    return f"{root.rstrip('/')}/tillspark/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once for each Spark context.

    A worker may start where the driver's import path means nothing.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tillspark_given", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(SparkFiles.getRootDirectory()) / "given" / f"{package.name}.zip"
    archive.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, str(file.relative_to(package.parent)))
    sc.addPyFile(str(archive))
    sc._tillspark_given = True


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read, not a
    recomputation, and later readers still get column pruning and pushdown.
    """
    spark = df.sparkSession
    target = path or shared_path(spark, name)
    df.write.mode("overwrite").parquet(target)
    for paths in _recorders:
        paths.append(target)
    return spark.read.schema(df.schema).parquet(target)


@contextmanager
def recording() -> Iterator[list[str]]:
    """The paths that ``stage`` writes meanwhile, for ``drop`` when they are done with."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [r for r in _recorders if r is not paths]


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables and forget their paths; none may still be read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)
