"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate words: space and U+0009 to U+000D. ``bytes.split``
#: and ``bytes.strip`` without arguments use exactly these.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Texts that a task has in Python at one time.
TEXTS_AT_ONCE = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once for each Spark context.

    A worker may start where the driver's import path means nothing.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tillspark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(SparkFiles.getRootDirectory(), "packages")
    os.makedirs(target, exist_ok=True)
    archive = os.path.join(target, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, str(file.relative_to(package.parent)))
    sc.addPyFile(archive)
    sc._tillspark_shipped = True


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)


def text_map(df: DataFrame, column: str, fields: list[tuple[str, T.DataType]],
             setup: Callable[[], Callable], keep: bool | list[str] = True) -> DataFrame:
    """Add columns computed in Python from one text column, batch by batch.

    ``setup`` runs once a task and returns a function from a list of texts
    (``None`` for null) to one list for each of ``fields``. ``keep`` names the
    input columns that go on, all by default.
    """
    ship(df.sparkSession)
    names = df.columns if keep is True else list(keep)
    kept = [f for f in df.schema.fields if f.name in names]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in fields]])
    types = [_arrow(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = setup()
        for batch in _slices(batches):
            made = compute(batch.column(batch.schema.get_field_index(column)).to_pylist())
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            arrays += [v if isinstance(v, pa.Array) else pa.array(v, t)
                       for v, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        pa.default_memory_pool().release_unused()  # the worker waits for its next task

    inner = df.select(*[quoted(c) for c in dict.fromkeys([*(f.name for f in kept), column])])
    return inner.mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
            "string": pa.string(), "binary": pa.binary(),
            "boolean": pa.bool_()}[t.simpleString()]
