"""Scoring requests from CSV and JSON files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NUMBER_PATTERN
from ..schema import REQUEST_SCHEMA, RequestError

# ---- fixed values ----
REQUEST_REQUIRED = ("date", "product_id", "price")
REQUEST_FLAGS = ("snap_day", "holiday", "has_named_event")
FEATURE_NAME_PATTERN = r"^(lag_|rolling_|expanding|price_change|price_pct)"
FEATURES_TYPE = "array<struct<name:string,value:double>>"

# Flags are read as text: a typed read turns a bad one into NULL.
_ONE = T.StructType([T.StructField(f.name, T.StringType()) if f.name in REQUEST_FLAGS else f
                     for f in REQUEST_SCHEMA.fields])
JSON_SCHEMA = T.StructType([*_ONE.fields, T.StructField("requests", T.ArrayType(_ONE))])


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def _flag(text: Column) -> Column:
    """A flag as number; NULL when blank, NaN when it is no number at all.

    Scoring takes 0 and 1 only, so that NaN and fractions are rejected there.
    """
    return F.when(F.trim(text) != "", F.coalesce(_number(text), F.lit(float("nan"))))


def feature_list(values: dict[str, Column]) -> Column:
    """A list of (name, value) from text columns.

    Blank values are left out; a value that is no number stays in the list
    as NULL, which scoring treats as unknown.
    """
    if not values:
        return F.array().cast(FEATURES_TYPE)
    entries = []
    for name, text in values.items():
        given = text.isNotNull() & (F.trim(text) != "")
        entries.append(F.when(given, F.struct(
            F.lit(name).alias("name"), _number(text).alias("value"))))
    return F.filter(F.array(*entries), lambda e: e.isNotNull()).cast(FEATURES_TYPE)


def read_requests_csv(spark: SparkSession, path: str) -> DataFrame:
    """One request per CSV row.

    Flags are taken when not blank, history feature columns become the
    feature list, other columns are ignored. A row with a wrong number of
    cells fails the read.
    """
    header = spark.read.option("header", True).csv(path).columns
    names = [h.strip() for h in header]
    missing = [c for c in REQUEST_REQUIRED if c not in names]
    if missing:
        raise RequestError(f"CSV is missing required column(s): {missing}")
    schema = ", ".join(f"`{n}` STRING" for n in names)
    raw = (spark.read.option("header", True).option("mode", "FAILFAST")
           .option("enforceSchema", False)  # another header order raises
           .option("escape", '"')
           .option("columnPruning", False)  # pruned reads skip the cell count
           .option("ignoreLeadingWhiteSpace", True)
           .option("ignoreTrailingWhiteSpace", True)
           .schema(schema).csv(path))
    flags = [(_flag(F.col(f)) if f in names else F.lit(None).cast("double")).alias(f)
             for f in REQUEST_FLAGS]
    features = {n: F.col(f"`{n}`") for n in names
                if re.match(FEATURE_NAME_PATTERN, n)}
    return raw.select(
        "date", "product_id", _number(F.col("price")).alias("price"), *flags,
        feature_list(features).alias("features"))


def read_requests_json(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Requests from JSON: objects, arrays of them, or ``{"requests": [...]}``.

    Each line holds one of the three; with ``whole_files`` a file may spread
    over any lines, and one task then reads it as a whole.
    """
    return parse_requests(
        spark.read.schema(JSON_SCHEMA).option("multiLine", whole_files).json(path))


def parse_requests(raw: DataFrame) -> DataFrame:
    """Request rows from ``JSON_SCHEMA``: wrapped ones unpacked, flags checked."""
    single = F.array(F.struct(*[F.col(f.name) for f in _ONE.fields]))
    rows = raw.select(F.explode(F.coalesce("requests", single)).alias("r")).select("r.*")
    return rows.withColumns({f: _flag(F.col(f)) for f in REQUEST_FLAGS})
