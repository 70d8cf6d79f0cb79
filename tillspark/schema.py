"""Names, types and limits of the daily product-store sales model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------
REQUIRED_COLUMNS = ("date", "product_id", "sales_quantity", "store_id")
OPTIONAL_COLUMNS = (
    "product_name", "category", "price", "promotion", "snap_day", "holiday",
    "event_name", "discount", "current_stock",
)
ANALYTICS_COLUMNS = ("date", "product_id", "sales_quantity")
FEATURE_COLUMNS = ("date", "product_id", "sales_quantity")
SPARSE_BY_DESIGN = ("event_name",)
SERIES_COLUMNS = ("product_id", "store_id")
KEY_COLUMNS = ("date", "product_id", "store_id")
STATIC_COLUMNS = ("product_name", "category")
FLAG_COLUMNS = ("holiday", "snap_day", "promotion")
NO_EVENT = "none"
TARGET = "sales_quantity"
MISSING_WARN_FRACTION = 0.05
MAX_UNREADABLE_FRACTION = 0.05  # of the filled numeric cells of a raw file
MAX_BAD_DATE_FRACTION = 0.05
IQR_MULTIPLIER = 3.0
STD_MULTIPLIER = 4.0
DATE_FORMAT = "yyyy-MM-dd"
# Text that a CSV reader of data frames takes for a missing value.
MISSING_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# -------------------------------------------------------------------------

SALES_TYPES: dict[str, T.DataType] = {
    "date": T.DateType(),
    "product_id": T.StringType(),
    "product_name": T.StringType(),
    "category": T.StringType(),
    "sales_quantity": T.LongType(),
    "price": T.DoubleType(),
    "snap_day": T.IntegerType(),
    "holiday": T.IntegerType(),
    "promotion": T.IntegerType(),
    "event_name": T.StringType(),
    "store_id": T.StringType(),
    "discount": T.DoubleType(),
    "current_stock": T.DoubleType(),
    "is_gap_fill": T.IntegerType(),
    "outlier_flag": T.IntegerType(),
}

REQUEST_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("snap_day", T.IntegerType()),
    T.StructField("holiday", T.IntegerType()),
    T.StructField("has_named_event", T.IntegerType()),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]))),
])


class DataQualityError(Exception):
    """Data with problems that have no safe automatic repair."""

    def __init__(self, errors: list[str]) -> None:
        self.errors = list(errors)
        super().__init__("; ".join(self.errors))


class FeatureInputError(ValueError):
    """Input or settings on which history features would be wrong."""


class AnalyticsInputError(ValueError):
    """Input on which a report cannot be computed."""


class TrainingInputError(ValueError):
    """Input or settings on which training would be wrong."""


class RequestError(ValueError):
    """A batch of scoring requests that must not be scored."""


class ModelBundleError(ValueError):
    """A saved model that is absent or incomplete."""


def series_columns(df: DataFrame) -> list[str]:
    """The columns that name a series: product, and store where present."""
    return [c for c in SERIES_COLUMNS if c in df.columns]


def flag_columns(df: DataFrame) -> list[str]:
    return [c for c in FLAG_COLUMNS if c in df.columns]


def missing_columns(df: DataFrame, wanted) -> list[str]:
    return [c for c in wanted if c not in df.columns]
