"""Reading sales and raw retail files, writing tables and summaries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import to_date, to_number
from ..functions.columns import NUMBER_PATTERN
from ..schema import DATE_FORMAT, MISSING_TEXT, SALES_TYPES, series_columns

# ---- fixed values: names of the raw files, first sales file found wins ----
RAW_SALES_FILES = (
    "sales_train_evaluation.csv", "sales_train_validation.csv",
)
RAW_CALENDAR_FILE = "calendar.csv"
RAW_PRICES_FILE = "sell_prices.csv"


#: A quote inside a quoted cell is written twice, as other readers expect.
QUOTING = {"header": True, "quote": '"', "escape": '"'}


def _read_text_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A headed CSV with every column as text and missing marks as NULL.

    ``multi_line`` allows line breaks in quoted cells; such a file is read by
    one task.
    """
    raw = spark.read.options(**QUOTING, multiLine=multi_line).csv(path)
    return raw.select(*[
        F.when(~F.col(f"`{c}`").isin(*MISSING_TEXT), F.col(f"`{c}`")).alias(c)
        for c in raw.columns])


def conform_sales(df: DataFrame, fmt: str = DATE_FORMAT) -> DataFrame:
    """Cast the known columns to the types of the model, keep the others.

    Values that do not fit become NULL; use the cleaning checks first where
    such values must be reported.
    """
    out = []
    for name in df.columns:
        want = SALES_TYPES.get(name)
        if want is None or df.schema[name].dataType == want:
            col = F.col(name)
        elif isinstance(want, T.DateType):
            col = to_date(df, name, fmt)
        elif isinstance(want, T.StringType):
            col = F.col(name).cast("string")
        else:
            col = to_number(df, name).try_cast(want)
        out.append(col.alias(name))
    return df.select(*out)


def read_sales_csv(spark: SparkSession, path: str, parse: bool = False,
                   fmt: str = DATE_FORMAT, multi_line: bool = False) -> DataFrame:
    """Sales from CSV: raw text for cleaning, or typed with ``parse=True``."""
    raw = _read_text_table(spark, path, multi_line)
    return conform_sales(raw, fmt) if parse else raw


def read_sales_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _read_if_there(spark: SparkSession, path: str, multi_line: bool) -> DataFrame | None:
    try:
        return _read_text_table(spark, path, multi_line)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _raw_texts(spark: SparkSession, raw_dir: str, multi_line: bool,
               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = raw_dir.rstrip("/")
    tables = (_read_if_there(spark, f"{base}/{n}", multi_line) for n in RAW_SALES_FILES)
    sales = next((t for t in tables if t is not None), None)
    if sales is None:
        raise FileNotFoundError(
            f"no sales file in {raw_dir}; expected one of {RAW_SALES_FILES}")
    rest = []
    for name in (RAW_CALENDAR_FILE, RAW_PRICES_FILE):
        table = _read_if_there(spark, f"{base}/{name}", multi_line)
        if table is None:
            raise FileNotFoundError(f"missing raw file {base}/{name}")
        rest.append(table)
    return sales, *rest


def _whole_columns(df: DataFrame) -> list[str]:
    """Columns of a raw file that hold whole numbers."""
    return [c for c in df.columns if c.startswith(("d_", "snap_")) or c == "wm_yr_wk"]


def read_raw_files(spark: SparkSession, raw_dir: str, multi_line: bool = False,
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The wide sales matrix, the calendar and the weekly prices.

    ``3.0`` is a whole number. Cells that hold no number become NULL;
    ``unreadable_cells`` counts them. With ``multi_line`` quoted cells may hold
    line breaks, and one task then reads a file as a whole.
    """
    sales, calendar, prices = (
        t.withColumns({c: F.coalesce(F.col(c).try_cast("bigint"),
                                     to_number(t, c).try_cast("bigint"))
                       for c in _whole_columns(t)})
        for t in _raw_texts(spark, raw_dir, multi_line))
    return (sales, calendar.withColumns({c: F.col(c).try_cast("int")
                                         for c in _whole_columns(calendar)}),
            prices.withColumns({"sell_price": to_number(prices, "sell_price"),
                                "wm_yr_wk": F.col("wm_yr_wk").try_cast("int")}))


def unreadable_cells(spark: SparkSession, raw_dir: str, multi_line: bool = False) -> DataFrame:
    """One row per raw file: its rows, filled numeric cells, and how many of
    these hold no number.

    The cells of a row travel as one array, so a matrix of years needs one
    expression, not one per day.
    """
    out = None
    tables = _raw_texts(spark, raw_dir, multi_line)
    for name, df in zip(("sales", "calendar", "prices"), tables, strict=True):
        cols = [c for c in df.columns if c in _whole_columns(df) or c == "sell_price"]
        cells = F.expr("array(" + ", ".join(f"`{c}`" for c in cols) + ")").cast("array<string>")
        number = lambda x: x.try_cast("bigint").isNotNull() | x.rlike(NUMBER_PATTERN)
        n = df.select(
            F.size(F.filter(cells, lambda x: x.isNotNull())).alias("filled"),
            F.size(F.filter(cells, lambda x: x.isNotNull() & ~number(x))).alias("bad"))
        row = n.agg(F.lit(name).alias("file"), F.count(F.lit(1)).alias("n_rows"),
                    F.coalesce(F.sum("filled"), F.lit(0)).cast("bigint").alias("n_cells"),
                    F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("n_unreadable"))
        out = row if out is None else out.unionByName(row)
    return out


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows sorted by series and date inside each file, so that the file
    statistics prune reads of single products; there is no global sort."""
    order = [*series_columns(df), *[c for c in ("date",) if c in df.columns]]
    out = df.sortWithinPartitions(*order) if order else df
    out.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**QUOTING).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_series_table(df: DataFrame, table: str, buckets: int,
                       mode: str = "overwrite") -> None:
    """A table bucketed by series: window jobs on it need no exchange."""
    keys = series_columns(df)
    (df.repartition(buckets, *keys).write.mode(mode).format("parquet")
     .bucketBy(buckets, keys[0], *keys[1:]).sortBy(*keys, "date")
     .saveAsTable(table))
