"""Column helpers: tolerant parsing, rounding, safe division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DATE_FORMAT

# Decimal notation only: a JVM cast alone would also take "1d" or "1f".
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
# Whole numbers in their shortest form, and dates that a cast reads as the formatter
# does; both spare most rows a costly parse. \z, as $ lets a line end follow.
PLAIN_PATTERN = r"^(0|[1-9][0-9]{0,14})\z"
ISO_FORMAT, ISO_PATTERN = "yyyy-MM-dd", r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}\z"


def np_round(col: Column, digits: int) -> Column:
    """Round half to even on the scaled value, as numpy and pandas do."""
    scale = F.lit(float(10 ** digits))
    return F.rint(col * scale) / scale


def settled(col: Column, digits: int) -> Column:
    """``np_round`` for means of fractions: 9 digits first, so that a tie
    does not depend on the order in which the values were added up."""
    return np_round(np_round(col, 9), digits)


def quotient(num: Column, den: Column) -> Column:
    """A double ratio that is NULL where the denominator is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def _type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def to_number(df: DataFrame, name: str) -> Column:
    """The column as double; text that is no number and NaN become NULL."""
    col = F.col(name)
    if isinstance(_type(df, name), T.StringType):
        return F.when(col.rlike(NUMBER_PATTERN), col.try_cast("double"))
    num = col.cast("double")
    if isinstance(_type(df, name), (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(num), num)
    return num


def plain_number(df: DataFrame, name: str) -> Column:
    """Text that holds a number in its shortest plain form (``5.0`` and `` 5``
    become ``5``); other text and other types stay as they are.

    Decimals rather than doubles, so that no two different numbers of up to 20
    digits before and 18 behind the point look alike; longer ones stay as written.
    """
    col = F.col(name)
    if not isinstance(_type(df, name), T.StringType):
        return col
    exact = col.try_cast("decimal(38,18)")
    digits = F.regexp_replace(exact.cast("string"), r"^([^E]*?)\.?0+$", "$1")
    return (F.when(col.rlike(PLAIN_PATTERN), col)
            .when(~F.coalesce(col.rlike(NUMBER_PATTERN), F.lit(False)) | exact.isNull()
                   | (exact.cast("double") != col.try_cast("double")), col)
            .when(exact == 0, F.lit("0")).otherwise(digits))


def is_fraction(df: DataFrame, name: str) -> bool:
    """Whether the column's type can hold fractions."""
    return isinstance(_type(df, name), T.FractionalType)


def to_date(df: DataFrame, name: str = "date", fmt: str = DATE_FORMAT) -> Column:
    """The column as date; text not written in ``fmt`` becomes NULL."""
    col = F.col(name)
    if isinstance(_type(df, name), T.StringType):
        parsed = F.try_to_date(col, fmt)
        if fmt != ISO_FORMAT:
            return parsed
        return F.coalesce(F.when(col.rlike(ISO_PATTERN), col.try_cast("date")), parsed)
    return col.cast("date")


def to_flag(df: DataFrame, name: str) -> Column:
    """The column as 0/1 style integer; bad or missing values become 0."""
    return F.coalesce(to_number(df, name).try_cast("int"), F.lit(0))


def is_missing(df: DataFrame, name: str) -> Column:
    col = F.col(name)
    if isinstance(_type(df, name), (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def units(col: Column) -> Column:
    """Sum of whole units; 0 where nothing was observed."""
    return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")
