"""Forecast errors as one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import np_round, quotient


def evaluate(df: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """MAE, RMSE and R2 to 4 digits, per group of ``by`` where given.

    A constant target has R2 1 when predicted without error, else 0.
    """
    y, e = F.col(actual).cast("double"), F.col(actual) - F.col(predicted)
    pairs = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    sse = F.sum(e * e)
    spread = F.var_pop(y) * F.count(y)
    r2 = (F.when(F.count(y) < 2, F.lit(None))
          .when(F.min(y) < F.max(y), 1 - quotient(sse, spread))
          .otherwise(F.when(sse == 0, 1.0).otherwise(0.0)))
    return pairs.groupBy(*by).agg(
        np_round(F.avg(F.abs(e)), 4).alias("mae"),
        np_round(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
        np_round(r2, 4).alias("r2"))
