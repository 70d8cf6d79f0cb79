"""Leakage-safe features of a continuous daily series.

Everything but the calendar and today's price looks strictly backwards.
All window expressions share one partitioning (the series) and one order
(the date), hence one exchange and one sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar_columns, is_fraction, quotient
from ..schema import (
    FEATURE_COLUMNS, NO_EVENT, FeatureInputError, missing_columns,
    series_columns,
)

DEFAULT_LAGS = (1, 7, 14, 28)
DEFAULT_WINDOWS = (7, 14, 28)
DEFAULT_MEDIAN_WINDOWS = (7, 28)
DEFAULT_PRICE_WINDOW = 7


@dataclass(frozen=True)
class _Frames:
    """Row frames of a series, all ending yesterday."""

    order: object

    @classmethod
    def of(cls, df: DataFrame) -> "_Frames":
        return cls(Window.partitionBy(*series_columns(df)).orderBy("date"))

    @property
    def before(self):
        return self.order.rowsBetween(Window.unboundedPreceding, -1)

    def last(self, n: int):
        return self.order.rowsBetween(-n, -1)


# ---- checks ---------------------------------------------------------------

def check_settings(lags, windows) -> None:
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    bad = [x for x in lags if not whole(x) or x < 1]
    if bad:
        raise FeatureInputError(
            f"Lags must be positive integers; got {bad}. Anything else would "
            "use today's or later sales.")
    bad = [x for x in windows if not whole(x) or x < 2]
    if bad:
        raise FeatureInputError(f"Rolling windows must be integers >= 2; got {bad}.")


def feature_precheck(df: DataFrame) -> DataFrame:
    """One row: rows, rows repeating a (series, date), gapped series, days."""
    keys = series_columns(df)
    per_day = df.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n"))
    per_series = per_day.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_days"),
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("n_expected"))
    missing = F.col("n_expected") - F.col("n_days")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per_series.agg(
        total("n_rows").alias("n_rows"),
        total(F.col("n_rows") - F.col("n_days")).alias("n_duplicates"),
        F.count_if(missing > 0).alias("n_gapped_series"),
        total(missing).alias("n_missing_days"))


def worst_series(df: DataFrame, n: int = 3) -> DataFrame:
    keys = series_columns(df)
    missing = (F.datediff(F.max("date"), F.min("date")) + 1
               - F.count_distinct("date"))
    return (df.groupBy(*keys).agg(missing.alias("missing_days"))
            .where(F.col("missing_days") > 0)
            .orderBy(F.desc("missing_days"), *keys).limit(n))


def check_feature_input(df: DataFrame) -> None:
    """Raises where a previous row would not be the previous day."""
    if not df.columns:
        raise FeatureInputError("Input DataFrame is empty.")
    absent = missing_columns(df, FEATURE_COLUMNS)
    if absent:
        raise FeatureInputError(f"Missing required columns: {absent}.")
    if not isinstance(df.schema["date"].dataType,
                      (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise FeatureInputError("date column must be a date.")
    found = feature_precheck(df).first()
    if not found["n_rows"]:
        raise FeatureInputError("Input DataFrame is empty.")
    if found["n_duplicates"]:
        raise FeatureInputError(
            f"{found['n_duplicates']:,} duplicate (series, date) rows.")
    if found["n_missing_days"]:
        worst = [r.asDict() for r in worst_series(df).collect()]
        raise FeatureInputError(
            f"{found['n_missing_days']:,} missing days across "
            f"{found['n_gapped_series']} series (worst: {worst}). Lags require "
            "a continuous daily calendar.")


# ---- single groups of features ---------------------------------------------

def calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns(calendar_columns(F.col("date")))


def _lags(fr: _Frames, lags) -> dict[str, Column]:
    return {f"lag_{k}": F.lag("sales_quantity", k).over(fr.order) for k in lags}


def lag_features(df: DataFrame, lags=DEFAULT_LAGS) -> DataFrame:
    """Sales of k rows earlier in the series."""
    check_settings(lags, ())
    return df.withColumns(_lags(_Frames.of(df), lags))


def _demand(df: DataFrame) -> Column:
    """Sales, with NaN as missing."""
    q = F.col("sales_quantity")
    if isinstance(df.schema["sales_quantity"].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(q), q.cast("double"))
    return q.cast("double") if is_fraction(df, "sales_quantity") else q


def _rolling_inputs(df: DataFrame, fr: _Frames, windows, median_windows) -> dict[str, Column]:
    """Running totals up to yesterday, and the last values as a list.

    Running frames cost one update per row whatever the window length; a
    window's total is the difference of two of them. That is exact for whole
    units; the figures of fractional demand come from the list of last values.
    """
    q = _demand(df)
    out = {"_n": F.count(q).over(fr.before), "_s": F.sum(q).over(fr.before)}
    if windows and not is_fraction(df, "sales_quantity"):
        out["_t"] = F.sum(q * q).over(fr.before)
    longest = max([*windows, *median_windows], default=0)
    if longest:
        out["_tail"] = F.collect_list(q).over(fr.last(longest))
    return out


def _rolling_differences(df: DataFrame, fr: _Frames, windows, median_windows) -> dict[str, Column]:
    out = {}
    for w in sorted({*windows, *median_windows}):
        for c in ("_n", "_s", "_t"):
            if c == "_n" or w in windows and not is_fraction(df, "sales_quantity"):
                out[f"{c}{w}"] = F.coalesce(F.col(c), F.lit(0)) - F.coalesce(
                    F.lag(c, w).over(fr.order), F.lit(0))
        # A full window of values means that the tail of the list is it.
        out[f"_sorted{w}"] = F.when(
            out[f"_n{w}"] == w, F.sort_array(F.slice("_tail", -w, w)))
    return out


def _listed_moments(ordered: Column, w: int) -> tuple[Column, Column]:
    """Mean and sample variance of a full list, from distances to its middle
    and then to the mean: no large terms are subtracted."""
    middle = ordered[w // 2]
    mean = middle + F.aggregate(
        ordered, F.lit(0.0), lambda done, x: done + (x - middle)) / F.lit(float(w))
    start = F.struct(F.lit(0.0).alias("sum"), mean.alias("mean"))
    squares = F.aggregate(
        ordered, start, lambda done, x: F.struct(
            (done["sum"] + (x - done["mean"]) * (x - done["mean"])).alias("sum"),
            done["mean"].alias("mean")), lambda done: done["sum"])
    return mean, squares / F.lit(float(w - 1))


def _rolling_outputs(df: DataFrame, windows, median_windows) -> dict[str, Column]:
    out = {}
    for w in windows:
        full, ordered = F.col(f"_n{w}") == w, F.col(f"_sorted{w}")
        if is_fraction(df, "sales_quantity"):
            mean, spread = _listed_moments(ordered, w)
        else:
            s, t = F.col(f"_s{w}"), F.col(f"_t{w}")
            mean = s / F.lit(float(w))
            spread = (w * t - s * s).cast("double") / float(w * (w - 1))
        out[f"rolling_mean_{w}"] = F.when(full, mean)
        out[f"rolling_std_{w}"] = F.when(full, F.sqrt(spread))
        out[f"rolling_min_{w}"] = ordered[0].cast("double")
        out[f"rolling_max_{w}"] = ordered[w - 1].cast("double")
    for w in median_windows:
        ordered = F.col(f"_sorted{w}")
        out[f"rolling_median_{w}"] = \
            (ordered[(w - 1) // 2] + ordered[w // 2]) / F.lit(2.0)
    return out


def _with_rolling(df: DataFrame, fr: _Frames, windows, median_windows,
                  first: dict[str, Column]) -> DataFrame:
    """Adds the inputs together with ``first``, then the window totals."""
    return (df.withColumns({**first, **_rolling_inputs(df, fr, windows, median_windows)})
            .withColumns(_rolling_differences(df, fr, windows, median_windows)))


def rolling_features(df: DataFrame, windows=DEFAULT_WINDOWS,
                     median_windows=DEFAULT_MEDIAN_WINDOWS) -> DataFrame:
    """Mean, std, min, max and median of the w rows before today.

    A value appears only where all w rows hold one.
    """
    check_settings((), (*windows, *median_windows))
    wide = _with_rolling(df, _Frames.of(df), windows, median_windows, {})
    out = _rolling_outputs(df, windows, median_windows)
    return wide.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def rolling_median(df: DataFrame, median_windows=DEFAULT_MEDIAN_WINDOWS) -> DataFrame:
    return rolling_features(df, (), median_windows)


def expanding_mean(df: DataFrame) -> DataFrame:
    """Mean of all earlier rows of the series."""
    mean = F.avg("sales_quantity").over(_Frames.of(df).before)
    return df.withColumn("expanding_mean", mean)


def _price_inputs(fr: _Frames, window: int) -> dict[str, Column]:
    p, prior = F.col("price"), fr.last(window)
    full = F.count(p).over(prior) == window
    # The change in percent bridges missing prices with the last known one.
    now = F.last(p, ignorenulls=True).over(
        fr.order.rowsBetween(Window.unboundedPreceding, 0))
    then = F.last(p, ignorenulls=True).over(fr.before)
    return {
        "price_change": p - F.lag(p, 1).over(fr.order),
        "price_pct_change": quotient(now, then) - 1,
        f"rolling_price_mean_{window}": F.when(full, F.avg(p).over(prior)),
        f"rolling_price_std_{window}": F.when(full, F.stddev_samp(p).over(prior)),
    }


def price_features(df: DataFrame, window: int = DEFAULT_PRICE_WINDOW) -> DataFrame:
    if "price" not in df.columns:
        return df
    check_settings((), (window,))
    return df.withColumns(_price_inputs(_Frames.of(df), window))


def _named_event() -> Column:
    # A missing name counts as named, as "not equal to none" does there.
    return (~F.col("event_name").eqNullSafe(NO_EVENT)).cast("int")


def event_features(df: DataFrame) -> DataFrame:
    if "event_name" not in df.columns:
        return df
    return df.withColumn("has_named_event", _named_event())


# ---- the whole job --------------------------------------------------------

def build_features(df: DataFrame, lags=DEFAULT_LAGS, windows=DEFAULT_WINDOWS,
                   median_windows=DEFAULT_MEDIAN_WINDOWS,
                   price_window: int = DEFAULT_PRICE_WINDOW,
                   validate: bool = True) -> tuple[DataFrame, list[str]]:
    """All features in one plan; returns the table and the new names.

    The row count never changes and warm-up NULLs stay.
    """
    check_settings(lags, (*windows, *median_windows, price_window))
    if validate:
        check_feature_input(df)

    fr = _Frames.of(df)
    first = _lags(fr, lags)
    prices = _price_inputs(fr, price_window) if "price" in df.columns else {}
    wide = _with_rolling(df, fr, windows, median_windows, {**first, **prices})

    out = dict(calendar_columns(F.col("date")))
    out.update({n: F.col(n) for n in first})
    out.update(_rolling_outputs(df, windows, median_windows))
    out["expanding_mean"] = quotient(F.col("_s"), F.col("_n"))
    out.update({n: F.col(n) for n in prices})
    if "event_name" in df.columns:
        out["has_named_event"] = _named_event()
    kept = [c for c in df.columns if c not in out]
    new = [n for n in out if n not in df.columns]
    return wide.select(*kept, *[c.alias(n) for n, c in out.items()]), new


def feature_null_report(features: DataFrame, names: list[str]) -> DataFrame:
    """Missing values per generated column."""
    counts = features.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_missing"))
        for c in names])).alias("r")
    return counts.select(rows).select("r.*")
