"""Descriptive reports over real observations of a cleaned table.

Reports aggregate with map-side combining on small keys. Where a report
needs an order inside a product, the rows are first reduced per store or
per day, so that no task sees all rows of a product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import is_fraction, np_round, quotient, settled, units
from ..schema import (
    ANALYTICS_COLUMNS, NO_EVENT, AnalyticsInputError, flag_columns,
    missing_columns, series_columns,
)

# ---- fixed values ----
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
             "Saturday", "Sunday")
PRICE_NOTE = ("Correlations are observed associations, confounded by "
              "seasonality, events and time trends; they are no causal effect.")


# ---- input ----------------------------------------------------------------

def check_analytics_input(df: DataFrame, *needed: str) -> None:
    """Raises on an empty table or absent columns (runs a one-row job)."""
    if not df.columns:
        raise AnalyticsInputError("Analytics input DataFrame is empty.")
    absent = missing_columns(df, (*ANALYTICS_COLUMNS, *needed))
    if absent:
        raise AnalyticsInputError(
            f"Analytics input is missing required columns: {absent}.")
    if df.limit(1).isEmpty():
        raise AnalyticsInputError("Analytics input DataFrame is empty.")


def real_rows(df: DataFrame, *needed: str) -> DataFrame:
    """Observed rows with typed dates; structural gap rows are left out."""
    absent = missing_columns(df, (*ANALYTICS_COLUMNS, *needed))
    if absent:
        raise AnalyticsInputError(
            f"Analytics input is missing required columns: {absent}.")
    out = df.where(F.col("is_gap_fill") == 0) if "is_gap_fill" in df.columns else df
    if not isinstance(out.schema["date"].dataType, T.DateType):
        out = out.withColumn("date", F.col("date").cast("date"))
    return out


def _zero() -> Column:
    return F.col("sales_quantity") == 0


# ---- trends ---------------------------------------------------------------

def daily_totals(df: DataFrame) -> DataFrame:
    return (real_rows(df).where(F.col("date").isNotNull()).groupBy("date")
            .agg(units(F.col("sales_quantity")).alias("total_units")))


def daily_sales(df: DataFrame, moving_averages=(7, 30)) -> DataFrame:
    """Daily totals with trailing means over the observed dates.

    The window is global, over one row per calendar day.
    """
    out = daily_totals(df)
    for w in moving_averages:
        frame = Window.orderBy("date").rowsBetween(-(w - 1), 0)
        mean = F.sum("total_units").over(frame) / F.lit(float(w))
        out = out.withColumn(
            f"ma_{w}", F.when(F.count("total_units").over(frame) == w,
                              np_round(mean, 2)))
    return out.orderBy("date")


def _by_period(df: DataFrame, unit: str, name: str) -> DataFrame:
    start = F.date_trunc(unit, F.col("date")).cast("date")
    return (daily_totals(df).groupBy(start.alias(name))
            .agg(units(F.col("total_units")).alias("total_units")).orderBy(name))


def weekly_sales(df: DataFrame) -> DataFrame:
    """Totals per week, labelled by its Monday."""
    return _by_period(df, "week", "week_start")


def monthly_sales(df: DataFrame) -> DataFrame:
    return _by_period(df, "month", "month_start")


def demand_growth(df: DataFrame) -> DataFrame:
    """Mean of the last 12 full months against the first 12, in percent.

    The first and the last month are taken as partial. Both row numbers run
    over one row per month.
    """
    months = monthly_sales(df).withColumns({
        "_up": F.row_number().over(Window.orderBy("month_start")),
        "_down": F.row_number().over(Window.orderBy(F.desc("month_start")))})
    first = F.avg(F.when(F.col("_up").between(2, 13), F.col("total_units")))
    last = F.avg(F.when(F.col("_down").between(2, 13), F.col("total_units")))
    return months.agg(
        np_round(last, 4).alias("last_avg"), np_round(first, 4).alias("first_avg"),
        np_round((quotient(last, first) - 1) * 100, 1).alias("growth_pct"))


# ---- summary --------------------------------------------------------------

def dataset_summary(df: DataFrame) -> DataFrame:
    """Key figures as one row.

    Rows are reduced per product first; the number of dates comes from a
    scan of the date column alone. That avoids expanding every row for two
    distinct counts.
    """
    real = real_rows(df)
    outliers = F.sum("outlier_flag") if "outlier_flag" in real.columns else F.lit(0)
    per_product = real.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("sales_quantity").alias("units"),
        F.count_if(_zero()).alias("zero"),
        F.min("date").alias("lo"), F.max("date").alias("hi"),
        outliers.alias("outliers"))
    n_dates = (real.select("date").where(F.col("date").isNotNull()).distinct()
               .agg(F.count(F.lit(1)))).scalar()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return (per_product.agg(
        total("rows").alias("total_rows"),
        F.count("product_id").alias("total_products"),
        total("units").alias("total_units_sold"),
        F.min("lo").alias("date_start"), F.max("hi").alias("date_end"),
        total("zero").alias("_zero"),
        total("outliers").alias("outlier_flag_count"))
        .withColumn("n_dates", n_dates)
        .select(
            "total_rows", "total_products", "total_units_sold", "date_start",
            "date_end", "n_dates",
            np_round(F.coalesce(quotient(F.col("total_units_sold"), F.col("n_dates")),
                                F.lit(0.0)), 2).alias("avg_daily_demand"),
            np_round(quotient(F.col("_zero"), F.col("total_rows")) * 100, 2)
            .alias("zero_sales_pct"),
            "outlier_flag_count"))


# ---- products -------------------------------------------------------------

def product_metrics(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Demand profile per product over all its stores.

    Rows are first reduced per series and name with plain sums, which hash
    aggregation holds in place; the name of the earliest row and the
    deviation then come from one row per series. The squares of fractional
    demand do not add up exactly; its deviation is merged from partial moments
    of the rows, a second aggregation by product.
    """
    real = real_rows(df).where(F.col("product_id").isNotNull())
    keys = series_columns(real)
    name = [c for c in ("product_name",) if c in real.columns]
    flag = [c for c in ("outlier_flag",) if c in real.columns]
    q = F.col("sales_quantity")
    series = real.groupBy(*keys, *name).agg(
        F.sum(q).alias("s"), F.sum(q * q).alias("t"), F.count(q).alias("n"),
        F.count(F.lit(1)).alias("rows"), F.count_if(_zero()).alias("zero"),
        F.min("date").alias("date"), *[F.sum(c).alias(c) for c in flag])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    s, n = F.sum("s").cast("double"), F.sum("n")
    mean = quotient(s, n)
    # Whole numbers keep the difference of the two large terms exact.
    gap = (whole("n") * whole("t") - whole("s") * whole("s")).cast("double")
    std = F.sqrt(quotient(gap, n.cast("double") * (n - 1)))
    if is_fraction(real, "sales_quantity"):
        spread = real.groupBy("product_id").agg(F.stddev_samp(q.cast("double")).alias("_std"))
        series, std = series.join(spread, "product_id"), F.first("_std")
    place = F.struct(*keys[1:], "date")
    named = [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in name]
    out = series.groupBy("product_id").agg(
        *named, units(F.col("s")).alias("total_units"), n.alias("n_days"),
        np_round(mean, 3).alias("avg_daily_units"),
        np_round(std, 3).alias("std_daily_units"),
        np_round(quotient(std, mean), 3).alias("cv"),
        np_round(quotient(F.sum("zero"), F.sum("rows")) * 100, 3).alias("zero_sales_pct"),
        *[F.sum(c).cast("bigint").alias("outlier_count") for c in flag])
    return out.orderBy(F.desc("total_units"), "product_id") if ordered else out


def top_products(df: DataFrame, n: int = 10, lowest: bool = False) -> DataFrame:
    """First or last ``n`` products by units; ties go by product."""
    by = F.asc("total_units") if lowest else F.desc("total_units")
    return product_metrics(df, ordered=False).orderBy(by, "product_id").limit(n)


# ---- events ---------------------------------------------------------------

def _event_cube(df: DataFrame) -> DataFrame:
    """Row counts per combination of flags, event name and sales value.

    The only pass over the table; every event figure derives from it.
    """
    real = real_rows(df)
    dims = [*flag_columns(real), *[c for c in ("event_name",) if c in real.columns]]
    return real.groupBy(*dims, "sales_quantity").agg(F.count(F.lit(1)).alias("n"))


def _event_table(rows: DataFrame) -> DataFrame:
    """Figures per event from rows (event, event_type, on, sales, n).

    The median reads a weighted histogram, whose size is the number of
    distinct daily quantities and not the number of rows.
    """
    cells = rows.groupBy("event", "event_type", "on", "sales_quantity").agg(
        F.sum("n").alias("n"))
    q, n, on = F.col("sales_quantity"), F.col("n"), F.col("on") == 1
    valued = F.when(q.isNotNull(), n)
    return cells.withColumn("_q_on", F.when(on, q)).groupBy("event", "event_type").agg(
        F.coalesce(F.sum(F.when(on, n)), F.lit(0)).alias("observations"),
        F.coalesce(F.sum(F.when(~on, n)), F.lit(0)).alias("_off"),
        quotient(F.sum(F.when(on, q * n)), F.sum(F.when(on, valued))).alias("_avg"),
        F.expr("percentile(_q_on, 0.5D, n)").alias("median_units"),
        F.coalesce(F.sum(F.when(on, q * n)), F.lit(0)).alias("total_units"),
        quotient(F.sum(F.when(~on, q * n)), F.sum(F.when(~on, valued))).alias("_base"))


def _present(table: DataFrame) -> DataFrame:
    pct = F.when(F.col("_base") > 0, (quotient(F.col("_avg"), F.col("_base")) - 1) * 100)
    return table.select(
        "event", "event_type", F.col("observations").cast("bigint").alias("observations"),
        np_round(F.col("_avg"), 3).alias("avg_units"), "median_units",
        F.col("total_units").cast("bigint").alias("total_units"),
        np_round(F.col("_base"), 3).alias("baseline_avg_units"),
        np_round(pct, 2).alias("pct_vs_baseline"))


_EVENT_SCHEMA = ("event string, event_type string, observations bigint, "
                 "avg_units double, median_units double, total_units bigint, "
                 "baseline_avg_units double, pct_vs_baseline double")


def _state(event: Column, kind: str, on: Column) -> Column:
    return F.struct(event.alias("event"), F.lit(kind).alias("event_type"),
                    on.cast("int").alias("on"))


def _flag_states(cube: DataFrame) -> list[Column]:
    return [_state(F.lit(f), "flag", F.col(f)) for f in flag_columns(cube)]


def _name_state() -> Column:
    return _state(F.col("event_name"), "named_event", F.lit(1))


def _event_rows(cube: DataFrame, states: list[Column]) -> DataFrame:
    """Each cell of the cube once per event it says something about."""
    rows = cube.select(F.explode(F.array(*states)).alias("s"), "sales_quantity", "n")
    return (rows.where(F.col("s.on").isin(0, 1) & F.col("s.event").isNotNull())
            .select("s.*", "sales_quantity", "n"))


def _reported(table: DataFrame) -> DataFrame:
    """Flags with both kinds of days, and named events, with their baseline.

    Days without an event are the baseline of every named event. The window
    spans one row per event.
    """
    named = F.col("event_type") == "named_event"
    plain = F.max(F.when(F.col("event") == NO_EVENT, F.col("_avg"))).over(
        Window.partitionBy("event_type"))
    shown = F.when(named, F.col("event") != NO_EVENT).otherwise(
        (F.col("observations") > 0) & (F.col("_off") > 0))
    return (table.withColumn("_base", F.when(named, plain).otherwise(F.col("_base")))
            .where(shown))


def _events(df: DataFrame, flags: bool, names: bool) -> DataFrame:
    """The event figures of one pass over the table."""
    cube = _event_cube(df)
    states = _flag_states(cube) if flags else []
    if names and "event_name" in df.columns:
        states.append(_name_state())
    if not states:
        return df.sparkSession.createDataFrame([], _EVENT_SCHEMA)
    return _present(_reported(_event_table(_event_rows(cube, states))))


def event_flags(df: DataFrame) -> DataFrame:
    """Sales on days with a flag against days without it.

    A flag is reported only where both kinds of days occur.
    """
    return _events(df, flags=True, names=False)


def named_events(df: DataFrame) -> DataFrame:
    """Sales per named event against days without any event."""
    return _events(df, flags=False, names=True)


def event_analysis(df: DataFrame) -> DataFrame:
    """Both event tables together, strongest difference first."""
    return _events(df, flags=True, names=True).orderBy(
        F.desc_nulls_last("pct_vs_baseline"), "event")


def strongest_events(df: DataFrame, n: int = 5) -> DataFrame:
    """First and last ``n`` named events of the event table.

    Both row numbers run over one row per event name.
    """
    cols = ["event", "observations", "avg_units", "pct_vs_baseline"]
    first = Window.orderBy(F.desc_nulls_last("pct_vs_baseline"), "event")
    last = Window.orderBy(F.asc_nulls_first("pct_vs_baseline"), F.desc("event"))
    ranked = named_events(df).select(*cols).withColumns({
        "_first": F.row_number().over(first), "_last": F.row_number().over(last)})
    side = F.explode(F.array_compact(F.array(
        F.when(F.col("_first") <= n, F.lit("positive")),
        F.when(F.col("_last") <= n, F.lit("negative"))))).alias("direction")
    return ranked.select(side, *cols)


# ---- outliers -------------------------------------------------------------

def _on_event_day(df: DataFrame) -> Column:
    flags = [F.coalesce(F.col(c), F.lit(0)) for c in flag_columns(df)]
    return F.greatest(F.lit(0), *flags)


def outlier_summary(df: DataFrame) -> DataFrame:
    """Where the outlier flags landed, as one row."""
    real = real_rows(df, "outlier_flag")
    flags = flag_columns(real)
    flagged = F.col("outlier_flag") == 1
    total = F.count_if(flagged)
    aggs = [total.alias("total_flagged"),
            np_round(quotient(total, F.count(F.lit(1))) * 100, 3)
            .alias("flagged_pct_of_rows")]
    aggs += [F.count_if(flagged & (F.col(f) == 1)).alias(f"on_{f}_days") for f in flags]
    if flags:
        on = _on_event_day(real)
        aggs += [
            np_round(quotient(F.sum(F.when(flagged, on)), total) * 100, 2)
            .alias("pct_on_event_days"),
            np_round(F.when(total > 0, F.avg(on)) * 100, 2)
            .alias("pct_of_all_rows_on_event_days")]
    return real.agg(*aggs)


def _flagged_by(df: DataFrame, name: str) -> DataFrame:
    return (real_rows(df, "outlier_flag")
            .where((F.col("outlier_flag") == 1) & F.col(name).isNotNull())
            .groupBy(name).agg(F.count(F.lit(1)).alias("n_flagged")))


def outliers_by_product(df: DataFrame, n: int = 10) -> DataFrame:
    return (_flagged_by(df, "product_id")
            .orderBy(F.desc("n_flagged"), "product_id").limit(n))


def outliers_by_event(df: DataFrame) -> DataFrame:
    return (_flagged_by(df, "event_name").where(F.col("event_name") != NO_EVENT)
            .orderBy(F.desc("n_flagged"), "event_name"))


# ---- prices ---------------------------------------------------------------

def price_profile(df: DataFrame, min_obs: int = 30, ordered: bool = True) -> DataFrame:
    """Prices, number of price changes and price-sales correlation per product.

    Changes are counted along (store, date). Each series is reduced first,
    to its changes, its first and last price and its centred moments; the
    product level then combines one row per store.
    """
    real = (real_rows(df, "price")
            .where(F.col("product_id").isNotNull() & F.col("price").isNotNull()
                   & ~F.isnan("price")))
    keys = series_columns(real)
    days = Window.partitionBy(*keys).orderBy("date")
    p, q = F.col("price"), F.col("sales_quantity").cast("double")
    both = q.isNotNull()
    series = (real.withColumn("_step", (p != F.lag(p).over(days)).cast("int"))
              .groupBy(*keys).agg(
                  F.count(p).alias("n"), F.count_if(both).alias("m"),
                  F.sum(p).alias("sp"), F.min(p).alias("lo"), F.max(p).alias("hi"),
                  F.coalesce(F.sum("_step"), F.lit(0)).alias("steps"),
                  F.min_by(p, "date").alias("first"), F.max_by(p, "date").alias("last"),
                  F.avg(F.when(both, p)).alias("mp"), F.avg(q).alias("mq"),
                  F.min(q).alias("qlo"), F.max(q).alias("qhi"),
                  F.covar_pop(p, q).alias("cpq"),
                  F.var_pop(F.when(both, p)).alias("vp"), F.var_pop(q).alias("vq")))

    product = Window.partitionBy("product_id")
    stores = product.orderBy(*(keys[1:] or keys))
    m = F.col("m")
    gmean = lambda c: quotient(F.sum(m * F.col(c)).over(product), F.sum(m).over(product))
    joined = series.withColumns({
        "_seam": F.coalesce((F.col("first") != F.lag("last").over(stores)).cast("int"),
                            F.lit(0)),
        "_dp": F.col("mp") - gmean("mp"), "_dq": F.col("mq") - gmean("mq")})
    cov = F.sum(m * (F.col("cpq") + F.col("_dp") * F.col("_dq")))
    var_p = F.sum(m * (F.col("vp") + F.col("_dp") * F.col("_dp")))
    var_q = F.sum(m * (F.col("vq") + F.col("_dq") * F.col("_dq")))
    usable = ((F.sum("n") >= min_obs) & (F.min("lo") < F.max("hi"))
              & (F.min("qlo") < F.max("qhi")))
    out = joined.groupBy("product_id").agg(
        settled(quotient(F.sum("sp"), F.sum("n")), 3).alias("avg_price"),
        F.min("lo").alias("min_price"), F.max("hi").alias("max_price"),
        (F.sum("steps") + F.sum("_seam")).cast("bigint").alias("n_price_changes"),
        np_round(F.when(usable, quotient(cov, F.sqrt(var_p * var_q))), 4)
        .alias("within_product_corr"))
    return out.orderBy(F.desc("avg_price"), "product_id") if ordered else out


def price_summary(df: DataFrame, min_obs: int = 30) -> DataFrame:
    """Correlation over all rows, and the mean of the products' own ones."""
    real = real_rows(df, "price")
    p, q = F.col("price"), F.col("sales_quantity").cast("double")
    pairs = real.where(p.isNotNull() & ~F.isnan(p) & q.isNotNull())
    pooled = pairs.agg(F.when(F.min(p) < F.max(p), quotient(
        F.covar_samp(p, q), F.stddev_samp(p) * F.stddev_samp(q)))).scalar()
    corr = F.col("within_product_corr")
    return (price_profile(df, min_obs, ordered=False).agg(
        F.count(corr).alias("products_with_computable_within_corr"),
        np_round(F.avg(corr), 4).alias("mean_within_product_corr"))
        .select(np_round(pooled, 4).alias("pooled_correlation"),
                "products_with_computable_within_corr", "mean_within_product_corr"))


# ---- weekdays and categories ----------------------------------------------

def day_of_week(df: DataFrame) -> DataFrame:
    """Mean daily total per weekday; absent weekdays appear with 0 dates."""
    days = df.sparkSession.range(len(DAY_NAMES)).select(
        F.col("id").cast("int").alias("day_index"))
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    per_day = daily_totals(df).groupBy(F.weekday("date").alias("day_index")).agg(
        F.avg("total_units").alias("mean"), F.sum("total_units").alias("sum"),
        F.count(F.lit(1)).alias("dates"))
    zero = F.lit(0).cast("bigint")
    return (days.join(per_day, "day_index", "left").orderBy("day_index").select(
        F.element_at(names, F.col("day_index") + 1).alias("day_of_week"),
        np_round(F.col("mean"), 2).alias("avg_daily_total_units"),
        F.coalesce("sum", zero).cast("bigint").alias("total_units"),
        F.coalesce("dates", zero).alias("n_dates")))


def category_analysis(df: DataFrame) -> DataFrame:
    """Demand per category and its share of all units."""
    real = real_rows(df, "category").where(F.col("category").isNotNull())
    per_product = real.groupBy("category", "product_id").agg(
        F.sum("sales_quantity").alias("units"),
        F.count("sales_quantity").alias("valued"),
        F.count(F.lit(1)).alias("rows"), F.count_if(_zero()).alias("zero"))
    table = per_product.groupBy("category").agg(
        F.count("product_id").alias("n_products"), units(F.col("units")).alias("total_units"),
        np_round(quotient(F.sum("units"), F.sum("valued")), 3).alias("avg_units_per_row"),
        np_round(quotient(F.sum("zero"), F.sum("rows")) * 100, 3).alias("zero_sales_pct"))
    # One row per category is left, so the total is taken in place.
    everything = F.sum("total_units").over(Window.partitionBy())
    return (table.withColumn("units_share_pct", np_round(
        quotient(F.col("total_units"), everything) * 100, 2))
        .orderBy(F.desc("total_units"), "category"))
