"""First look at a raw dataset: distributions, coverage, flags, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact_quantiles, np_round, quotient, settled
from ..schema import flag_columns


def describe_measures(df: DataFrame) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max of sales and price.

    The table is read into a histogram of distinct values. The deviation is
    taken around the mean, as a difference of sums of squares loses its digits
    when the values are large and close together.
    """
    measures = [c for c in ("sales_quantity", "price") if c in df.columns]
    pair = F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v"))
        for c in measures])).alias("p")
    values = (df.select(*measures).select(pair).select("p.*")
              .where(F.col("v").isNotNull() & ~F.isnan("v")))
    histogram = values.groupBy("measure", "v").agg(F.count(F.lit(1)).alias("n"))
    v, n, count = F.col("v"), F.col("n"), F.sum("n")
    means = histogram.groupBy("measure").agg(quotient(F.sum(v * n), count).alias("_mean"))
    away = v - F.col("_mean")
    var = quotient(F.sum(away * away * n), count - 1)
    stats = histogram.join(means, "measure").groupBy("measure").agg(
        count.alias("count"), settled(F.first("_mean"), 2).alias("mean"),
        settled(F.sqrt(var), 2).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    quartiles = exact_quantiles(histogram, ["measure"], "v", "n",
                                {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return stats.join(quartiles, "measure").select(
        "measure", "count", "mean", "std",
        *[np_round(F.col(c), 2).alias(c) for c in ("min", "q25", "q50", "q75", "max")])


def days_per_product(df: DataFrame) -> DataFrame:
    """Fewest, median and most dates of a product, and the overall range.

    The number of dates of a product is a small integer, so the histogram
    of those numbers has one row per day of the calendar at most.
    """
    pairs = df.where(F.col("product_id").isNotNull()).groupBy("product_id").agg(
        F.count_distinct("date").alias("days"),
        F.min("date").alias("lo"), F.max("date").alias("hi"))
    sizes = pairs.groupBy("days").agg(
        F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    all_days = df.select("date").where(F.col("date").isNotNull()).distinct().agg(
        F.count(F.lit(1))).scalar()
    return sizes.agg(
        F.min("days").alias("min_days"),
        F.expr("percentile(days, 0.5D, n)").cast("bigint").alias("median_days"),
        F.max("days").alias("max_days"),
        F.min("lo").alias("date_start"), F.max("hi").alias("date_end"),
    ).withColumn("total_days", all_days)


def avg_price_changes(df: DataFrame) -> DataFrame:
    """Mean number of price changes per product along (date, store).

    A step into or out of a missing price counts as none. Copies of a row
    collapse before the shuffle, and rows are reduced per product and day
    before the days of a product are put in order.
    """
    df = df.where(F.col("product_id").isNotNull())
    by_store = ["store_id"] if "store_id" in df.columns else []
    stores = Window.partitionBy("product_id", "date").orderBy(*by_store, "price")
    p = F.col("price")
    changed = lambda a, b: F.coalesce((a != b).cast("int"), F.lit(0))
    days = (df.select("product_id", "date", *by_store, "price").distinct()
            .withColumns({"_row": F.row_number().over(stores),
                          "_step": changed(p, F.lag(p).over(stores))})
            .groupBy("product_id", "date").agg(
                F.sum("_step").alias("steps"),
                F.min_by("price", "_row").alias("first"),
                F.max_by("price", "_row").alias("last")))
    dates = Window.partitionBy("product_id").orderBy("date")
    per_product = (days.withColumn(
        "_seam", changed(F.col("first"), F.lag("last").over(dates)))
        .groupBy("product_id").agg(
            (F.sum("steps") + F.sum("_seam")).alias("changes")))
    return per_product.agg(np_round(F.avg("changes"), 4).alias("avg_price_changes"))


def flag_lift(df: DataFrame) -> DataFrame:
    """Frequency of each flag and the plain difference of mean sales."""
    flags = flag_columns(df)
    cells = df.groupBy(*flags).agg(
        F.sum("sales_quantity").alias("units"),
        F.count("sales_quantity").alias("valued"),
        F.count(F.lit(1)).alias("rows"))
    state = F.explode(F.array(*[
        F.struct(F.lit(f).alias("flag"), F.col(f).cast("double").alias("on"))
        for f in flags])).alias("s")
    on, n = F.col("s.on"), F.col("rows")
    mean = lambda cond: quotient(F.sum(F.when(cond, F.col("units"))),
                                 F.sum(F.when(cond, F.col("valued"))))
    table = (cells.select(state, "units", "valued", "rows").groupBy("s.flag").agg(
        quotient(F.sum(on * n), F.sum(F.when(on.isNotNull(), n))).alias("_freq"),
        mean(on == 0).alias("_off"), mean(on == 1).alias("_on")))
    lift = F.when((F.col("_off") > 0) & (F.col("_freq") > 0),
                  (quotient(F.col("_on"), F.col("_off")) - 1) * 100)
    return table.select(
        "flag", np_round(F.col("_freq"), 4).alias("frequency"),
        np_round(F.col("_on"), 4).alias("avg_on"),
        np_round(F.col("_off"), 4).alias("avg_off"),
        np_round(lift, 1).alias("lift_pct"))


def event_frequency(df: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent events of raw rows against rows without an event."""
    events = df.groupBy("event_name").agg(
        F.count("sales_quantity").alias("days"), F.avg("sales_quantity").alias("_avg"))
    baseline = df.where(F.col("event_name").isNull()).agg(
        F.avg("sales_quantity")).scalar()
    return (events.where(F.col("event_name").isNotNull())
            .orderBy(F.desc("days"), "event_name").limit(n)
            .select("event_name", "days", np_round(F.col("_avg"), 2).alias("avg_units"),
                    np_round((quotient(F.col("_avg"), baseline) - 1) * 100, 1)
                    .alias("vs_baseline_pct")))
