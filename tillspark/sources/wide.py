"""From the wide sales matrix (one column per day) to the sales model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import np_round

ID_COLUMNS = ("item_id", "cat_id", "store_id", "state_id")
DAY_PREFIX = "d_"
SNAP_PREFIX = "snap_"


def day_columns(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c.startswith(DAY_PREFIX)]


def _day_cells(wide: DataFrame) -> Column:
    """The day columns as one array; written as text, since a call per
    column costs seconds of plan building on a matrix of years."""
    return F.expr("array(" + ", ".join(
        f"CAST(`{c}` AS BIGINT)" for c in day_columns(wide)) + ")")


def filter_wide(wide: DataFrame, store_id: str | None = None,
                category: str | None = None) -> DataFrame:
    """Rows of one store and one category; both reach the scan as filters."""
    out = wide
    if store_id is not None:
        out = out.where(F.col("store_id") == store_id)
    if category is not None:
        out = out.where(F.col("cat_id") == category)
    return out


def row_totals(wide: DataFrame) -> DataFrame:
    """Adds ``total_units``, the sum over all day columns of the row."""
    total = F.aggregate(_day_cells(wide), F.lit(0).cast("bigint"),
                        lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return wide.withColumn("total_units", total)


def top_items(wide: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with most units; ties go to the first item and store."""
    return (row_totals(wide)
            .orderBy(F.desc("total_units"), "item_id", "store_id").limit(n))


def melt_wide(wide: DataFrame) -> DataFrame:
    """One row per item, store and day code.

    The day cells travel as one array and are exploded by position: a
    single generator instead of one projection per day column.
    """
    names = F.expr("array(" + ", ".join(f"'{d}'" for d in day_columns(wide)) + ")")
    return (wide.select(*ID_COLUMNS, F.posexplode(_day_cells(wide))
                        .alias("_i", "sales_quantity"))
            .select(*ID_COLUMNS, F.element_at(names, F.col("_i") + 1).alias("d"),
                    "sales_quantity"))


def join_calendar(long: DataFrame, calendar: DataFrame,
                  state: str | None = None) -> DataFrame:
    """Adds date, week, event and the SNAP flag of the row's state.

    The calendar has one row per day; Spark broadcasts it after checking
    its size. Without ``state`` the flags of all states are looked up.
    """
    if state is not None:
        cal = calendar.select("d", "date", "wm_yr_wk", "event_name_1",
                              F.col(f"{SNAP_PREFIX}{state}").alias("snap"))
        return long.join(cal, "d", "left")
    states = [c for c in calendar.columns if c.startswith(SNAP_PREFIX)]
    flags = F.map_from_arrays(
        F.array(*[F.lit(c[len(SNAP_PREFIX):]) for c in states]),
        F.array(*[F.col(c) for c in states]))
    cal = calendar.select("d", "date", "wm_yr_wk", "event_name_1",
                          flags.alias("_snap"))
    return (long.join(cal, "d", "left")
            .withColumn("snap", F.try_element_at("_snap", F.col("state_id")))
            .drop("_snap"))


def join_weekly_price(long: DataFrame, prices: DataFrame) -> DataFrame:
    cols = prices.select("store_id", "item_id", "wm_yr_wk", "sell_price")
    return long.join(cols, ["store_id", "item_id", "wm_yr_wk"], "left")


def drop_prelaunch(priced: DataFrame) -> DataFrame:
    """Drops rows without a price: the item was not yet offered there."""
    return priced.where(F.col("sell_price").isNotNull())


def prelaunch_count(wide: DataFrame, calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: cells of the matrix, and those that ``drop_prelaunch`` drops.

    Counted from items, weeks and prices without the melt: a priced week keeps
    as many cells of an item as it has days in the matrix. Every table is reduced
    before its join; repeated rows of the matrix count each, repeated calendar
    days or prices once.
    """
    days = F.array(*[F.lit(d) for d in day_columns(wide)])
    weeks = (calendar.where(F.array_contains(days, F.col("d"))).dropDuplicates(["d"])
             .groupBy("wm_yr_wk").agg(F.count(F.lit(1)).alias("n_days")))
    priced = (prices.where(F.col("sell_price").isNotNull())
              .select("store_id", "item_id", "wm_yr_wk").distinct()
              .join(weeks, "wm_yr_wk").groupBy("store_id", "item_id")
              .agg(F.sum("n_days").alias("n_kept")))
    items = wide.groupBy("store_id", "item_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return (items.join(priced, ["store_id", "item_id"], "left")
            .agg(F.coalesce(F.sum("n_lines"), F.lit(0)).alias("lines"),
                 F.coalesce(F.sum(F.col("n_lines") * F.col("n_kept")), F.lit(0)).alias("kept"))
            .select((F.col("lines") * len(day_columns(wide))).alias("n_cells"),
                    (F.col("lines") * len(day_columns(wide)) - F.col("kept"))
                    .alias("n_prelaunch")))


def canonical_sales(priced: DataFrame) -> DataFrame:
    """The columns of the sales model in their order."""
    return priced.select(
        F.col("date").cast("date").alias("date"),
        F.col("item_id").alias("product_id"),
        F.col("item_id").alias("product_name"),
        F.col("cat_id").alias("category"),
        F.col("sales_quantity").cast("bigint").alias("sales_quantity"),
        np_round(F.col("sell_price"), 2).alias("price"),
        F.col("snap").cast("int").alias("snap_day"),
        F.col("event_name_1").isNotNull().cast("int").alias("holiday"),
        F.col("event_name_1").alias("event_name"),
        "store_id")


def subset_of(wide: DataFrame, store_id: str | None = None, category: str | None = None,
              top_n: int | None = None) -> DataFrame:
    """The rows of the matrix that a preparation asks for."""
    kept = filter_wide(wide, store_id, category)
    if kept is not wide and kept.limit(1).isEmpty():
        raise ValueError(
            f"no rows for store_id={store_id!r} and category={category!r}")
    return kept if top_n is None else top_items(kept, top_n)


def prepare_subset(wide: DataFrame, calendar: DataFrame, prices: DataFrame,
                   store_id: str | None = None,
                   category: str | None = None,
                   top_n: int | None = None) -> DataFrame:
    """The whole preparation: filter and top-N before the melt, then joins.

    Everything is converted unless a store, a category or a number of items
    is asked for. A subset without rows is an error.
    """
    kept = subset_of(wide, store_id, category, top_n)
    state = store_id.split("_")[0] if store_id is not None else None
    dated = join_calendar(melt_wide(kept), calendar, state)
    return canonical_sales(drop_prelaunch(join_weekly_price(dated, prices)))
