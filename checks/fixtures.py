"""The given star-schema tables in the shape of the sales model.

Every adapter reads whole tables. Joins carry no broadcast hints: Spark
broadcasts a side after checking its size and otherwise splits skewed join
partitions at run time. Aggregations combine before their shuffle, so a
part or a day that holds a large share of all lines shrinks to its cells.
"""

from __future__ import annotations

from datetime import date
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillspark.operators import clean
from tillspark.operators.features import build_features
from tillspark.session import stage

# ---- fixed values ----
NAMED_DAYS = {
    (12, 25): "Christmas", (1, 1): "NewYear", (7, 4): "IndependenceDay",
    (2, 14): "ValentinesDay", (10, 31): "Halloween",
}
VALUE_TYPES = ("ECONOMY", "STANDARD", "SMALL")
STORES = ("CA_1", "TX_1", "WI_1", "CA_2", "TX_2")
CATEGORIES = ("FOODS", "HOBBIES", "HOUSEHOLD")
FIRST_WEEK = 11101
ROWS_A_PART = 250_000


@cache
def _schema(spark: SparkSession, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet").schema


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its footer is read for the schema once per session."""
    return spark.read.schema(_schema(spark, sf, name)).parquet(f"{sf}/{name}.parquet")


def event_name(on: Column) -> Column:
    out = F.lit(None).cast("string")
    for (month, day), name in NAMED_DAYS.items():
        out = F.when((F.month(on) == month) & (F.dayofmonth(on) == day),
                     name).otherwise(out)
    return out


def with_events(df: DataFrame) -> DataFrame:
    named = event_name(F.col("date"))
    return df.withColumns({
        "snap_day": (F.dayofmonth("date") <= 10).cast("int"),
        "holiday": named.isNotNull().cast("int"),
        "event_name": named})


def _cents(col: Column) -> Column:
    return F.floor(col * 100) / F.lit(100.0)


def _ratio() -> Column:
    return F.max(F.try_divide("l_extendedprice", "l_quantity")).alias("ratio")


def _qty() -> Column:
    return F.sum("l_quantity").cast("bigint").alias("qty")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with their day and region.

    Each dimension is joined to the lines by itself: Spark knows the size of a
    table before it runs, that of a join of dimensions only after all lines
    have been shuffled for it.
    """
    lines = table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
        F.col("l_shipdate").cast("date").alias("date"))
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf, "region").select("r_regionkey", "r_name")
    return (lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .drop("s_suppkey", "s_nationkey", "n_nationkey", "n_regionkey"))


def _typed_lines(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", *columns)
    return _lines(spark, sf).join(part, F.col("l_partkey") == F.col("p_partkey"))


def parts_of(spark: SparkSession, sf: str) -> int:
    """Parts of the order lines, so that the rows of a task stay as they are
    however large the table is."""
    return max(1, -(-_line_count(spark, sf) // ROWS_A_PART))


@cache
def _line_count(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "lineitem").count()


def item(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse: one series per part and region.

    Hardly two lines share a cell, so combining them before the shuffle would
    only fill a table of a whole split's lines; they are dealt by cell, which
    spreads a part with a large share of them. Its cells, a few a day at most,
    then go by product, and everything along a series finds them there.
    """
    parts, product = parts_of(spark, sf), lambda key: F.concat(
        F.lit("P"), F.col(key).cast("string"))
    part = table(spark, sf, "part").select(
        product("p_partkey").alias("product_id"), "p_name", "p_type")
    cells = (_lines(spark, sf).select(
        "date", product("l_partkey").alias("product_id"), F.col("r_name").alias("store_id"),
        "l_quantity", "l_extendedprice").repartition(parts, "date", "product_id", "store_id")
        .groupBy("date", "product_id", "store_id").agg(_qty(), _ratio()))
    return with_events(cells.repartition(parts, "product_id").join(part, "product_id").select(
        "date", "product_id", F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"), F.col("qty").alias("sales_quantity"),
        _cents(F.col("ratio")).alias("price"), "store_id"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Gappy but dense: part type times region."""
    kind = F.col("p_type")
    grouped = (_typed_lines(spark, sf, "p_type")
               .groupBy("date", "p_type", "r_name").agg(_qty(), _ratio()))
    return with_events(grouped.select(
        "date", kind.alias("product_id"), kind.alias("product_name"),
        F.when(kind.isin(*VALUE_TYPES), "VALUE").otherwise("CORE").alias("category"),
        F.col("qty").alias("sales_quantity"), _cents(F.col("ratio")).alias("price"),
        F.col("r_name").alias("store_id")))


def clean_series(spark: SparkSession, sf: str) -> DataFrame:
    """``series`` after the cleaning steps; its keys are unique."""
    return clean.finish_rows(series(spark, sf))


def dense(spark: SparkSession, sf: str) -> DataFrame:
    """Every day for every series, zero where nothing was shipped."""
    sold = series(spark, sf).select(
        "product_id", "store_id", "date", "sales_quantity", "price")
    days = table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("day"))
    ends = days.agg(F.struct(F.min("day").alias("lo"), F.max("day").alias("hi"))).scalar()
    calendar = (sold.select("product_id", "store_id").distinct()
                .withColumns({"_lo": ends["lo"], "_hi": ends["hi"]})
                .select("product_id", "store_id",
                        F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day")))
                        .alias("date")))
    full = calendar.join(sold, ["product_id", "store_id", "date"], "left")
    return with_events(full.withColumn(
        "sales_quantity", F.coalesce("sales_quantity", F.lit(0).cast("bigint"))))


def dense_clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean.finish_rows(dense(spark, sf))


def dense_features(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    return build_features(dense_clean(spark, sf), validate=False)


@cache
def staged_features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table written once per session, for the training queries."""
    return stage(dense_features(spark, sf)[0], "features")


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """All text, with known defects and exact copies."""
    return spark.sql(DIRTY_SQL.format(lineitem=f"parquet.`{sf}/lineitem.parquet`"))


DIRTY_ROW = """
SELECT CASE WHEN l_orderkey % 97 = 0 THEN 'not-a-date'
            ELSE substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 10) END AS date,
       concat('P', CAST(l_partkey AS STRING)) AS product_id,
       concat('S', CAST(l_suppkey AS STRING)) AS store_id,
       CAST(CAST(l_quantity AS BIGINT) AS STRING) AS sales_quantity,
       CASE WHEN l_orderkey % 89 = 0 THEN '-1.0' WHEN l_orderkey % 83 = 0 THEN NULL
            ELSE CAST(CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS STRING)
            END AS price,
       CASE l_orderkey % 7 WHEN 0 THEN 'x' WHEN 1 THEN NULL WHEN 2 THEN '1'
            WHEN 3 THEN '0' WHEN 4 THEN '1.0' WHEN 5 THEN '5.7' ELSE ' 0 ' END AS snap_day
FROM {lineitem}"""
DIRTY_SQL = f"{DIRTY_ROW} UNION ALL {DIRTY_ROW} WHERE l_orderkey % 101 = 0"


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    """``dirty`` without the keys whose rows disagree.

    Rows meet their key's others in one shuffle, in parts of a fixed number of
    rows. The window goes by a copy of the date, so that a reader's filter on dates
    stays above it and two readers in a plan share the shuffle.
    """
    rows, key = dirty(spark, sf), ["_day", "product_id", "store_id"]
    values = F.xxhash64("sales_quantity", "price", "snap_day")
    same = Window.partitionBy(*key)
    dealt = rows.withColumn("_day", F.col("date")).repartition(parts_of(spark, sf), *key)
    marked = dealt.withColumn("_torn", F.min(values).over(same) != F.max(values).over(same))
    unkeyed = F.lit(False)
    for c in key:
        unkeyed = unkeyed | F.col(c).isNull()
    return marked.where(unkeyed | (F.col("_day") == "not-a-date") | ~F.col("_torn")).drop(
        "_day", "_torn")


# ---- the wide matrix --------------------------------------------------------

@cache
def wide_period(spark: SparkSession, sf: str) -> tuple[date, int]:
    """First day of the table and its number of days."""
    day = F.col("l_shipdate").cast("date")
    ends = table(spark, sf, "lineitem").agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()
    return ends["lo"], (ends["hi"] - ends["lo"]).days + 1


def _wide_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with the number of their day, all of them."""
    start = F.lit(wide_period(spark, sf)[0])
    brand = F.substring("p_brand", 7, 10).cast("int")
    store = F.element_at(F.array(*[F.lit(s) for s in STORES]), F.col("r_regionkey") + 1)
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), brand % 3 + 1)
    return (_typed_lines(spark, sf, "p_brand")
            .select(F.col("p_brand").alias("item_id"), category.alias("cat_id"),
                    store.alias("store_id"), F.substring(store, 1, 2).alias("state_id"),
                    (F.datediff("date", start) + 1).alias("n"), "l_quantity",
                    "l_extendedprice"))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """One row per item and store, one column per day of the table.

    The days of a row are gathered as one map, which the calendar bounds: a
    pivot of thousands of columns outgrows the compiler of the JVM.
    """
    ids, count = ("item_id", "cat_id", "store_id", "state_id"), wide_period(spark, sf)[1]
    rows = (_wide_lines(spark, sf).groupBy(*ids, "n").agg(_qty())
            .groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("n", "qty")))
                               .alias("_sold")))
    cells = rows.select(*ids, F.transform(
        F.sequence(F.lit(1), F.lit(count)),
        lambda n: F.coalesce(F.try_element_at("_sold", n), F.lit(0).cast("bigint"))
    ).alias("_cells"))
    return cells.selectExpr(*ids, *[f"_cells[{i}] AS d_{i + 1}" for i in range(count)])


def wide_calendar(spark: SparkSession, sf: str) -> DataFrame:
    start, count = wide_period(spark, sf)
    days = spark.range(1, count + 1).select(F.col("id").cast("int").alias("n"))
    dated = days.withColumn("date", F.date_add(F.lit(start), F.col("n") - 1))
    day = F.dayofmonth("date")
    return dated.select(
        F.concat(F.lit("d_"), F.col("n").cast("string")).alias("d"), "date",
        (FIRST_WEEK + F.floor((F.col("n") - 1) / F.lit(7))).cast("int").alias("wm_yr_wk"),
        event_name(F.col("date")).alias("event_name_1"),
        (day <= 10).cast("int").alias("snap_CA"),
        day.between(11, 20).cast("int").alias("snap_TX"),
        (day % 2 == 1).cast("int").alias("snap_WI"))


def wide_prices(spark: SparkSession, sf: str) -> DataFrame:
    week = (FIRST_WEEK + F.floor((F.col("n") - 1) / F.lit(7))).cast("int")
    return (_wide_lines(spark, sf).groupBy("store_id", "item_id", week.alias("wm_yr_wk"))
            .agg(_ratio())
            .select("store_id", "item_id", "wm_yr_wk",
                    _cents(F.col("ratio")).alias("sell_price")))


# ---- requests ---------------------------------------------------------------

REQUEST_FEATURES = (
    "price", "snap_day", "holiday", "has_named_event", "year", "month",
    "day_of_week", "is_weekend", "lag_1", "lag_7", "rolling_mean_7",
)


def request_rows(features: DataFrame) -> DataFrame:
    """One request per feature row, with defects by the day's number."""
    n = F.datediff("date", F.lit("1995-01-02")) % 50
    pair = lambda name, value: F.struct(
        F.lit(name).alias("name"), value.cast("double").alias("value"))
    lag_1, lag_7 = pair("lag_1", F.col("lag_1")), pair("lag_7", F.col("lag_7"))
    mean_7 = pair("rolling_mean_7", F.col("rolling_mean_7"))
    text = F.date_format("date", "yyyy-MM-dd")
    given = (F.when(n == 4, F.array(lag_1, lag_7, mean_7, lag_1))
             .when(n == 5, F.array(lag_1, pair("mystery", F.lit(1.0))))
             .when(n == 8, F.array(lag_1, pair("lag_7", F.lit(None))))
             .when(n == 9, F.lit(None))
             .when(n == 10, F.array(lag_1, pair("month", F.lit(99.0))))
             .otherwise(F.array(lag_1, lag_7, mean_7)))
    return features.select(
        F.when(n == 1, F.date_format("date", "yyyyMMdd"))
        .when(n == 7, F.concat(F.substring(text, 1, 4), F.lit("-13-45")))
        .otherwise(text).alias("date"),
        F.when(n == 6, "").otherwise(F.col("product_id")).alias("product_id"),
        F.when(n == 2, -F.col("price")).otherwise(F.col("price")).alias("price"),
        F.when(n == 3, 2).otherwise(F.col("snap_day")).alias("snap_day"),
        F.col("holiday"), F.col("has_named_event"), given.alias("features"),
        F.concat_ws("/", "product_id", "store_id", text).alias("request_id"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return request_rows(dense_features(spark, sf)[0])
