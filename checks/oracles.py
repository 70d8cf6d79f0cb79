"""The registered queries in SQL for DuckDB, written on their own.

Each text is one SELECT over common table expressions that shape the
given tables; only the needed ones are put in front.
"""

from __future__ import annotations

import re

ORACLES: dict[str, str] = {}

EVENT = """CASE WHEN month(date)=12 AND day(date)=25 THEN 'Christmas'
     WHEN month(date)=1  AND day(date)=1  THEN 'NewYear'
     WHEN month(date)=7  AND day(date)=4  THEN 'IndependenceDay'
     WHEN month(date)=2  AND day(date)=14 THEN 'ValentinesDay'
     WHEN month(date)=10 AND day(date)=31 THEN 'Halloween' END"""
FLAGS = f"""CAST(CASE WHEN day(date) <= 10 THEN 1 ELSE 0 END AS INT) AS snap_day,
    CAST(CASE WHEN {EVENT} IS NOT NULL THEN 1 ELSE 0 END AS INT) AS holiday,
    {EVENT} AS event_name"""


def r(expr: str, digits: int) -> str:
    """Half-to-even rounding of the scaled value."""
    scale = f"CAST({10 ** digits} AS DOUBLE)"
    return f"(round_even(CAST({expr} AS DOUBLE) * {scale}, 0) / {scale})"


def outliers(k: float) -> str:
    """1 where sales exceed the limit of their series, else 0."""
    iqr = "(q3 - q1)"
    return (f"CAST(CASE WHEN {iqr} > 0 THEN CASE WHEN sales_quantity > q3 + {k} * {iqr} "
            f"THEN 1 ELSE 0 END WHEN sd > 0 AND sales_quantity > mu + 4 * sd THEN 1 "
            f"ELSE 0 END AS INT)")


LINES = """SELECT CAST(l_shipdate AS DATE) AS date, l_partkey, l_quantity, l_extendedprice,
    r_name, n_regionkey, p_name, p_type, p_brand
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

CTES: dict[str, str] = {
    "lines": LINES,
    "item0": """SELECT date, concat('P', CAST(l_partkey AS VARCHAR)) AS product_id,
        p_name AS product_name, p_type AS category,
        CAST(sum(l_quantity) AS BIGINT) AS sales_quantity,
        floor(max(l_extendedprice / l_quantity) * 100) / 100 AS price, r_name AS store_id
      FROM lines GROUP BY 1, 2, 3, 4, 7""",
    "item": f"SELECT *, {FLAGS} FROM item0",
    "series0": """SELECT date, p_type AS product_id, p_type AS product_name,
        CASE WHEN p_type IN ('ECONOMY','STANDARD','SMALL') THEN 'VALUE' ELSE 'CORE' END AS category,
        CAST(sum(l_quantity) AS BIGINT) AS sales_quantity,
        floor(max(l_extendedprice / l_quantity) * 100) / 100 AS price, r_name AS store_id
      FROM lines GROUP BY 1, 2, 3, 4, 7""",
    "series": f"SELECT *, {FLAGS} FROM series0",
    "series_stats": """SELECT product_id, store_id,
        quantile_cont(CAST(sales_quantity AS DOUBLE), 0.25) AS q1,
        quantile_cont(CAST(sales_quantity AS DOUBLE), 0.75) AS q3,
        avg(sales_quantity) AS mu, stddev_samp(sales_quantity) AS sd
      FROM series GROUP BY 1, 2""",
    # cleaned: events named, flags of unusual demand
    "cs": f"""SELECT s.* REPLACE (coalesce(event_name, 'none') AS event_name),
        0 AS is_gap_fill, {outliers(3.0)} AS outlier_flag
      FROM series s JOIN series_stats t USING (product_id, store_id)""",
    "cs15": f"""SELECT s.* REPLACE (coalesce(event_name, 'none') AS event_name),
        {outliers(1.5)} AS outlier_flag
      FROM series s JOIN series_stats t USING (product_id, store_id)""",
    "dense0": """SELECT k.product_id, k.store_id, k.date,
        coalesce(s.sales_quantity, 0) AS sales_quantity, s.price
      FROM (SELECT product_id, store_id,
              CAST(unnest(generate_series(mn, mx, INTERVAL 1 DAY)) AS DATE) AS date
            FROM (SELECT DISTINCT product_id, store_id FROM series0) a
            CROSS JOIN (SELECT min(date) AS mn, max(date) AS mx FROM series0) b) k
      LEFT JOIN series0 s ON s.product_id = k.product_id AND s.store_id = k.store_id
        AND s.date = k.date""",
    "dense": f"SELECT *, {FLAGS} FROM dense0",
    "dense_stats": """SELECT product_id, store_id,
        quantile_cont(CAST(sales_quantity AS DOUBLE), 0.25) AS q1,
        quantile_cont(CAST(sales_quantity AS DOUBLE), 0.75) AS q3,
        avg(sales_quantity) AS mu, stddev_samp(sales_quantity) AS sd
      FROM dense GROUP BY 1, 2""",
    "dc": f"""SELECT d.* REPLACE (coalesce(event_name, 'none') AS event_name,
          last_value(price IGNORE NULLS) OVER (PARTITION BY d.product_id, d.store_id
            ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price),
        CAST(0 AS INT) AS is_gap_fill, {outliers(3.0)} AS outlier_flag
      FROM dense d JOIN dense_stats t USING (product_id, store_id)""",
    "dirty0": """SELECT l_orderkey, CASE WHEN l_orderkey % 97 = 0 THEN 'not-a-date'
          ELSE substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 1, 10) END AS date,
        concat('P', CAST(l_partkey AS VARCHAR)) AS product_id,
        concat('S', CAST(l_suppkey AS VARCHAR)) AS store_id,
        CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS sales_quantity,
        CASE WHEN l_orderkey % 89 = 0 THEN '-1.0' WHEN l_orderkey % 83 = 0 THEN NULL
          ELSE CAST(CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS VARCHAR) END AS price,
        CASE l_orderkey % 7 WHEN 0 THEN 'x' WHEN 1 THEN NULL WHEN 2 THEN '1'
          WHEN 3 THEN '0' WHEN 4 THEN '1.0' WHEN 5 THEN '5.7' ELSE ' 0 ' END AS snap_day
      FROM lineitem""",
    "dirty": """SELECT * EXCLUDE (l_orderkey) FROM dirty0 UNION ALL
      SELECT * EXCLUDE (l_orderkey) FROM dirty0 WHERE l_orderkey % 101 = 0""",
    "conflicts": """SELECT date, product_id, store_id, count(*) AS n_rows
      FROM (SELECT DISTINCT * FROM dirty WHERE date <> 'not-a-date')
      GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "resolved": """SELECT d.* FROM dirty d WHERE NOT EXISTS (SELECT 1 FROM conflicts c
        WHERE c.date = d.date AND c.product_id = d.product_id AND c.store_id = d.store_id)""",
    "uniq": """SELECT DISTINCT CAST(date AS DATE) AS date, product_id, store_id,
        CAST(sales_quantity AS BIGINT) AS sales_quantity,
        CAST(price AS DOUBLE) AS raw_price, snap_day
      FROM resolved WHERE date <> 'not-a-date'""",
    "filled": """SELECT date, product_id, store_id, sales_quantity, raw_price,
        last_value(CASE WHEN raw_price > 0 THEN raw_price END IGNORE NULLS) OVER (
          PARTITION BY product_id, store_id ORDER BY date
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price,
        CAST(coalesce(trunc(TRY_CAST(trim(snap_day) AS DOUBLE)), 0) AS INT) AS snap_day
      FROM uniq""",
    "filled_stats": """SELECT product_id, store_id,
        quantile_cont(CAST(sales_quantity AS DOUBLE), 0.25) AS q1,
        quantile_cont(CAST(sales_quantity AS DOUBLE), 0.75) AS q3,
        avg(sales_quantity) AS mu, stddev_samp(sales_quantity) AS sd
      FROM filled GROUP BY 1, 2""",
    "cleaned": f"""SELECT f.date, product_id, store_id, sales_quantity, price, snap_day,
        CAST(0 AS INT) AS is_gap_fill, {outliers(3.0)} AS outlier_flag
      FROM filled f JOIN filled_stats t USING (product_id, store_id)""",
    "item_gaps": """SELECT product_id, store_id,
        CAST(date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS BIGINT)
          AS missing_days FROM item GROUP BY 1, 2""",
    # the wide matrix in long form
    "wlines": """SELECT p_brand AS item_id,
        CASE CAST(substr(p_brand, 7) AS INT) % 3 WHEN 0 THEN 'FOODS' WHEN 1 THEN 'HOBBIES'
          ELSE 'HOUSEHOLD' END AS cat_id,
        CASE n_regionkey WHEN 0 THEN 'CA_1' WHEN 1 THEN 'TX_1' WHEN 2 THEN 'WI_1'
          WHEN 3 THEN 'CA_2' ELSE 'TX_2' END AS store_id,
        CASE n_regionkey WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' WHEN 2 THEN 'WI'
          WHEN 3 THEN 'CA' ELSE 'TX' END AS state_id,
        date_diff('day', lo, date) + 1 AS n, l_quantity,
        l_extendedprice / l_quantity AS ratio
      FROM lines, wends""",
    "wends": """SELECT CAST(min(l_shipdate) AS DATE) AS lo, CAST(max(l_shipdate) AS DATE) AS hi
      FROM lineitem""",
    "wsum": """SELECT item_id, store_id, n, CAST(sum(l_quantity) AS BIGINT) AS q
      FROM wlines GROUP BY 1, 2, 3""",
    "wids": "SELECT DISTINCT item_id, cat_id, store_id, state_id FROM wlines",
    "wlong": """SELECT i.*, g.n, coalesce(w.q, 0) AS q FROM wids i
      CROSS JOIN (SELECT unnest(range(1, date_diff('day', lo, hi) + 2)) AS n FROM wends) g
      LEFT JOIN wsum w ON w.item_id = i.item_id AND w.store_id = i.store_id AND w.n = g.n""",
    "wdated0": """SELECT wlong.*, CAST(lo + CAST(n - 1 AS INT) AS DATE) AS date,
        CAST(11101 + (n - 1) // 7 AS INT) AS wm_yr_wk FROM wlong, wends""",
    "wdated": f"""SELECT *, {EVENT} AS event_name_1,
        CAST(CASE state_id WHEN 'CA' THEN day(date) <= 10
          WHEN 'TX' THEN day(date) BETWEEN 11 AND 20 ELSE day(date) % 2 = 1 END AS INT) AS snap
      FROM wdated0""",
    "wprices": """SELECT item_id, store_id, CAST(11101 + (n - 1) // 7 AS INT) AS wm_yr_wk,
        floor(max(ratio) * 100) / 100 AS sell_price FROM wlines GROUP BY 1, 2, 3""",
    "wpriced": """SELECT d.*, p.sell_price FROM wdated d LEFT JOIN wprices p
        USING (item_id, store_id, wm_yr_wk)""",
    "wcanon": f"""SELECT date, item_id AS product_id, item_id AS product_name,
        cat_id AS category, q AS sales_quantity, {r('sell_price', 2)} AS price,
        snap AS snap_day, CAST(event_name_1 IS NOT NULL AS INT) AS holiday,
        event_name_1 AS event_name, store_id FROM wpriced WHERE sell_price IS NOT NULL""",
    "price_prior": """SELECT *, lag(price) OVER (PARTITION BY product_id
          ORDER BY store_id, date) AS prior FROM item WHERE price IS NOT NULL""",
    "profile": f"""SELECT product_id, {r(r('avg(price)', 9), 3)} AS avg_price,
        min(price) AS min_price, max(price) AS max_price,
        CAST(count(*) FILTER (WHERE prior IS NOT NULL AND price <> prior) AS BIGINT)
          AS n_price_changes,
        {r('''CASE WHEN count(*) >= 30 AND min(price) < max(price)
              AND min(sales_quantity) < max(sales_quantity)
              THEN corr(price, sales_quantity) END''', 4)} AS within_product_corr
      FROM price_prior GROUP BY 1""",
    # events
    "flag_long": """SELECT 'holiday' AS event, holiday AS flag, sales_quantity FROM cs
      UNION ALL SELECT 'snap_day', snap_day, sales_quantity FROM cs""",
    "flag_events": f"""SELECT event, 'flag' AS event_type,
        count(*) FILTER (WHERE flag = 1) AS observations,
        {r('avg(sales_quantity) FILTER (WHERE flag = 1)', 3)} AS avg_units,
        median(sales_quantity) FILTER (WHERE flag = 1) AS median_units,
        CAST(sum(sales_quantity) FILTER (WHERE flag = 1) AS BIGINT) AS total_units,
        {r('avg(sales_quantity) FILTER (WHERE flag = 0)', 3)} AS baseline_avg_units,
        {r('''(avg(sales_quantity) FILTER (WHERE flag = 1)
            / avg(sales_quantity) FILTER (WHERE flag = 0) - 1) * 100''', 2)} AS pct_vs_baseline
      FROM flag_long GROUP BY 1
      HAVING count(*) FILTER (WHERE flag = 1) > 0 AND count(*) FILTER (WHERE flag = 0) > 0""",
    "named": f"""SELECT event_name AS event, 'named_event' AS event_type,
        count(*) AS observations, {r('avg(sales_quantity)', 3)} AS avg_units,
        median(sales_quantity) AS median_units,
        CAST(sum(sales_quantity) AS BIGINT) AS total_units,
        {r("(SELECT avg(sales_quantity) FROM cs WHERE event_name = 'none')", 3)}
          AS baseline_avg_units,
        {r('''(avg(sales_quantity) / (SELECT avg(sales_quantity) FROM cs
            WHERE event_name = 'none') - 1) * 100''', 2)} AS pct_vs_baseline
      FROM cs WHERE event_name <> 'none' GROUP BY 1""",
    "dow0": "SELECT date, sum(sales_quantity) AS t FROM cs GROUP BY 1",
    "months": """SELECT CAST(date_trunc('month', date) AS DATE) AS month_start,
        sum(sales_quantity) AS t FROM cs GROUP BY 1""",
    "month_no": """SELECT t, row_number() OVER (ORDER BY month_start) AS up,
        row_number() OVER (ORDER BY month_start DESC) AS down FROM months""",
    "metrics": """SELECT product_id, arg_min(product_name, (store_id, date)) AS product_name,
        CAST(sum(sales_quantity) AS BIGINT) AS total_units,
        count(sales_quantity) AS n_days, avg(sales_quantity) AS mu,
        stddev_samp(sales_quantity) AS sd,
        avg(CASE WHEN sales_quantity = 0 THEN 1.0 ELSE 0.0 END) * 100 AS z
      FROM item GROUP BY 1""",
    "metrics3": f"""SELECT product_id, product_name, total_units, n_days,
        {r('mu', 3)} AS avg_daily_units, {r('sd', 3)} AS std_daily_units,
        {r('sd / nullif(mu, 0)', 3)} AS cv, {r('z', 3)} AS zero_sales_pct FROM metrics""",
    "item_stats": """SELECT product_id, store_id,
        quantile_cont(CAST(sales_quantity AS DOUBLE), 0.25) AS q1,
        quantile_cont(CAST(sales_quantity AS DOUBLE), 0.75) AS q3,
        avg(sales_quantity) AS mu, stddev_samp(sales_quantity) AS sd
      FROM item GROUP BY 1, 2""",
    "item_flagged": f"""SELECT product_id, sum({outliers(3.0)}) AS n
      FROM item JOIN item_stats USING (product_id, store_id) GROUP BY 1""",
    "dates": """SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n
      FROM (SELECT DISTINCT date FROM series)""",
    "ddates": """SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n
      FROM (SELECT DISTINCT date FROM dense)""",
}


def split_of(i: str, n: str) -> str:
    return (f"CASE WHEN {i} <= floor({n} * CAST(0.7 AS DOUBLE)) THEN 'train' "
            f"WHEN {i} <= floor({n} * CAST(0.85 AS DOUBLE)) THEN 'validation' "
            f"ELSE 'test' END")


# ---- features over the dense table ------------------------------------------

W = "PARTITION BY product_id, store_id ORDER BY date"


def frame(w: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


def full(fn: str, col: str, w: int) -> str:
    return f"CASE WHEN count({col}) {frame(w)} = {w} THEN {fn} {frame(w)} END"


def rolling(w: int) -> list[str]:
    q = "sales_quantity"
    return [f"{r(full(f'avg({q})', q, w), 6)} AS rolling_mean_{w}",
            f"{r(full(f'stddev_samp({q})', q, w), 6)} AS rolling_std_{w}",
            f"CAST({full(f'min({q})', q, w)} AS DOUBLE) AS rolling_min_{w}",
            f"CAST({full(f'max({q})', q, w)} AS DOUBLE) AS rolling_max_{w}"]


def median(w: int) -> str:
    q = "sales_quantity"
    return f"CAST({full(f'median({q})', q, w)} AS DOUBLE) AS rolling_median_{w}"


CALENDAR = """CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
  CAST(quarter(date) AS INT) AS quarter, CAST(weekofyear(date) AS INT) AS week_of_year,
  CAST(day(date) AS INT) AS day_of_month, CAST(isodow(date) - 1 AS INT) AS day_of_week,
  CAST(dayofyear(date) AS INT) AS day_of_year, CAST(isodow(date) >= 6 AS INT) AS is_weekend,
  CAST(day(date) = 1 AS INT) AS is_month_start,
  CAST(date = last_day(date) AS INT) AS is_month_end"""
LAGS = ", ".join(f"lag(sales_quantity, {k}) OVER ({W}) AS lag_{k}" for k in (1, 7, 14, 28))
ROLLING = ", ".join(x for w in (7, 14, 28) for x in rolling(w))
MEDIANS = ", ".join(median(w) for w in (7, 28))
EXPANDING = (f"{r(f'avg(sales_quantity) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 6)}"
             " AS expanding_mean")
CHANGE = f"{r(f'price - lag(price) OVER ({W})', 6)} AS price_change"
BRIDGED = (f"last_value(price IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING "
           "AND {end})")
PCT = r(f"{BRIDGED.format(end='CURRENT ROW')} / {BRIDGED.format(end='1 PRECEDING')} - 1", 6) \
    + " AS price_pct_change"
PRICE7 = (f"{r(full('avg(price)', 'price', 7), 6)} AS rolling_price_mean_7, "
          f"{r(full('stddev_samp(price)', 'price', 7), 6)} AS rolling_price_std_7")
NAMED = "CAST(event_name IS DISTINCT FROM 'none' AS INT) AS has_named_event"

CTES["feats"] = f"""SELECT product_id, store_id, date, sales_quantity,
    {r('price', 6)} AS price, snap_day, holiday, event_name, is_gap_fill, outlier_flag,
    {CALENDAR}, {LAGS}, {ROLLING}, {MEDIANS}, {EXPANDING}, {CHANGE}, {PCT}, {PRICE7}, {NAMED}
  FROM dc"""
FEATURE_NAMES = re.findall(r" AS (\w+)(?:,|$|\s*\n)", ", ".join(
    [CALENDAR.replace("AS INT", ""), LAGS, ROLLING, MEDIANS, EXPANDING, CHANGE, PCT, PRICE7,
     NAMED]))
FEATURE_NAMES = [n for n in FEATURE_NAMES if n not in ("DOUBLE", "INT")]

# Requests with their defects, by the number of the day.
CTES["req0"] = f"""SELECT *, concat_ws('/', product_id, store_id, strftime(date, '%Y-%m-%d'))
      AS request_id, date_diff('day', DATE '1995-01-02', date) % 50 AS n,
    lag(sales_quantity, 1) OVER ({W}) AS f_lag_1,
    lag(sales_quantity, 7) OVER ({W}) AS f_lag_7,
    {full('avg(sales_quantity)', 'sales_quantity', 7)} AS f_mean_7, {NAMED} FROM dc"""
CTES["req"] = """SELECT request_id, n, date AS day,
    CASE n WHEN 1 THEN strftime(date, '%Y%m%d')
      WHEN 7 THEN concat(CAST(year(date) AS VARCHAR), '-13-45')
      ELSE strftime(date, '%Y-%m-%d') END AS date,
    CASE n WHEN 6 THEN '' ELSE product_id END AS product_id,
    CASE n WHEN 2 THEN -price ELSE price END AS price,
    CAST(CASE n WHEN 3 THEN 2 ELSE snap_day END AS INT) AS snap_day,
    holiday, has_named_event, f_lag_1, f_lag_7, f_mean_7 FROM req0"""
CTES["checked"] = """SELECT *, concat_ws(',',
      CASE WHEN n = 1 THEN 'bad_date_format' END, CASE WHEN n = 7 THEN 'not_a_date' END,
      CASE WHEN n = 6 THEN 'empty_product' END,
      CASE WHEN price IS NULL OR price <= 0 THEN 'price_not_positive' END,
      CASE WHEN n = 3 THEN 'bad_snap_day' END,
      CASE WHEN n = 4 THEN 'duplicate_feature' END,
      CASE WHEN n = 5 THEN 'unknown_feature' END) AS reasons FROM req"""


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# ---- sources and preparation -------------------------------------------------
oracle("ingest_sales", "SELECT * FROM series")
IDS = "item_id, cat_id, store_id, state_id"
oracle("wide_filter", f"""SELECT {IDS}, string_agg(CAST(q AS VARCHAR), ',' ORDER BY n) AS cells
  FROM wlong WHERE store_id = 'CA_1' AND cat_id = 'FOODS' GROUP BY ALL""")
oracle("wide_row_total",
       f"SELECT {IDS}, CAST(sum(q) AS BIGINT) AS total_units FROM wlong GROUP BY ALL")
oracle("top_n_items", f"""SELECT {IDS}, CAST(sum(q) AS BIGINT) AS total_units FROM wlong
  WHERE cat_id = 'FOODS' GROUP BY ALL ORDER BY total_units DESC, item_id, store_id LIMIT 10""")
DAY = "concat('d_', CAST(n AS VARCHAR)) AS d"
oracle("melt_wide", f"SELECT {IDS}, {DAY}, q AS sales_quantity FROM wlong")
oracle("join_calendar", f"""SELECT {DAY}, {IDS}, q AS sales_quantity, date, wm_yr_wk,
  event_name_1, snap FROM wdated""")
oracle("join_weekly_price", f"""SELECT item_id, store_id, {DAY}, wm_yr_wk,
  q AS sales_quantity, sell_price FROM wpriced""")
oracle("drop_prelaunch", f"""SELECT item_id, store_id, {DAY}, q AS sales_quantity, sell_price
  FROM wpriced WHERE sell_price IS NOT NULL""")
oracle("prelaunch_count", """SELECT count(*) AS n_cells,
  count(*) FILTER (WHERE sell_price IS NULL) AS n_prelaunch FROM wpriced""")
oracle("canonical_project", "SELECT * FROM wcanon")
oracle("prepare_subset", """SELECT c.* FROM wcanon c WHERE store_id = 'CA_1'
  AND product_id IN (SELECT item_id FROM wlong WHERE store_id = 'CA_1' AND cat_id = 'FOODS'
    GROUP BY item_id ORDER BY sum(q) DESC, item_id LIMIT 5)""")
oracle("requests_from_csv", f"""SELECT strftime(date, '%Y-%m-%d') AS date, product_id,
    count(*) AS n_requests,
    CAST(sum(CAST(f_lag_1 IS NOT NULL AS INT)
      + CAST(f_lag_7 IS NOT NULL OR snap_day = 1 AS INT)
      + CAST(f_mean_7 IS NOT NULL AS INT)) AS BIGINT) AS n_features,
    CAST(sum(snap_day) AS BIGINT) AS snap_days,
    {r('max(coalesce(price, 0.0))', 6)} AS max_price, CAST(0 AS BIGINT) AS n_holiday,
    CAST(sum(f_lag_1) AS DOUBLE) AS lag_1,
    CAST(sum(CASE WHEN snap_day = 0 THEN f_lag_7 END) AS DOUBLE) AS lag_7,
    {r('max(f_mean_7)', 6)} AS max_mean_7
  FROM req0 GROUP BY 1, 2""")

oracle("requests_from_json", f"""SELECT date, product_id, count(*) AS n_requests,
    {r('max(price)', 6)} AS max_price, CAST(sum(snap_day) AS BIGINT) AS snap_days,
    CAST(sum(has_named_event) AS BIGINT) AS named_days,
    CAST(sum(CASE n WHEN 4 THEN 4 WHEN 5 THEN 2 WHEN 8 THEN 2 WHEN 9 THEN 0 WHEN 10 THEN 2
      ELSE 3 END) AS BIGINT) AS n_features,
    CAST(sum(CASE WHEN n <> 9 THEN f_lag_1 END) AS DOUBLE) AS lag_1
  FROM req GROUP BY 1, 2""")
oracle("sink_roundtrip", """SELECT product_id, store_id, count(*) AS n_rows,
    CAST(sum(sales_quantity) AS BIGINT) AS units FROM series GROUP BY 1, 2""")

# ---- validation ----------------------------------------------------------------
oracle("validate_counts", """
  SELECT 'rows' AS "check", 'info' AS severity, count(*) AS n_rows FROM dirty
  UNION ALL SELECT 'bad_dates', 'error', count(*) FROM dirty WHERE date = 'not-a-date'
  UNION ALL SELECT 'non_numeric_sales', 'error', count(*) FROM dirty
    WHERE sales_quantity IS NOT NULL AND TRY_CAST(sales_quantity AS DOUBLE) IS NULL
  UNION ALL SELECT 'negative_sales', 'error', count(*) FROM dirty
    WHERE TRY_CAST(sales_quantity AS DOUBLE) < 0
  UNION ALL SELECT 'null_series_key', 'warning', count(*) FROM dirty
    WHERE product_id IS NULL OR store_id IS NULL
  UNION ALL SELECT 'non_positive_price', 'warning', count(*) FROM dirty
    WHERE TRY_CAST(price AS DOUBLE) <= 0""")
oracle("validate_duplicates", """SELECT CAST(count(*)
    - (SELECT count(*) FROM (SELECT DISTINCT date, product_id, store_id FROM dirty)) AS BIGINT)
    AS n_duplicates FROM dirty""")
oracle("missing_fraction", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {r(f'avg(CAST({c} IS NULL AS INT))', 6)} AS missing_fraction,
    avg(CAST({c} IS NULL AS INT)) > 0.05 AS warn FROM dirty"""
    for c in ("date", "product_id", "store_id", "sales_quantity", "price", "snap_day")))
oracle("series_gap_total",
       "SELECT CAST(sum(missing_days) AS BIGINT) AS total_missing_days FROM item_gaps")

# ---- cleaning --------------------------------------------------------------------
oracle("clean_dates", """SELECT * REPLACE (CAST(date AS DATE) AS date) FROM dirty
  WHERE date <> 'not-a-date'""")
oracle("sales_check", """SELECT count(*) AS input_rows,
    count(*) FILTER (WHERE date = 'not-a-date') AS bad_dates,
    count(*) FILTER (WHERE date <> 'not-a-date'
      AND TRY_CAST(sales_quantity AS DOUBLE) IS NULL) AS non_numeric_sales,
    count(*) FILTER (WHERE date <> 'not-a-date'
      AND TRY_CAST(sales_quantity AS DOUBLE) < 0) AS negative_sales FROM dirty""")
oracle("exact_dedup", """SELECT DISTINCT * REPLACE (CAST(date AS DATE) AS date) FROM dirty
  WHERE date <> 'not-a-date'""")
oracle("conflicting_keys", """SELECT CAST(date AS DATE) AS date, product_id, store_id, n_rows
  FROM conflicts""")
oracle("price_ffill", "SELECT date, product_id, store_id, price FROM filled")
oracle("price_repair_report", """SELECT
    count(*) FILTER (WHERE raw_price <= 0) AS invalid_price_count,
    count(*) FILTER (WHERE raw_price IS NULL OR raw_price <= 0) AS missing_price_count,
    count(*) FILTER (WHERE (raw_price IS NULL OR raw_price <= 0) AND price IS NOT NULL)
      AS prices_imputed,
    count(*) FILTER (WHERE price IS NULL) AS unresolved_price_count FROM filled""")
oracle("normalize_event", """SELECT date, product_id, store_id,
  coalesce(event_name, 'none') AS event_name FROM item""")
oracle("coerce_flags", """SELECT date, product_id, store_id, sales_quantity,
  CAST(coalesce(trunc(TRY_CAST(trim(snap_day) AS DOUBLE)), 0) AS INT) AS snap_day FROM dirty""")
oracle("detect_gaps", "SELECT * FROM item_gaps WHERE missing_days > 0")
oracle("worst_gaps", """SELECT * FROM item_gaps WHERE missing_days > 0
  ORDER BY missing_days DESC, product_id, store_id LIMIT 25""")
oracle("structural_gaps", """SELECT k.date, k.product_id, s0.product_name, s0.category,
    s.sales_quantity, s.price, k.store_id, s.snap_day, s.holiday, s.event_name,
    CAST(s.date IS NULL AS INT) AS is_gap_fill
  FROM (SELECT product_id, store_id, CAST(unnest(generate_series(min(date), max(date),
          INTERVAL 1 DAY)) AS DATE) AS date FROM series GROUP BY 1, 2) k
  JOIN (SELECT DISTINCT product_id, product_name, category FROM series) s0 USING (product_id)
  LEFT JOIN series s ON s.product_id = k.product_id AND s.store_id = k.store_id
    AND s.date = k.date""")
oracle("flag_outliers", f"""SELECT date, product_id, store_id, sales_quantity,
    {outliers(3.0)} AS flag_3, {outliers(1.5)} AS flag_1_5
  FROM series JOIN series_stats USING (product_id, store_id)""")
oracle("outliers_on_events", """SELECT count(*) FILTER (WHERE outlier_flag = 1)
    AS outlier_flag_count,
    CAST(coalesce(sum(greatest(snap_day, holiday)) FILTER (WHERE outlier_flag = 1), 0) AS BIGINT)
    AS outliers_on_event_days FROM cs15""")
oracle("top_outliers", """SELECT date, product_id, store_id, sales_quantity, snap_day, holiday,
    event_name FROM cs WHERE outlier_flag = 1
  ORDER BY sales_quantity DESC, product_id, store_id, date LIMIT 5""")
oracle("cleaning_report", f"""SELECT
    (SELECT count(*) FROM resolved) AS input_rows,
    (SELECT count(*) FROM cleaned) AS output_rows,
    (SELECT count(*) FROM resolved WHERE date <> 'not-a-date')
      - (SELECT count(*) FROM uniq) AS exact_duplicates_removed,
    (SELECT count(*) FROM resolved WHERE date = 'not-a-date') AS invalid_date_rows_dropped,
    CAST(0 AS BIGINT) AS negative_sales_rows,
    (SELECT count(*) FROM uniq WHERE raw_price <= 0) AS invalid_price_count,
    (SELECT count(*) FROM uniq WHERE raw_price IS NULL OR raw_price <= 0)
      AS missing_price_count,
    (SELECT count(*) FROM filled WHERE price IS NOT NULL
      AND (raw_price IS NULL OR raw_price <= 0)) AS prices_imputed,
    (SELECT count(*) FROM filled WHERE price IS NULL) AS unresolved_price_count,
    (SELECT {r('avg(CASE WHEN sales_quantity = 0 THEN 1.0 ELSE 0.0 END)', 4)} FROM cleaned)
      AS zero_sales_pct,
    (SELECT CAST(sum(outlier_flag) AS BIGINT) FROM cleaned) AS outlier_flag_count,
    (SELECT CAST(coalesce(sum(snap_day), 0) AS BIGINT) FROM cleaned WHERE outlier_flag = 1)
      AS outliers_on_event_days,
    (SELECT count(*) FROM (SELECT 1 FROM uniq GROUP BY product_id, store_id
      HAVING date_diff('day', min(date), max(date)) + 1 > count(*))) AS products_with_date_gaps,
    (SELECT CAST(sum(g) AS BIGINT) FROM (SELECT date_diff('day', min(date), max(date)) + 1
      - count(*) AS g FROM uniq GROUP BY product_id, store_id)) AS total_missing_days,
    CAST(0 AS BIGINT) AS gap_rows_inserted""")
oracle("clean_sales", "SELECT * FROM cleaned")

# ---- features ----------------------------------------------------------------------
oracle("feature_precheck", """SELECT (SELECT count(*) FROM item) AS n_rows,
    (SELECT count(*) FROM item) - (SELECT count(*) FROM (SELECT DISTINCT product_id, store_id,
      date FROM item)) AS n_duplicates,
    count(*) FILTER (WHERE missing_days > 0) AS n_gapped_series,
    CAST(sum(missing_days) AS BIGINT) AS n_missing_days FROM item_gaps""")
KEY = "date, product_id, store_id"
oracle("calendar_features", f"SELECT {KEY}, {CALENDAR} FROM series")
oracle("lag_features", f"SELECT {KEY}, sales_quantity, {LAGS} FROM dense")
oracle("rolling_features", f"SELECT {KEY}, sales_quantity, {ROLLING} FROM dense")
oracle("rolling_fractions", f"""SELECT {KEY}, sales_quantity, {ROLLING} FROM (
  SELECT * REPLACE (sales_quantity / 10.0::DOUBLE + 1000.0::DOUBLE AS sales_quantity) FROM dense)""")
oracle("rolling_median", f"SELECT {KEY}, sales_quantity, {MEDIANS} FROM dense")
oracle("expanding_mean", f"SELECT {KEY}, sales_quantity, {EXPANDING} FROM dense")
oracle("price_change", f"SELECT {KEY}, {CHANGE} FROM dc")
oracle("price_pct_change", f"SELECT {KEY}, {PCT} FROM dense")
oracle("rolling_price", f"SELECT {KEY}, {PRICE7} FROM dc")
oracle("named_event", """SELECT k.date, k.product_id, k.store_id,
    CAST(s.date IS NULL OR s.event_name IS NOT NULL AS INT) AS has_named_event
  FROM (SELECT product_id, store_id, CAST(unnest(generate_series(min(date), max(date),
          INTERVAL 1 DAY)) AS DATE) AS date FROM series GROUP BY 1, 2) k
  LEFT JOIN series s ON s.product_id = k.product_id AND s.store_id = k.store_id
    AND s.date = k.date""")
oracle("build_features", "SELECT * FROM feats")
oracle("feature_null_report", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing FROM feats"
    for c in FEATURE_NAMES))

# ---- analytics -----------------------------------------------------------------------
oracle("real_rows", f"SELECT {KEY}, sales_quantity FROM series")
oracle("daily_totals", """SELECT date, CAST(sum(sales_quantity) AS BIGINT) AS total_units
  FROM series GROUP BY 1""")
oracle("dataset_summary", f"""SELECT count(*) AS total_rows,
    count(DISTINCT product_id) AS total_products,
    CAST(sum(sales_quantity) AS BIGINT) AS total_units_sold, min(date) AS date_start,
    max(date) AS date_end, count(DISTINCT date) AS n_dates,
    {r('sum(sales_quantity) / count(DISTINCT date)', 2)} AS avg_daily_demand,
    {r('avg(CASE WHEN sales_quantity = 0 THEN 1.0 ELSE 0.0 END) * 100', 2)} AS zero_sales_pct,
    CAST(sum(outlier_flag) AS BIGINT) AS outlier_flag_count FROM cs""")


def ma(w: int) -> str:
    over = f"OVER (ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) {over} = {w} THEN {r(f'avg(t) {over}', 2)} END AS ma_{w}"


oracle("daily_sales_ma",
       f"SELECT date, CAST(t AS BIGINT) AS total_units, {ma(7)}, {ma(30)} FROM dow0")
oracle("weekly_sales", """SELECT CAST(date_trunc('week', date) AS DATE) AS week_start,
  CAST(sum(sales_quantity) AS BIGINT) AS total_units FROM cs GROUP BY 1""")
oracle("monthly_sales",
       "SELECT month_start, CAST(t AS BIGINT) AS total_units FROM months")
oracle("product_metrics", """SELECT m.*, CAST(n AS BIGINT) AS outlier_count
  FROM metrics3 m JOIN item_flagged USING (product_id)""")
oracle("top_products",
       "SELECT * FROM metrics3 ORDER BY total_units DESC, product_id LIMIT 10")
oracle("lowest_products",
       "SELECT * FROM metrics3 ORDER BY total_units, product_id LIMIT 10")
oracle("event_flags", "SELECT * FROM flag_events")
oracle("named_events", "SELECT * FROM named")
oracle("event_analysis", "SELECT * FROM flag_events UNION ALL SELECT * FROM named")
oracle("strongest_events", """
  SELECT 'positive' AS direction, * FROM (SELECT event, observations, avg_units,
    pct_vs_baseline FROM named ORDER BY pct_vs_baseline DESC NULLS LAST, event LIMIT 2)
  UNION ALL SELECT 'negative', * FROM (SELECT event, observations, avg_units,
    pct_vs_baseline FROM named ORDER BY pct_vs_baseline NULLS FIRST, event DESC LIMIT 2)""")
oracle("outlier_summary", f"""SELECT count(*) FILTER (WHERE outlier_flag = 1) AS total_flagged,
    {r('avg(outlier_flag) * 100', 3)} AS flagged_pct_of_rows,
    count(*) FILTER (WHERE outlier_flag = 1 AND holiday = 1) AS on_holiday_days,
    count(*) FILTER (WHERE outlier_flag = 1 AND snap_day = 1) AS on_snap_day_days,
    {r('avg(greatest(holiday, snap_day)) FILTER (WHERE outlier_flag = 1) * 100', 2)}
      AS pct_on_event_days,
    {r('avg(greatest(holiday, snap_day)) * 100', 2)} AS pct_of_all_rows_on_event_days
  FROM cs15""")
oracle("outliers_by_product", """SELECT product_id, count(*) AS n_flagged FROM cs15
  WHERE outlier_flag = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
oracle("outliers_by_event", """SELECT event_name, count(*) AS n_flagged FROM cs15
  WHERE outlier_flag = 1 AND event_name <> 'none' GROUP BY 1""")
oracle("price_profile", "SELECT * FROM profile")
oracle("price_summary", f"""SELECT
    {r('(SELECT corr(price, sales_quantity) FROM item)', 4)} AS pooled_correlation,
    count(within_product_corr) AS products_with_computable_within_corr,
    {r('avg(within_product_corr)', 4)} AS mean_within_product_corr FROM profile""")
oracle("day_of_week", f"""SELECT name AS day_of_week, {r('avg(t)', 2)} AS avg_daily_total_units,
    CAST(coalesce(sum(t), 0) AS BIGINT) AS total_units, count(date) AS n_dates
  FROM (VALUES ('Monday'), ('Tuesday'), ('Wednesday'), ('Thursday'), ('Friday'), ('Saturday'),
    ('Sunday')) v(name) LEFT JOIN dow0 ON dayname(date) = name GROUP BY 1""")
oracle("category_analysis", f"""SELECT category, count(DISTINCT product_id) AS n_products,
    CAST(sum(sales_quantity) AS BIGINT) AS total_units,
    {r('avg(sales_quantity)', 3)} AS avg_units_per_row,
    {r('avg(CASE WHEN sales_quantity = 0 THEN 1.0 ELSE 0.0 END) * 100', 3)} AS zero_sales_pct,
    {r('sum(sales_quantity) / (SELECT sum(sales_quantity) FROM item) * 100', 2)}
      AS units_share_pct
  FROM item GROUP BY 1""")
oracle("demand_growth", f"""SELECT
    {r('avg(t) FILTER (WHERE down BETWEEN 2 AND 13)', 4)} AS last_avg,
    {r('avg(t) FILTER (WHERE up BETWEEN 2 AND 13)', 4)} AS first_avg,
    {r('''(avg(t) FILTER (WHERE down BETWEEN 2 AND 13)
        / avg(t) FILTER (WHERE up BETWEEN 2 AND 13) - 1) * 100''', 1)} AS growth_pct
  FROM month_no""")
oracle("describe_measures", " UNION ALL ".join(
    f"""SELECT '{c}' AS measure, count({c}) AS "count", {r(r(f'avg({c})', 9), 2)} AS mean,
    {r(r(f'stddev_samp({c})', 9), 2)} AS std, {r(f'min({c})', 2)} AS "min",
    {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)', 2)} AS q25,
    {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 2)} AS q50,
    {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)', 2)} AS q75, {r(f'max({c})', 2)} AS "max"
  FROM item""" for c in ("sales_quantity", "price")))
oracle("days_per_product", """SELECT min(d) AS min_days,
    CAST(trunc(median(d)) AS BIGINT) AS median_days, max(d) AS max_days,
    (SELECT min(date) FROM item) AS date_start, (SELECT max(date) FROM item) AS date_end,
    (SELECT count(DISTINCT date) FROM item) AS total_days
  FROM (SELECT product_id, count(DISTINCT date) AS d FROM item GROUP BY 1)""")
oracle("avg_price_changes", f"""SELECT {r('avg(c)', 4)} AS avg_price_changes FROM (
  SELECT product_id, count(*) FILTER (WHERE price <> prior) AS c FROM (
    SELECT product_id, price, lag(price) OVER (PARTITION BY product_id
      ORDER BY date, store_id) AS prior FROM dense) GROUP BY 1)""")


def lift(flag: str) -> str:
    on = f"avg(sales_quantity) FILTER (WHERE {flag} = 1)"
    off = f"avg(sales_quantity) FILTER (WHERE {flag} = 0)"
    return (f"SELECT '{flag}' AS flag, {r(f'avg({flag})', 4)} AS frequency, {r(on, 4)} AS avg_on, "
            f"{r(off, 4)} AS avg_off, {r(f'({on} / {off} - 1) * 100', 1)} AS lift_pct FROM series")


oracle("flag_lift", lift("holiday") + " UNION ALL " + lift("snap_day"))
oracle("event_frequency", f"""SELECT event_name, count(sales_quantity) AS days,
    {r('avg(sales_quantity)', 2)} AS avg_units,
    {r('''(avg(sales_quantity) / (SELECT avg(sales_quantity) FROM series
        WHERE event_name IS NULL) - 1) * 100''', 1)} AS vs_baseline_pct
  FROM series WHERE event_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")

# ---- splits -----------------------------------------------------------------------------
oracle("training_precheck", """SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM
  (SELECT DISTINCT product_id, store_id, date FROM item)) AS n_duplicates FROM item""")
oracle("chronological_split", f"""SELECT {KEY}, sales_quantity, {split_of('i', 'n')} AS split
  FROM series JOIN dates USING (date)""")
oracle("split_boundaries", f"""SELECT {split_of('i', 'n')} AS split, min(date) AS start_date,
  max(date) AS end_date, count(*) AS n_dates FROM dates GROUP BY 1""")
oracle("date_folds", """SELECT CAST(fold AS INT) AS fold,
    min(date) FILTER (WHERE i <= s) AS train_start, max(date) FILTER (WHERE i <= s) AS train_end,
    min(date) FILTER (WHERE i > s AND i <= s + sz) AS valid_start,
    max(date) FILTER (WHERE i > s AND i <= s + sz) AS valid_end,
    count(*) FILTER (WHERE i <= s) AS n_train_dates,
    count(*) FILTER (WHERE i > s AND i <= s + sz) AS n_valid_dates
  FROM (SELECT date, i, fold, n // 4 AS sz, n - (4 - fold) * (n // 4) AS s
        FROM dates CROSS JOIN (VALUES (1), (2), (3)) f(fold)) GROUP BY 1""")
oracle("drop_warmup", "SELECT date, product_id, store_id, lag_28 FROM feats WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in [*FEATURE_NAMES, "price"]))
oracle("evaluate_metrics", f"""SELECT split, {r('avg(abs(e))', 4)} AS mae,
    {r('sqrt(avg(e * e))', 4)} AS rmse,
    {r('1 - sum(e * e) / (var_pop(y) * count(*))', 4)} AS r2
  FROM (SELECT {split_of('i', 'n')} AS split, y, y - p AS e FROM (
      SELECT date, sales_quantity AS y, lag(sales_quantity, 7) OVER ({W}) AS p FROM dense)
    JOIN ddates USING (date) WHERE p IS NOT NULL) GROUP BY 1""")

# ---- requests -----------------------------------------------------------------------------
oracle("validate_requests", """SELECT request_id,
    CAST(CASE WHEN reasons = '' THEN 0
      ELSE length(reasons) - length(replace(reasons, ',', '')) + 1 END AS INT) AS n_reasons,
    reasons = '' AS valid FROM checked""")
oracle("rejected_requests",
       "SELECT request_id, date, product_id, reasons FROM checked WHERE reasons <> ''")
oracle("request_calendar", f"""SELECT strftime(date, '%Y-%m-%d') AS date, request_id, {CALENDAR}
  FROM (SELECT day AS date, request_id FROM checked WHERE reasons = '')""")
oracle("request_features", f"""SELECT request_id, {r('price', 6)} AS price,
    CAST(snap_day AS DOUBLE) AS snap_day, CAST(holiday AS DOUBLE) AS holiday,
    CAST(has_named_event AS DOUBLE) AS has_named_event, CAST(year(day) AS DOUBLE) AS year,
    CASE WHEN n = 10 THEN 99.0::DOUBLE ELSE CAST(month(day) AS DOUBLE) END AS month,
    CAST(isodow(day) - 1 AS DOUBLE) AS day_of_week,
    CAST(isodow(day) >= 6 AS INT)::DOUBLE AS is_weekend,
    CASE WHEN n = 9 THEN NULL ELSE CAST(f_lag_1 AS DOUBLE) END AS lag_1,
    CASE WHEN n IN (8, 9, 10) THEN NULL ELSE CAST(f_lag_7 AS DOUBLE) END AS lag_7,
    CASE WHEN n IN (8, 9, 10) THEN NULL ELSE {r('f_mean_7', 6)} END AS rolling_mean_7
  FROM checked WHERE reasons = ''""")


# ---- models without their figures, scores of a formula --------------------------------------
CTES["scored"] = """SELECT request_id, day, date, product_id, reasons,
    CASE WHEN reasons = '' THEN 'success' ELSE 'error' END AS status,
    CASE WHEN reasons = '' THEN greatest(
      0.5::DOUBLE * coalesce(CASE WHEN n <> 9 THEN f_lag_1 END, 0)
      + 0.25::DOUBLE * coalesce(CASE WHEN n NOT IN (8, 9, 10) THEN f_lag_7 END, 0)
      + CASE n WHEN 10 THEN 99 ELSE month(day) END + isodow(day) - 1 - 15, 0::DOUBLE) END
      AS predicted_sales FROM checked"""
oracle("score_batch_formula", """SELECT request_id, date, product_id, status, predicted_sales,
    'Formula' AS model_type, reasons FROM scored""")
oracle("score_stream_formula",
       "SELECT date, product_id, status, predicted_sales, reasons FROM scored")
LOG = """SELECT CAST(date_trunc('month', day) AS DATE) AS day,
    concat_ws(' ', product_id, date) AS label, predicted_sales AS prediction, status FROM scored"""
oracle("prediction_log_formula", LOG)
oracle("latest_predictions", f"""SELECT * FROM ({LOG})
  ORDER BY day DESC, label, status, prediction NULLS FIRST LIMIT 500""")
oracle("tuning_points", f"""SELECT fold, train_end, valid_start, valid_end,
    CAST(a * 6 + b * 2 + c AS INT) AS position, max_iter, max_depth, step_size
  FROM ({ORACLES['date_folds']})
  CROSS JOIN (VALUES (0, 150), (1, 300)) x(a, max_iter)
  CROSS JOIN (VALUES (0, 4), (1, 6), (2, 8)) y(b, max_depth)
  CROSS JOIN (VALUES (0, 0.05::DOUBLE), (1, 0.1::DOUBLE)) z(c, step_size)""")
oracle("test_actuals", f"""SELECT date, product_id, sales_quantity AS actual, true AS plausible
  FROM dense JOIN ddates USING (date) WHERE {split_of('i', 'n')} = 'test'""")
oracle("baseline_facts", f"""SELECT concat('rows_', {split_of('i', 'n')}) AS fact,
    CAST(count(*) AS VARCHAR) AS value FROM dense JOIN ddates USING (date) GROUP BY 1
  UNION ALL SELECT unnest(['importance_is_a_share', 'rmse_at_least_mae', 'r2_at_most_1',
    'reloaded_predicts_the_same']), 'true'
  UNION ALL SELECT 'features', '{",".join(["price", "snap_day", "holiday", *FEATURE_NAMES])}'""")


def _needed(sql: str, found: set[str]) -> None:
    for name in CTES:
        if name not in found and re.search(rf"\b{name}\b", sql):
            found.add(name)
            _needed(CTES[name], found)


def full_sql(name: str) -> str:
    """The query with the table expressions it needs, in their order."""
    body, needed = ORACLES[name], set()
    _needed(body, needed)
    parts = []
    done: set[str] = set()

    def put(cte: str) -> None:
        if cte in done:
            return
        done.add(cte)
        for other in CTES:
            if other != cte and re.search(rf"\b{other}\b", CTES[cte]):
                put(other)
        parts.append(f"{cte} AS ({CTES[cte]})")

    for cte in CTES:
        if cte in needed:
            put(cte)
    return f"WITH {', '.join(parts)} {body}" if parts else body
