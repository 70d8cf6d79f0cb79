"""One registered query per operator of the inventory."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark import sources
from tillspark.functions import np_round
from tillspark.operators import (
    analytics, clean, features, inspect, metrics, scoring, split, validate,
)
from tillspark.plans import training
from tillspark.session import shared_path
from tillspark.streaming import append_log, read_log, score_stream

from . import fixtures as fx

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, *skip: str) -> DataFrame:
    """Doubles to 6 digits, where the order of summation no longer shows."""
    return df.select(*[
        np_round(F.col(c), 6).alias(c) if t == "double" and c not in skip else F.col(c)
        for c, t in df.dtypes])


# ---- sources and preparation -------------------------------------------------

@query
def ingest_sales(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "csv")
    sources.write_csv(fx.series(spark, sf), path)
    return sources.read_sales_csv(spark, path, parse=True)


@query
def sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "sink")
    sources.write_parquet(fx.clean_series(spark, sf), f"{path}/parquet")
    table = sources.read_sales_parquet(spark, f"{path}/parquet")
    sources.write_csv(table, f"{path}/csv")
    sources.write_json(analytics.dataset_summary(table), f"{path}/json")
    back = sources.read_sales_csv(spark, f"{path}/csv", parse=True)
    return (back.groupBy("product_id", "store_id")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("sales_quantity").alias("units")))


@query
def wide_filter(spark, sf):
    kept = sources.filter_wide(fx.wide(spark, sf), "CA_1", "FOODS")
    cells = ", ".join(sources.wide.day_columns(kept))
    return kept.selectExpr(*sources.wide.ID_COLUMNS, f"concat_ws(',', array({cells})) AS cells")


@query
def wide_row_total(spark, sf):
    return sources.row_totals(fx.wide(spark, sf)).select(
        *sources.wide.ID_COLUMNS, "total_units")


@query
def top_n_items(spark, sf):
    kept = sources.filter_wide(fx.wide(spark, sf), category="FOODS")
    return sources.top_items(kept, 10).select(*sources.wide.ID_COLUMNS, "total_units")


@query
def melt_wide(spark, sf):
    return sources.melt_wide(fx.wide(spark, sf))


def _dated(spark, sf):
    return sources.join_calendar(sources.melt_wide(fx.wide(spark, sf)),
                                 fx.wide_calendar(spark, sf))


@query
def join_calendar(spark, sf):
    return _dated(spark, sf)


def _priced(spark, sf):
    return sources.join_weekly_price(_dated(spark, sf), fx.wide_prices(spark, sf))


@query
def join_weekly_price(spark, sf):
    return _priced(spark, sf).select(
        "item_id", "store_id", "d", "wm_yr_wk", "sales_quantity", "sell_price")


@query
def drop_prelaunch(spark, sf):
    return sources.drop_prelaunch(_priced(spark, sf)).select(
        "item_id", "store_id", "d", "sales_quantity", "sell_price")


@query
def prelaunch_count(spark, sf):
    return sources.prelaunch_count(
        fx.wide(spark, sf), fx.wide_calendar(spark, sf), fx.wide_prices(spark, sf))


@query
def canonical_project(spark, sf):
    return sources.canonical_sales(sources.drop_prelaunch(_priced(spark, sf)))


@query
def prepare_subset(spark, sf):
    return sources.prepare_subset(
        fx.wide(spark, sf), fx.wide_calendar(spark, sf), fx.wide_prices(spark, sf),
        "CA_1", "FOODS", 5)


@query
def requests_from_csv(spark, sf):
    path = shared_path(spark, "requests-csv")
    rows, _ = fx.dense_features(spark, sf)
    text = rows.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "product_id",
        F.coalesce("price", F.lit(0.0)).alias("price"), "snap_day", "lag_1",
        F.when(F.col("snap_day") == 1, "n/k").otherwise(F.col("lag_7").cast("string"))
        .alias("lag_7"), "rolling_mean_7", F.lit("kept out").alias("note"))
    sources.write_csv(text, path)
    got = sources.read_requests_csv(spark, path)
    value = lambda name: F.try_element_at(F.transform(
        F.filter("features", lambda f: f["name"] == name), lambda f: f["value"]), F.lit(1))
    return got.groupBy("date", "product_id").agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.sum(F.size("features")).cast("bigint").alias("n_features"),
        F.sum(F.col("snap_day")).cast("bigint").alias("snap_days"),
        np_round(F.max("price"), 6).alias("max_price"),
        F.count("holiday").alias("n_holiday"),
        F.sum(value("lag_1")).alias("lag_1"), F.sum(value("lag_7")).alias("lag_7"),
        np_round(F.max(value("rolling_mean_7")), 6).alias("max_mean_7"))


@query
def requests_from_json(spark, sf):
    path = shared_path(spark, "requests-json")
    sources.write_json(fx.requests(spark, sf), path)
    got = sources.read_requests_json(spark, path)
    value = F.sum(F.try_element_at(F.transform(
        F.filter("features", lambda f: f["name"] == "lag_1"), lambda f: f["value"]), F.lit(1)))
    return got.groupBy("date", "product_id").agg(
        F.count(F.lit(1)).alias("n_requests"), np_round(F.max("price"), 6).alias("max_price"),
        F.sum("snap_day").cast("bigint").alias("snap_days"),
        F.sum("has_named_event").cast("bigint").alias("named_days"),
        F.sum(F.coalesce(F.size("features"), F.lit(0))).cast("bigint").alias("n_features"),
        value.alias("lag_1"))


# ---- validation ----------------------------------------------------------------

@query
def validate_counts(spark, sf):
    return validate.validation_counts(fx.dirty(spark, sf))


@query
def validate_duplicates(spark, sf):
    return validate.duplicate_count(fx.dirty(spark, sf))


@query
def missing_fraction(spark, sf):
    return _rounded(validate.missing_fraction(fx.dirty(spark, sf)))


@query
def series_gap_total(spark, sf):
    return validate.series_gap_total(fx.item(spark, sf))


# ---- cleaning -------------------------------------------------------------------

@query
def clean_dates(spark, sf):
    return clean.clean_dates(fx.dirty(spark, sf))


@query
def sales_check(spark, sf):
    return clean.raw_counts(fx.dirty(spark, sf))


@query
def exact_dedup(spark, sf):
    return clean.exact_dedup(clean.clean_dates(fx.dirty(spark, sf)))


@query
def conflicting_keys(spark, sf):
    return clean.conflicting_keys(clean.clean_dates(fx.dirty(spark, sf)))


def _unique_rows(spark, sf):
    return clean.exact_dedup(clean.clean_dates(fx.resolved(spark, sf)))


@query
def price_ffill(spark, sf):
    return clean.price_ffill(_unique_rows(spark, sf)).select(
        "date", "product_id", "store_id", "price")


@query
def price_repair_report(spark, sf):
    return clean.price_repair_report(_unique_rows(spark, sf))


@query
def normalize_event(spark, sf):
    return clean.normalize_event(fx.item(spark, sf)).select(
        "date", "product_id", "store_id", "event_name")


@query
def coerce_flags(spark, sf):
    return clean.coerce_flags(fx.dirty(spark, sf)).select(
        "date", "product_id", "store_id", "sales_quantity", "snap_day")


@query
def detect_gaps(spark, sf):
    return clean.detect_gaps(fx.item(spark, sf))


@query
def worst_gaps(spark, sf):
    return clean.worst_gaps(fx.item(spark, sf), 25)


@query
def structural_gaps(spark, sf):
    return clean.structural_gaps(fx.series(spark, sf))


@query
def flag_outliers(spark, sf):
    strict = clean.flag_outliers(fx.series(spark, sf)).withColumnRenamed(
        "outlier_flag", "flag_3")
    return clean.flag_outliers(strict, 1.5).select(
        "date", "product_id", "store_id", "sales_quantity", "flag_3",
        F.col("outlier_flag").alias("flag_1_5"))


@query
def outliers_on_events(spark, sf):
    return clean.outliers_on_events(clean.flag_outliers(fx.series(spark, sf), 1.5))


@query
def top_outliers(spark, sf):
    return clean.top_outliers(fx.clean_series(spark, sf))


@query
def cleaning_report(spark, sf):
    return clean.cleaning_report(fx.resolved(spark, sf))


@query
def clean_sales(spark, sf):
    return clean.clean_sales(fx.resolved(spark, sf))


# ---- features ---------------------------------------------------------------------

@query
def feature_precheck(spark, sf):
    return features.feature_precheck(fx.item(spark, sf))


@query
def calendar_features(spark, sf):
    return features.calendar_features(fx.series(spark, sf).select(
        "date", "product_id", "store_id"))


def _plain(spark, sf):
    return fx.dense(spark, sf).select("date", "product_id", "store_id", "sales_quantity")


@query
def lag_features(spark, sf):
    return features.lag_features(_plain(spark, sf))


@query
def rolling_features(spark, sf):
    return _rounded(features.rolling_features(_plain(spark, sf), median_windows=()))


def _tenths(spark, sf):
    """Fractional demand: a large base, so that sums of squares would not do."""
    return _plain(spark, sf).withColumn(
        "sales_quantity", F.col("sales_quantity") / F.lit(10.0) + F.lit(1000.0))


@query
def rolling_fractions(spark, sf):
    return _rounded(features.rolling_features(_tenths(spark, sf), median_windows=()))


@query
def rolling_median(spark, sf):
    return features.rolling_median(_plain(spark, sf))


@query
def expanding_mean(spark, sf):
    return _rounded(features.expanding_mean(_plain(spark, sf)))


def _prices(spark, sf):
    return fx.dense_clean(spark, sf).select(
        "date", "product_id", "store_id", "sales_quantity", "price")


@query
def price_change(spark, sf):
    return _rounded(features.price_features(_prices(spark, sf)).select(
        "date", "product_id", "store_id", "price_change"))


@query
def price_pct_change(spark, sf):
    # Prices before their repair, so that missing ones are bridged.
    return _rounded(features.price_features(fx.dense(spark, sf)).select(
        "date", "product_id", "store_id", "price_pct_change"))


@query
def rolling_price(spark, sf):
    return _rounded(features.price_features(_prices(spark, sf)).select(
        "date", "product_id", "store_id", "rolling_price_mean_7", "rolling_price_std_7"))


@query
def named_event(spark, sf):
    filled = clean.structural_gaps(clean.normalize_event(fx.series(spark, sf)))
    return features.event_features(filled).select(
        "date", "product_id", "store_id", "has_named_event")


@query
def build_features(spark, sf):
    rows, _ = fx.dense_features(spark, sf)
    return _rounded(rows)


@query
def feature_null_report(spark, sf):
    rows, names = fx.dense_features(spark, sf)
    return features.feature_null_report(rows, names)


# ---- analytics ----------------------------------------------------------------------

@query
def real_rows(spark, sf):
    filled = clean.structural_gaps(fx.series(spark, sf))
    return analytics.real_rows(filled).select(
        "date", "product_id", "store_id", "sales_quantity")


@query
def daily_totals(spark, sf):
    return analytics.daily_totals(fx.clean_series(spark, sf))


@query
def dataset_summary(spark, sf):
    return analytics.dataset_summary(fx.clean_series(spark, sf))


@query
def daily_sales_ma(spark, sf):
    return analytics.daily_sales(fx.clean_series(spark, sf))


@query
def weekly_sales(spark, sf):
    return analytics.weekly_sales(fx.clean_series(spark, sf))


@query
def monthly_sales(spark, sf):
    return analytics.monthly_sales(fx.clean_series(spark, sf))


@query
def product_metrics(spark, sf):
    return analytics.product_metrics(clean.finish_rows(fx.item(spark, sf)))


@query
def top_products(spark, sf):
    return analytics.top_products(fx.item(spark, sf), 10)


@query
def lowest_products(spark, sf):
    return analytics.top_products(fx.item(spark, sf), 10, lowest=True)


@query
def event_flags(spark, sf):
    return analytics.event_flags(fx.clean_series(spark, sf))


@query
def named_events(spark, sf):
    return analytics.named_events(fx.clean_series(spark, sf))


@query
def event_analysis(spark, sf):
    return analytics.event_analysis(fx.clean_series(spark, sf))


@query
def strongest_events(spark, sf):
    return analytics.strongest_events(fx.clean_series(spark, sf), 2)


def _flagged(spark, sf):
    return clean.flag_outliers(clean.normalize_event(
        fx.series(spark, sf)).withColumn("is_gap_fill", F.lit(0)), 1.5)


@query
def outlier_summary(spark, sf):
    return analytics.outlier_summary(_flagged(spark, sf))


@query
def outliers_by_product(spark, sf):
    return analytics.outliers_by_product(_flagged(spark, sf))


@query
def outliers_by_event(spark, sf):
    return analytics.outliers_by_event(_flagged(spark, sf))


@query
def price_profile(spark, sf):
    return analytics.price_profile(fx.item(spark, sf))


@query
def price_summary(spark, sf):
    return analytics.price_summary(fx.item(spark, sf))


@query
def day_of_week(spark, sf):
    return analytics.day_of_week(fx.clean_series(spark, sf))


@query
def category_analysis(spark, sf):
    return analytics.category_analysis(fx.item(spark, sf))


@query
def demand_growth(spark, sf):
    return analytics.demand_growth(fx.clean_series(spark, sf))


@query
def describe_measures(spark, sf):
    return inspect.describe_measures(fx.item(spark, sf))


@query
def days_per_product(spark, sf):
    return inspect.days_per_product(fx.item(spark, sf))


@query
def avg_price_changes(spark, sf):
    return inspect.avg_price_changes(fx.dense(spark, sf))


@query
def flag_lift(spark, sf):
    return inspect.flag_lift(fx.series(spark, sf))


@query
def event_frequency(spark, sf):
    return inspect.event_frequency(fx.series(spark, sf), 10)


# ---- splits, models -----------------------------------------------------------------

@query
def training_precheck(spark, sf):
    return split.training_precheck(fx.item(spark, sf))


@query
def chronological_split(spark, sf):
    return split.chronological_split(fx.series(spark, sf)).select(
        "date", "product_id", "store_id", "sales_quantity", "split")


@query
def split_boundaries(spark, sf):
    return split.split_boundaries(fx.series(spark, sf))


@query
def date_folds(spark, sf):
    return split.date_folds(fx.series(spark, sf))


@query
def drop_warmup(spark, sf):
    rows, _ = fx.dense_features(spark, sf)
    return split.drop_warmup(rows, split.select_features(rows)).select(
        "date", "product_id", "store_id", "lag_28")


@query
def evaluate_metrics(spark, sf):
    rows = features.lag_features(_plain(spark, sf), (7,))
    return metrics.evaluate(split.chronological_split(rows),
                            "sales_quantity", "lag_7", "split")


@cache
def _baseline(spark, sf):
    return training.train_baseline(fx.staged_features(spark, sf))


@query
def train_baseline(spark, sf):
    result = _baseline(spark, sf)
    rows = [(part, m["mae"], m["rmse"], m["r2"], result.sizes[part])
            for part, m in result.scores.items()]
    return spark.createDataFrame(
        rows, "split string, mae double, rmse double, r2 double, n_rows bigint")


@query
def feature_importance(spark, sf):
    return _baseline(spark, sf).tables["importance"]


@query
def test_predictions(spark, sf):
    return _baseline(spark, sf).tables["test_predictions"]


@query
def test_actuals(spark, sf):
    """The test rows of the baseline without its figures, and whether they are sound."""
    result = _baseline(spark, sf)
    ends = fx.staged_features(spark, sf).agg(
        F.struct(F.min("sales_quantity").alias("lo"), F.max("sales_quantity").alias("hi"))).scalar()
    room = ends["hi"] - ends["lo"]
    return result.tables["test_predictions"].select(
        "date", "product_id", "actual",
        F.col("predicted").between(ends["lo"] - room, ends["hi"] + room).alias("plausible"))


@query
def baseline_facts(spark, sf):
    """What holds for the baseline whatever its trees are: one fact per row."""
    result = _baseline(spark, sf)
    path = shared_path(spark, "baseline")
    training.save_training(spark, result, path)
    loaded = training.load_bundle(spark, f"{path}/baseline_model")
    rows = fx.staged_features(spark, sf).where(F.col("date") >= result.ranges["test"][0])
    pair = [m.transform(rows).select("date", "product_id", "store_id", "prediction")
            for m in (result.model, loaded.model)]
    share = result.tables["importance"].agg(F.sum("share_pct"), F.min("importance")).first()
    facts = {
        **{f"rows_{s}": n for s, n in result.sizes.items()},
        "features": ",".join(loaded.feature_names),
        "importance_is_a_share": abs(share[0] - 100) < 0.1 * len(result.features)
        and share[1] >= 0,
        "rmse_at_least_mae": all(m["rmse"] >= m["mae"] >= 0 for m in result.scores.values()),
        "r2_at_most_1": all(m["r2"] <= 1 for m in result.scores.values()),
        "reloaded_predicts_the_same": pair[0].exceptAll(pair[1]).isEmpty(),
    }
    return spark.createDataFrame([(k, str(v).lower()) for k, v in facts.items()],
                                 "fact string, value string")


@query
def tuning_points(spark, sf):
    """Every grid point on every fold, as the search fits them."""
    points = spark.createDataFrame(
        [(i, p["maxIter"], p["maxDepth"], p["stepSize"])
         for i, p in enumerate(training.grid_points(training.BOOSTING_GRID))],
        "position int, max_iter int, max_depth int, step_size double")
    folds = split.date_folds(fx.series(spark, sf)).select(
        "fold", "train_end", "valid_start", "valid_end", F.sequence(
            F.lit(0), F.lit(points.count() - 1)).alias("points"))
    return folds.select("*", F.explode("points").alias("position")).drop("points").join(
        points, "position")


@query
def tune_grid(spark, sf):
    rows = fx.staged_features(spark, sf)
    features = split.select_features(rows)
    return training.tune_boosting(training.training_rows(rows, features), features).table


@query
def compare_models(spark, sf):
    return training.compare_models(fx.staged_features(spark, sf)).tables["comparison"]


# ---- scoring --------------------------------------------------------------------------

@query
def validate_requests(spark, sf):
    checked = scoring.validate_requests(fx.requests(spark, sf), list(fx.REQUEST_FEATURES))
    return checked.select("request_id", F.size("reasons").alias("n_reasons"),
                          (F.size("reasons") == 0).alias("valid"))


@query
def rejected_requests(spark, sf):
    bad = scoring.rejected_requests(fx.requests(spark, sf), list(fx.REQUEST_FEATURES))
    return bad.select("request_id", "date", "product_id",
                      F.array_join("reasons", ",").alias("reasons"))


@query
def request_calendar(spark, sf):
    good = scoring.valid_requests(fx.requests(spark, sf), list(fx.REQUEST_FEATURES))
    return scoring.request_calendar(good).drop(
        "features", "price", "snap_day", "holiday", "has_named_event", "product_id")


@query
def request_features(spark, sf):
    names = list(fx.REQUEST_FEATURES)
    good = scoring.valid_requests(fx.requests(spark, sf), names)
    return _rounded(scoring.request_features(good, names).select(
        "request_id", *[F.col(f"x_{n}").alias(n) for n in names]))


@cache
def _bundle(spark, sf):
    """A model on the request features, saved and loaded as a bundle."""
    rows = fx.staged_features(spark, sf)
    result = training.train_baseline(
        rows.select("date", "product_id", "store_id", "sales_quantity", "lag_28",
                    *fx.REQUEST_FEATURES))
    path = shared_path(spark, "bundle")
    training.save_bundle(spark, path, result.model, result.features,
                         "boosting_baseline", metrics=result.scores)
    return training.load_bundle(spark, path)


@query
def score_batch(spark, sf):
    rows = fx.request_rows(fx.staged_features(spark, sf))
    return scoring.score_batch(rows, _bundle(spark, sf), mode="SPLIT").select(
        "request_id", "date", "product_id", "status", "predicted_sales")


def _streamed(spark, sf):
    base = shared_path(spark, "stream")
    sources.write_json(fx.request_rows(fx.staged_features(spark, sf)), f"{base}/in")
    running = score_stream(spark, f"{base}/in", _bundle(spark, sf),
                           f"{base}/out", f"{base}/state")
    running.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query
def score_stream_rows(spark, sf):
    return _streamed(spark, sf).select(
        "date", "product_id", "status", "predicted_sales")


@query
def prediction_log(spark, sf):
    scored = scoring.score_batch(fx.request_rows(fx.staged_features(spark, sf)),
                                 _bundle(spark, sf), mode="SPLIT")
    path = shared_path(spark, "log")
    append_log(scored, path)
    return read_log(spark, path).select("label", "prediction", "status")


# A formula instead of a fitted model: every figure of a score has SQL.
FORMULA = ("0.5 * coalesce(lag_1, 0) + 0.25 * coalesce(lag_7, 0) + month + day_of_week - 15")


def _formula_bundle(spark):
    path = shared_path(spark, "formula")
    training.save_bundle(spark, path, training.formula_model(FORMULA),
                         list(fx.REQUEST_FEATURES), "Formula")
    return training.load_bundle(spark, path)


@query
def score_batch_formula(spark, sf):
    return scoring.score_batch(fx.requests(spark, sf), _formula_bundle(spark), mode="SPLIT").select(
        "request_id", "date", "product_id", "status", "predicted_sales", "model_type",
        F.array_join("reasons", ",").alias("reasons"))


@query
def score_stream_formula(spark, sf):
    base = shared_path(spark, "stream")
    sources.write_json(fx.requests(spark, sf), f"{base}/in")
    score_stream(spark, f"{base}/in", _formula_bundle(spark), f"{base}/out",
                 f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        "date", "product_id", "status", "predicted_sales",
        F.array_join("reasons", ",").alias("reasons"))


@query
def prediction_log_formula(spark, sf):
    """The log of all requests, appended on the days that their ids name."""
    scored = scoring.score_batch(fx.requests(spark, sf), _formula_bundle(spark), mode="SPLIT")
    path = shared_path(spark, "log")
    month = F.trunc(F.substring_index("request_id", "/", -1).cast("date"), "month")
    append_log(scored, path, month.cast("timestamp"))
    return read_log(spark, path).select(F.col("time").cast("date").alias("day"), "label",
                                        "prediction", "status")


@query
def latest_predictions(spark, sf):
    """The newest entries of the log: a top list by time, then label."""
    scored = scoring.score_batch(fx.requests(spark, sf), _formula_bundle(spark), mode="SPLIT")
    path = shared_path(spark, "log")
    day = F.substring_index("request_id", "/", -1).cast("date")
    append_log(scored, path, F.trunc(day, "month").cast("timestamp"))
    return read_log(spark, path, 500).select(F.col("time").cast("date").alias("day"), "label",
                                             "prediction", "status")


QUERIES["score_stream"] = QUERIES.pop("score_stream_rows")
