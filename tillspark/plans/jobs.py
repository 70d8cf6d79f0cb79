"""The jobs from raw files to a compared model, table in and table out.

Tables travel between jobs as parquet; reports are also written as CSV or
JSON folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import sources
from ..operators import analytics, clean, features, inspect, scoring
from ..operators.validate import ValidationResult, validate_sales
from ..schema import MAX_UNREADABLE_FRACTION, DataQualityError
from ..streaming import append_log, score_stream
from . import training
from .cleaning import preprocess_sales


def prepare(spark: SparkSession, raw_dir: str, output: str, store_id: str | None = None,
            category: str | None = None, top_n: int | None = None,
            multi_line: bool = False) -> DataFrame:
    """Raw wide files to a sales table; all of them unless a subset is asked for.

    A file of which more than ``MAX_UNREADABLE_FRACTION`` of the filled cells
    hold no number is an error.
    """
    for file in sources.unreadable_cells(spark, raw_dir, multi_line).collect():
        if file["n_unreadable"] > MAX_UNREADABLE_FRACTION * file["n_cells"]:
            raise DataQualityError([
                f"{file['file']}: no number in {file['n_unreadable']:,} of "
                f"{file['n_cells']:,} cells."])
    table = sources.prepare_subset(*sources.read_raw_files(spark, raw_dir, multi_line),
                                   store_id, category, top_n)
    sources.write_parquet(table, output)
    return sources.read_sales_parquet(spark, output)


def preparation_counts(spark: SparkSession, raw_dir: str, store_id: str | None = None,
                       category: str | None = None, top_n: int | None = None,
                       multi_line: bool = False) -> dict[str, int]:
    """What ``prepare`` leaves out: cells without a number by file, and the
    cells before an item's launch."""
    wide, calendar, prices = sources.read_raw_files(spark, raw_dir, multi_line)
    kept = sources.subset_of(wide, store_id, category, top_n)
    out = {f"unreadable_{r['file']}": r["n_unreadable"]
           for r in sources.unreadable_cells(spark, raw_dir, multi_line).collect()}
    return out | sources.prelaunch_count(kept, calendar, prices).first().asDict()


def first_look(spark: SparkSession, path: str) -> tuple[ValidationResult, dict[str, DataFrame]]:
    """Validation and the first figures of a sales table."""
    df = sources.read_sales_parquet(spark, path)
    tables = {"sample": df.limit(8), "coverage": inspect.days_per_product(df),
              "summary": analytics.dataset_summary(df),
              "top_products": analytics.top_products(df, 5),
              "lowest_products": analytics.top_products(df, 5, lowest=True),
              "measures": inspect.describe_measures(df)}
    if "price" in df.columns:
        tables["price_changes"] = inspect.avg_price_changes(df)
    if analytics.flag_columns(df):
        tables["flags"] = inspect.flag_lift(df)
    if "event_name" in df.columns:
        tables["events"] = inspect.event_frequency(df)
    return validate_sales(df), tables


def clean_table(spark: SparkSession, path: str, output: str, fill_date_gaps: bool = False,
                strict: bool = False, multi_line: bool = False) -> clean.CleaningReport:
    """Sales table or CSV folder to a clean table; returns the report."""
    df = (sources.read_sales_csv(spark, path, multi_line=multi_line) if path.rstrip("/").endswith("csv")
          else sources.read_sales_parquet(spark, path))
    return preprocess_sales(df, fill_date_gaps=fill_date_gaps, strict=strict,
                            output=output)[1]


def report_tables(df: DataFrame) -> dict[str, DataFrame]:
    """Every report that the columns of a clean table allow."""
    out = {"summary": analytics.dataset_summary(df),
           "daily_sales": analytics.daily_sales(df),
           "weekly_sales": analytics.weekly_sales(df),
           "monthly_sales": analytics.monthly_sales(df),
           "demand_growth": analytics.demand_growth(df),
           "product_metrics": analytics.product_metrics(df),
           "event_analysis": analytics.event_analysis(df),
           "day_of_week_analysis": analytics.day_of_week(df)}
    if "event_name" in df.columns:
        out["strongest_events"] = analytics.strongest_events(df)
    if "outlier_flag" in df.columns:
        out["outlier_analysis"] = analytics.outlier_summary(df)
        out["outliers_by_product"] = analytics.outliers_by_product(df)
        if "event_name" in df.columns:
            out["outliers_by_event"] = analytics.outliers_by_event(df)
    if "price" in df.columns:
        out["price_analysis"] = analytics.price_profile(df)
        out["price_summary"] = analytics.price_summary(df)
    if "category" in df.columns:
        out["category_analysis"] = analytics.category_analysis(df)
    return out


ONE_ROW = ("summary", "demand_growth", "outlier_analysis", "price_summary")


def reports(spark: SparkSession, path: str, output: str) -> list[str]:
    """Writes all reports of a clean table; one-row reports as JSON."""
    df = sources.read_sales_parquet(spark, path)
    analytics.check_analytics_input(df)
    tables = report_tables(df)
    for name, table in tables.items():
        write = sources.write_json if name in ONE_ROW else sources.write_csv
        write(table, f"{output}/{name}")
    return list(tables)


def feature_table(spark: SparkSession, path: str, output: str,
                  ) -> tuple[list[str], DataFrame]:
    """Clean table to feature table; returns the new names and their gaps."""
    df = sources.read_sales_parquet(spark, path)
    table, names = features.build_features(df)
    sources.write_parquet(table, output)
    written = sources.read_sales_parquet(spark, output)
    return names, features.feature_null_report(written, names)


def train(spark: SparkSession, path: str, output: str, **settings) -> training.ModelReport:
    result = training.train_baseline(sources.read_sales_parquet(spark, path), **settings)
    training.save_training(spark, result, output)
    return result


def compare(spark: SparkSession, path: str, output: str, **settings) -> training.ModelReport:
    result = training.compare_models(sources.read_sales_parquet(spark, path), **settings)
    training.save_comparison(spark, result, output)
    return result


def score(spark: SparkSession, path: str, output: str, model: str, split: bool = False,
          log: str | None = None, whole_files: bool = False) -> dict[str, int]:
    """Requests from CSV or JSON to a table of predictions; rows by status.

    A bad request refuses the batch; with ``split`` it is kept with its
    reasons. ``log`` names a prediction log that the written rows are added to.
    """
    requests = (sources.read_requests_csv(spark, path) if path.rstrip("/").endswith("csv")
                else sources.read_requests_json(spark, path, whole_files))
    scored = scoring.score_batch(requests, training.load_bundle(spark, model),
                                 "SPLIT" if split else "FAILFAST")
    scored.write.mode("overwrite").parquet(output)
    written = spark.read.parquet(output)
    if log is not None:
        append_log(written, log)
    return {r["status"]: r["count"] for r in written.groupBy("status").count().collect()}


def score_arrivals(spark: SparkSession, source: str, output: str, model: str) -> DataFrame:
    """All request files that have arrived since the last call; every row so far."""
    running = score_stream(spark, source, training.load_bundle(spark, model), output,
                           f"{output.rstrip('/')}.state")
    running.awaitTermination()
    return spark.read.parquet(output)
