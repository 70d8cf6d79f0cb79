"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from checks.queries import QUERIES  # noqa: E402
from tillspark.session import get_spark  # noqa: E402

HEADLINE = (
    "prepare_subset", "melt_wide", "validate_counts", "validate_duplicates",
    "clean_sales", "cleaning_report", "structural_gaps", "flag_outliers",
    "build_features", "rolling_features", "daily_sales_ma", "dataset_summary",
    "product_metrics", "event_analysis", "price_profile", "day_of_week",
    "category_analysis", "describe_measures", "chronological_split",
    "evaluate_metrics", "request_features", "train_baseline", "score_batch",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in sys.argv[1:] if n in QUERIES] or list(HEADLINE)
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()  # starts the workers
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": Path(sf).name.removeprefix("sf"),
        "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
