from .files import (
    conform_sales, read_raw_files, read_sales_csv, read_sales_parquet,
    unreadable_cells, write_csv, write_json, write_parquet, write_series_table,
)
from .requests import feature_list, read_requests_csv, read_requests_json
from .wide import (
    canonical_sales, day_columns, drop_prelaunch, filter_wide, join_calendar,
    join_weekly_price, melt_wide, prelaunch_count, prepare_subset, row_totals, subset_of, top_items,
)

__all__ = [
    "canonical_sales", "conform_sales", "day_columns", "drop_prelaunch",
    "feature_list", "filter_wide", "join_calendar", "join_weekly_price",
    "melt_wide", "prelaunch_count", "prepare_subset", "read_raw_files", "read_requests_csv",
    "read_requests_json", "read_sales_csv", "read_sales_parquet",
    "row_totals", "subset_of", "top_items", "unreadable_cells", "write_csv", "write_json", "write_parquet",
    "write_series_table",
]
