"""Continuous scoring of arriving requests, and the prediction log."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import score_requests
from ..sources.requests import JSON_SCHEMA, parse_requests

STATUSES = ("success", "error")
LOG_SCHEMA = "time timestamp, label string, prediction double, status string, day date"


def score_stream(spark: SparkSession, source: str, bundle, output: str,
                 checkpoint: str, available_now: bool = True,
                 files_per_trigger: int = 1000) -> StreamingQuery:
    """Scores JSON request files as they arrive, appending to a table.

    The work has no state. Good and bad requests leave through one sink,
    told apart by ``status``, so that each file is read once and the file
    sink's log makes the output exactly-once after a restart.
    """
    arriving = (spark.readStream.schema(JSON_SCHEMA)
                .option("maxFilesPerTrigger", files_per_trigger).json(source))
    scored = score_requests(parse_requests(arriving), bundle).withColumn(
        "scored_at", F.current_timestamp())
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("path", output).option("checkpointLocation", checkpoint)
              .partitionBy("status"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def append_log(scored: DataFrame, path: str, time: Column | None = None) -> None:
    """Appends scored requests to the prediction log, one folder a day."""
    label = F.concat_ws(" ", "product_id", "date")
    (scored.select((F.current_timestamp() if time is None else time).alias("time"),
                   label.alias("label"), F.col("predicted_sales").alias("prediction"),
                   "status")
     .withColumn("day", F.to_date("time"))
     .write.mode("append").partitionBy("day").parquet(path))


def first_day_needed(log: DataFrame, limit: int) -> date | None:
    """The day that the newest ``limit`` entries go back to; None if to all.

    Counts by day come from the files' row numbers, no column is read; days
    arrive newest first, and entries without a time count as the oldest.
    """
    days = log.groupBy("day").count().orderBy(F.desc_nulls_last("day"))
    have = 0
    for row in days.toLocalIterator():  # one row per calendar day
        have += row["count"]
        if have >= limit:
            return row["day"]
    return None


def read_log(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The log, newest entries first; ``limit`` reads the days it needs only."""
    log = spark.read.schema(LOG_SCHEMA).parquet(path)
    if limit is not None:
        since = first_day_needed(log, limit)
        log = log if since is None else log.where(F.col("day") >= F.lit(since))
    log = log.drop("day").orderBy(F.desc_nulls_last("time"), "label", "status", "prediction")
    return log if limit is None else log.limit(limit)
