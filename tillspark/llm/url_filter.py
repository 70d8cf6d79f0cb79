"""URL filters with dated lists: which entries were active at fetch time.

List entries are dated events (listed, delisted) for a host, a parent domain
or a whole address. They become validity intervals, kept as their
beginnings and ends. A capture has a key for its
host, for each parent domain and for its address. The join is an as-of join: a
key's list changes and its fetch times are put in one order, and each fetch time
takes the change last before it. The order is cut into days; what holds at a day's
beginning is carried over from the days before, of which a key has one row each. So
a host with very many captures or an entry with very many changes is spread over its days.

Defined results: a null URL has no key and is not blocked; a null time is at no
time and not blocked; an entry counts from its date on and no longer from its
delisting date on; of events of one entry at one time the delisting holds;
repeated rows are judged each; an empty list blocks nothing; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or a final dot; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.$", "")


def address_of(url: Column) -> Column:
    """Host and path, without scheme, query and fragment."""
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*(/[^?#]*)", 1)
    return F.concat(host_of(url), F.when(path == "", "/").otherwise(path))


def keys_of(url: Column) -> Column:
    """The host and its parents of two labels or more, and the address.

    Every parent counts, however many labels the host has: a host name's
    length bounds their number.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.array_append(parents, address_of(url))))


def as_of(points: DataFrame, before: bool = False) -> DataFrame:
    """Adds ``found``: the last non-null ``state`` of the key up to a point's time.

    Points are (key, time, state, ...); at one time states come first. With
    ``before`` the point's own state does not count.
    """
    points = points.withColumn("day", F.to_date("time"))
    days = points.groupBy("key", "day").agg(F.max(F.when(
        F.col("state").isNotNull(), F.struct("time", "state")))["state"].alias("last"))
    earlier = Window.partitionBy("key").orderBy("day").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = days.select("key", "day", F.last("last", ignorenulls=True).over(earlier)
                          .alias("carried"))
    inside = Window.partitionBy("key", "day").orderBy("time", F.col("state").isNull()).rowsBetween(
        Window.unboundedPreceding, -1 if before else Window.currentRow)
    return points.join(carried, ["key", "day"]).withColumn("found", F.coalesce(
        F.last("state", ignorenulls=True).over(inside), "carried")).drop("day", "carried")


def changes(events: DataFrame) -> DataFrame:
    """key, time, listed: the events that change whether an entry is listed."""
    one = (events.where("key is not null and time is not null and listed is not null")
           .groupBy("key", "time").agg(F.min("listed").alias("state")))
    return as_of(one, before=True).where(
        F.coalesce("found", F.lit(False)) != F.col("state")).select(
        "key", "time", F.col("state").alias("listed"))


def judge(captures: DataFrame, events: DataFrame, capture_id: str = "page_id", url: str = "url",
          time: str = "fetched") -> DataFrame:
    """capture_id, host, fetched, blocked, n_entries, entry and valid_from.

    ``entry`` is the longest active key, ``valid_from`` since when it is active.
    """
    row = captures.select(quoted(capture_id).alias("capture_id"), quoted(url).alias("url"),
                          quoted(time).alias("fetched"))
    keyed = row.withColumn("key", F.explode_outer(keys_of(F.coalesce(F.col("url"), F.lit("")))))
    wanted = keyed.where("key is not null and fetched is not null").select(
        "key", F.col("fetched").alias("time")).distinct()
    turned = changes(events).select(
        "key", "time", F.struct("listed", F.col("time").alias("since")).alias("state"))
    points = turned.unionByName(wanted.withColumn(
        "state", F.lit(None).cast("struct<listed:boolean,since:timestamp>")))
    listed = as_of(points).where("state is null and found.listed").select(
        F.col("key").alias("entry"), F.col("time").alias("at"),
        F.col("found.since").alias("valid_from"))
    active = keyed.join(listed, (F.col("key") == F.col("entry"))
                        & (F.col("fetched") == F.col("at")))
    hits = active.groupBy("capture_id", "url", "fetched").agg(
        F.countDistinct("entry").alias("n_entries"),
        F.max(F.struct(F.length("entry").alias("size"), "entry", "valid_from")).alias("best"))
    hits = hits.toDF("h_id", "h_url", "h_fetched", "n_entries", "best")
    joined = row.join(hits, F.col("capture_id").eqNullSafe(F.col("h_id"))
                      & (F.col("url") == F.col("h_url"))
                      & (F.col("fetched") == F.col("h_fetched")), "left")
    return joined.select(
        F.col("capture_id").alias(capture_id), host_of(F.col("url")).alias("host"), "fetched",
        F.col("n_entries").isNotNull().alias("blocked"),
        F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
        F.col("best.entry").alias("entry"), F.col("best.valid_from").alias("valid_from"))
