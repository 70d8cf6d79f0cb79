"""Exact quantiles of large groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slot(value: Column) -> Column:
    """A monotone slot number: 64 slots per power of two, per sign.

    It depends on the value alone, so every branch of a plan and every
    retried task puts a value into the same slot.
    """
    size = F.floor(F.log2(F.abs(value)) * 64) + 100_000
    return (F.when(value > 0, size).when(value < 0, -size)
            .otherwise(F.lit(0))).cast("bigint")


def exact_quantiles(histogram: DataFrame, keys: list[str], value: str,
                    weight: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles from a (keys, value, weight) histogram.

    ``histogram`` holds one row per distinct value of a group, so map-side
    combining has already removed any skew of the raw rows. Slot totals
    locate the slots that hold the wanted ranks; only their values are
    ordered, slot by slot. Memory of a task is bounded by the distinct
    values of one slot, whatever the size of the group.
    """
    hist = (histogram.where(F.col(value).isNotNull())
            .select(*keys, F.col(value).cast("double").alias("_v"),
                    F.col(weight).alias("_n"))
            .withColumn("_slot", _slot(F.col("_v"))))
    # The join below needs its keys to be there; saying so here keeps both
    # branches alike, so that the histogram is shuffled once for the two.
    for c in (*keys, "_slot"):
        hist = hist.where(F.col(c).isNotNull())

    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_slot")
    slots = (hist.groupBy(*keys, "_slot").agg(F.sum("_n").alias("_m"))
             .withColumn("_upto", F.sum("_m").over(upto))
             .withColumn("_total", F.sum("_m").over(by_key)))

    def ranks(p: float) -> tuple[Column, Column, Column]:
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        return F.floor(pos), F.ceil(pos), pos - F.floor(pos)

    def holds(rank: Column) -> Column:
        return (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_m"))

    wanted = F.lit(False)
    for p in probs.values():
        lo, hi, _ = ranks(p)
        wanted = wanted | holds(lo) | holds(hi)
    slots = slots.where(wanted).select(
        *keys, "_slot", "_total", (F.col("_upto") - F.col("_m")).alias("_before"))

    inside = Window.partitionBy(*keys, "_slot").orderBy("_v")
    ordered = (hist.join(slots, [*keys, "_slot"])
               .withColumn("_cum", F.col("_before") + F.sum("_n").over(inside)))

    aggs = [F.max("_total").alias("_total")]
    for name, p in probs.items():
        lo, hi, _ = ranks(p)
        aggs += [F.min(F.when(F.col("_cum") > lo, F.col("_v"))).alias(f"_lo_{name}"),
                 F.min(F.when(F.col("_cum") > hi, F.col("_v"))).alias(f"_hi_{name}")]
    found = ordered.groupBy(*keys).agg(*aggs)
    out = []
    for name, p in probs.items():
        frac = ranks(p)[2]
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * frac).alias(name))
    return found.select(*keys, *out)
