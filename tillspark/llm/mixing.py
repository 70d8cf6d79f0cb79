"""Mix sources to target weights with hash keys and distributed prefix sums.

Each document gets a hash-random key. Within its source the key space is cut
into ranges, the ranges' token counts are summed and their running totals
give every range its offset, so a document's place in its source's order is
known without one task ever holding a source. A source is taken whole as often
as its target allows (epochs), then in key order up to the rest of the budget:
a document counts when at least half of it lies inside, so a source misses its
target by at most half a document.

Defined results: a null or empty text has size 0 and is never taken; a null
source is a source of its own and comes last; repeated rows are documents of
their own, and as equal rows have equal keys it does not matter which comes
first; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import WORD, fresh, quoted

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
RANGE_DOCS = 2000


def source_targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
                   share: float = 1.0) -> DataFrame:
    """Source, size, number of documents and target; one row for each source.

    Targets share ``share`` of all sizes by weight; one that reaches
    ``max_epochs`` times its source stops there and the excess goes to the
    others. Each turn of the loop is one aggregate over the source table: what
    the capped sources hold and what weight is left.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                         F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ring = F.array(*[F.lit(w) for w in weights])
    table = stage(totals.withColumn("weight", F.get(ring, place % len(weights)))
                  .withColumn("cap", F.col("source_size") * max_epochs), "sources")
    row = table.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    budget, left, weight = (row.t or 0) * share, (row.t or 0) * share, row.w or 1
    while True:
        capped = F.col("cap") * F.lit(weight) < F.lit(left) * F.col("weight")
        row = table.agg(F.sum(F.when(capped, F.col("cap"))).alias("c"),
                        F.sum(F.when(~capped, F.col("weight"))).alias("w")).first()
        now = (budget - (row.c or 0), row.w or 1)
        if now == (left, weight) or not row.w:
            break
        left, weight = now
    part = F.lit(float(left)) * F.col("weight") / F.lit(float(weight))
    target = F.least(F.col("cap").cast("double"), part)
    return table.select("source", "source_size", "n_docs", target.alias("target"))


def mix(sized: DataFrame, seed: int = 0, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
        share: float = 1.0) -> DataFrame:
    """Add source_size, target, epochs and taken to rows of doc_id, source, size."""
    targets = source_targets(sized, weights, max_epochs, share).withColumnRenamed(
        "source", "__s")
    whole = F.floor(F.col("target") / F.col("source_size"))
    whole = F.when(F.col("source_size") > 0, whole).otherwise(0).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ranges = F.ceil(F.col("n_docs") / RANGE_DOCS)
    unit = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)
    keyed = (sized.join(targets, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
             .withColumn("key", key)
             .withColumn("range", F.floor(unit * ranges))
             .withColumn("whole", whole))
    sums = (keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
            .withColumn("offset", F.sum("range_size").over(
                Window.partitionBy("source").orderBy("range")) - F.col("range_size"))
            .select(F.col("source").alias("__s"), F.col("range").alias("__r"), "offset"))
    inside = F.sum("size").over(Window.partitionBy("source", "range")
                                .orderBy("key", "size")
                                .rowsBetween(Window.unboundedPreceding, -1))
    placed = (keyed.withColumn("before", F.coalesce(inside, F.lit(0)))
              .join(sums, F.col("source").eqNullSafe(F.col("__s"))
                    & (F.col("range") == F.col("__r")), "left")
              .withColumn("before", F.col("before") + F.col("offset")))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    extra = (F.col("before") + F.col("size") / 2 <= rest) & (F.col("whole") < max_epochs)
    epochs = F.when(F.col("size") > 0, F.col("whole") + extra.cast("long")).otherwise(F.lit(0))
    return (placed.withColumn("epochs", epochs.cast("long"))
            .withColumn("taken", F.col("epochs") * F.col("size"))
            .drop("__s", "__r", "n_docs", "key", "range", "whole", "before", "offset"))


def word_count(text: str):
    return F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, doc_id: str = "doc_id", source: str = "source",
          text: str = "text") -> DataFrame:
    """Document, source and number of words, stored once."""
    return stage(docs.select(quoted(doc_id).alias("doc_id"), quoted(source).alias("source"),
                             word_count(text).alias("size")), "sizes")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source",
                  text: str = "text", **options) -> DataFrame:
    """Every document as often as the mix takes it, with its own columns.

    The documents are stored with a row number, so that repeated rows stay
    apart when their shares are joined back.
    """
    row, size, mine, epochs = fresh(docs, "__row", "__size", "__mine", "__epochs")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id())
                     .withColumn(size, word_count(text)), "numbered")
    sized = numbered.select(quoted(doc_id).alias("doc_id"), quoted(source).alias("source"),
                            F.col(size).alias("size"), F.col(row).alias("row"))
    plan = mix(sized, **options).where("epochs > 0").select(
        F.col("row").alias(mine), F.col("epochs").alias(epochs))
    return (numbered.join(plan, F.col(row) == F.col(mine))
            .withColumn(size, F.explode(F.sequence(F.lit(1).cast("long"), F.col(epochs))))
            .select(*map(quoted, docs.columns)))
