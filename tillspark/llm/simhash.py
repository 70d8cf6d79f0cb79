"""SimHash fingerprints and every fingerprint within a Hamming radius.

The terms of a text are its word pairs (its word when it has one), weighted
``1 + ln(count)``; each term's 64-bit hash votes on the bits. For the search
the 64 bits are cut into ``radius + 2`` blocks, so two fingerprints within the
radius share at least two whole blocks: one table for each choice of two
blocks, keyed by them. A pair is counted in the first table that holds it.

Defined results: a null or empty text has no terms and the fingerprint 0;
equal texts have equal fingerprints and are searched once; the next document
follows in descending id, nulls last, equal ids by the hash of their text;
after the last comes the first; one document is its own next; an empty table
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import quoted, ship

BITS = 64
RADIUS = 3
LEAF = 512


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def fingerprint(raw: bytes, known: dict) -> int:
    """The signs of the weighted votes of a text's terms."""
    words = raw.split()
    if not words:
        return 0
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) > 1:
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    h.sort()
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    weight = (1 + np.log(np.diff(np.append(first, len(h))))).astype(np.float32)
    terms = h[first].astype("<u8")
    votes = np.zeros(BITS, np.float32)
    for at in range(0, len(terms), 4096):
        part = slice(at, at + 4096)
        bits = np.unpackbits(terms[part].view(np.uint8), bitorder="little").reshape(-1, BITS)
        votes += weight[part] @ bits
    ones = 2 * votes > weight.sum()
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> 63 else x


_ROW = ("doc_id bigint, n_chars bigint, fingerprint bigint, edited_fingerprint bigint, "
        "edited_sha256 string, near_edited double, near_next double, "
        "part int, place int, text string")


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints along a sorted part.

    A part's first and last text go out again (place 0 and 1): the last one's
    next document is the first of a later part.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()),
                        ("fingerprint", pa.int64()), ("edited_fingerprint", pa.int64()),
                        ("edited_sha256", pa.string()), ("near_edited", pa.float64()),
                        ("near_next", pa.float64()), ("part", pa.int32()),
                        ("place", pa.int32()), ("text", pa.string())])
    part, known, prior = TaskContext.get().partitionId(), _WordHashes(), None
    for batch in batches:
        out = []
        if len(known) > 200_000:
            known.clear()
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                strict=True):
            text = text or ""
            here = (doc_id, text, fingerprint(text.encode("utf-8", "surrogatepass"), known))
            if prior is None:
                out.append((doc_id, *[None] * 6, part, 0, text))
            else:
                out.append((*edited_row(prior, here, known), None, None, None))
            prior = here
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out],
                                         schema)
    if prior is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(
            schema.names, (prior[0], *[None] * 6, part, 1, prior[1]), strict=True))], schema)


def edited_row(own: tuple, following: tuple, known: dict) -> tuple:
    """Figures of one document, given (id, text, fingerprint) of it and the next."""
    doc_id, text, mark = own
    half = len(text) // 2
    raw = (text[:len(text) - half] + following[1][:half]).encode("utf-8", "surrogatepass")
    edited = fingerprint(raw, known)
    return (doc_id, len(text), _signed(mark), _signed(edited), hashlib.sha256(raw).hexdigest(),
            likeness(mark, edited), likeness(mark, following[2]))


def _join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "fingerprint", "edited_fingerprint", "edited_sha256",
             "near_edited", "near_next"]
    known = _WordHashes()
    for batch in batches:
        rows = []
        for doc_id, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = (fingerprint(x.encode("utf-8", "surrogatepass"), known) for x in (text, after))
            rows.append(edited_row((doc_id, text, a), (None, after, b), known))
        types = [pa.int64()] * 4 + [pa.string()] + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          parts: int | None = None) -> DataFrame:
    """Each document's fingerprint and that of its edited text.

    The texts are shuffled once, into ranges of descending id; only the first
    and last text of every range are looked at a second time.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    walked = stage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                   .mapInArrow(_edit, _ROW), "walked")
    # One row for each part: the first text of the next part, or of the first part.
    ends = walked.where("place is not null")
    heads = ends.where("place = 0").select("part", F.col("text").alias("head"))
    next_part = F.coalesce(F.lead("part").over(Window.orderBy("part")),
                           F.min("part").over(Window.partitionBy()))
    order_of = (ends.where("place = 1").select("part").withColumn("next_part", next_part)
                .withColumnRenamed("part", "own_part"))
    tails = (ends.where("place = 1").select("part", "doc_id", "text")
             .join(order_of, F.col("part") == F.col("own_part"))
             .join(heads.withColumnRenamed("part", "head_part"),
                   F.col("next_part") == F.col("head_part"))
             .select("doc_id", "text", "head"))
    shape = ", ".join(_ROW.split(", ")[:7])
    return walked.where("place is null").select(*[c.split()[0] for c in shape.split(", ")]).union(
        tails.mapInArrow(_join_ends, shape))


# ---- search --------------------------------------------------------------------

def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of the ``radius + 2`` blocks."""
    n = radius + 2
    cuts = [k * BITS // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _table_key(mark: Column, table: int, pair, cuts) -> Column:
    key = F.lit(table).cast("long")
    for b in pair:
        low, width = cuts[b]
        piece = F.shiftrightunsigned(mark, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        key = F.shiftleft(key, width).bitwiseOR(piece)
    return key


def _count_near(radius: int):
    cuts = blocks(radius)
    pairs = list(combinations(range(len(cuts)), 2))
    masks = [np.uint64(((1 << w) - 1) << low) for low, w in cuts]

    def count(a: np.ndarray, b: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Partners of each of ``a`` and ``b`` that this table is the first to hold."""
        x = a[:, None] ^ b[None, :]
        near = (np.bitwise_count(x) <= radius) & (x != 0)
        rows, cols = np.nonzero(near)
        if len(rows):
            equal = np.stack([(x[rows, cols] & m) == 0 for m in masks])
            first = np.full(len(rows), len(pairs))
            for t in range(len(pairs) - 1, -1, -1):
                i, j = pairs[t]
                first[equal[i] & equal[j]] = t
            mine = first == table
            rows, cols = rows[mine], cols[mine]
        return np.bincount(rows, minlength=len(a)), np.bincount(cols, minlength=len(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, counts = [], []
            names = batch.schema.names
            left, right, tables = (batch.column(names.index(n)).to_pylist()
                                   for n in ("left", "right", "table"))
            for a, b, table in zip(left, right, tables, strict=True):
                a = np.array(a, np.int64).view(np.uint64)
                own = not b
                b = a if own else np.array(b, np.int64).view(np.uint64)
                n_a, n_b = count(a, b, table)
                marks.append(a)
                counts.append(n_a)
                if not own:
                    marks.append(b)
                    counts.append(n_b)
            m = np.concatenate(marks).view(np.int64) if marks else np.zeros(0, np.int64)
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(m[some], pa.int64()),
                                              pa.array(n[some], pa.int64())],
                                             names=["fingerprint", "n"])
    return run


def near_counts(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each different fingerprint with company: how many others lie within.

    A bucket of more than ``LEAF`` fingerprints is cut into chunks by hash and
    every chunk meets every other one in a task of its own.
    """
    ship(marks.sparkSession)
    cuts = blocks(radius)
    pairs = list(combinations(range(len(cuts)), 2))
    mark = F.col("fingerprint")
    tables = F.array(*[F.struct(F.lit(t).alias("table"), _table_key(mark, t, p, cuts).alias("key"))
                       for t, p in enumerate(pairs)])
    rows = (marks.where(mark.isNotNull()).select("fingerprint").distinct()
            .select("fingerprint", F.explode(tables).alias("slot"))
            .select("fingerprint", "slot.table", "slot.key"))
    sizes = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = rows.join(sizes, ["table", "key"]).withColumn(
        "chunks", F.ceil(F.col("n") / LEAF).cast("int")).withColumn(
        "chunk", F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int"))
    # The chunk meets itself and all others: cells (low, high) of a triangle.
    cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(
        F.least(o, F.col("chunk")).alias("low"), F.greatest(o, F.col("chunk")).alias("high"),
        (F.col("chunk") <= o).alias("is_left")))
    met = (full.withColumn("cell", F.explode(cells))
           .groupBy("table", "key", "cell.low", "cell.high")
           .agg(F.collect_list(F.when(F.col("cell.is_left"), mark)).alias("left"),
                F.collect_list(F.when(~F.col("cell.is_left"), mark)).alias("right"),
                F.count_if(F.col("cell.low") == F.col("cell.high")).alias("same"))
           .where((F.size("left") > 0) & ((F.size("right") > 0) | (F.col("same") > 0))))
    return (met.select("table", "left", "right")
            .mapInArrow(_count_near(radius), "fingerprint bigint, n bigint")
            .groupBy("fingerprint").agg(F.sum("n").alias("n_near")))


def as_hex(mark: Column) -> Column:
    return F.lpad(F.lower(F.hex(mark)), BITS // 4, "0")


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  radius: int = RADIUS) -> DataFrame:
    """Fingerprints, likenesses and ``n_near``, the other fingerprints in reach."""
    rows = stage(edits(docs, doc_id, text), "fingerprints")
    near = near_counts(rows, radius).withColumnRenamed("fingerprint", "mark")
    return rows.join(near, F.col("fingerprint") == F.col("mark"), "left").select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("fingerprint")).alias("fingerprint"),
        as_hex(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited",
        "near_next", F.coalesce("n_near", F.lit(0)).alias("n_near"))
