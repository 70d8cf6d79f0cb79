"""Near duplicates by SimHash fingerprints that meet under Golay-code keys.

A text's fingerprint has a bit set when more than half of the XXH64 hashes of
its three-word shingles have it set; two fingerprints link when they differ in
two bits or fewer. The 64 bits are cut into three segments. Two differing bits
leave one segment untouched and at most two errors in the one after it. The
binary Golay code of length 23 is perfect: every word lies within three bits
of exactly one codeword. The indices of the codewords nearest to a segment and
to its 23 one-bit neighbours are its keys: one, or six when the segment lies
three bits from its codeword. Two segments two bits apart share a neighbour
between them, hence a key. Each of the three tables joins on one whole segment
and one key of the next; the joined fingerprints are verified bit by bit.

Defined results: a null, empty or blank text has no shingles and the
fingerprint zero, which links like any other; one or two words are one
shingle; repeated rows and equal texts share a fingerprint; a row without id
takes the least id it reaches, or null; an empty table gives an empty result;
only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .common import quoted, ship, text_map
from .jaccard import components

# ---- fixed values: the hash and the code ----
SEED = 42
SHINGLE = 3
RADIUS = 2
LENGTH, MESSAGE = 23, 12
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
# ---------------------------------------------
#: (lowest bit, width) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a bucket that a task compares at one time.
CHUNK = 512
#: A fingerprint of a larger share of all rows than this is joined by broadcast.
HOT_SHARE = 1 / 1000


# ---- fingerprints ----------------------------------------------------------------

def fingerprint(raw: bytes) -> int:
    """Majority of the shingles' hash bits of a text in UTF-8."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(
        starts, ends[size - 1:].tolist(), strict=True)), "<u8", len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at:at + 8192].view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints():
    def compute(texts: list) -> list:
        marks = np.fromiter((fingerprint((t or "").encode("utf-8", "surrogatepass"))
                             for t in texts), np.uint64, len(texts))
        return [pa.array(marks.view(np.int64))]
    return compute


# ---- the code ----------------------------------------------------------------------

def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - (LENGTH - MESSAGE))
    return word


def _leaders() -> np.ndarray:
    """Error pattern of least weight for each of the 2^11 remainders."""
    syndrome = [_remainder(1 << b) for b in range(LENGTH)]
    out = np.zeros(1 << (LENGTH - MESSAGE), np.int64)
    for a in range(LENGTH):
        out[syndrome[a]] = 1 << a
        for b in range(a):
            out[syndrome[a] ^ syndrome[b]] = 1 << a | 1 << b
            for c in range(b):
                out[syndrome[a] ^ syndrome[b] ^ syndrome[c]] = 1 << a | 1 << b | 1 << c
    return out


class Golay:
    """Decoder of whole arrays; built by rule where it is used."""

    def __init__(self) -> None:
        self.high = np.array([_remainder(m << (LENGTH - MESSAGE)) for m in range(1 << MESSAGE)])
        self.leaders = _leaders()
        self.flips = np.array([0, *(1 << b for b in range(LENGTH))])

    def decode(self, words: np.ndarray) -> np.ndarray:
        """Index of the only codeword within three bits of each word."""
        low = LENGTH - MESSAGE
        error = self.leaders[(words & ((1 << low) - 1)) ^ self.high[words >> low]]
        return (words ^ error) >> low

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the word, key) for every different key of every word."""
        found = np.sort(self.decode(words[:, None] ^ self.flips[None, :]), axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        return np.nonzero(new)[0], found[new]


def join_keys(marks: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) over the three tables."""
    parts = [((marks >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
             for low, width in SEGMENTS]
    places, keys = [], []
    for table in range(len(SEGMENTS)):
        at, index = code.keys(parts[(table + 1) % len(SEGMENTS)])
        places.append(at)
        keys.append(((table << LENGTH | parts[table][at]) << MESSAGE) | index)
    return np.concatenate(places), np.concatenate(keys)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        marks = batch.column(0).to_numpy()
        for at in range(0, len(marks), 10_000):
            part = marks[at:at + 10_000]
            places, keys = join_keys(part.view(np.uint64), code)
            yield pa.RecordBatch.from_arrays([pa.array(part[places]), pa.array(keys)],
                                             names=["fingerprint", "key"])


# ---- links ---------------------------------------------------------------------------

def forest(marks: np.ndarray) -> list[tuple[int, int]]:
    """(place, place of its group's first) of linked fingerprints.

    All are compared with all; pairs inside a group are not given out.
    """
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= RADIUS
    open_, out = np.ones(len(marks), bool), []
    for first in range(len(marks)):
        if not open_[first]:
            continue
        group = np.zeros(len(marks), bool)
        group[first] = True
        edge = group
        while edge.any():
            reached = near[edge].any(0) & ~group
            group = group | reached
            edge = reached
        open_ &= ~group
        out += [(int(k), first) for k in np.flatnonzero(group) if k != first]
    return out


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for cell in batch.column(0).to_pylist():
            marks = np.array(cell, np.int64)
            for x, first in forest(marks.view(np.uint64)):
                a.append(marks[x])
                b.append(marks[first])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                         names=["a", "b"])


def links(marks: DataFrame) -> DataFrame:
    """Pairs (a, b) that join every group of linked fingerprints.

    A bucket larger than ``CHUNK`` is cut by hash; each two of its chunks meet
    in a row of bounded size, so no task holds a whole bucket.
    """
    ship(marks.sparkSession)
    keyed = stage(marks.select("fingerprint").distinct()
                  .mapInArrow(_emit_keys, "fingerprint bigint, key bigint"), "golay-keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = keyed.join(sizes, "key").withColumn(
        "chunks", F.ceil(F.col("n") / CHUNK).cast("int")).withColumn(
        "chunk", F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(
        F.least(o, F.col("chunk")).alias("low"), F.greatest(o, F.col("chunk")).alias("high")))
    met = (full.select("key", "fingerprint", F.explode(cells).alias("cell"))
           .groupBy("key", "cell").agg(F.collect_list("fingerprint").alias("marks"))
           .where(F.size("marks") > 1))
    return met.select("marks").mapInArrow(_link, "a bigint, b bigint").distinct()


def as_hex(mark: Column) -> Column:
    return F.lpad(F.lower(F.hex(mark)), 16, "0")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id, the least doc_id reachable, of every row.

    A fingerprint of more than a thousandth of all rows, of which there are
    fewer than a thousand, finds its component by broadcast; the others are
    joined by a shuffle in which no key is hot.
    """
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    rows = stage(text_map(rows, "text", [("fingerprint", T.LongType())], _fingerprints,
                          keep=["doc_id"]), "golay-marks")
    marks = stage(rows.groupBy("fingerprint").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "golay-distinct")
    classes = components(links(marks)).withColumnRenamed("key", "fingerprint")
    joined = marks.join(classes, "fingerprint", "left").withColumn(
        "class", F.coalesce("class", "fingerprint"))
    least = joined.groupBy("class").agg(F.min("least").alias("component_id"))
    found = stage(joined.join(least, "class").select("fingerprint", "n", "component_id"),
                  "golay-components")
    total = marks.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > F.lit(total * HOT_SHARE)
    few = F.broadcast(found.where(hot).drop("n"))
    usual = found.where(~hot).drop("n")
    out = ["doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id"]
    return rows.join(few, "fingerprint").select(*out).union(
        rows.join(usual, "fingerprint").select(*out))
