"""Near duplicates by a chosen-path join on five-word shingles.

A text is the set of its five-word shingles (all its words when it has fewer);
64 minimum hashes embed the set so that the share of equal coordinates follows
the Jaccard similarity. Each run splits the texts recursively: a node chooses
one or two coordinates by a hash of its path (1 / similarity on average) and a
text goes to the child of its own value there. Buckets of up to ``LEAF`` texts
are compared by brute force inside a task, which passes on the spanning forest of
the pairs that the minima support: no pair is lost as a member of the same
family, and what leaves the task grows with the texts, not with their pairs. In a
bucket beyond ``LEAF`` one text stands for those of the same minima. It splits
further where that at least halves its pairs; otherwise, and at the last depth,
it is dealt into blocks, each pair of blocks is a cell compared in one task, and
only the cell's forest leaves it. So every pair of every bucket is compared.

Families are the components of these forests. Inside a family every pair that
the minima support is confirmed on the whole texts, and every link is counted. A
family is dealt into blocks of bounded size by a hash of the text, and each pair
of blocks is a cell, compared in one task; a cell gives one row for each text,
with the number of its links and the least text it can reach. So no group is
ever in one task, and no list of pairs is ever stored. Exact counts of links take
work that is quadratic in a family; a text is shuffled once for each block of its
own family, which is once for nearly all.

The number of runs follows from the chance that a pair right at the threshold
survives to the deepest level reached, so that the target recall holds for the
hardest pairs: where buckets went deeper than ``DEPTH``, runs are added.

Defined results: texts are the same when their bytes are, and equal texts are
one class without further comparison; a null text is nobody's copy and a class
of its own; empty texts and texts of blanks are equal only to themselves;
repeated rows are copies; null ids are allowed; an empty table gives an empty
result; other columns pass through ``keep_one`` untouched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .common import fresh, quoted, text_map

SHINGLE = 5
COORDINATES = 64
LEAF = 4096
#: Shingles and texts of a block of a family, on average.
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 20, 2048
DEPTH = 4
MAX_DEPTH = 12
#: Equal coordinates from which a pair is confirmed on its texts.
ENOUGH = 40
#: Bits of the filter that keeps texts without candidates out of a shuffle.
FILTER_BITS = 1 << 23

_M64 = (1 << 64) - 1
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_STEP = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], np.uint64)


class _WordHashes(dict):
    """64-bit hashes of words, remembered while a batch lasts."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(raw: bytes, known: _WordHashes) -> np.ndarray:
    """Hashes of the five-word shingles, repeated ones included."""
    words = raw.split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    if not width:
        return h
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += h[k:k + n] * _STEP[k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def minima(hashes: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, _M64, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at:at + 2048]
        low = np.minimum(low, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def _mix(*values: int) -> int:
    return xxhash.xxh64_intdigest(b",".join(b"%d" % v for v in values))


def chosen(path: int, similarity: float) -> list[int]:
    """Coordinates of a node: one, or two with the chance 1 / similarity - 1."""
    first = _mix(path, 1) % COORDINATES
    if _mix(path, 2) / 2.0 ** 64 >= 1 / similarity - 1:
        return [first]
    return [first, (first + 1 + _mix(path, 3) % (COORDINATES - 1)) % COORDINATES]


def child(path: int, coordinate: int, value: int) -> int:
    return _mix(path, coordinate, value) - (1 << 63)


def survival(depth: int, similarity: float) -> float:
    """Chance that a pair at the threshold shares a node at ``depth``."""
    lost, two = 0.0, 1 / similarity - 1
    for _ in range(depth):
        miss = 1 - similarity * (1 - lost)
        lost = (1 - two) * miss + two * miss * miss
    return 1 - lost


def runs_for(recall: float, similarity: float, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth, similarity)))


def roots_of(runs: int, similarity: float) -> list[tuple[int, int]]:
    """Run and coordinate of the first-level buckets of a text, in this order."""
    return [(r, c) for r in range(runs) for c in chosen(r, similarity)]


def _sketcher(runs: int, similarity: float):
    roots = roots_of(runs, similarity)

    def setup():
        known = _WordHashes()

        def compute(texts):
            if len(known) > 200_000:
                known.clear()
            keys, marks, paths, sizes = [], [], [], []
            for text in texts:
                raw = None if text is None else text.encode("utf-8", "surrogatepass")
                keys.append(None if raw is None else hashlib.md5(raw).digest())
                hashes = shingles(raw or b"", known)
                sizes.append(len(hashes))
                if not len(hashes):
                    marks.append(None)
                    paths.append(None)
                    continue
                low = minima(hashes)
                marks.append((low & np.uint32(255)).astype(np.uint8).tobytes())
                paths.append([child(r, c, int(low[c])) for r, c in roots])
            return keys, marks, paths, sizes
        return compute
    return setup


def sketch(docs: DataFrame, text: str, runs: int, similarity: float, keep) -> DataFrame:
    """Key of the text, one byte for each coordinate, first-level buckets, shingles."""
    return text_map(docs, text, [("key", T.BinaryType()), ("marks", T.BinaryType()),
                                 ("paths", T.ArrayType(T.LongType())),
                                 ("size", T.LongType())],
                    _sketcher(runs, similarity), keep)


def _frame(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal coordinates of every row of ``left`` with every row of ``right``."""
    if len(left) * len(right) <= 4096:
        return (left[:, None, :] == right[None, :, :]).sum(axis=2, dtype=np.uint8)
    same = np.zeros((len(left), len(right)), np.uint8)
    for c in range(COORDINATES):
        same += left[:, c][:, None] == right[:, c][None, :]
    return same


def spanning(same: np.ndarray) -> list[tuple[int, int]]:
    """Forest of greatest agreement, from ``ENOUGH`` on, row by row."""
    n, out = len(same), []
    best, link = np.zeros(n, np.int64), np.full(n, -1)
    free = np.ones(n, bool)
    for _ in range(n):
        at = int(np.where(free, best, -1).argmax())
        if link[at] >= 0:
            out.append((int(link[at]), at))
        free[at] = False
        row = same[at].astype(np.int64)
        nearer = free & (row >= ENOUGH) & (row > best)
        best[nearer], link[nearer] = row[nearer], at
    return out


def leaf_forest(marks: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold together what the minima of a bucket support."""
    same = agreement(marks, marks)
    np.fill_diagonal(same, 0)
    if len(marks) == 2:
        return [(0, 1)] if same[0, 1] >= ENOUGH else []
    return spanning(same)


def _marks(rows: list[dict]) -> np.ndarray:
    joined = b"".join(x["marks"] for x in rows)
    return np.frombuffer(joined, np.uint8).reshape(len(rows), COORDINATES)


def _compare_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = [], []
        for bucket in _frame(batch, "texts"):
            bucket.sort(key=lambda x: x["key"])
            for i, j in leaf_forest(_marks(bucket)):
                left.append(bucket[min(i, j)]["key"])
                right.append(bucket[max(i, j)]["key"])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()),
                                          pa.array(right, pa.binary())], names=["a", "b"])


def _compare_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest of each cell of a bucket: of one block, or of the pairs between two."""
    for batch in batches:
        left, right = [], []
        cells = batch.column(batch.schema.get_field_index("cell")).to_pylist()
        for cell, rows in zip(cells, _frame(batch, "texts"), strict=True):
            rows.sort(key=lambda x: (x["block"], x["key"]))
            marks, n = _marks(rows), sum(x["block"] == cell["i"] for x in rows)
            if cell["i"] == cell["j"]:
                pairs = leaf_forest(marks)
            else:
                same = np.zeros((len(rows), len(rows)), np.uint8)
                same[:n, n:] = agreement(marks[:n], marks[n:])
                same[n:, :n] = same[:n, n:].T
                pairs = spanning(same)
            for i, j in pairs:
                left.append(min(rows[i]["key"], rows[j]["key"]))
                right.append(max(rows[i]["key"], rows[j]["key"]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()),
                                          pa.array(right, pa.binary())], names=["a", "b"])


def _bucket_cells(large: DataFrame) -> DataFrame:
    """Keys and marks of each pair of blocks of a bucket: one row, of bounded size.

    Blocks have half of ``LEAF`` texts on average; a text goes out once for each
    block of its bucket, with its marks alone.
    """
    blocks = F.ceil(F.col("n") * 2 / LEAF).cast("long")
    pair = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.struct(
        F.least("block", other).alias("i"), F.greatest("block", other).alias("j")))
    return (large.withColumn("block", F.pmod(F.xxhash64("key"), blocks))
            .select("path", F.explode(pair).alias("cell"),
                    F.struct("key", "marks", "block").alias("row"))
            .groupBy("path", "cell").agg(F.collect_list("row").alias("texts"))
            .where(F.size("texts") > 1).select("cell", "texts"))


def _children(similarity: float):
    """Paths of the children of each row's bucket that the row goes to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _frame(batch, "marks")
            paths = [[child(path, c, marks[at][c]) for c in chosen(path, similarity)]
                     for at, path in enumerate(_frame(batch, "path"))]
            index = batch.schema.get_field_index
            yield pa.RecordBatch.from_arrays(
                [batch.column(index(n)) for n in ("path", "key", "marks", "n")]
                + [pa.array(paths, pa.list_(pa.int64()))],
                names=["path", "key", "marks", "n", "paths"])
    return run


def _descend(rows: DataFrame, marks: DataFrame, similarity: float) -> tuple[list[DataFrame], int]:
    """Links of all buckets below the first-level ``rows`` (path, key), and the depth reached."""
    found, depth = [], 1
    while True:
        size = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        full = rows.join(size, "path")
        if depth == 1:
            full = full.join(marks, "key")
        full = stage(full, f"buckets-{depth}")
        leaves = (full.where(F.col("n") <= LEAF).groupBy("path")
                  .agg(F.collect_list(F.struct("key", "marks")).alias("texts"))
                  .select("texts"))
        found.append(leaves.mapInArrow(_compare_leaves, "a binary, b binary"))
        large = full.where(F.col("n") > LEAF)
        if large.isEmpty():
            return found, depth
        # One text stands for all of the same minima: what they support is the same.
        heads = stage(large.groupBy("path", "marks").agg(
            F.min("key").alias("key"), F.count(F.lit(1)).alias("alike")), f"heads-{depth}")
        alike = heads.where("alike > 1").select("path", "marks", F.col("key").alias("a"))
        found.append(large.hint("merge").join(alike, ["path", "marks"])
                     .where("key != a").select("a", F.col("key").alias("b")))
        counts = heads.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        shape = "path bigint, key binary, marks binary, n bigint, paths array<bigint>"
        kept = stage(heads.join(counts, "path").select("path", "key", "marks", "n")
                     .mapInArrow(_children(similarity), shape), f"children-{depth}")
        split = (kept.where(F.lit(depth < MAX_DEPTH) & (F.col("n") > LEAF))
                 .select("path", "n", F.explode("paths").alias("child"))
                 .groupBy("path", "n", "child").agg(F.count(F.lit(1)).alias("m"))
                 .groupBy("path", "n").agg(F.sum(F.col("m").cast("double") ** 2).alias("pairs"))
                 .where(F.col("pairs") * 2 <= F.col("n").cast("double") ** 2).select("path"))
        split = stage(split, f"split-{depth}")
        found.append(_bucket_cells(kept.join(split, "path", "left_anti"))
                     .mapInArrow(_compare_parts, "a binary, b binary"))
        if split.isEmpty():
            return found, depth
        rows = kept.join(split, "path", "left_semi").select(
            F.explode("paths").alias("path"), "key", "marks")
        depth += 1


def candidates(texts: DataFrame, similarity: float, recall: float) -> DataFrame:
    """Links between keys that a bucket brought together and the marks support.

    Their components hold every such pair. ``texts`` has one row for each
    different text: key, marks and the paths of as many runs as ``MAX_DEPTH``
    takes, of which only those are used that the depth reached asks for.
    """
    found, done, deepest = [], 0, DEPTH
    while done < (need := runs_for(recall, similarity, deepest)):
        first, end = (len(roots_of(r, similarity)) for r in (done, need))
        rows = texts.select(F.explode(F.slice("paths", first + 1, end - first)).alias("path"),
                            "key")
        links, depth = _descend(rows, texts.select("key", "marks"), similarity)
        found += links
        done, deepest = need, max(deepest, depth)
    return reduce(DataFrame.union, found).distinct()


def compare_cell(sets: list[np.ndarray], marks: np.ndarray, second: np.ndarray,
                 similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each text of a cell and the first text it can reach.

    ``sets`` holds different shingles; ``second`` marks the rows of the second
    block, which are compared with those of the first alone. A cell of one block
    has none of them, and all its rows are compared.
    """
    n, two = len(sets), bool(second.any())
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.flatnonzero(~second)
    others = np.flatnonzero(second) if two else rows
    supported = agreement(marks[rows], marks[others]) >= ENOUGH
    counts, least = np.zeros(n, np.int64), np.arange(n)
    present = np.zeros(len(ids), bool)
    for at, i in enumerate(rows.tolist()):
        to = others[supported[at]]
        if not two:
            to = to[to > i]
        if not len(to):
            continue
        mine = ids[start[i]:start[i] + size[i]]
        present[mine] = True
        ends = np.cumsum(size[to])
        spots = np.arange(ends[-1]) + np.repeat(start[to] - ends + size[to], size[to])
        both = np.add.reduceat(present[ids[spots]], ends - size[to], dtype=np.int64)
        present[mine] = False
        linked = to[both >= similarity * (size[i] + size[to] - both) - 1e-9]
        if len(linked):
            counts[i] += len(linked)
            counts[linked] += 1
            met = np.unique(np.append(least[linked], least[i]))
            least[np.isin(least, met)] = met[0]
    return counts, least


def _compare_cells(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            keys, least, counts = [], [], []
            pairs = _frame(batch, "cell")
            for pair, cell in zip(pairs, batch.column(batch.schema.get_field_index("rows"))):
                if len(known) > 200_000:
                    known.clear()
                rows = sorted(cell.as_py(), key=lambda x: x["key"])
                if pair["i"] != pair["j"] and len({x["block"] for x in rows}) == 1:
                    continue  # the other block is empty; this one has its own cell
                sets = [np.unique(shingles(x["text"].encode("utf-8", "surrogatepass"), known))
                        for x in rows]
                block = np.array([x["block"] for x in rows])
                n, first = compare_cell(sets, _marks(rows), block > pair["i"], similarity)
                for at in np.flatnonzero(n).tolist():
                    keys.append(rows[at]["key"])
                    least.append(rows[first[at]]["key"])
                    counts.append(int(n[at]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(least, pa.binary()),
                 pa.array(counts, pa.int64())], names=["key", "least", "n"])
    return run


def _cells(members: DataFrame) -> DataFrame:
    """Texts of each pair of blocks of a family: one row, of bounded size."""
    last = F.col("blocks") - 1
    pair = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda other: F.struct(
        F.least("block", other).alias("i"), F.greatest("block", other).alias("j")))
    return (members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
            .select("family", F.explode(pair).alias("cell"),
                    F.struct("key", "marks", "text", "block").alias("row"))
            .groupBy("family", "cell").agg(F.collect_list("row").alias("rows"))
            .where(F.size("rows") > 1).select("cell", "rows"))


def components(links: DataFrame) -> DataFrame:
    """Key and class of every linked key: the least key it can reach.

    Each round takes the least class among a key's neighbours and then that
    class's own class, so chains halve. Every round is a stored table.
    """
    both = stage(links.union(links.select("b", "a")).distinct(), "links")
    state = stage(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("least"))
                  .select("key", F.least("key", "least").alias("class")), "classes")
    while True:
        seen = (both.join(state.select(F.col("key").alias("b"), "class"), "b")
                .groupBy(F.col("a").alias("key")).agg(F.min("class").alias("least")))
        near = state.join(seen, "key").select("key", "class", F.least("class", "least").alias("to"))
        jump = state.select(F.col("key").alias("to"), F.col("class").alias("further"))
        after = stage(near.join(jump, "to").select(
            "key", F.least("to", "further").alias("class"),
            (F.least("to", "further") != F.col("class")).alias("moved")), "classes")
        state = after.select("key", "class")
        if after.where("moved").isEmpty():
            return state


def _marked_bits(keys: DataFrame) -> DataFrame:
    """A bitmap of the keys' hashes in slices: ``FILTER_BITS / 8`` bytes at most."""
    at = F.pmod(F.xxhash64("wanted"), F.lit(FILTER_BITS))
    return (keys.select(at.alias("at"))
            .groupBy(F.shiftright("at", 15).alias("slice"))
            .agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits")))


def _maybe_wanted(body: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key's bit is set: all wanted ones and few others.

    The bitmap has a fixed size, so it is broadcast; the shuffle that follows
    carries the texts of candidates instead of all texts.
    """
    at = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    bits = F.broadcast(_marked_bits(keys))
    spot = F.col("at").bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(spot, 3) + 1), F.lit(1))), 16, 10)
    on = F.expr("shiftright(cast(byte as int), cast(at & 7 as int)) & 1") == 1
    return (body.withColumn("at", at).join(bits, F.shiftright("at", 15) == F.col("slice"))
            .withColumn("byte", byte).where(on).select(*body.columns))


def _classes(docs: DataFrame, marked: DataFrame, text: str, doc_id: str, similarity: float,
             recall: float):
    """For each different text its class, links and copies.

    ``marked`` is stored: doc_id, key, marks, paths of every row of ``docs``.
    """
    known = marked.where(F.col("key").isNotNull())
    groups = stage(known.groupBy("key").agg(F.min("doc_id").alias("first_id"),
                                            F.count(F.lit(1)).alias("n_rows")), "texts")
    one = known.where("paths is not null").dropDuplicates(["key"])
    one = stage(one.select("key", "marks", "paths", "size"), "sketches")
    near = stage(candidates(one.select("key", "marks", "paths"), similarity, recall), "candidates")
    # Families and their members grow with the input: they are never broadcast.
    members = (components(near).withColumnRenamed("class", "family").hint("merge")
               .join(one.select("key", "marks", "size"), "key"))
    blocks = members.groupBy("family").agg(F.greatest(
        F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS),
    ).cast("long").alias("blocks"))
    wanted = stage(members.hint("merge").join(blocks, "family").hint("merge").join(groups, "key")
                   .select(F.col("key").alias("wanted"), "family", "blocks", "marks",
                           "first_id"), "wanted")
    body = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"),
                       F.unhex(F.md5(quoted(text))).alias("key"))
    texts = (_maybe_wanted(body, wanted).join(
        wanted.hint("merge"), (F.col("key") == F.col("wanted"))
        & F.col("doc_id").eqNullSafe(F.col("first_id")))
        .dropDuplicates(["key"]).select("key", "text", "family", "blocks", "marks"))
    links = stage(_cells(texts).mapInArrow(_compare_cells(similarity),
                                           "key binary, least binary, n bigint"), "links")
    state = components(links.where("key != least")
                       .select(F.col("least").alias("a"), F.col("key").alias("b")))
    degree = links.groupBy("key").agg(F.sum("n").alias("n_links"))
    return stage(groups.join(state, "key", "left").join(degree, "key", "left").select(
        "key", "first_id", "n_rows", F.coalesce("class", "key").alias("class"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "text-classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    similarity: float = 0.8, recall: float = 0.998) -> DataFrame:
    """doc_id, class_id, n_links and n_copies for every row of ``docs``.

    ``class_id`` is the least id of the class. ``n_links`` counts all links of
    the row's text to different texts, ``n_copies`` other rows with the same text.
    """
    docs = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    runs = runs_for(recall, similarity, max(DEPTH, MAX_DEPTH))
    marked = stage(sketch(docs, "text", runs, similarity, ["doc_id"]), "marked")
    by_text = _classes(docs, marked, "text", "doc_id", similarity, recall)
    least = by_text.groupBy("class").agg(F.min("first_id").alias("class_id"))
    facts = by_text.join(least, "class").select("key", "class_id", "n_links", "n_rows")
    return (marked.select("doc_id", "key").join(facts, "key", "left")
            .select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id"))
                    .otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    (F.coalesce("n_rows", F.lit(1)) - 1).alias("n_copies")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             similarity: float = 0.8, recall: float = 0.998) -> DataFrame:
    """One document of each class, the one of least id; null texts all stay."""
    row, = fresh(docs, "__row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    plain = numbered.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"),
                            F.col(row).alias("row"))
    runs = runs_for(recall, similarity, max(DEPTH, MAX_DEPTH))
    marked = stage(sketch(plain, "text", runs, similarity, ["doc_id", "row"]), "marked")
    by_text = _classes(plain, marked, "text", "doc_id", similarity, recall)
    best = (marked.join(by_text.select("key", "class"), "key")
            .groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
                                  .alias("best")).select("best.row"))
    mine, = fresh(numbered, "__mine")
    stays = stage(best.union(marked.where("key is null").select("row")).toDF(mine), "stays")
    return numbered.join(stays.hint("merge"), F.col(row) == F.col(mine), "left_semi").select(
        *map(quoted, docs.columns))
