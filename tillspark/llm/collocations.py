"""Phrases whose words keep company, counted by partitioned suffix trees.

The words of every piece of text give its suffixes, truncated to five words.
Vertical partitioning: a suffix belongs to the partition of its first word,
or, where that word occurs more often than the budget, of its first two words,
and so on; one pass over the texts counts the extensions of all prefixes that
are still too heavy. Partitions are grouped by hash so that a group expects a
budget of suffixes. Tasks send a group its suffixes in blocks, equal ones
counted once, words as numbers beside the block's own list of words. A group
is built in one task: its sorted suffixes are the leaves of its truncated
suffix tree in order, and each node's count is the total of its leaves. Nodes
above a partition's prefix have leaves in several groups, and their totals are
summed at the end.

Defined results: a null text counts as empty and a null language as ``und``;
repeated rows count again; ties in a list go by score, frequency and phrase;
an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import TEXTS_AT_ONCE, quoted, ship

# ---- fixed values ----
LONGEST = 5
FREQUENT = 100
BEST = 2000
UNKNOWN = "und"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
# ----------------------
#: Suffixes that a partition and, on average, a group may hold.
BUDGET = 1_000_000
#: The budget rises with the table so that fewer prefixes than this exceed it.
MOST_HEAVY = 10_000
#: Keys or suffixes that a task counts before it hands them on.
HELD = 200_000
SUFFIXES_HELD = 500_000

#: Stands between language and words; below every byte of an escaped word.
_GAP = b"\x00"
_CLEAN = bytes.maketrans(bytes(range(65, 91)) + _BREAKS + b"\t",
                         bytes(range(97, 123)) + b"\n" * len(_BREAKS) + b" ")


def _escape(raw: bytes) -> bytes:
    if b"\x01" in raw or b"\x00" in raw:
        raw = raw.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")
    return raw


def pieces(text: str) -> Iterator[list[bytes]]:
    """Words of each piece that has any, lower-cased and escaped."""
    raw = _escape(text.encode("utf-8", "surrogatepass").translate(_CLEAN))
    for piece in raw.split(b"\n"):
        words = piece.split()  # of white space only blanks are left in a piece
        if words:
            yield words


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, str]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(at, TEXTS_AT_ONCE)
            for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if text:
                    yield _escape((UNKNOWN if lang is None else lang).encode(
                        "utf-8", "surrogatepass")), text


def _counted(keys: Iterator[list[bytes]], add) -> Iterator[pa.RecordBatch]:
    """Keys with their number, counted within bounded stretches of the input."""
    held: Counter = Counter()
    for found in keys:
        for at in range(0, len(found), HELD):
            held.update(found[at:at + HELD])
            if len(held) >= HELD:
                yield add(held)
                held = Counter()
    if held:
        yield add(held)


def _key_rows(held: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
        names=["key", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words counted by language, which is written before them once they leave."""
    held: dict[bytes, Counter] = {}

    def rows() -> pa.RecordBatch:
        return _key_rows({lang + _GAP + w: n for lang, words in held.items()
                          for w, n in words.items()})
    for lang, text in _texts(batches):
        held.setdefault(lang, Counter()).update(chain.from_iterable(pieces(text)))
        if sum(map(len, held.values())) >= HELD:
            yield rows()
            held = {}
    if held:
        yield rows()


def _extensions(heavy: set[bytes]):
    """Counts of the heavy prefixes' extensions by one word, or by their piece's end."""
    depth = next(iter(heavy)).count(_GAP)
    # Only a suffix whose first word begins a heavy prefix is looked at.
    begins: dict[bytes, set[bytes]] = {}
    for prefix in heavy:
        lang, word = prefix.split(_GAP, 2)[:2]
        begins.setdefault(lang, set()).add(word)

    def keys(lang: bytes, text: str) -> list[bytes]:
        out, mine = [], begins.get(lang)
        if mine is None:
            return out
        for words in pieces(text):
            if mine.isdisjoint(words):
                continue
            for k, word in enumerate(words):
                if word in mine and _GAP.join((lang, *words[k:k + depth])) in heavy:
                    out.append(_GAP.join((lang, *words[k:k + depth + 1])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted((keys(*row) for row in _texts(batches)), _key_rows)
    return run


# ---- suffixes ------------------------------------------------------------------------

class _Numbers(dict):
    """Numbers of words from 1 on; 0 stands for the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        return number


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ b) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def _sorted_runs(columns: np.ndarray) -> np.ndarray:
    """Order by the rows (columns) of numbers, the first one leading."""
    bits = max(1, int(columns.max(initial=0)).bit_length())
    per, keys = 63 // bits, []
    for at in range(0, len(columns), per):
        key = np.zeros(columns.shape[1], np.int64)
        for column in columns[at:at + per]:
            key = key << bits | column
        keys.append(key)
    return np.lexsort(keys[::-1])


class HeavyPrefixes:
    """The heavy prefixes as a trie of (parent's place, word)."""

    def __init__(self, heavy: set[bytes]) -> None:
        self.levels: list[list[tuple[int, bytes, bytes]]] = []
        place: dict[bytes, int] = {}
        for depth in range(1, LONGEST):
            level = sorted(p for p in heavy if p.count(_GAP) == depth)
            self.levels.append([(place.get(p.rpartition(_GAP)[0], 0), p.partition(_GAP)[0],
                                 p.rpartition(_GAP)[2]) for p in level])
            place = {p: k for k, p in enumerate(level)}

    def depth(self, columns: np.ndarray, numbers: dict) -> np.ndarray:
        """Words of each suffix's shortest prefix that isn't heavy, its end included."""
        size = len(numbers) + 1
        out = np.ones(columns.shape[1], np.int64)
        rows = np.arange(columns.shape[1])
        above = columns[0].astype(np.int64)
        for d, level in enumerate(self.levels):
            codes = {}
            for k, (parent, lang, word) in enumerate(level):
                if word in numbers and lang in numbers:
                    codes[(parent if d else numbers[lang]) * size + numbers[word]] = k
            if not codes or not len(rows):
                break
            known = np.array(sorted(codes))
            code = above * size + columns[d + 1][rows]
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = known[at] == code
            rows = rows[hit]
            above = np.array([codes[c] for c in known.tolist()])[at[hit]]
            out[rows] += 1
        return out


def windows(ids: list[int], langs: list[int], lengths: list[int]) -> np.ndarray:
    """Language and five words of every suffix, one a column; 0 after the piece's end."""
    flat = np.array([*ids, *[0] * LONGEST], np.int64)
    n = len(ids)
    out = np.zeros((LONGEST + 1, n), np.int64)
    out[0] = np.repeat(np.array(langs, np.int64), lengths)
    out[1] = flat[:n]
    for j in range(1, LONGEST):
        out[j + 1] = np.where(out[j] > 0, flat[j:n + j], 0)
    return out[:, out[1] > 0]


_BLOCK = pa.schema([("grp", pa.int64()), ("words", pa.binary()), ("ids", pa.binary()),
                    ("wide", pa.bool_()), ("depth", pa.binary()), ("n", pa.binary())])


def _blocks(numbers: dict, columns: np.ndarray, heavy: HeavyPrefixes,
            groups: int) -> pa.RecordBatch:
    """One row for each group: its different suffixes and how often each came."""
    order = _sorted_runs(columns)
    columns = columns[:, order]
    new = np.ones(columns.shape[1], bool)
    new[1:] = (columns[:, 1:] != columns[:, :-1]).any(0)
    starts = np.flatnonzero(new)
    count = np.diff(np.append(starts, columns.shape[1])).astype(np.uint32)
    columns = columns[:, starts]
    depth = heavy.depth(columns, numbers)
    words = [b"", *numbers]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 5) for w in words), np.uint64, len(words))
    mixed = hashes[columns[0]]
    for j in range(LONGEST):
        mixed = np.where(j < depth, _mix(mixed, hashes[columns[j + 1]]), mixed)
    group = (mixed % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    group, columns, depth, count = group[order], columns[:, order], depth[order], count[order]
    edges = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(group)]
    rows = []
    for low, high in zip(edges, edges[1:], strict=False):
        used, local = np.unique(columns[:, low:high], return_inverse=True)
        if used[0] != 0:
            used, local = np.concatenate(([0], used)), local + 1
        wide = len(used) > 1 << 16
        rows.append((int(group[low]), _GAP.join(words[k] for k in used[1:].tolist()),
                     local.astype("<u4" if wide else "<u2").tobytes(), wide,
                     depth[low:high].astype(np.uint8).tobytes(), count[low:high].tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_BLOCK)], schema=_BLOCK)


def _emit_blocks(heavy: HeavyPrefixes, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, langs, lengths = _Numbers(), [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if ids:
                yield _blocks(numbers, windows(ids, langs, lengths), heavy, groups)
            for held in (numbers, ids, langs, lengths):
                held.clear()

        for lang, text in _texts(batches):
            for words in pieces(text):
                ids.extend(map(numbers.__getitem__, words))
                ids.append(0)
                langs.append(numbers[lang])
                lengths.append(len(words) + 1)
                if len(ids) >= SUFFIXES_HELD:
                    yield from flush()
        yield from flush()
    return run


# ---- trees ---------------------------------------------------------------------------

def node_totals(columns: np.ndarray, depth: np.ndarray, n: np.ndarray,
                least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, total) of the nodes of each depth of the tree over these suffixes.

    Sorted, the suffixes are the tree's leaves in order, and a node is a run of
    them that agree so far. Only a heavy prefix may have leaves in other groups;
    other nodes below ``least`` go no further.
    """
    order = _sorted_runs(columns)
    columns, total = columns[:, order], n[order]
    new = np.zeros(columns.shape[1], bool)
    new[:1] = True
    new[1:] |= columns[0, 1:] != columns[0, :-1]
    for d in range(1, LONGEST + 1):
        new[1:] |= columns[d, 1:] != columns[d, :-1]
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(total, starts)
        keep = (columns[d, starts] > 0) & ((sums >= least) | (depth[order[starts]] > d))
        yield order[starts[keep]], sums[keep]


def _build(least: int):
    """All nodes of a group's truncated suffix tree from its blocks."""
    def build(table: pa.Table) -> pa.Table:
        numbers, parts = _Numbers(), []
        for words, ids, wide in zip(*(table.column(c).to_pylist()
                                      for c in ("words", "ids", "wide")), strict=True):
            own = np.array([0, *map(numbers.__getitem__, words.split(_GAP))], np.int64)
            local = np.frombuffer(ids, "<u4" if wide else "<u2").reshape(LONGEST + 1, -1)
            parts.append(own[local])
        columns = np.concatenate(parts, axis=1)
        depth = np.frombuffer(b"".join(table.column("depth").to_pylist()), np.uint8)
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), np.uint32).astype(np.int64)
        words = [b"", *numbers]
        keys, sums = [], []
        for d, (rows, totals) in enumerate(node_totals(columns, depth, n, least), 1):
            keys += [_GAP.join([words[w] for w in path])
                     for path in columns[:d + 1, rows].T.tolist()]
            sums.append(totals)
        return pa.table({"key": pa.array(keys, pa.binary()),
                         "n": pa.array(np.concatenate(sums), pa.int64())})
    return build


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text",
                  least: int = FREQUENT, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(key, n) of all phrases of up to five words found ``least`` times, and of all words.

    A key is language and words with a zero byte between.
    """
    ship(docs.sparkSession)
    rows = docs.select(quoted(lang).alias("lang"), quoted(text).alias("text"))
    sums = lambda df: df.groupBy("key").agg(F.sum("n").alias("n"))
    shape = "key binary, n bigint"
    words = stage(sums(rows.mapInArrow(_count_words, shape)), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    budget = max(budget, -(-total // MOST_HEAVY))
    heavy: set[bytes] = set()
    prefixes = words
    for _ in range(LONGEST - 1):
        level = {bytes(r.key) for r in prefixes.where(F.col("n") > budget).collect()}
        if not level:
            break
        heavy |= level
        prefixes = sums(rows.mapInArrow(_extensions(level), shape))
    groups = max(1, -(-total // budget))
    blocks = rows.mapInArrow(_emit_blocks(HeavyPrefixes(heavy), groups),
                             "grp bigint, words binary, ids binary, wide boolean, "
                             "depth binary, n binary")
    counts = blocks.groupBy("grp").applyInArrow(_build(least), shape)
    return stage(sums(counts).where(F.col("n") >= least), "phrases"), words


# ---- scores ------------------------------------------------------------------------

def _joined(parts: Column) -> Column:
    return F.array_join(parts, _GAP.decode())


def _plain(text: Column) -> Column:
    """The words as they stand in the texts."""
    inner = F.replace(text, F.lit("\x01\x01"), F.lit("\x00"))
    return F.replace(inner, F.lit("\x01\x02"), F.lit("\x01"))


def _product(a: Column, b: Column) -> Column:
    """Exact product of two whole numbers up to 18 and 19 digits."""
    return a.cast("decimal(18,0)") * b.cast("decimal(19,0)")


def scored(counts: DataFrame, words: DataFrame) -> DataFrame:
    """Each candidate with its lowest-scoring cut: key, parts, a, l, r, n, score."""
    known = counts.select(F.col("key").cast("string").alias("key"), "n")
    size = (words.groupBy(F.substring_index(F.col("key").cast("string"), _GAP.decode(), 1)
                          .alias("lang")).agg(F.sum("n").alias("n")))
    parts = F.split("key", "\\x00")
    k, cut = F.size("parts") - 1, F.col("cut")
    cuts = (known.select("key", F.col("n").alias("a"), parts.alias("parts"))
            .where(F.size("parts") > 2)
            .select("*", F.explode(F.sequence(F.lit(1), k - 1)).alias("cut"))
            .withColumns({
                "lang": F.element_at("parts", 1),
                "head": _joined(F.slice("parts", F.lit(1), cut + 1)),
                "tail": _joined(F.concat(F.slice("parts", 1, 1),
                                         F.slice("parts", cut + 2, k - cut)))}))
    heads = known.select(F.col("key").alias("head"), F.col("n").alias("l"))
    tails = known.select(F.col("key").alias("tail"), F.col("n").alias("r"))
    table = cuts.join(heads, "head").join(tails, "tail").join(size, "lang")
    table = table.withColumn("over", _product(F.col("n"), F.col("a") * 1000)).withColumn(
        "under", _product(F.col("l"), F.col("r"))).withColumn("score", F.expr("over div under"))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("low")
    return table.groupBy("key", "parts", "lang", "a", "n").agg(lowest).select(
        "key", "parts", "lang", "a", "low.l", "low.r", "n", "low.score")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text",
                 least: int = FREQUENT, best: int = BEST, budget: int = BUDGET) -> DataFrame:
    """Each language's best phrases by the score of their lowest cut.

    A candidate that never occurs outside a longer one goes. If it lies in one
    some words longer, equally frequent, then also in one a word longer, so
    those are looked at alone.
    """
    counts, words = phrase_counts(docs, lang, text, least, budget)
    table = stage(scored(counts, words), "scored")
    k = F.size("parts") - 1
    longer = table.where(k > 2).select(F.col("a").alias("as_often"), F.explode(F.array(
        _joined(F.slice("parts", F.lit(1), k)),
        _joined(F.concat(F.slice("parts", 1, 1), F.slice("parts", F.lit(3), k - 1))))
    ).alias("inner"))
    kept = table.join(longer, (F.col("key") == F.col("inner"))
                      & (F.col("as_often") >= F.col("a")), "left_anti")
    named = kept.select(
        _plain(F.col("lang")).alias("lang"),
        _plain(F.array_join(F.slice("parts", F.lit(2), k), " ")).alias("phrase"),
        "a", "l", "r", "n", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return named.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= best).select("lang", F.col("rank").cast("long").alias("rank"),
                                      "phrase", "a", "l", "r", "n", "score")
