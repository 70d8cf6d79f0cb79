"""Merkle manifest of a dataset with a membership proof for every document.

A document is a leaf; three consecutive nodes become their parent. Leaves are
numbered within their source by a range sort and prefix sums. Each aligned
block of ``3 ** LEVELS`` leaves is one stream of appends in a task: a leaf
starts with an empty witness, and whenever a subtree is completed by its last
sibling the witnesses of all its leaves grow by the siblings' digests. The
roots of the blocks are appended the same way to the next round's blocks until
one node a source remains, and the sources' roots form one more such tree. A
block's own witness then completes those of its leaves.

Defined results: null fields are ``-``; the null source comes first, then the
others by their UTF-8 bytes; null ids come first, equal ids go by leaf digest,
and equal rows take neighbouring places; a document without id is not tampered
with; a source of one document has its leaf as root, a single source its root
as the dataset's; an empty table gives an empty result; only the named columns
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import quoted, ship

# ---- fixed values ----
ARITY = 3
ABSENT = "-"
# ----------------------
#: Levels that a task grows at one time: blocks of 3 ** 7 = 2,187 nodes.
LEVELS = 7

_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
_WITNESS = "array<struct<left:string,right:string>>"


def leaf(*fields: Column) -> Column:
    """Digest of the fields, each preceded by its length in bytes."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.when(value.isNull(), ABSENT).otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))
    return F.sha2(F.concat(*map(part, fields)), 256)


def fold(start: Column, witness: Column) -> Column:
    """The root that a digest and its siblings lead to."""
    return F.aggregate(witness, start, lambda at, w: F.sha2(
        F.concat(w["left"], at, w["right"]), 256))


def proof(witness: Column) -> Column:
    """Digest of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(
        witness, lambda w: F.concat(w["left"], w["right"])), ""), 256)


# ---- places ------------------------------------------------------------------------

def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row among those of its group in this sorted part."""
    part, group, place = TaskContext.get().partitionId(), None, -1
    for batch in batches:
        places = []
        for value in batch.column(0).to_pylist():
            place = place + 1 if value == group else 0
            group = value
            places.append(place)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * n, pa.int32()), pa.array(places, pa.int64())],
            names=[*batch.schema.names, "part", "place"])


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds ``at``, the place from 0 within the group, and ``n``, its size.

    ``rows`` is stored. They are sorted by range, numbered within each range,
    and each range's offset is a sum over one row for each range and group.
    """
    ship(rows.sparkSession)
    names = [group, *[c for c in rows.columns if c != group]]
    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    placed = stage(rows.select(*names).repartitionByRange(group, *order)
                   .sortWithinPartitions(group, *order)
                   .mapInArrow(_number, f"{shape}, part int, place bigint"), "placed")
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(group, "part").agg((F.max("place") + 1).alias("in_part")).select(
        group, "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"),
        F.sum("in_part").over(whole).alias("n"))
    return placed.join(sizes, [group, "part"]).withColumn(
        "at", F.col("place") + F.col("offset")).drop("part", "place", "offset")


# ---- witnesses -----------------------------------------------------------------------

class Appender:
    """A tree that grows by appended digests and keeps every witness up to date.

    ``open`` holds, level by level, the completed subtrees that wait for their
    siblings, each with the range of leaves below it.
    """

    def __init__(self, levels: int) -> None:
        self.levels = levels
        self.open: list[list[tuple[str, int, int]]] = [[] for _ in range(levels + 1)]
        self.witnesses: list[list[tuple[str, str]]] = []

    def append(self, digest: str) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        self.open[0].append((digest, at, at + 1))
        for level in range(self.levels):
            if len(self.open[level]) < ARITY:
                break
            self._join(level)

    def _join(self, level: int) -> None:
        nodes, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in nodes]
        for k, (_, low, high) in enumerate(nodes):
            step = ("".join(digests[:k]), "".join(digests[k + 1:]))
            for at in range(low, high):
                self.witnesses[at].append(step)
        parent = hashlib.sha256("".join(digests).encode()).hexdigest()
        self.open[level + 1].append((parent, nodes[0][1], nodes[-1][2]))

    def close(self) -> str:
        """Completes the runs that stay short; the root."""
        for level in range(self.levels):
            if self.open[level]:
                self._join(level)
        return self.open[self.levels][0][0]


def levels_of(n: int, most: int) -> int:
    """Levels above ``n`` nodes until one remains, at most ``most``."""
    level, reach = 0, 1
    while reach < n and level < most:
        level, reach = level + 1, reach * ARITY
    return level


def _grow(levels: int):
    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        tree = Appender(levels_of(table.column("n")[0].as_py(), levels))
        for digest in table.column("digest").to_pylist():
            tree.append(digest)
        root = tree.close()
        size = table.num_rows
        steps = [[{"left": a, "right": b} for a, b in w] for w in tree.witnesses]
        arrays = []
        for name in table.schema.names:
            own = table.column(name).combine_chunks()
            last = {"at": table.column("block")[0].as_py(), "digest": root,
                    "n": -(-table.column("n")[0].as_py() // ARITY ** levels)}.get(
                name, own[0].as_py() if name in ("grp", "block") else None)
            arrays.append(pa.concat_arrays([own, pa.array([last], own.type)]))
        arrays += [pa.array([*steps, None], pa.list_(_STEP)),
                   pa.array([False] * size + [True], pa.bool_())]
        return pa.Table.from_arrays(arrays, names=[*table.schema.names, "witness", "is_root"])
    return grow


def climb(nodes: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The witnesses of each round within its blocks, and the groups' roots.

    ``nodes`` has grp, at, n, digest and any other columns; no two groups'
    rows meet. Every round shortens a group by 3 ** levels.
    """
    ship(nodes.sparkSession)
    rounds = []
    while True:
        rows = nodes.withColumn("block", F.floor(F.col("at") / ARITY ** levels))
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        grown = stage(rows.groupBy("grp", "block").applyInArrow(
            _grow(levels), f"{shape}, witness {_WITNESS}, is_root boolean"), "grown")
        rounds.append(grown.where("not is_root").drop("is_root"))
        nodes = grown.where("is_root").select("grp", "at", "n", "digest")
        if (nodes.agg(F.max("n")).first()[0] or 1) <= 1:
            return rounds, nodes.select("grp", "digest")


def descend(rounds: list[DataFrame], upper: DataFrame) -> DataFrame:
    """The first round's nodes with witnesses completed by their blocks' own.

    ``upper`` has grp, block, upper and columns to hand down. A block joins at
    most 3 ** levels nodes, so no key of these joins is hot.
    """
    more = [c for c in upper.columns if c not in ("grp", "block", "upper")]
    for below in reversed(rounds):
        below = below.join(upper, ["grp", "block"]).withColumn(
            "witness", F.concat("witness", "upper"))
        upper = below.select("grp", F.col("at").alias("block"),
                             F.col("witness").alias("upper"), *more)
    return below


def build(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang",
          n_chars: str = "n_chars", text: str = "text", levels: int = LEVELS) -> DataFrame:
    """Leaf, subroot, root, witness and the tampered leaf of every document.

    Texts are read once, where their leaves are hashed; digests alone travel.
    """
    c = {n: quoted(v) for n, v in dict(doc_id=doc_id, source=source, lang=lang,
                                       n_chars=n_chars, text=text).items()}
    head = [c["doc_id"], c["source"], c["lang"], c["n_chars"]]
    even = F.crc32(c["doc_id"].cast("string")) % 2 == 0
    own = leaf(*head, c["text"])
    bent = F.when(even, leaf(*head, F.translate(c["text"], "\n", "")))
    group = F.when(c["source"].isNull(), "").otherwise(F.concat(F.lit("="), c["source"]))
    leaves = stage(docs.select(
        group.alias("grp"), c["doc_id"].alias("doc_id"), own.alias("digest"), bent.alias("bent"),
        F.monotonically_increasing_id().alias("tie")), "leaves")
    placed = ranked(leaves, "grp", "doc_id", "digest", "tie")
    rounds, roots = climb(placed.drop("tie"), levels)
    tops = stage(roots.select(F.lit("").alias("grp"), F.col("grp").alias("own"), "digest"),
                 "subroots")
    top_rounds, top = climb(ranked(tops, "grp", "own"), levels)
    row = top.first()
    root = F.lit(row["digest"] if row else None).cast("string")
    empty = F.array().cast(_WITNESS)
    above = descend(top_rounds, top.select("grp", F.lit(0).cast("bigint").alias("block"),
                                           empty.alias("upper")))
    below = descend(rounds, above.select(
        F.col("own").alias("grp"), F.lit(0).cast("bigint").alias("block"),
        F.col("witness").alias("upper"), F.col("digest").alias("subroot")))
    return below.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "witness",
        F.coalesce("bent", "digest").alias("tampered"))


def verify(manifest: DataFrame) -> DataFrame:
    """Proof digest, and whether the (perhaps tampered) leaf still leads to the root."""
    out = manifest.select("doc_id", "leaf", "subroot", "root",
                          proof(F.col("witness")).alias("proof_sha256"),
                          fold(F.col("tampered"), F.col("witness")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
