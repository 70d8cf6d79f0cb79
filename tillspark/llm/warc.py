"""WARC archives with revisit records, and a merged index of their captures.

Pages become WARC records: of equal payloads the one of least page id is a
response, the others revisit it. Each archive read back gives a run of
captures sorted by URL key and time. The runs are cut into ranges of the key
and every range merges its pieces of all runs with a loser tree, so the ranges
in order hold the capture history of each URL in global order.

Defined results: a null page counts as empty; a null URL has the empty key; a
null id sorts last and is written as no id; rows that repeat an id and its
payload are one response and revisits of it; an empty table gives no archive
and an empty index; only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_path, stage
from .common import quoted, ship

VERSION = "WARC/1.1"
END = "\r\n"
#: Most bytes of payload in an archive; a larger record has one of its own.
ARCHIVE_BYTES = 4000 * 65_536
#: Pages are archived by size, up to each of these bytes and beyond, so that a
#: number of records, which is what Spark's writer can bound, bounds the bytes.
SIZE_LIMITS = (65_536, 16 * 65_536, 256 * 65_536)
#: Bytes of captures that one range merges, and the most ranges: beyond their
#: product (80 GB of captures) the ranges grow.
RANGE_BYTES = 4 << 20
MOST_RANGES = 20_000


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 5 hex digits are 4 of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_responses(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add record_type and refers_to to page_id, url, html.

    Only digests that occur more than once are stored and joined; Spark
    broadcasts them when their stored size allows it.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    seen = pages.select(F.col("page_id"), F.xxhash64("url").alias("h"),
                        payload_digest(body).alias("digest"), F.octet_length(body).alias("n"))
    order = F.struct(F.col("page_id").isNull().alias("unknown"), F.col("page_id").alias("page_id"),
                     F.col("h").alias("h"))
    shared = stage(seen.where(F.col("n") >= least_bytes).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_pages"), F.min(order).alias("first"))
        .where("n_pages > 1").select("digest", "first"), "shared-payloads")
    shared = shared.select(F.col("digest").alias("d"), "first")
    out = (pages.withColumn("digest", payload_digest(body))
           .withColumn("url_hash", F.xxhash64("url"))
           .join(shared, F.col("digest") == F.col("d"), "left"))
    mine = (F.col("page_id").eqNullSafe(F.col("first.page_id"))
            & (F.col("url_hash") == F.col("first.h")))
    # Rows that repeat the first one wholly: one of them, by number, is the response.
    twin = F.row_number().over(Window.partitionBy("digest", "page_id", "url_hash")
                               .orderBy(F.lit(0)))
    same = out.where(F.col("first").isNotNull() & mine).withColumn("twin", twin)
    rest = out.where(~(F.col("first").isNotNull() & mine)).withColumn("twin", F.lit(0))
    return (same.unionByName(rest)
            .withColumn("record_type", F.when(F.col("first").isNull() | (F.col("twin") == 1),
                                              "response").otherwise("revisit"))
            .withColumn("refers_to", F.when(F.col("record_type") == "revisit",
                                            F.col("first.page_id")))
            .drop("d", "first", "twin", "url_hash"))


def _line(name: str, value: Column) -> Column:
    """A header line, left out when the value is null; control characters escaped."""
    text = F.regexp_replace(value.cast("string"), "[\\r\\n]", "%0A")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), text, F.lit(END)))


def records(pages: DataFrame, date: Column) -> DataFrame:
    """One column ``record``: the whole WARC record as text."""
    html = F.coalesce(F.col("html"), F.lit(""))
    block = F.when(F.col("record_type") == "response", html).otherwise("")
    urn = lambda c: F.when(c.isNotNull(), F.concat(F.lit("<urn:page:"), c, F.lit(">")))
    head = F.concat_ws(
        "", F.lit(VERSION + END), _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", urn(F.col("page_id").cast("string"))),
        _line("WARC-Refers-To", urn(F.col("refers_to").cast("string"))),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-Date", date),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("Payload-Length", F.octet_length(html)),
        _line("Content-Length", F.octet_length(block)))
    return pages.select(F.concat(head, F.lit(END), block).alias("record"))


def size_class(limits: Sequence[int] = SIZE_LIMITS) -> Column:
    """Place of a page's bytes among ``limits``."""
    n = F.coalesce(F.octet_length("html"), F.lit(0))
    return sum(((n > limit).cast("int") for limit in limits), F.lit(0))


def write_archives(pages: DataFrame, path: str, date: Column | None = None,
                   least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
                   limits: Sequence[int] = SIZE_LIMITS) -> None:
    """Write page_id, url, html as gzipped WARC files through Spark's writer.

    Equal payloads have one size, hence one folder of ``path``. Without ``date``
    a capture's time is 2024-01-01 plus its id in seconds.
    """
    if date is None:
        date = F.date_format(F.timestamp_seconds(
            F.lit(1_704_067_200) + F.coalesce(F.col("page_id"), F.lit(0))),
            "yyyy-MM-dd'T'HH:mm:ss'Z'")
    found = {r[0] for r in pages.select(size_class(limits)).distinct().collect()}
    marked = with_responses(pages, least_bytes)
    for k in sorted(found | {0}):
        most = archive_bytes // limits[k] if k < len(limits) else 1
        (records(marked.where(size_class(limits) == k), date)
         .write.mode("overwrite").option("lineSep", END * 2).option("compression", "gzip")
         .option("maxRecordsPerFile", max(1, most)).text(f"{path}/size-{k}"))


# ---- reading -------------------------------------------------------------------

def url_key(url: str | None) -> str:
    """Sort key of a URL: host turned round, no scheme, no www, no fragment."""
    try:
        u = urlsplit(url or "")
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url or ""
    query = f"?{u.query}" if u.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/") + query if host else url or ""


_HEADER = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """Headers, offset and payload start of each record; by lengths only."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at) + 4
        headers = {k.decode(): v.decode("utf-8", "surrogatepass")
                   for k, v in _HEADER.findall(data, at, head_end - 2)}
        yield headers, at, head_end
        at = head_end + int(headers["Content-Length"]) + 4


def _urn(value: str | None) -> int | None:
    return int(value[len("<urn:page:"):-1]) if value else None


_CAPTURE = pa.schema([
    ("url_key", pa.string()), ("time", pa.string()), ("page_id", pa.int64()),
    ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()),
    ("offset", pa.int64()), ("verified", pa.bool_())])
_CAPTURE_SQL = ("url_key string, time string, page_id bigint, url string, payload_bytes bigint, "
                "payload_digest string, record_type string, refers_to bigint, archive string, "
                "offset bigint, verified boolean")


def capture_order(row: Sequence) -> tuple:
    """URL key, time, id (none last), then the place in the archives."""
    return (row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9])


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of each archive, one sorted run for each."""
    for batch in batches:
        for path, content in zip(*(batch.column(k) for k in (0, 1)), strict=True):
            name = path.as_py().rsplit("/", 1)[-1]
            data = gzip.decompress(content.as_py())
            rows = []
            for h, at, start in parse(data):
                payload = data[start:start + int(h["Content-Length"])]
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                response = h["WARC-Type"] == "response"
                rows.append((url_key(h.get("WARC-Target-URI")), h["WARC-Date"],
                             _urn(h.get("WARC-Record-ID")), h.get("WARC-Target-URI"),
                             int(h["Payload-Length"]), own if response else digest,
                             h["WARC-Type"], _urn(h.get("WARC-Refers-To")), name, at,
                             own == digest if response else not payload))
            rows.sort(key=capture_order)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_CAPTURE)],
                schema=_CAPTURE)


class LoserTree:
    """Merge of k sorted lists; each output costs one path of comparisons."""

    def __init__(self, lists: list[list], key):
        self.lists, self.key = lists, key
        self.at = [0] * len(lists)
        self.heads = [key(x[0]) if x else None for x in lists]
        self.tree = [-1] * len(lists)
        for k in range(len(lists)):
            self._play(k)

    def _before(self, a: int, b: int) -> bool:
        """Whether list a's head goes first; spent lists last, ties by number."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or x == y and a < b

    def _play(self, player: int) -> None:
        """From the leaf up: the loser stays at a node, the winner goes on."""
        node = (player + len(self.lists)) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = player
                return
            if self._before(other, player):
                self.tree[node], player = player, other
            node //= 2
        self.tree[0] = player

    def __iter__(self):
        while self.lists and self.heads[top := self.tree[0]] is not None:
            at = self.at[top]
            yield self.lists[top][at]
            self.at[top] = at = at + 1
            more = at < len(self.lists[top])
            self.heads[top] = self.key(self.lists[top][at]) if more else None
            self._play(top)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of one range; rows come run after run, each in order."""
    runs: dict[str, list] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(row[8], []).append(row)
    out = []
    for row in LoserTree([runs[k] for k in sorted(runs)], capture_order):
        out.append(row)
        if len(out) == 5000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_CAPTURE)], schema=_CAPTURE)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives, stored with each archive's run in order."""
    ship(spark)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .load(path).select("path", "content"))
    return stage(files.mapInArrow(_captures, _CAPTURE_SQL), "runs")


def merge_runs(runs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All captures in global order of (url_key, time, page_id).

    The ranges are cut by key, time and id, so one URL with very many captures
    spreads over several; a range holds about ``range_bytes`` of captures.
    """
    ship(runs.sparkSession)
    width = 200 + sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in ("url", "url_key"))
    size = runs.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    parts = min(MOST_RANGES, max(1, -(-size // range_bytes)))
    keys = ["url_key", "time", F.col("page_id").asc_nulls_last()]
    return (runs.repartitionByRange(parts, *keys)
            .sortWithinPartitions("archive", *keys, "offset")
            .mapInArrow(_merge, _CAPTURE_SQL))


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url",
                  html: str = "html", path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write the pages, read the archives back, and return the merged index."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    plain = pages.select(quoted(page_id).alias("page_id"), quoted(url).alias("url"),
                         quoted(html).alias("html"))
    write_archives(plain, path, least_bytes=least_bytes)
    return merge_runs(read_runs(spark, path))
