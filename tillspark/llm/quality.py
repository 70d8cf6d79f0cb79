"""Host-level quality rules with a beta prior taken from the hosts themselves.

Every document gets its rule failures. They are counted by host, each rate is
shrunk towards the corpus by a beta prior whose mean and strength come from
the spread of the host rates, and the verdict goes back to the documents.

Defined results: a null text counts as empty (no words, so the base rule
fails); a null host is no host: it gives no evidence and its documents are
judged alone; repeated rows count as often as they occur; an empty table
gives an empty result; other columns pass through untouched, whatever their
names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .common import BLANKS, fresh, quoted, text_map

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
RULES = ("short", "repeat", "symbols", "dup_lines", "word_length")


@dataclass(frozen=True)
class HostPolicy:
    """A host goes when the shrunk rate of any rule exceeds ``max_rate``.

    The prior weighs as much as ``min_strength`` to ``max_strength`` documents.
    """

    max_rate: float = 0.5
    min_strength: float = 10.0
    max_strength: float = 1000.0


def _repeated(words: list[bytes]) -> int:
    """Words inside windows of eight that occur at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n].astype(np.uint64)
    order = np.sort(mixed)
    if not (order[1:] == order[:-1]).any():
        return 0
    # Equal hashes are confirmed: ranks of pairs, then of fours, then of eights.
    rank, step = ids, 1
    while step < WINDOW:
        pair = rank[:len(rank) - step] * np.int64(len(words) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW:] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_signals(text: str | None) -> tuple[int, ...]:
    """The figures of ``SIGNALS`` for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text) - sum(map(text.count, BLANKS)),
            sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)),
            _repeated(words))


def _setup():
    def compute(texts):
        rows = [text_signals(t) for t in texts]
        return [[r[k] for r in rows] for k in range(len(SIGNALS))]
    return compute


def with_signals(docs: DataFrame, names: list[str], text: str = "text",
                 keep: bool | list[str] = True) -> DataFrame:
    return text_map(docs, text, [(n, T.LongType()) for n in names], _setup, keep)


def failures(n: dict[str, F.Column]) -> dict[str, F.Column]:
    """Each rule as a condition over the signals."""
    return {
        "short": n["n_words"] < 20,
        "repeat": 100 * n["n_repeat_words"] > 30 * n["n_words"],
        "symbols": 10 * n["n_symbols"] > n["n_words"],
        "dup_lines": 10 * n["n_dup_lines"] > 3 * n["n_lines"],
        "word_length": (n["word_chars"] < 2 * n["n_words"]) | (n["word_chars"] > 12 * n["n_words"]),
    }


def host_verdicts(counts: DataFrame, policy: HostPolicy = HostPolicy()) -> DataFrame:
    """Shrunk rate of each rule and the verdict of each host.

    ``counts`` has host, n_docs and one failure count for each rule. The prior
    is fitted by moments: the spread of host rates, weighted by documents, less
    what sampling alone would give. One row of sums goes to the driver.
    """
    def moments(rule):
        p = F.col(rule) / F.col("n_docs")
        return [F.sum(rule).alias(f"{rule}_f"), F.sum(p * F.col(rule)).alias(f"{rule}_s"),
                F.sum(p * (1 - p)).alias(f"{rule}_e")]

    row = counts.agg(F.sum("n_docs").alias("n"), *[c for r in RULES for c in moments(r)]).first()
    out = counts
    for rule in RULES:
        mean = (row[f"{rule}_f"] or 0) / row["n"] if row["n"] else 0.0
        n = row["n"] or 1
        spread = (row[f"{rule}_s"] or 0.0) / n - mean ** 2 - (row[f"{rule}_e"] or 0.0) / n
        strength = mean * (1 - mean) / spread - 1 if spread > 0 else math.inf
        strength = min(max(strength, policy.min_strength), policy.max_strength)
        out = out.withColumn(f"{rule}_rate", (F.col(rule) + F.lit(mean * strength))
                             / (F.col("n_docs") + F.lit(strength)))
    worst = F.greatest(*[F.col(f"{r}_rate") for r in RULES])
    return out.withColumn("worst_rate", worst).withColumn("rejected", worst > policy.max_rate)


def _judge(tagged: DataFrame, host: str, names: list[str], policy: HostPolicy):
    """Base verdict, and the stored host verdicts joined back."""
    sig = {s: quoted(n) for s, n in zip(SIGNALS, names, strict=True)}
    fails = failures(sig)
    counts = (tagged.where(quoted(host).isNotNull()).groupBy(quoted(host).alias("host"))
              .agg(F.count(F.lit(1)).alias("n_docs"),
                   *[F.count_if(fails[r]).alias(r) for r in RULES]))
    verdicts = stage(host_verdicts(stage(counts, "host-counts"), policy)
                     .select("host", "n_docs", "worst_rate", "rejected"), "hosts")
    h, n, rate, bad = fresh(tagged, "__host", "__host_docs", "__host_rate", "__host_rejected")
    verdicts = verdicts.toDF(h, n, rate, bad)
    joined = tagged.join(verdicts, quoted(host) == F.col(h), "left")
    base = fails["short"] | fails["repeat"]
    return joined, base, F.coalesce(F.col(bad), F.lit(False)), F.col(rate)


def judge(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text",
          policy: HostPolicy = HostPolicy()) -> DataFrame:
    """One row for each document: its signals, base result and verdict."""
    docs = docs.select(quoted(doc_id).alias("doc_id"), quoted(host).alias("host"),
                       quoted(text).alias("text"))
    tagged = stage(with_signals(docs, list(SIGNALS), keep=["doc_id", "host"]), "signals")
    joined, base, rejected, rate = _judge(tagged, "host", list(SIGNALS), policy)
    return joined.select("doc_id", *SIGNALS, base.alias("base_failed"), "host",
                         rejected.alias("host_rejected"), F.round(rate, 6).alias("host_rate"),
                         (~base & ~rejected).alias("kept"))


def keep_good(docs: DataFrame, host: str = "source", text: str = "text",
              policy: HostPolicy = HostPolicy()) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    names = fresh(docs, *SIGNALS)
    tagged = stage(with_signals(docs, names, text), "tagged")
    joined, base, rejected, _ = _judge(tagged, host, names, policy)
    return joined.where(~base & ~rejected).select(*map(quoted, docs.columns))
