"""Secrets by fixed rules and two character Markov models, in SQL only.

The rules find assignments, access keys and hexadecimal strings. Two models of
character pairs are trained from labelled samples: random strings are the
values that the rules mark in all texts, ordinary identifiers are the words of
a bounded sample of documents without such marks, and those words joined as
snake_case and CamelCase names. A fifth of each sample is held out. A token of
``SHORTEST`` characters or more outside the rules' spans is added when its
mean log-likelihood ratio a pair reaches the cut that the held-out samples
give: above all but a hundredth of the ordinary windows of the shortest length.

Every step is linear in the text, in its matches and in a token's length, but
for offsets carried from chunk to chunk of ``CHUNK`` matches.

Defined results: a null text counts as empty and has no spans; the empty list
of spans is the empty string; repeated rows are read each; without marked
values or ordinary words nothing is added; an empty table gives an empty
result; ``redact`` leaves other columns as they are and a null text null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import fresh, quoted

KINDS = ("assign", "access", "hex", "random")
ASSIGN = (r"(?i:pass(?:word|wd)|secret|token|api_?key)[\x22']?\x20*[:=]\x20*[\x22']?"
          r"([A-Za-z0-9+/_.=-]++)")
#: A failing match covers no start of a match that would do, so the length
#: can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}+"
SHORTEST = 16
#: Share of held-out ordinary windows that the cut may let through.
PASSED = 0.01
#: Least mean log ratio a pair, whatever the samples say.
LEAST_RATIO = 0.25
#: Matches over which a running figure is carried at one time.
CHUNK = 256
#: Characters of the pieces from which redaction takes its gaps.
PIECE = 4096
#: Bound of the sample of ordinary identifiers, in documents.
SAMPLE_DOCS = 1000

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, value, merge, zero: Column) -> Column:
    """For each item the merged values of all items before it.

    Growing an array copies it, so the items are taken in chunks: the totals
    of the chunks give where each starts.
    """
    def grow(start: Column, over: Column, worth) -> Column:
        return F.aggregate(over, F.array(start), lambda done, x: F.concat(
            done, F.array(merge(F.element_at(done, -1), worth(x)))))

    def of_chunks(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda ch: F.aggregate(
            ch, zero, lambda done, x: merge(done, value(x))))
        starts = F.slice(grow(zero, totals, lambda t: t), F.lit(1), F.size(chunks))
        return F.flatten(F.zip_with(chunks, starts, lambda ch, start: F.slice(
            grow(start, ch, value), F.lit(1), F.size(ch))))

    return let(items, lambda held: let(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(held) - 1) / CHUNK).cast("int")),
        lambda c: F.slice(held, c * CHUNK + 1, F.lit(CHUNK))), of_chunks))


def _found(text: Column, pattern: str, kind: int, shortest: int = 0) -> Column:
    """Matches as (start, kind, end, value) in code points.

    The pieces between the matches give the positions: no native function
    returns them. Only texts with a match get beyond the first test.
    """
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    value = F.regexp_extract_all(text, F.lit(f"({pattern})"), 2) if shortest else F.lit(None)

    def sized(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        rows = F.arrays_zip(found.alias("whole"), gaps.alias("gap"),
                            (value if shortest else found).alias("value"))
        return F.transform(rows, lambda m: F.struct(
            F.length(m["gap"]).cast("bigint").alias("gap"),
            F.length(m["whole"]).cast("bigint").alias("size"), m["value"].alias("value")))

    def placed(rows: Column) -> Column:
        before = running(rows, lambda m: m["gap"] + m["size"], lambda a, b: a + b,
                         F.lit(0).cast("bigint"))
        return F.zip_with(rows, before, lambda m, at: F.struct(
            (at + m["gap"]).alias("start"), F.lit(kind).alias("kind"),
            (at + m["gap"] + m["size"]).alias("end"), m["value"].alias("value")))

    spans = let(let(whole, sized), placed).cast(_SPAN)
    if shortest:
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= shortest)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def _among(base: Column, tokens: Column, free: bool) -> Column:
    """Tokens that meet no base span, or those that meet one.

    In order of their starts, a token meets one before it that ends later than
    it starts, or the very next one, as tokens don't meet each other.
    """
    def picked(every: Column) -> Column:
        before = running(every, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(
            F.lit(0).cast("bigint")), F.greatest, F.lit(0).cast("bigint"))
        rows = F.arrays_zip(every.alias("own"), before.alias("before"),
                            F.slice(every, F.lit(2), F.size(every)).alias("next"))
        meets = lambda r: ((r["before"] > r["own"]["start"])
                           | F.coalesce((r["next"]["kind"] < 3)
                                        & (r["next"]["start"] < r["own"]["end"]), F.lit(False)))
        return F.transform(F.filter(rows, lambda r: (r["own"]["kind"] == 3) & (
            ~meets(r) if free else meets(r))), lambda r: r["own"])

    return (F.when(F.size(tokens) == 0, tokens)
            .when(F.size(base) == 0, tokens if free else F.array().cast(_SPAN))
            .otherwise(let(F.array_sort(F.concat(base, tokens)), picked)))


def marked(docs: DataFrame, text: str, base: str, tokens: str) -> DataFrame:
    """``docs`` with the base spans and the candidate tokens outside them."""
    body = F.coalesce(quoted(text), F.lit(""))
    spans = F.concat(_found(body, ASSIGN, 0, 6), _found(body, ACCESS, 1), _found(body, HEX, 2))
    return docs.withColumn(base, F.array_sort(spans)).withColumn(tokens, _found(body, TOKEN, 3))


def _neighbours(value: Column) -> Column:
    """Places in the alphabet, from 1, of each two neighbouring characters; 0 for others."""
    places = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(places, lambda p: F.arrays_zip(
        F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))).alias("a"),
        F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))).alias("b")))


def ratios(values: DataFrame, ordinary: DataFrame) -> list[float]:
    """Log ratio of each character pair, random over ordinary.

    ``values`` and ``ordinary`` have one string column ``value``. One row for
    each pair of the alphabet, at most, comes to the driver. One is added to each
    count.
    """
    size = len(ALPHABET)
    both = values.select("value", F.lit(0).alias("model")).union(
        ordinary.select("value", F.lit(1).alias("model")))
    rows = (both.where(F.length("value") >= 2)
            .select("model", F.explode(_neighbours(F.col("value"))).alias("p"))
            .where("p.a > 0 and p.b > 0").groupBy("model", "p.a", "p.b")
            .agg(F.count(F.lit(1)).alias("n")).collect())
    counts = {(r.model, r.a, r.b): r.n for r in rows}
    out = []
    for a in range(1, size + 1):
        total = [sum(counts.get((m, a, b), 0) for b in range(1, size + 1)) for m in (0, 1)]
        for b in range(1, size + 1):
            chance = [(counts.get((m, a, b), 0) + 1) / (total[m] + size) for m in (0, 1)]
            out.append(math.log(chance[0]) - math.log(chance[1]))
    return out


def score(value: Column, table: list[float]) -> Column:
    """Mean of the pairs' log ratios along a token of the alphabet."""
    known = F.split(F.lit(",".join(f"{x:.9g}" for x in table)), ",").cast("array<double>")
    pairs = F.filter(_neighbours(value), lambda p: (p["a"] > 0) & (p["b"] > 0))
    return let(pairs, lambda held: F.aggregate(held, F.lit(0.0), lambda done, p: done + F.element_at(
        known, (p["a"] - 1) * len(ALPHABET) + p["b"])) / F.greatest(F.size(held), F.lit(1)))


def cut_of(values: DataFrame, ordinary: DataFrame, table: list[float]) -> float:
    """The mean log ratio from which a token counts as random.

    All but ``PASSED`` of the ordinary windows of ``SHORTEST`` characters lie
    below; if the random ones lie wholly above, the middle between both.
    """
    windows = F.regexp_extract_all("value", F.lit(f"(.{{{SHORTEST}}})"), 1)
    high = (ordinary.select(F.explode(windows).alias("value")).select(score(
        F.col("value"), table).alias("s")).agg(F.percentile_approx("s", 1 - PASSED, 10_000))
        .first()[0])
    low = (values.where(F.length("value") >= SHORTEST).select(score(
        F.col("value"), table).alias("s")).agg(F.percentile_approx("s", 0.01, 10_000)).first()[0])
    if high is None or low is None:
        return math.inf
    return max(high, (high + low) / 2, LEAST_RATIO)


def learn(docs: DataFrame, found: DataFrame, text: str, base: str, tokens: str,
          sample: int = SAMPLE_DOCS) -> tuple[list[float], float]:
    """Train both models and set the cut.

    ``found`` is stored. Random strings are its tokens inside base spans, all
    of them. Ordinary names come from the documents without base spans among
    the ``sample`` texts of least hash; the bound is fixed.
    """
    inside = _among(F.col(base), F.col(tokens), free=False)
    bare = F.transform(inside, lambda t: F.regexp_replace(t["value"], "^[A-Za-z_]+=+", ""))
    values = found.where(F.size(base) > 0).select(F.explode(bare).alias("value"))
    body = quoted(text)
    clean = ~(body.rlike(ASSIGN) | body.rlike(ACCESS) | body.rlike(HEX))
    few = (docs.where(body.isNotNull()).select(F.xxhash64(body).alias("h")).distinct()
           .orderBy("h").limit(sample))
    least = [r.h for r in few.collect()]
    words = F.regexp_extract_all(body, F.lit("([A-Za-z0-9]{3,})"), 1)
    names = F.array(F.array_join(words, "_"), F.array_join(F.transform(words, F.initcap), ""),
                    F.array_join(words, "-"))
    ordinary = (docs.where(F.xxhash64(body).isin(least) & clean) if least else docs.limit(0)
                ).select(F.explode(names).alias("value"))
    fifth = F.pmod(F.xxhash64("value", F.lit("held out")), F.lit(5)) == 0
    table = ratios(values.where(~fifth), ordinary.where(~fifth))
    return table, cut_of(values.where(fifth), ordinary.where(fifth), table)


def _added(base: str, tokens: str, model: tuple[list[float], float]) -> Column:
    table, cut = model
    if not math.isfinite(cut):
        return F.array().cast(_SPAN)
    return F.filter(_among(F.col(base), F.col(tokens), free=True),
                    lambda t: score(t["value"], table) >= cut)


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         sample: int = SAMPLE_DOCS) -> DataFrame:
    """Counts of base spans, their digest, all spans, and how many were added."""
    docs = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    found = stage(marked(docs, "text", "base", "tokens").drop("text"), "marked")
    model = learn(docs, found, "text", "base", "tokens", sample)
    out = found.withColumn("more", F.when(F.size("tokens") > 0, _added("base", "tokens", model))
                           .otherwise(F.array().cast(_SPAN)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.array_sort(F.concat("base", "more"))).alias("spans"),
        F.size("more").cast("long").alias("n_random"))


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars",
           mark: str = "[SECRET]", sample: int = SAMPLE_DOCS) -> DataFrame:
    """Every secret replaced by ``mark``; ``length`` is counted anew if present."""
    base, tokens, spans = fresh(docs, "__base", "__tokens", "__spans")
    found = stage(marked(docs, text, base, tokens), "marked-texts")
    model = learn(docs, found, text, base, tokens, sample)
    every = F.array_sort(F.concat(F.col(base), F.when(
        F.size(tokens) > 0, _added(base, tokens, model)).otherwise(F.array().cast(_SPAN))))
    body = F.col(spans + "_text")
    pieces = F.regexp_extract_all(body, F.lit(f"((?s).{{1,{PIECE}}})"), 1)

    def gap(held: Column, low: Column, high: Column) -> Column:
        """Characters from ``low`` to before ``high``, out of the pieces that hold them."""
        first, last = F.floor(low / PIECE).cast("int"), F.floor(high / PIECE).cast("int")
        whole = F.array_join(F.slice(held, first + 1, last - first + 1), "")
        return F.substring(whole, (low % PIECE + 1).cast("int"), (high - low).cast("int"))

    def gaps(ends: Column) -> Column:
        before = running(ends, lambda s: s["end"], F.greatest, F.lit(0).cast("bigint"))
        return F.filter(F.zip_with(ends, before, lambda s, at: F.struct(
            at.alias("low"), s["start"].alias("high"))), lambda g: g["high"] >= g["low"])

    close = F.struct(F.length(body).cast("bigint").alias("start"),
                     F.length(body).cast("bigint").alias("end"))
    ends = F.concat(F.transform(F.col(spans), lambda s: F.struct(s["start"], s["end"])),
                    F.array(close))
    joined = let(pieces, lambda held: F.array_join(
        F.transform(let(ends, gaps), lambda g: gap(held, g["low"], g["high"])), mark))
    clean = F.when(F.size(spans) == 0, body).otherwise(joined)
    out = (found.withColumn(spans, every).withColumn(spans + "_text", quoted(text))
           .withColumn(spans + "_clean", clean))
    new = {text: F.col(spans + "_clean")}
    if length in docs.columns:
        new[length] = F.length(spans + "_clean").cast(docs.schema[length].dataType)
    return out.select(*[new.get(c, quoted(c)).alias(c) for c in docs.columns])
