"""Registered queries of the text operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, collocations, golay, jaccard, licenses, manifest, mixing, oracles, pii, quality,
    secret_scan, simhash, url_filter, warc,
)
from .common import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = dict(oracles.ORACLES)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_path() -> str:
    """The given vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_host_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(read_table(spark, sf, "documents"))


@query
def op2_semicrf_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(read_table(spark, sf, "documents", "doc_id", "text"))


@query
def op3_license_compression(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.find(read_table(spark, sf, "documents", "doc_id", "text"))


def _list_events(pages: DataFrame) -> DataFrame:
    """A dated list made of the table's own hosts, parent domains and addresses.

    The digest of a name sets when it is listed, delisted and listed again.
    """
    host = url_filter.host_of(F.col("url"))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    address = url_filter.address_of(F.col("url"))
    names = (pages.where(host != "").select(F.explode(F.array(host, domain, address)).alias("key"))
             .where("key != ''").distinct())
    number = lambda at: F.conv(F.substring(F.md5("key"), at, 4), 16, 10).cast("long")
    first = F.lit(1_704_067_200) + F.pmod(number(1), F.lit(300)) * 86_400
    stay = (1 + F.pmod(number(5), F.lit(60))) * 86_400
    events = F.array(F.struct(first.alias("at"), F.lit(True).alias("listed")),
                     F.struct((first + stay).alias("at"), F.lit(False).alias("listed")),
                     F.struct((first + 2 * stay).alias("at"), F.lit(True).alias("listed")))
    return names.select("key", F.explode(events).alias("e")).select(
        "key", F.timestamp_seconds("e.at").alias("time"), "e.listed")


@query
def op4_dated_url_list(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages", "page_id", "url")
    minute = F.pmod(F.col("page_id") * 7, F.lit(525_600))
    captures = pages.withColumn("fetched", F.timestamp_seconds(1_704_067_200 + 60 * minute))
    return url_filter.judge(captures, _list_events(pages))


@query
def op5_markov_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.find(read_table(spark, sf, "documents", "doc_id", "text"))


@query
def op6_chosen_path_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf, "documents", "doc_id", "text"))


@query
def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.compare_edits(read_table(spark, sf, "documents", "doc_id", "text"))


@query
def op8_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents", "doc_id", "source", "text")
    return mixing.mix(mixing.sizes(docs)).select(
        "doc_id", "size", "source_size", "target", "taken")


@query
def op9_warc_index(spark: SparkSession, sf: str) -> DataFrame:
    merged = warc.archive_pages(read_table(spark, sf, "pages", "page_id", "url", "html"))
    # The names of the archives, and so the places in them, are new in each run.
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type",
                         "refers_to", "url_key", "time", "verified")


@query
def op10_lexicon_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf, "documents", "doc_id", "text"), vocabulary_path())


@query
def op11_golay_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return golay.near_duplicates(read_table(spark, sf, "documents", "doc_id", "text"))


@query
def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.verify(manifest.build(read_table(spark, sf, "documents")))


@query
def op13_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf, "documents", "lang", "text"))
