"""One query per corpus operator, with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripgrid.llm import ann, counts, credentials, links, lm, mixing, packing, phrases, quality, records, sanitise, simhash, spelling
from tripgrid.llm.common import table
from tripgrid.llm.oracle import ORACLES
from tripgrid.session import own_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
__all__ = ["ORACLES", "QUERIES"]

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

RULES = (
    links.UrlRule("allow", "com"),
    links.UrlRule("block", "example.com", "/en/"),
    links.UrlRule("allow", "www.example.com", "/en/"),
    links.UrlRule("block", "net", "/es/"),
    links.UrlRule("block", "net", "/fr/"),
)

FORUMS = [f"src{i}" for i in range(10, 15)]
BOOKS = [f"src{i}" for i in range(15, 20)]
MIX = mixing.Mix(
    weights={
        ("web",): 50,
        ("forum",): 30,
        ("books",): 20,
        (..., "en"): 60,
        (..., "de"): 15,
        (..., "fr"): 15,
        (..., "es"): 10,
        (..., ..., "src0"): 8,
    }
)


def domain_of(source: Column) -> Column:
    return F.when(source.isin(FORUMS), "forum").when(source.isin(BOOKS), "books").otherwise("web")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _digest(spans: DataFrame, counted: dict[str, str], base: list[str], printed: Callable[[Column], Column]) -> DataFrame:
    """Counts by kind, the checksum of the base spans, and all spans printed."""
    of = lambda kinds: F.filter("spans", lambda p: p["kind"].isin(kinds))
    counts = [F.size(of([kind])).cast("long").alias(name) for name, kind in counted.items()]
    return spans.select("doc_id", *counts, F.sha2(printed(of(base)), 256).alias("base_sha256"), printed(F.col("spans")).alias("spans"))


@query
def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lm.score(table(spark, sf_dir, "documents"), held_out)


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed("fingerprint").alias("fingerprint"), "component_id")


@query
def op3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("domain", domain_of(F.col("source")))
    taken, copies = mixing.choose(docs, MIX)
    return taken.select("doc_id", "domain", "lang", "source", F.col(copies).alias("copies"))


@query
def op6_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = credentials.scan(table(spark, sf_dir, "documents"))
    base = ["assign", "access", "hex"]
    return _digest(spans, {f"n_{k}": k for k in base}, base, credentials.printed)


@query
def op7_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = sanitise.scan(table(spark, sf_dir, "documents"))
    base = ["email", "ip", "card", "phone"]
    return _digest(spans, {f"n_{k}": k for k in base}, base, sanitise.printed)


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality.judge(table(spark, sf_dir, "documents"), measures=digest)
    m = {c: F.col(c) for c in judged.columns}
    failed = quality.FEW_WORDS.rejects(m) | quality.REPEATS.rejects(m)
    return judged.select("doc_id", *digest, failed.alias("base_failed"), "kept")


@query
def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_path(spark, "records")
    records.write(table(spark, sf_dir, "documents"), path, TOKENIZER)
    index = records.write_index(spark, path, f"{path}-index")
    return index.select("doc_id", "start", "n_tokens", F.col("crc32").alias("ids_crc32"))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), spoil=spelling.SPOIL)
    return spelling.variants(words)


@query
def op12_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.count(table(spark, sf_dir, "documents"), TOKENIZER)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
