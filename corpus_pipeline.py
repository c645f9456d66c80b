"""Documents to packed token sequences: quality rules, near-duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next stage's documents; the last table goes when the session's Python
ends.

A null or empty text fails the quality rules, so it goes in the first stage; very long
texts stay whole. Repeated rows are near-duplicates of each other, and one of them stays;
of groups with one id several times, or with null ids, the first row stays. Null
languages and sources are leaves of their own in the mix. Extra columns, also with names
that operators use, pass every stage but the last, which returns pieces. An empty table
gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripgrid.llm import credentials, mixing, packing, quality, queries, simhash
from tripgrid.llm.common import free, table
from tripgrid.session import own_path, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, that with the smallest id."""
    return simhash.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a placeholder for every secret found; n_chars counts the new text."""
    return credentials.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of domains, languages and sources take them."""
    domain = free("domain", docs.columns)
    mix = mixing.Mix(levels=(domain, "lang", "source"), weights=queries.MIX.weights)
    return mixing.resample(docs.withColumn(domain, queries.domain_of(F.col("source"))), mix).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and places in sequences of at most 1,024 tokens."""
    return packing.pack(docs, queries.TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("mix sources", mix_sources),
    ("pack sequences", pack_sequences),
]

#: XXH64 and the tokenizer have no SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = own_path(spark, "corpus")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
