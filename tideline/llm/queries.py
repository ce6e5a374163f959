"""The thin queries that apply each text operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .exact_dedup import ORACLE_SQL as DEDUP_SQL
from .exact_dedup import exact_duplicates
from .hard_negatives import ORACLE_SQL as NEGATIVES_SQL
from .hard_negatives import hard_negatives
from .kmeans import cluster
from .kmeans import oracle_sql as kmeans_sql
from .licenses import scan as scan_licenses
from .licenses import with_paths
from .near_dedup import near_duplicates
from .packing import pack
from .quality import judge
from .secrets import digest, find_secrets
from .quotes import ORACLE_SQL as QUOTES_SQL
from .quotes import REPLIES_SQL, link_quotes, with_replies
from .quotes import oracle_sql as quotes_sql
from .sharding import digest as sharding_digest
from .sharding import sharded
from .toxicity import toxicity
from .winnowing import digest as winnowing_digest
from .winnowing import fingerprints

#: Tokenizer file of the queries, on every machine.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document, its own or that of its directory; where the table has no paths, digits of the id stand for directories."""
    return scan_licenses(with_paths(table(spark, sf_dir, "documents")))


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without quotes, every message with what it replies to."""
    return link_quotes(table(spark, sf_dir, "conversations"))


def replies_with_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over conversations in which every third message quotes those before it, as the table has no quote."""
    return link_quotes(with_replies(table(spark, sf_dir, "conversations")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and likelihood verdict of every document."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return winnowing_digest(fingerprints(table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels outside the held-out fold."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with similar sets of three-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, part=85, whole=100)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document after a two-pass shuffle into 16 shards."""
    return sharding_digest(sharded(table(spark, sf_dir, "documents"), 16))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    out = encode_decode(table(spark, sf_dir, "documents"), TOKENIZER)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, as counts and text."""
    return digest(find_secrets(table(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 ids, lexical neighbours together."""
    return pack(table(spark, sf_dir, "documents"), TOKENIZER).drop("ids")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive, by searches of key intervals around pivots."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every usable vector after ten rounds over all of them."""
    return cluster(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for every document, by a digest index to which the table is added in two batches."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_licenses": op1_licenses,
        "op2_quotes": op2_quotes,
        "replies_with_quotes": replies_with_quotes,
        "op3_quality_rules": op3_quality_rules,
        "op4_winnowing": op4_winnowing,
        "op5_toxicity": op5_toxicity,
        "op6_near_dedup": op6_near_dedup,
        "op7_sharding": op7_sharding,
        "op8_bpe": op8_bpe,
        "op9_secrets": op9_secrets,
        "op10_packing": op10_packing,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_kmeans": op12_kmeans,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quotes": QUOTES_SQL, "replies_with_quotes": quotes_sql(REPLIES_SQL), "op11_hard_negatives": NEGATIVES_SQL, "op12_kmeans": kmeans_sql(), "op13_exact_dedup": DEDUP_SQL}
