"""The corpus pipeline: toxicity, quality, near-duplicates, secrets, packing.

Each stage works on all rows its predecessor kept, read again from Parquet in
the shared folder, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.near_dedup import keep_first
from tideline.llm.packing import pack
from tideline.llm.quality import keep_good
from tideline.llm.queries import TOKENIZER, table
from tideline.llm.secrets import redact_secrets
from tideline.llm.store import exists, remove, shared_folder
from tideline.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that shares four fifths of its five-word shingles."""
    return keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of ids, lexical neighbours together."""
    return pack(docs, TOKENIZER)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: The stages with models can't be given in SQL; tests hold each against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages one after the other over ``documents``.

    With ``folder`` (in a file system that driver and executors share) a run
    goes on where an earlier one over the same tables stopped: a stage that
    was written to its end is read, not made again.  Without it the run has a
    folder of its own, and a stage's table goes when the next one is written.
    """
    docs = table(spark, sf_dir, "documents")
    root = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = ""
    for name, stage in STAGES:
        path = f"{root}/{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before and not folder:
            remove(spark, before)
        before = path
    return docs
