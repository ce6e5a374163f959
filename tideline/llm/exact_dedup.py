"""Exact duplicates by a persistent digest index, bucketed and sorted by hash.

The index holds one row for each different text ever seen: the SHA-256 of the
text with A-Z lower-cased, the largest document of the text and its count.  It
is a bucketed table, sorted by digest within its buckets, with a partition for
each batch.  A batch is summed up by digest first (copies of a text combine
before the shuffle), dealt out by the index's own buckets, and held against
the index by a sort-merge anti-join, for which the index is not shuffled.
What the anti-join leaves is appended.  Digests that the index has already go
to a second table of the same buckets, which raises counts and documents that
stay without rewriting the index.

A batch is written as one partition and replaces what an interrupted attempt
of the same batch left, so adding it again changes nothing.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import exists, remove, shared_folder, shuffle_partitions, written

#: Batches in which the query adds a table.
BATCHES = 2
#: A text with at least this many copies, or this share of all rows, is joined by broadcast: there are at most ``1 / HOT_SHARE`` of them.
HOT_COPIES, HOT_SHARE = 1_000, 1e-5

ORACLE_SQL = f"""
with t as (select doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) as text_sha256 from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept, text_sha256
from t window w as (partition by text_sha256)"""


def digest_of(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased and all else as it is; a null counts as empty."""
    full = F.coalesce(text, F.lit(""))
    # lower() takes whole of Unicode and is fast; where all is ASCII both are the same
    low = F.when(F.octet_length(full) == F.char_length(full), F.lower(full)).otherwise(F.translate(full, string.ascii_uppercase, string.ascii_lowercase))
    return F.unhex(F.sha2(low, 256))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, row`` of every row of ``docs``, computed once; ``row`` tells rows of one ``doc_id`` apart."""
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")))


class DigestIndex:
    """An index in a folder of a file system that driver and executors share; opening it again finds what is there, with the buckets it was made with."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root
        if exists(spark, f"{root}/buckets"):
            self.buckets = spark.read.parquet(f"{root}/buckets").first().n
        else:
            self.buckets = buckets or shuffle_partitions(spark)
            spark.range(1).select(F.lit(self.buckets).alias("n")).write.mode("ignore").parquet(f"{root}/buckets")
        self._new, self._again = self._open("digests"), self._open("repeats")

    def _open(self, part: str) -> str:
        name = f"tideline_{part}_{uuid.uuid4().hex}"
        self.spark.sql(
            f"create table {name} (digest binary, keep_id bigint, keep_row bigint, n bigint, batch string) using parquet"
            f" partitioned by (batch) clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.root}/{part}'"
        )
        if exists(self.spark, f"{self.root}/{part}"):
            self.spark.sql(f"msck repair table {name}")
        return name

    def _put(self, rows: DataFrame, part: str, table: str, batch: str) -> None:
        self.spark.sql(f"alter table {table} drop if exists partition (batch = '{batch}')")
        remove(self.spark, f"{self.root}/{part}/batch={batch}")  # what an interrupted attempt left
        rows.select("digest", "keep_id", "keep_row", "n", F.lit(batch).alias("batch")).write.insertInto(table)

    def known(self, but: str | None = None) -> DataFrame:
        """The index's digests, without those that batch ``but`` brought."""
        table = self.spark.table(self._new)
        return table if but is None else table.where(F.col("batch") != but)

    def add(self, rows: DataFrame, batch: str) -> None:
        """Add a batch of ``doc_id, digest, row`` under a name of its own.

        An empty batch adds nothing.  Of one text's rows in a batch that with
        the largest ``doc_id`` counts, then the one with the largest ``row``;
        a null ``doc_id`` is smaller than any other.
        """
        top = F.max(F.struct("doc_id", "row"))
        summed = rows.groupBy("digest").agg(top.alias("k"), F.count("*").alias("n"))
        groups = summed.select("digest", F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("keep_row"), "n").repartition(self.buckets, "digest")
        old = self.known(batch).select("digest").hint("merge")
        self._put(groups.join(old, "digest", "left_anti"), "digests", self._new, batch)
        self._put(groups.join(old, "digest", "left_semi"), "repeats", self._again, batch)

    def groups(self) -> DataFrame:
        """``digest, keep_id, keep_batch, keep_row, n`` of every text in the index; both tables are read bucket by bucket, without a shuffle."""
        rank = F.struct("keep_id", "batch", "keep_row")
        again = self.spark.table(self._again).groupBy("digest").agg(F.max(rank).alias("_k"), F.sum("n").alias("_n"))
        both = self.spark.table(self._new).select("digest", rank.alias("k"), "n").join(again.hint("merge"), "digest", "left")
        best = both.select("digest", F.greatest("k", F.coalesce("_k", "k")).alias("k"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
        return best.select("digest", "k.keep_id", F.col("k.batch").alias("keep_batch"), F.col("k.keep_row").alias("keep_row"), "n")


def joined(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """``rows`` with the columns of their digest's group.

    The rows of a text with very many copies would meet in one task, so they
    stay where they are and their group comes to them: there are at most
    ``1 / HOT_SHARE`` such groups, whatever the table's size.
    """
    limit = max(HOT_COPIES, int(total * HOT_SHARE) + 1)
    hot = F.broadcast(groups.where(F.col("n") >= limit))
    rest = rows.join(hot.select("digest"), "digest", "left_anti")
    return rows.join(hot, "digest").unionByName(rest.join(groups.where(F.col("n") < limit).hint("merge"), "digest"))


def exact_duplicates(docs: DataFrame, batches: int = BATCHES, root: str | None = None) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z; a null is
    an empty text.  Of equal texts the row with the largest ``doc_id`` stays,
    of its repeated rows exactly one.  A null ``doc_id`` is smaller than any
    other and has no ``keep_id`` unless another row of the text has one.  The
    table is added to an index in ``root`` (a new one by default) in
    ``batches`` parts, each held against those before it.  Other columns are
    not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = digests(docs).withColumn("batch", F.format_string("%06d", F.pmod(F.xxhash64("doc_id"), F.lit(batches))))
    index = DigestIndex(spark, root or f"{shared_folder(spark)}/digest-index-{uuid.uuid4().hex}")
    for k in range(batches):
        name = f"{k:06d}"
        index.add(rows.where(F.col("batch") == name), name)
    kept = (F.col("row") == F.col("keep_row")) & (F.col("batch") == F.col("keep_batch"))
    return joined(rows, index.groups(), rows.count()).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_last(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that no later document repeats; rows of one ``doc_id`` and text, and those of none, stay or go together."""
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.unhex("text_sha256").alias("_kept_text"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (digest_of(F.col("text")) == F.col("_kept_text")), "left_semi")
