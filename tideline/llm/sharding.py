"""Two-pass external shuffle into shards, in DataFrame functions only.

First pass: a seeded hash of ``doc_id`` chooses the shard (highest random
weight, so one more shard takes rows only into itself), and another scatters
the shard's records uniformly over buckets that fit in memory, counted by rows
and bytes.  Second pass: each bucket is put in the order of a Fisher-Yates shuffle.  The permutation is
drawn once for each bucket, in the bucket's own task, from its size and its
own seeded hashes; records keep streaming and are never gathered in an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import shuffle_partitions, written

#: Records and bytes of text a bucket holds on average, at most.
BUCKET_ROWS, BUCKET_BYTES = 256, 1 << 22
SEED = 1_729
#: Buckets a record's repeats may fill before they are spread.
REPEATED_BUCKETS = 4
#: Buckets a task works through, at most on average.
TASK_BUCKETS = 128


def _weight(shard: int) -> Column:
    return F.xxhash64(F.lit(SEED), F.lit(shard), "doc_id")


def shard_of(shards: int) -> Column:
    """The shard with the highest weight for the row's ``doc_id``; decided by it and by ``shards`` alone."""
    weights = [_weight(s) for s in range(shards)]
    top = F.greatest(*weights) if shards > 1 else weights[0]
    return (F.array_position(F.array(*weights), top) - 1).cast("int")


def fisher_yates(size: Column, *key: Column) -> Column:
    """A permutation of ``0 .. size - 1``: for i from the last down, place i changes with a drawn place at or before it."""

    def swap(places: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(SEED), *key, i), (i + 1).cast("long")).cast("int")
        a, b = F.get(places, i), F.get(places, j)
        moved = F.concat(
            F.slice(places, F.lit(1), j),
            F.array(a),
            F.slice(places, j + 2, i - j - 1),
            F.array(b),
            F.slice(places, i + 2, F.size(places) - i - 1),
        )
        return F.when(i == j, places).otherwise(moved)

    start = F.sequence(F.lit(0), size - 1)
    steps = F.when(size > 1, F.sequence(size - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, swap)


def _salted(keyed: DataFrame, bucket_rows: int) -> DataFrame:
    """``_salt``: 0, but for records repeated more than ``REPEATED_BUCKETS * bucket_rows`` times a hash of the record's number.

    Repeats are counted exactly, by key, whatever the size of the table.  The
    keys above the limit are written; Spark broadcasts them by the size of
    what was written, or sorts both sides and splits the hot ones.  Only where
    there are some the records are kept, as their numbers must be the same
    when they are counted and when they are placed.
    """
    seen = keyed.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > REPEATED_BUCKETS * bucket_rows)
    often = written(seen.select("_key", F.ceil(F.col("_n") / bucket_rows).alias("_parts")))
    if often.isEmpty():
        return keyed.withColumns({"_salt": F.lit(0).cast("long"), "_row": F.lit(0).cast("long")})
    numbered = written(keyed.withColumn("_row", F.monotonically_increasing_id())).join(often, "_key", "left")
    salt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(F.lit(SEED + 2), "_row"), "_parts")).otherwise(F.lit(0).cast("long"))
    return numbered.withColumn("_salt", salt).drop("_parts")


def sharded(docs: DataFrame, shards: int, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``docs`` with ``shard``, ``grown_shard`` (with one shard more) and ``slot`` (gapless in its shard).

    The law is ``key``: ``doc_id`` and the number of shards decide the shard.
    All columns travel with their row; one that has the name of a column made
    here comes back as ``input_<name>``.  A shard has as many buckets as its
    own records and bytes need.  A record goes to a bucket by ``doc_id`` and
    text, so that the order does not depend on how the input is stored; a
    record repeated more than four buckets' rows goes to as many buckets as it fills.  A null
    ``doc_id`` is a key like any other, a null text is an empty one; an empty
    table gives an empty result.
    """
    made = {"shard", "grown_shard", "slot"}
    content = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.withColumnsRenamed({c: f"input_{c}" for c in docs.columns if c in made})
    keyed = plain.withColumns({"shard": shard_of(shards), "grown_shard": shard_of(shards + 1), "_key": F.xxhash64(F.lit(SEED + 1), "doc_id", content)})
    buckets = [1] * shards  # of each shard
    for shard, n, size in keyed.groupBy("shard").agg(F.count("*"), F.sum(F.octet_length(content))).collect():
        buckets[shard] = max(1, -(-n // bucket_rows), -(-size // bucket_bytes))
    tasks = max(shuffle_partitions(docs.sparkSession), sum(buckets) // TASK_BUCKETS)
    own = F.get(F.lit(buckets), F.col("shard")).cast("long")
    scattered = _salted(keyed, bucket_rows).withColumn("_bucket", F.pmod(F.xxhash64("_key", "_salt"), own).cast("int"))
    sizes = scattered.groupBy("shard", "_bucket").agg(F.count("*").cast("int").alias("_size"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("_first", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    # drawn where the bucket is, not where its shard was summed up
    drawn = first.repartition(tasks, "shard", "_bucket").withColumn("_places", fisher_yates(F.col("_size"), F.col("shard"), F.col("_bucket")))
    # equal rows beyond doc_id and text follow each other in no order that could be told
    inside = Window.partitionBy("shard", "_bucket").orderBy(F.asc_nulls_first("doc_id"), content, "_row")
    placed = scattered.repartition(tasks, "shard", "_bucket").withColumn("_at", F.row_number().over(inside) - 1)
    return (
        placed.join(drawn.select("shard", "_bucket", "_first", "_places"), ["shard", "_bucket"])
        .withColumn("slot", F.col("_first") + F.get("_places", F.col("_at")))
        .select(*plain.columns, "shard", "grown_shard", "slot")
    )


def write_shards(docs: DataFrame, shards: int, path: str) -> None:
    """The second pass written out: one folder for each shard, rows in the order of their slots within each file.

    Files of a shard hold ranges of slots, in the order of their names.  A
    column named ``shard``, ``slot`` or ``grown_shard`` is renamed as in
    :func:`sharded`; an empty table writes no shard.
    """
    sharded(docs, shards).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(placed: DataFrame) -> DataFrame:
    """Size and checksum of each placed record of :func:`sharded`; a null text counts as an empty one."""
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return placed.select(
        "doc_id",
        (F.length(content) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        "grown_shard",
    )
