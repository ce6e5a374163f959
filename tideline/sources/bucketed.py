"""Tables at rest that are joined by one key again and again: bucketed by it, replaced a slice at a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.lineage import exists, remove


class Bucketed:
    """A Parquet table in a shared folder, bucketed and sorted by ``key``, a partition for each value of ``part``.

    Tables of one key and number of buckets are joined and grouped by it
    without a shuffle.  A slice is replaced as a whole: what a broken-off
    attempt left of it goes first, so writing it again counts once.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, key: str, part: str, buckets: int):
        self.spark, self.path, self.columns, self.part, self.buckets, self.key = spark, path, columns, part, buckets, key
        self.name = f"tideline_{uuid.uuid4().hex}"
        spark.sql(f"create table {self.name} ({columns}, {part} string) using parquet partitioned by ({part}) clustered by ({key}) sorted by ({key}) into {buckets} buckets location '{path}'")
        if exists(spark, path):
            spark.sql(f"msck repair table {self.name}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def replace(self, rows: DataFrame, value: str) -> None:
        """``rows`` in place of the slice ``value``; a value is letters, digits, dots, dashes and underscores."""
        if not value or not all(c.isalnum() or c in ".-_" for c in value):
            raise ValueError(f"not a name of a slice: {value!r}")
        names = [c.split()[0] for c in self.columns.split(", ")]
        self.spark.sql(f"alter table {self.name} drop if exists partition ({self.part} = '{value}')")
        remove(self.spark, f"{self.path}/{self.part}={value}")
        rows.select(*names, F.lit(value).alias(self.part)).repartition(self.buckets, self.key).write.insertInto(self.name)
