"""Keeping intermediate tables in the shared folder, and the number of shuffle partitions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tideline.sources.lineage import cut, exists, remove, shared_folder, written

__all__ = ["cut", "exists", "remove", "shared_folder", "shuffle_partitions", "written"]


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

