"""Tables at rest: append, upsert, update, replace, and publishing of snapshots.

Each change is a pure function of two frames, so it is tested and planned like
a query; the writers apply it to a Parquet folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def known(df: DataFrame) -> DataFrame:
    """Not-a-number and infinities become NULL, as at rest there are none."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*(F.when(~bad(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def coerce(df: DataFrame, schema: T.StructType, drop_unknown: bool = False) -> DataFrame:
    """``df`` in a table's columns and types; what can't be cast is NULL. Unknown columns are an error, or dropped."""
    names = {f.name for f in schema.fields}
    unknown = [c for c in df.columns if c not in names]
    if unknown and not drop_unknown:
        raise ValueError(f"unknown columns: {unknown}")
    have = set(df.columns)
    cast = lambda f: F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
    return known(df.select(*(cast(f).alias(f.name) for f in schema.fields)))


def last_of(batch: DataFrame, keys: list[str], order: str | Column | None = None) -> DataFrame:
    """The last row of each key by ``order``; without one, in the order in which the rows stand."""
    if order is None:
        batch = batch.withColumn("_at", F.monotonically_increasing_id())
        return last_of(batch, keys, "_at").drop("_at")
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if isinstance(order, str) else order.desc())
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _match(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"o.{k}") == F.col(f"n.{k}")
    return out


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new`` in its columns and types; an unknown column is an error."""
    return old.unionByName(coerce(new, old.schema))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None, order: str | Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key.

    ``update`` names the columns a match overwrites (all by default); with none
    of them rows are only added where the key is absent.  Of several rows of a
    key in ``new`` the last one counts, by ``order`` or as they stand.
    """
    columns = old.columns
    new = last_of(new, keys, order).select(*new.columns)
    update = [c for c in columns if c not in keys and c in new.columns] if update is None else update
    if not update:
        return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True).select(*columns)
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    both = o.join(n, _match(keys), "full_outer")
    pick = lambda c: (
        F.coalesce(f"o.{c}", f"n.{c}")
        if c in keys
        else F.when(F.col("_n") & (F.lit(c in update) | F.col("_o").isNull()), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        if c in new.columns
        else F.col(f"o.{c}")
    )
    return both.select(*(pick(c).alias(c) for c in columns))


def update_from(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the other columns of ``new`` where keys match; a NULL in ``new`` overwrites too."""
    values = [c for c in new.columns if c not in keys]
    o, n = old.alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    joined = o.join(n, _match(keys), "left")
    return joined.select(*(F.when(F.col("_n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in values else F.col(f"o.{c}") for c in old.columns))


def replace_where(old: DataFrame, new: DataFrame, condition: Column) -> DataFrame:
    """``old`` without the slice, with ``new`` in its place."""
    return old.where(~F.coalesce(condition, F.lit(False))).unionByName(new.select(*old.columns))


def write_slices(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def publish(spark: SparkSession, root: str, week: str, frames: dict[str, DataFrame], run: DataFrame) -> None:
    """Write a snapshot's tables, then its run row: a reader that goes by run rows never sees half a snapshot."""
    for name, frame in frames.items():
        write_slices(frame.withColumn("week_end_date", F.lit(week).cast("date")), f"{root}/{name}", ["week_end_date"])
    write_slices(run.withColumn("week_end_date", F.lit(week).cast("date")), f"{root}/scan_runs", ["week_end_date"])


def row_counts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``table, rows`` of each."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
