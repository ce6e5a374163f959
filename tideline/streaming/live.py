"""Weekly bars, the trend and the day's files as streams.

The weekly bar is a tumbling window that begins on Monday; rows up to three
weeks late are taken in.  A gate in front of it keeps later ones aside, and a
batch repair makes their weeks anew, so that nothing is lost.  The trend keeps
each symbol's state between batches, starts from a batch's states and gives
the same rows as a full computation.  Files of missed days are caught up by a
sink that keeps a ledger by source and date.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tideline.functions.columns import monday
from tideline.operators import bars as batch_bars
from tideline.operators import jobs
from tideline.operators.trend import Bands, as_tuple, run_bands
from tideline.sources import files
from tideline.sources.lineage import cut, exists, remove
from tideline.sources.store import last_of, write_slices

LATE = "21 days"
_BANDS = "close double, atr double, upper double, lower double, direction int, weeks int, warm_sum double, warm_bars int"
_TREND = "symbol_id int, week_end_date date, atr double, upper_band double, lower_band double, st_value double, direction int, weeks_in_trend int, is_flip boolean, close double"

Sink = Callable[[DataFrame, int], None]


def weekly_bars(ticks: DataFrame, key: str = "symbol_id", late: str = LATE) -> DataFrame:
    """Bars of ``key, ts (timestamp), open, high, low, close, volume`` by week from Monday, once the watermark has passed.

    1970-01-01 was a Thursday, so windows of seven days start four days on.
    """
    week = F.window("ts", "7 days", startTime="4 days")
    return (
        ticks.withWatermark("ts", late)
        .groupBy(key, week)
        .agg(
            F.to_date(F.max("ts")).alias("week_end_date"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
            F.coalesce(F.sum("volume"), F.lit(0)).cast("long").alias("volume"), F.count("*").alias("trading_days"),
        )
        .select(key, F.to_date("window.start").alias("monday"), "week_end_date", "open", "high", "low", "close", "volume", "trading_days")
    )


# ---------------------------------------------------------------- late rows


def late_gate(root: str, late: str = LATE) -> Sink:
    """A ``foreachBatch`` writer that deals rows with a ``ts`` to ``root/ontime`` and ``root/late``.

    A row is late when its week had ended ``late`` before the newest ``ts`` of
    all batches before: just those that a windowed aggregation with this
    watermark would drop.  A batch's rows appear whole, by a rename of what
    was staged, and once: a batch made again after a crash leaves what is
    already there.  So a stream over ``root/ontime`` (without a limit of files
    a batch) has the same watermark or an older one when it meets a row, and
    drops none.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = [f"{root}/{kind}/batch={number}" for kind in ("ontime", "late")]
        if all(exists(spark, d) for d in done):
            return
        newest = F.lit(None).cast("timestamp")
        if exists(spark, f"{root}/newest"):
            before = spark.read.parquet(f"{root}/newest").where(F.col("batch") < number).agg(F.max("ts").alias("ts")).first().ts
            newest = F.lit(before).cast("timestamp")
        week_end = F.date_add(monday(F.to_date("ts")), 7).cast("timestamp")
        is_late = F.coalesce(week_end <= newest - F.expr(f"interval {late}"), F.lit(False))
        staged = f"{root}/_staged/batch={number}"
        batch.withColumn("late", is_late).write.mode("overwrite").partitionBy("late").parquet(staged)
        got = spark.read.schema(batch.schema).parquet(staged)
        got.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{root}/newest/batch={number}")
        for flag, place in zip(("false", "true"), done, strict=True):
            if not exists(spark, place):
                _rename(spark, f"{staged}/late={flag}", place)
        remove(spark, staged)

    return write


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """A staged folder under its own name; where nothing was staged, an empty folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if exists(spark, source):
        system.mkdirs(path(target).getParent())
        if not system.rename(path(source), path(target)):
            raise OSError(f"{source} could not become {target}")
    else:
        system.mkdirs(path(target))


def dealt(spark: SparkSession, root: str, kind: str, schema) -> DataFrame:  # noqa: ANN001
    """Rows of all batches that the gate dealt to ``ontime`` or ``late``."""
    return spark.read.schema(schema).parquet(f"{root}/{kind}")


def repair_weeks(stored: DataFrame, ontime: DataFrame, late: DataFrame, key: str = "symbol_id") -> DataFrame:
    """``stored`` weekly bars with every week that a late row falls in made anew from all its rows, also one that had none."""
    date = F.to_date("ts").alias("date")
    columns = [key, date, "open", "high", "low", "close", "volume"]
    touched = late.select(key, monday(F.to_date("ts")).alias("monday")).distinct()
    rows = ontime.select(*columns).unionByName(late.select(*columns)).withColumn("monday", monday(F.col("date")))
    anew = batch_bars.weekly_bars(rows.join(touched, [key, "monday"], "left_semi").drop("monday"))
    return stored.join(touched, [key, "monday"], "left_anti").unionByName(anew.select(*stored.columns))


# -------------------------------------------------------------------- trend


class TrendProcessor(StatefulProcessor):
    """The band recurrence of one symbol: a typed value state, from a batch's state where there is one."""

    def __init__(self, period: int, multiplier: float, keep_days: int | None):
        self.period, self.multiplier, self.keep_days = period, multiplier, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bands", _BANDS, None if self.keep_days is None else self.keep_days * 86_400_000)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: ANN001, N802, N803
        row = initialState.iloc[0]
        real = lambda v: math.nan if pd.isna(v) else float(v)
        self.state.update((real(row["close"]), real(row["atr"]), float(row["upper"]), float(row["lower"]), int(row["direction"]), int(row["weeks"]), float(row["warm_sum"]), int(row["warm_bars"])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        bands = Bands(*self.state.get()) if self.state.exists() else Bands()
        bars = pd.concat(list(rows)).sort_values("week_end_date", kind="stable")  # of a symbol in one batch
        got = run_bands(zip(bars["week_end_date"], bars["high"].astype(float), bars["low"].astype(float), bars["close"].astype(float), strict=True), bands, self.period, self.multiplier)
        self.state.update(as_tuple(bands))
        out = pd.DataFrame(got, columns=["week_end_date", "atr", "upper_band", "lower_band", "st_value", "direction", "weeks_in_trend", "is_flip", "close"])
        out.insert(0, "symbol_id", key[0])
        yield out


def trend(bars: DataFrame, period: int = 7, multiplier: float = 3.0, start: DataFrame | None = None, keep_days: int | None = None) -> DataFrame:
    """Trend rows of a stream of weekly bars, each symbol's state kept between batches.

    ``start`` (symbol_id, s as of :func:`tideline.operators.trend.fold`) are
    the states after a batch; the stream brings the bars after it.  A symbol
    without bars for ``keep_days`` (of processing time) loses its state, as it
    was delisted.  The state store must be RocksDB, so the session is set to it.
    """
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    held = None if start is None else start.select("symbol_id", "s.*").groupBy("symbol_id")
    mode = "None" if keep_days is None else "ProcessingTime"
    return bars.select("symbol_id", "week_end_date", "high", "low", "close").groupBy("symbol_id").transformWithStateInPandas(
        TrendProcessor(period, multiplier, keep_days), _TREND, "Append", mode, held
    )


# ------------------------------------------------------------------ catch-up

_FILE = ", ".join(f"{c} string" for c in files.DAY_FILE)
_LEDGER = "source string, trade_date date, status string, rows long, batch string"


def day_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of landed files of a day each, ``..yyyymmdd.csv``, with the day that was ``wanted``."""
    raw = spark.readStream.schema(_FILE).option("header", True).csv(path)
    return files.delivery_rows(raw.withColumn("wanted", files.day_wanted(F.col("_metadata.file_name"))), "wanted")


def land_days(lines: DataFrame, path: str) -> None:
    """Text columns of the day's file, with the day it is ``wanted`` for, as one CSV file a day named ``yyyymmdd.csv``."""
    spark = lines.sparkSession
    lines.select(F.date_format("wanted", "yyyyMMdd").alias("day"), *(c for c in lines.columns if c != "wanted")).repartition("day").write.partitionBy("day").option("header", True).option(
        "ignoreLeadingWhiteSpace", False
    ).csv(f"{path}/_parts")
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in system.listStatus(place(f"{path}/_parts")):
        day = folder.getPath().getName().removeprefix("day=")
        for part in system.listStatus(folder.getPath()) if folder.isDirectory() else []:
            system.rename(part.getPath(), place(f"{path}/{day}.csv"))
    remove(spark, f"{path}/_parts")


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """``source, trade_date, status, rows, batch`` of every day that was gone through: ok, holiday or missing."""
    path = f"{root}/ledger"
    return spark.read.schema(_LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], _LEDGER)


def pending(done: dt.date | None, end: dt.date, most: int = 10) -> list[dt.date]:
    """Days up to ``end`` after the last one that is done, at most ``most`` back, without Sundays."""
    first = max((done or end) + dt.timedelta(days=1), end - dt.timedelta(days=most))
    return [d for i in range((end - first).days + 1) if (d := first + dt.timedelta(days=i)).weekday() != 6]


def catch_up(root: str, source: str, symbols: DataFrame, aliases: DataFrame, series: list[str], most: int = 10, threshold: float = 0.03, query: str = "") -> Sink:
    """A ``foreachBatch`` writer that puts the files of missed days into ``root/bars`` (a partition a ``month``), each day once.

    The days are those :func:`pending` at the newest file of the batch, at
    most some ten, taken in order as each needs the closes of the one before.
    A file whose rows are of another day is a holiday's; a weekend without a
    file is one, any other day without is missing.  A day is written with its
    month of bars, its actions, its issues, and last its row in the
    ledger; a day without that row is made again after a crash, as if nothing
    of it were there, and an attempt made again goes by the days that the
    first one planned.  ``query`` names the stream, whose batch numbers tell an
    attempt made again from a new one.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"{query}/{number}"
        seen = batch.groupBy("wanted").agg(F.min("date").alias("first"), F.max("date").alias("last")).orderBy(F.desc("wanted")).limit(most + 1).collect()
        if not seen:
            return
        recorded = ledger(spark, root).where(F.col("source") == source)
        plan = f"{root}/plans/{source}/{query}-{number}"
        if not exists(spark, f"{plan}/_SUCCESS"):  # an attempt made again goes by the days of the first
            done = recorded.where(F.col("status") != "missing").agg(F.max("trade_date")).first()[0]
            if done is None and exists(spark, f"{root}/bars"):
                done = spark.read.parquet(f"{root}/bars").agg(F.max("date")).first()[0]
            days = pending(done, seen[0].wanted, most)
            spark.createDataFrame([(d,) for d in days], "day date").coalesce(1).write.mode("overwrite").parquet(plan)
        own = {r.trade_date for r in recorded.where(F.col("batch") == name).collect()}  # at most the days of one plan
        there = {r.wanted: r for r in seen}
        for day in sorted(r.day for r in spark.read.schema("day date").parquet(plan).collect()):
            if day in own:
                continue
            rows = 0
            if day in there and there[day].first == there[day].last == day:
                status = "ok"
                rows = _ingest(spark, root, batch, day, symbols, aliases, series, threshold, source)
            else:
                status = "holiday" if day in there or day.weekday() >= 5 else "missing"
            write_slices(spark.createDataFrame([(source, day, status, rows, name)], _LEDGER), f"{root}/ledger", ["source", "trade_date"])

    return write


def _ingest(spark: SparkSession, root: str, batch: DataFrame, day: dt.date, symbols: DataFrame, aliases: DataFrame, series: list[str], threshold: float, source: str) -> int:
    """One day's file into the bars; the number of bars of the day after it."""
    feed = files.preferred(batch.where(F.col("wanted") == F.lit(day)).drop("wanted"), series, ["symbol", "date"])
    stored = spark.read.parquet(f"{root}/bars")
    stored = stored.where((F.col("date") != F.lit(day)) | (F.col("source") != "file"))  # no half-made day
    dates = stored.where(F.col("date") < F.lit(day)).agg(F.max("date")).first()[0]
    okay = ledger(spark, root).where((F.col("source") == source) & (F.col("status") == "ok") & (F.col("trade_date") < F.lit(day))).agg(F.max("trade_date")).first()[0]
    previous = max((d for d in (dates, okay) if d is not None), default=None)
    month = day.replace(day=1)
    base = stored.where(F.col("month") == F.lit(month)).drop("month")
    got = jobs.ingest_day(feed, stored.drop("month"), symbols, aliases, str(day), None if previous is None else str(previous), threshold, base)
    write_slices(cut(got.actions.withColumn("day", F.lit(day))), f"{root}/actions", ["day"])
    write_slices(cut(got.issues.withColumn("day", F.lit(day))), f"{root}/issues", ["day"])
    now = cut(got.daily.withColumn("month", F.lit(month)))
    write_slices(now, f"{root}/bars", ["month"])
    return now.where(F.col("date") == F.lit(day)).count()


def upsert_each_batch(path: str, keys: list[str], by: list[str], order: str) -> Sink:
    """A ``foreachBatch`` writer that puts a batch into a Parquet table by key.

    The table is partitioned by ``by`` (columns among ``keys``), and only
    partitions that the batch has rows for are read and written; of several
    rows of a key the last by ``order`` stays, also against the table, so a
    batch written twice counts once and a late one undoes nothing.
    """
    if not set(by) <= set(keys):
        raise ValueError("a key must lie in one partition")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merged = batch
        if exists(spark, path):
            old = spark.read.schema(batch.schema).parquet(path)
            merged = old.join(batch.select(*by).distinct(), by, "left_semi").select(*batch.columns).unionByName(batch)
        write_slices(cut(last_of(merged, keys, order)), path, by)  # kept first: what is read is what is written

    return write
