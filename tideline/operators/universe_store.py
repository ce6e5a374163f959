"""A universe without survivors' bias as published tables, brought forward a quarter at a time.

Bars are stored as they were traded, a partition a quarter, and never written
again when a later event rescales them or a later ISIN links two symbols: what
such news changes is in small tables (names, events, members, entities) that
are made anew for each publication, and a reader puts the two together by
equality joins.  A publication is a version folder and, last, a run row that
names the version of each quarter, so a reader sees all of one or nothing, and
a broken-off attempt is written over by the next.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators import history
from tideline.sources.lineage import cut, exists, remove, written

BARS = "symbol string, isin string, date date, open double, high double, low double, close double, volume double, value double"
SUMMARY = "symbol string, isin string, first date, last date"
NAMES = "symbol string, start date, end date, entity string"
HIDDEN = "symbol string, date date"
EVENTS = "entity string, date date, factor double, gap double"
MEMBERS = "snapshot_date date, entity string"
ENTITIES = "entity string, symbol string, isin string, listed_date date, last_date date, status string, isins array<string>"
RUNS = "version int, parts map<string,int>, sessions long, entities long, events long, snapshots long"

#: Days without a bar after which an entity counts as delisted, and the longest quarter; fixed values.
DELISTED_DAYS, QUARTER_DAYS = 30, 92


def quarter(date: Column) -> Column:
    return F.concat(F.year(date), F.lit("Q"), F.quarter(date))


def spans(summary: DataFrame, max_gap_days: int) -> DataFrame:
    """``symbol, start, end, entity`` from first and last sessions by symbol, ISIN and quarter.

    A silence longer than a quarter lies between two quarters' sessions, so
    the summary cuts entities where all of their sessions would.
    """
    rooted = summary.join(history.linked_symbols(summary), "symbol")
    w = Window.partitionBy("root").orderBy("quarter")
    held = rooted.groupBy("root", "quarter").agg(F.min("first").alias("_a"), F.max("last").alias("_b"))
    new = F.coalesce((F.datediff("_a", F.lag("_b").over(w)) > max_gap_days).cast("int"), F.lit(0))
    segments = held.withColumn("_new", new).withColumn("_n", F.sum("_new").over(w)).select("root", "quarter", F.concat_ws("#", "root", F.col("_n").cast("string")).alias("entity"))
    return rooted.join(segments, ["root", "quarter"]).groupBy("symbol", "entity").agg(F.min("first").alias("start"), F.max("last").alias("end")).select("symbol", "start", "end", "entity")


def factors(events: DataFrame) -> DataFrame:
    """``entity, from, until, m``: the product of the events after each stretch of days between them; after the last one there is no row."""
    daily = events.groupBy("entity", "date").agg(F.product("factor").alias("factor"))
    w = Window.partitionBy("entity").orderBy("date")
    later = F.product("factor").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return daily.select("entity", F.coalesce(F.lag("date").over(w), F.lit("0001-01-01").cast("date")).alias("from"), F.col("date").alias("until"), later.alias("m"))


def entity_rows(bars: DataFrame) -> DataFrame:
    """Entities of ``bars`` (one a day) with the last symbol and ISIN; of those that used the same one the latest has it, the others a year after the symbol and no ISIN."""
    end = bars.agg(F.max("date").alias("_end"))  # one row
    last = bars.groupBy("entity").agg(F.max(F.struct("date", "symbol", "isin")).alias("s"), F.min("date").alias("listed_date"), F.array_sort(F.collect_set("isin")).alias("isins"))
    flat = last.select("entity", "s.symbol", "s.isin", "listed_date", F.col("s.date").alias("last_date"), "isins").join(F.broadcast(end))
    place = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("last_date"), "entity"))
    symbol = F.when(place(F.col("symbol")) > 1, F.concat("symbol", F.lit("~"), F.year("last_date"))).otherwise(F.col("symbol"))
    isin = F.when(place(F.coalesce("isin", "entity")) == 1, F.col("isin"))
    status = F.when(F.col("last_date") < F.date_sub("_end", DELISTED_DAYS), "delisted").otherwise("listed")
    named = flat.withColumns({"_symbol": symbol, "_isin": isin})
    return named.select("entity", F.col("_symbol").alias("symbol"), F.col("_isin").alias("isin"), "listed_date", "last_date", status.alias("status"), "isins")


@dataclass(frozen=True)
class Run:
    """A publication: its version, and the version that holds each quarter's bars."""

    version: int
    parts: dict[str, int]


class UniverseStore:
    """Point-in-time tables in a shared folder, for universes of ``top_n`` entities."""

    def __init__(self, spark: SparkSession, path: str, top_n: int, min_traded_pct: float = 80.0, max_gap_days: int = 365, files: int = 8):
        if max_gap_days < QUARTER_DAYS:
            raise ValueError(f"silences of less than {QUARTER_DAYS} days can't be told from a summary by quarter")
        self.spark, self.path, self.top_n, self.min_traded_pct, self.max_gap_days, self.files = spark, path.rstrip("/"), top_n, min_traded_pct, max_gap_days, files

    # ------------------------------------------------------------ reading

    def runs(self) -> DataFrame:
        """A row for each publication that was brought to its end."""
        path = f"{self.path}/runs"
        return self.spark.read.schema(RUNS).parquet(f"{path}/*") if exists(self.spark, path) else self.spark.createDataFrame([], RUNS)

    def run(self, version: int | None = None) -> Run:
        """The newest publication, or one by its version; before the first one version 0 without quarters."""
        rows = self.runs()
        rows = rows if version is None else rows.where(F.col("version") == version)
        newest = rows.orderBy(F.desc("version")).select("version", "parts").first()
        if newest is None and version is not None:
            raise ValueError(f"no publication {version}")
        return Run(newest.version, dict(newest.parts)) if newest else Run(0, {})

    def _quarters(self, table: str, columns: str, parts: dict[str, int]) -> DataFrame:
        paths = [f"{self.path}/{table}/version={v}/quarter={q}" for q, v in sorted(parts.items())]  # some four a year
        if not paths:
            return self.spark.createDataFrame([], f"{columns}, version int, quarter string")
        return self.spark.read.schema(f"{columns}, version int, quarter string").option("basePath", f"{self.path}/{table}").parquet(*paths)

    def _table(self, table: str, columns: str, version: int | None) -> DataFrame:
        at = self.run(version).version
        return self.spark.read.schema(columns).parquet(f"{self.path}/{table}/version={at}") if at else self.spark.createDataFrame([], columns)

    def entities(self, version: int | None = None) -> DataFrame:
        return self._table("entities", ENTITIES, version)

    def events(self, version: int | None = None) -> DataFrame:
        """Events that were applied, with the gap that confirms each."""
        return self._table("events", EVENTS, version)

    def members(self, version: int | None = None) -> DataFrame:
        return self._table("members", MEMBERS, version)

    def daily(self, version: int | None = None) -> DataFrame:
        """Adjusted bars of all entities that ever were members; filters on ``date`` reach the scan."""
        run = self.run(version)
        at = run.version or None
        # names of members only, so that no other bar goes on to the joins
        names = self._table("names", NAMES, at).join(self.entities(at).select("entity"), "entity", "left_semi").select("symbol", "start", "end", "entity")
        kept = _linked(self._quarters("bars", BARS, run.parts), names, self._table("hidden", HIDDEN, at))
        f = factors(self.events(at)).alias("f")
        met = kept.alias("b").join(f, (F.col("b.entity") == F.col("f.entity")) & (F.col("b.date") >= F.col("f.from")) & (F.col("b.date") < F.col("f.until")), "left")
        m = F.coalesce("f.m", F.lit(1.0))
        scaled = met.select("b.entity", "b.date", "b.symbol", *((F.col(f"b.{c}") * m).alias(c) for c in ("open", "high", "low", "close")), (F.col("b.volume") / m).alias("volume"))
        return scaled.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close")})

    # ------------------------------------------------------------ writing

    def publish(self, rows: DataFrame, events: DataFrame) -> int:
        """Add the quarters of ``rows``, in place of what was stored of them, and publish; the new version.

        ``rows`` is ``date, symbol, isin, open .. volume, value`` of whole
        quarters, ``events`` all events known by now (symbol, isin, ex_date,
        factor).  Rows without a symbol, date or positive prices are left out;
        of repeated rows of a symbol and day the most traded stays.
        """
        before = self.run()
        version = before.version + 1
        fresh = self._stage(rows, version)
        parts = before.parts | {q: version for q in fresh}
        self._write("names", spans(self._quarters("summary", SUMMARY, parts), self.max_gap_days), version)
        names = self.spark.read.schema(NAMES).parquet(f"{self.path}/names/version={version}")
        bars = self._quarters("bars", BARS, parts)
        # all bars meet their names once; what follows reads the columns it needs
        folder = f"{self.path}/ranked/version={version}"
        _ranked(bars, names).write.mode("overwrite").option("compression", "zstd").parquet(folder)
        ranked = self.spark.read.parquet(folder)
        self._write("hidden", ranked.where("_n > 1").select("symbol", "date"), version)
        linked = ranked.where("_n = 1").drop("_n")
        self._write("members", history.snapshots(linked.select("entity", "date", "value", "isin"), self.top_n, self.min_traded_pct), version)
        members = self.spark.read.schema(MEMBERS).parquet(f"{self.path}/members/version={version}")
        kept = written(linked.join(members.select("entity").distinct(), "entity", "left_semi"))
        self._write("entities", entity_rows(kept), version)
        self._write("events", _applied(kept, names, events), version)
        self._run_row(version, parts)
        remove(self.spark, folder)
        return version

    def _run_row(self, version: int, parts: dict[str, int]) -> None:
        """The last thing a publication writes."""
        read = lambda table, columns: self.spark.read.schema(columns).parquet(f"{self.path}/{table}/version={version}")
        sessions = self._quarters("bars", BARS, parts).select("date").distinct().count()
        counts = [read("entities", ENTITIES).count(), read("events", EVENTS).count(), read("members", MEMBERS).select("snapshot_date").distinct().count()]
        row = self.spark.createDataFrame([(version, parts, sessions, *counts)], RUNS)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/runs/version-{version}")

    def _write(self, table: str, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/version={version}")

    def _stage(self, rows: DataFrame, version: int) -> list[str]:
        """The rows by quarter in the version's folder, and a summary of them; the quarters that have any."""
        names = [c.split()[0] for c in BARS.split(", ")]
        kinds = dict(c.split() for c in BARS.split(", "))
        good = rows.where("symbol is not null and date is not null and open > 0 and high > 0 and low > 0 and close > 0").select(*(F.col(c).cast(kinds[c]).alias(c) for c in names))
        best = Window.partitionBy("symbol", "date").orderBy(F.desc_nulls_last("value"), F.asc_nulls_last("isin"), "close")
        one = good.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").withColumn("quarter", quarter(F.col("date")))
        folder = f"{self.path}/bars/version={version}"
        spread = one.repartition("quarter", F.pmod(F.hash("symbol"), F.lit(self.files))).sortWithinPartitions("quarter", "symbol", "date")
        spread.write.mode("overwrite").partitionBy("quarter").parquet(folder)
        staged = self.spark.read.schema(f"{BARS}, quarter string").parquet(folder)
        short = staged.groupBy("symbol", "isin", "quarter").agg(F.min("date").alias("first"), F.max("date").alias("last"))
        short.repartition("quarter").write.mode("overwrite").partitionBy("quarter").parquet(f"{self.path}/summary/version={version}")
        return [r.quarter for r in staged.select("quarter").distinct().collect()]

    def expire(self, keep: int = 1) -> None:
        """Remove what only publications older than the newest ``keep`` are made of."""
        if keep < 1:
            raise ValueError("the newest publication stays")
        rows = self.runs().orderBy(F.desc("version")).select("version", "parts").collect()  # one a publication
        stay, gone = rows[:keep], rows[keep:]
        used = {(v, q) for r in stay for q, v in r.parts.items()}
        for r in gone:
            remove(self.spark, f"{self.path}/runs/version-{r.version}")
            for table in ("names", "hidden", "members", "entities", "events"):
                remove(self.spark, f"{self.path}/{table}/version={r.version}")
        for v, q in {(v, q) for r in gone for q, v in r.parts.items()} - used:
            for table in ("bars", "summary"):
                remove(self.spark, f"{self.path}/{table}/version={v}/quarter={q}")


def _placed(bars: DataFrame, names: DataFrame) -> DataFrame:
    """Bars with their entity: a symbol has a span for each of its entities, so it meets a handful."""
    b, n = bars.alias("b"), names.alias("n")
    return b.join(n, (F.col("b.symbol") == F.col("n.symbol")) & F.col("b.date").between(F.col("n.start"), F.col("n.end"))).select("b.*", "n.entity")


def _ranked(bars: DataFrame, names: DataFrame) -> DataFrame:
    """Bars with their entity and their place ``_n`` among its bars of the day, the most traded first."""
    w = Window.partitionBy("entity", "date").orderBy(F.desc_nulls_last("value"), "symbol")
    return _placed(bars, names).withColumn("_n", F.row_number().over(w))


def _linked(bars: DataFrame, names: DataFrame, hidden: DataFrame) -> DataFrame:
    """Bars with their entity, one a day."""
    return _placed(bars, names).join(hidden, ["symbol", "date"], "left_anti")


def _applied(rows: DataFrame, names: DataFrame, events: DataFrame) -> DataFrame:
    """Events on their sessions, if the gap confirms them; only bars of entities that an event can belong to are read."""
    known = cut(events.select("symbol", "isin", "ex_date", "factor").withColumn("_id", F.monotonically_increasing_id()))  # ids must not change
    by_text = names.join(known.select("symbol").distinct(), "symbol", "left_semi").select("entity")
    by_isin = rows.join(known.select("isin").distinct(), "isin", "left_semi").select("entity")
    near = rows.join(by_text.unionByName(by_isin).distinct(), "entity", "left_semi")
    _, applied = history.adjust(near.select("entity", "date", "open", "high", "low", "close", "volume"), history.place_events(known, near))
    return applied.select("entity", "date", "factor", "gap")
