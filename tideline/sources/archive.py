"""A price archive as a data source: zipped CSV files, one a session, in either of two layouts.

``spark.read.format("price_archive").load(folder)`` lists the folder once, makes
a partition of each file whose date (in its name, ``yyyymmdd``) passes the
filters on ``date``, and reads a file in blocks inside its own task.  The
newest come first, so that of several files that can't be read the newest, the
likeliest to be unfinished, is met and named first.  A file
outside the dates is never opened.  Filters on ``date`` and ``series`` are
pushed down, where the session allows it (:func:`register` does); ``start``,
``end`` and ``series`` can be given as options as well.

Writing puts one file a session under ``yyyy/``, in the new layout from
``new_from`` on.  A task writes its sessions under temporary names, and they
get their own when all tasks are done.  Folders are any that Arrow's file
systems reach (local, object stores, HDFS).
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from tideline.sources.files import ARCHIVE_NEW, ARCHIVE_NUMBERS, ARCHIVE_OLD, preferred

NAME = "price_archive"
COLUMNS = ["date", "symbol", "series", "isin", *ARCHIVE_NUMBERS]
SCHEMA = "date date, symbol string, series string, isin string, " + ", ".join(f"{c} double" for c in ARCHIVE_NUMBERS)
#: Bytes of a file that are parsed at a time.
BLOCK = 1 << 22
#: Column that tells kinds of paper in the new layout, and shares in it; fixed values.
KIND, SHARES = "FinInstrmTp", "STK"

_ARROW = pa.schema([("date", pa.date32()), *((c, pa.string()) for c in ("symbol", "series", "isin")), *((c, pa.float64()) for c in ARCHIVE_NUMBERS)])
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_IN_NAME = re.compile(r"(\d{8})[^/]*\.zip$")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"/[^/]*\*[^/]*$", "", path)  # a pattern stands for its folder
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class Session(InputPartition):
    """One file of the archive."""

    path: str
    day: dt.date


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.first, self.last = (dt.date.fromisoformat(options[k]) if k in options else None for k in ("start", "end"))
        self.days: set[dt.date] | None = None
        self.series: set[str] | None = set(options["series"].split(",")) if "series" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        """Whether a filter is wholly done here: comparisons of the date, and wanted series."""
        if not isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            return False
        values = set(f.value) if isinstance(f, In) else {f.value}
        if f.attribute == ("series",) and isinstance(f, EqualTo | In) and all(isinstance(v, str) for v in values):
            self.series = values if self.series is None else self.series & values
        elif f.attribute == ("date",) and all(isinstance(v, dt.date) for v in values):
            if isinstance(f, EqualTo | In):
                self.days = values if self.days is None else self.days & values
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                low = f.value + dt.timedelta(days=isinstance(f, GreaterThan))
                self.first = max(self.first or low, low)
            else:
                high = f.value - dt.timedelta(days=isinstance(f, LessThan))
                self.last = min(self.last or high, high)
        else:
            return False
        return True

    def _wanted(self, day: dt.date) -> bool:
        return (self.first is None or day >= self.first) and (self.last is None or day <= self.last) and (self.days is None or day in self.days)

    def partitions(self) -> list[Session]:
        system, root = _place(self.root)
        found = []
        for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
            if f.is_file and "/_" not in f.path and (name := _IN_NAME.search(f.path)):
                day = dt.datetime.strptime(name[1], "%Y%m%d").date()
                if self._wanted(day):
                    found.append(Session(f.path, day))
        return sorted(found, key=lambda s: (s.day, s.path), reverse=True)

    def read(self, partition: Session) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.root)
        try:
            with system.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as z:
                yield from self._rows(z, partition.day)
        except (zipfile.BadZipFile, pa.ArrowInvalid) as e:
            raise ValueError(f"{partition.path}: {e}") from e

    def _rows(self, z: zipfile.ZipFile, day: dt.date) -> Iterator[pa.RecordBatch]:
        with z.open(z.namelist()[0]) as text:
            header = [c.strip() for c in text.readline().decode("utf-8-sig").split(",")]
            layout = ARCHIVE_NEW if "TckrSymb" in header else ARCHIVE_OLD
            types = pacsv.ConvertOptions(column_types=dict.fromkeys(header, pa.string()), strings_can_be_null=True, null_values=[""])
            try:
                blocks = pacsv.open_csv(text, pacsv.ReadOptions(column_names=header, block_size=BLOCK), convert_options=types)
            except pa.ArrowInvalid as e:
                if "Empty CSV" in str(e):  # a header and no rows
                    return
                raise
            for batch in blocks:
                have = {c: pc.utf8_trim_whitespace(batch.column(i)) for i, c in enumerate(header)}
                rows = {new: have[old] for old, new in layout.items() if old in have}
                keep = pa.array([True] * batch.num_rows) if KIND not in have or layout is ARCHIVE_OLD else pc.equal(have[KIND], SHARES)
                if self.series is not None:
                    keep = pc.and_(keep, pc.is_in(rows["series"], pa.array(sorted(self.series))))
                none = pa.nulls(batch.num_rows, pa.string())
                columns = [pa.array([day] * batch.num_rows, pa.date32())]
                for c in COLUMNS[1:]:
                    x = rows.get(c, none)
                    columns.append(x if c not in ARCHIVE_NUMBERS else pc.if_else(pc.match_substring_regex(x, _NUMBER), x, None).cast(pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW).filter(pc.fill_null(keep, False))


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: temporary path and session."""

    files: list[tuple[str, dt.date]]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        if missing := [c for c in COLUMNS if c not in schema.names]:
            raise ValueError(f"missing columns: {missing}")
        self.root, self.overwrite = options["path"], overwrite
        self.new_from = dt.date.fromisoformat(options["new_from"]) if "new_from" in options else dt.date.max
        self.temporary = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows of a session follow each other, in one task."""
        system, root = _place(self.root)
        done: list[tuple[str, dt.date]] = []
        folder = f"{root}/{self.temporary}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        for day, rows in _runs(iterator):
            if any(day == d for _, d in done):
                raise ValueError(f"rows of {day} do not follow each other")
            path = f"{folder}/{day:%Y%m%d}.zip"
            layout = ARCHIVE_NEW if day >= self.new_from else ARCHIVE_OLD
            with system.open_output_stream(path) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z, z.open(f"{day:%Y%m%d}.csv", "w") as sink:
                for i, batch in enumerate(rows):
                    named = {old: batch.column(batch.schema.get_field_index(new)) for old, new in layout.items()}
                    if layout is ARCHIVE_NEW:
                        named = {KIND: pa.array([SHARES] * batch.num_rows)} | named
                    table = pa.table(named)
                    pacsv.write_csv(table, pa.PythonFile(sink, "w"), pacsv.WriteOptions(include_header=i == 0, quoting_style="none", quoting_header="none"))
            done.append((path, day))
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        system, root = _place(self.root)
        files = [f for m in messages if m is not None for f in m.files]
        twice = {d for _, d in files if sum(d == e for _, e in files) > 1} if len(files) != len({d for _, d in files}) else set()
        if twice:
            self.abort(messages)
            raise ValueError(f"sessions of several tasks: {sorted(twice)[:5]}")
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if "/_" not in f.path and f.type == fs.FileType.Directory:
                    system.delete_dir(f.path)
        for path, day in files:
            system.create_dir(f"{root}/{day:%Y}", recursive=True)
            system.move(path, f"{root}/{day:%Y}/{day:%Y%m%d}.zip")
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        """Temporary files go."""
        system, root = _place(self.root)
        if system.get_file_info(f"{root}/{self.temporary}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.temporary}")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dt.date, Iterator[pa.RecordBatch]]]:
    """Each session with its slices, which are to be read before the next session."""
    held: list[pa.RecordBatch] = []
    day = None
    for batch in batches:
        days = batch.column(batch.schema.get_field_index("date"))
        for value, at, n in _lengths(days):
            if held and value != day:
                yield day, iter(held)
                held = []
            day = value
            held.append(batch.slice(at, n))
    if held:
        yield day, iter(held)


def _lengths(days: pa.Array) -> Iterator[tuple[dt.date, int, int]]:
    coded = pc.run_end_encode(days)
    at = 0
    for value, end in zip(coded.values.to_pylist(), coded.run_ends.to_pylist(), strict=True):
        yield value, at, end - at
        at = end


class PriceArchive(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to the session and let filters be pushed to it."""
    spark.dataSource.register(PriceArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(spark: SparkSession, path: str, series: list[str], **options: str) -> DataFrame:
    """Rows of the wanted series, one a session and symbol, in the order of the list of series."""
    register(spark)
    rows = spark.read.format(NAME).options(**options).load(path).where(F.col("series").isin(series))
    return preferred(rows, series, ["symbol", "date"])


def write_archive(rows: DataFrame, path: str, new_from: str | None = None, overwrite: bool = False) -> None:
    """``rows`` (the source's columns) as one file a session; a session written again takes the place of the one before."""
    register(rows.sparkSession)
    ready = rows.select(*COLUMNS).repartitionByRange("date").sortWithinPartitions("date", "symbol", "series")
    ready.write.format(NAME).options(**({"new_from": new_from} if new_from else {})).mode("overwrite" if overwrite else "append").save(path)
