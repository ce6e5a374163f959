"""The archive of zipped price files as a data source."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from tideline.sources import archive

DAY = dt.date


def prices(spark, days=(2, 3, 4)):
    rows = [(DAY(2024, 1, d), s, q, f" {s}1 ", 1.0, 2.5, 0.5, x, 1.0, 10.0 * d, None) for d in days for s, q, x in (("AAA", "EQ", 2.0), ("AAA", "BE", 9.0), ("B&B", "BE", 1e-7), ("007", "EQ", 1 / 3))]
    return spark.createDataFrame(rows, archive.SCHEMA)


@pytest.fixture
def folder(spark, tmp_path):
    archive.write_archive(prices(spark), str(tmp_path), new_from="2024-01-03")
    return tmp_path


def read(spark, path):
    archive.register(spark)
    return spark.read.format(archive.NAME).load(str(path))


def test_a_file_a_session_in_both_layouts(spark, folder):
    assert sorted(str(p.relative_to(folder)) for p in folder.rglob("*.zip")) == [f"2024/2024010{d}.zip" for d in (2, 3, 4)]
    heads = [zipfile.ZipFile(folder / f"2024/2024010{d}.zip").read(f"2024010{d}.csv").split(b"\n")[0] for d in (2, 3)]
    assert heads[0].startswith(b"SYMBOL,SERIES") and heads[1].startswith(b"FinInstrmTp,TckrSymb")
    assert not list(folder.glob("_*"))
    trimmed = prices(spark).withColumn("isin", F.trim("isin"))
    got = read(spark, folder)
    assert got.exceptAll(trimmed).count() == 0 == trimmed.exceptAll(got).count()


def test_files_out_of_range_are_not_opened(spark, folder):
    (folder / "2024/20240105.zip").write_bytes(b"no zip")
    (folder / "2023").mkdir()
    (folder / "2023/20231229.zip").write_bytes(b"no zip")
    inside = read(spark, folder).where("date >= '2024-01-01' and date < date '2024-01-05' and series = 'EQ'")
    assert inside.count() == 6 and inside.rdd.getNumPartitions() == 3
    assert read(spark, folder).where(F.col("date").isin(DAY(2024, 1, 2), DAY(2024, 1, 4)) & (F.col("close") > 1)).count() == 4
    assert read(spark, folder).where("date = '2024-01-02'").rdd.getNumPartitions() == 1
    assert spark.read.format(archive.NAME).options(start="2024-01-02", end="2024-01-03", series="BE").load(str(folder)).count() == 4
    with pytest.raises(Exception, match="20240105.zip"):
        read(spark, folder).count()


def test_filters_on_other_columns_are_left_to_the_engine(spark, folder):
    out = read(spark, folder).where("symbol = '007' and date > date '2024-01-02' and (series = 'EQ' or close > 5)")
    assert sorted((r.date.day, r.close) for r in out.collect()) == [(3, 1 / 3), (4, 1 / 3)]


def test_a_session_written_again_takes_its_place(spark, folder):
    archive.write_archive(prices(spark, (4, 5)).where("symbol = '007'"), str(folder))
    assert {r.date.day: r.n for r in read(spark, folder).groupBy("date").agg(F.count("*").alias("n")).collect()} == {2: 4, 3: 4, 4: 1, 5: 1}
    archive.write_archive(prices(spark, (8,)), str(folder), overwrite=True)
    assert [r.date.day for r in read(spark, folder).select("date").distinct().collect()] == [8]


def test_odd_files(spark, tmp_path):
    def put(day, text):
        with zipfile.ZipFile(tmp_path / f"cm{day}bhav.csv.zip", "w") as z:
            z.writestr("any.csv", text)

    put("20240102", " SYMBOL , SERIES,CLOSE\n X , EQ ,-\nY,EQ,1e2\n,EQ,nan\n")
    put("20240103", "SYMBOL,SERIES\n")
    put("20240104", "FinInstrmTp,TckrSymb,SctySrs,ClsPric\nIDX,Z,EQ,1\n STK ,Z,EQ,2\n")
    assert sorted((r.date.day, r.symbol or "", r.close) for r in read(spark, tmp_path).collect()) == [(2, "", None), (2, "X", None), (2, "Y", 100.0), (4, "Z", 2.0)]
    assert archive.archive(spark, str(tmp_path), ["BE"]).count() == 0


def test_rows_must_be_whole_and_sessions_in_one_task(spark, tmp_path):
    archive.register(spark)
    with pytest.raises(Exception, match="missing columns"):
        prices(spark).drop("isin").write.format(archive.NAME).mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="several tasks"):
        prices(spark, (2,)).repartition(3).write.format(archive.NAME).mode("append").save(str(tmp_path))
    assert not list(tmp_path.rglob("*.zip"))


def test_a_landing_zone_puts_bad_lines_aside(spark, tmp_path):
    from tideline.sources import files

    head = ",".join(files.DAY_FILE) + "\n"
    line = lambda s="A", d="02-Jan-2024", c="5.0": f"{s}, EQ, {d}, 1, 1, 1, 1, 1, {c}, 1, 1, 1, 1, -, -\n"
    put = lambda day, text: (tmp_path / f"sec_{day}.csv").write_text(head + text)
    put("20240102", line() + "A, EQ, 02-Jan-2024\n" + line("") + line("B", "32-Jan-2024") + line("C", c="-") + line("D"))
    put("20240103", line())  # rows of the day before
    put("20240104", "")
    put("20240105", "one,two\n")
    got = files.land(spark, str(tmp_path))
    assert sorted((r.wanted.day, r.status, r.rows, r.bad) for r in got.status.collect()) == [(2, "ok", 2, 4), (3, "holiday", 1, 0), (4, "unavailable", 0, 0), (5, "unavailable", 0, 1)]
    assert sorted((r.wanted.day, r.symbol, r.close) for r in got.rows.collect()) == [(2, "A", 5.0), (2, "D", 5.0), (3, "A", 5.0)]
    aside = sorted((r.wanted.day, r.reason, r.text.split(",")[0]) for r in got.quarantine.collect())
    assert aside == [(2, "close", "C"), (2, "date", "B"), (2, "fields", "A"), (2, "symbol", ""), (5, "fields", "one")]


def test_newest_files_come_first(tmp_path):
    for day in ("20240103", "20231229", "20240105"):
        (tmp_path / f"{day}.zip").write_bytes(b"no zip")
    assert [s.day for s in archive.ArchiveReader({"path": str(tmp_path)}).partitions()] == [DAY(2024, 1, 5), DAY(2024, 1, 3), DAY(2023, 12, 29)]
