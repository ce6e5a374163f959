"""Queries whose work must not grow faster than their tables."""

from pyspark.sql import functions as F

from tideline.llm import secrets
from tideline.operators import history, jobs
from tideline.operators.universe_store import UniverseStore
from tideline.sources import components, files
from tideline.sources.market import market


def test_price_factor_computes_each_step_once(spark):
    rows = spark.createDataFrame([("Bonus 1:1 / Stock Split From Rs 10 To Rs 5",), (None,)], "t string")
    made = rows.select(files.price_factor(F.col("t")).alias("f"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(step) for step in ("lower(", "array_position(", "-? *")] == [1, 1, 1]
    assert [r.f for r in made.collect()] == [0.25, None]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _archive(spark):
    rows = spark.range(600).selectExpr("date_add(date'2020-01-01', cast(id / 2 as int)) as date", "concat('T', id % 2) as symbol", "'INE000000001' as isin", "cast(id % 5 + 1 as double) as value")
    bars = rows.select("date", "symbol", "isin", "value", *(F.lit(10.0).alias(c) for c in ("open", "high", "low", "close", "volume")))
    return bars, spark.createDataFrame([("T0", "INE000000001", 0.5)], "symbol string, isin string, factor double").selectExpr("symbol", "isin", "date'2020-06-01' as ex_date", "factor")


def _asked(monkeypatch):
    seen = []
    plain = history.snapshots
    monkeypatch.setattr(history, "snapshots", lambda rows, *more: (seen.append(_plan(rows)), plain(rows, *more))[1])
    return seen


def test_publication_meets_bars_and_names_once(spark, monkeypatch, tmp_path):
    seen = _asked(monkeypatch)
    store = UniverseStore(spark, str(tmp_path / "universe"), 5, 10.0)
    store.publish(*_archive(spark))
    assert len(seen) == 1 and "Join" not in seen[0]
    assert store.entities().count() == 1 and store.daily().count() == 300  # the more traded of two symbols a day
    best = {r.date: r.volume for r in store.daily().collect()}
    assert len(best) == 300 and not (tmp_path / "universe" / "ranked" / "version=1").exists()


def test_point_in_time_links_rows_once(spark, monkeypatch):
    seen = _asked(monkeypatch)
    built = jobs.build_point_in_time(*_archive(spark), 5, 10.0)
    assert len(seen) == 1 and "Window" not in seen[0] and "Join" not in seen[0]
    assert built.entities.count() == 1 and built.daily.count() == 300


def test_market_goes_through_lines_once(spark):
    m = market(spark, "/root/testdata/sf0.001")
    assert not any("Join" in _plan(x) or "lineitem" in str(x.inputFiles()) for x in (m.daily, m.benchmark))
    assert "RegExp" not in _plan(m.symbols) and "regexp" not in _plan(m.symbols)
    assert m.daily.count() > 0 and m.symbols.count() == m.symbols.distinct().count()


def test_secrets_network_learns_from_all_windows(spark, monkeypatch):
    rows = spark.range(9000).selectExpr("id as doc_id", "concat('see run-', sha2(cast(id as string), 224), '_x of it') as text").selectExpr("doc_id", "translate(text, 'abcdef', 'ghijkl') as text")
    seen, learnt, plain, learn = [], [], secrets._calibrated, secrets._learn
    monkeypatch.setattr(secrets, "table_findings", None)
    monkeypatch.setattr(secrets, "PASSES", 1)
    monkeypatch.setattr(secrets, "_calibrated", lambda net, table, *more: (seen.append(int(table[:, 2].sum())), plain(net, table, *more))[1])
    monkeypatch.setattr(secrets, "_learn", lambda *a: (learnt.append(1), learn(*a))[1])
    windows = rows.select("text").mapInArrow(secrets._all_findings, "label int, at long, codes binary").distinct()
    held = windows.where("pmod(xxhash64(codes), 4) = 0").count()
    assert windows.count() >= 9000 and held > secrets.MOST_LABELLED
    secrets.network_for(rows)
    assert seen == [held] and learnt == [1]


def test_rounds_of_components_have_partitions_by_rows_not_by_shuffle(spark, monkeypatch):
    seen, cut = [], components.cut

    def counted(df):
        out = cut(df)
        seen.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(components, "cut", counted)
    edges = spark.range(120).selectExpr("id + 1 as a", "id - id % 3 as b")  # chains of three nodes that meet
    own = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        least = spark.sparkContext.defaultParallelism
        for rows, parts in ((components.PARTITION_ROWS, least), (5, max(least, 24))):
            monkeypatch.setattr(components, "PARTITION_ROWS", rows)
            seen.clear()
            got = components.connected_components(edges)
            assert {r.node: r.component for r in got.collect()} == dict.fromkeys(range(121), 0)
            assert got.rdd.getNumPartitions() <= parts and len(seen) >= 9 and max(seen[1:]) == parts
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
