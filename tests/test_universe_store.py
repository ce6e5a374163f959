"""The universe published by quarters against the same built at once, restarts, and old publications."""

import datetime as dt

import pytest

from tideline.operators import jobs
from tideline.operators.universe_store import UniverseStore

ROW = "date date, symbol string, isin string, open double, high double, low double, close double, volume double, value double"
EVENT = "symbol string, isin string, ex_date date, factor double"


def archive():
    """Two and a half years: a renamed share, a day with both names, one reused symbol, one delisted share, one that is no share."""
    rows, day = [], dt.date(2001, 1, 1)
    isin = lambda k: f"INE{k:09d}"
    for n in range(900):
        d = day + dt.timedelta(n)
        if d.weekday() > 4:
            continue
        add = lambda s, i, p, v: rows.append((d, s, i, p, p - 1.0, p + 1.0, p, 10.0, v))  # noqa: B023, E731
        if n <= 500:
            add("OLD", isin(1), 100.0 if n < 250 else 50.0, 1000.0)
        if n >= 498:
            add("NEW", isin(1), 50.0 if n < 700 else 10.0, 900.0 if n == 498 else 1100.0)
        if n < 200:
            add("TWICE", isin(2), 20.0, 700.0)
        if n > 620:
            add("TWICE", isin(3), 30.0, 800.0)
        add("STEADY", isin(4), 40.0, 600.0)
        add("FUND", "INF000000001", 10.0, 5000.0)
        add("ZERO", isin(5), 0.0, 9000.0)
    return rows


EVENTS = [
    ("OLD", "INE000000001", dt.date(2001, 9, 8), 0.5),  # a Saturday
    ("NEW", "INE000000001", dt.date(2002, 12, 2), 0.2),
    ("STEADY", "INE000000004", dt.date(2002, 3, 1), 0.5),  # no gap confirms it
    ("NOBODY", None, dt.date(2002, 3, 1), 0.5),
]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(archive(), ROW), spark.createDataFrame(EVENTS, EVENT)


#: Last symbol and status of each entity that ever is among the three most traded.
NAMES = {"NEW#0": ("NEW", "listed"), "STEADY#0": ("STEADY", "listed"), "TWICE#0": ("TWICE~2001", "delisted"), "TWICE#1": ("TWICE", "listed")}


def state(entities, daily, events, members):
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    return (
        key(entities, "entity", "symbol", "isin", "listed_date", "last_date", "status", "isins"), key(daily, "entity", "date", "open", "high", "low", "close", "volume"),
        key(events, "entity", "date", "factor", "gap"), key(members, "snapshot_date", "entity"),
    )


def of(store, version=None):
    return state(store.entities(version), store.daily(version), store.events(version), store.members(version))


def test_quarters_published_one_after_another_are_the_build_at_once(spark, frames, tmp_path):
    rows, events = frames
    store = UniverseStore(spark, str(tmp_path), 3, 50.0)
    assert store.entities().count() == store.daily().count() == store.run().version == 0
    store.publish(rows.where("date < '2002-07-01'"), events.where("ex_date < '2002-07-01'"))
    first = state(store.entities(), store.daily(), store.events(), store.members())
    stored = sorted(str(p) for p in tmp_path.glob("bars/version=1/*/*.parquet"))
    store.publish(rows.where("date >= '2002-07-01'"), events)
    built = jobs.build_point_in_time(rows, events, 3, 50.0)
    want = state(built.entities, built.daily, built.events, built.members)
    got = of(store)
    for g, w in zip(got, want, strict=True):
        assert g == w and g
    assert of(store, 1) == first
    assert sorted(str(p) for p in tmp_path.glob("bars/version=1/*/*.parquet")) == stored  # not written again
    names = {e[0]: e[1:] for e in got[0]}
    assert {k: (v[0], v[4]) for k, v in names.items()} == NAMES
    assert [(e[0], str(e[1]), e[2]) for e in got[2]] == [("NEW#0", "2001-09-10", 0.5), ("NEW#0", "2002-12-02", 0.2)]
    bars = {(e, d): c for e, d, _, _, _, c, _ in got[1]}
    assert bars["NEW#0", dt.date(2001, 1, 1)] == pytest.approx(10.0) and bars["NEW#0", dt.date(2003, 6, 18)] == 10.0
    assert len([1 for e, _ in bars if e == "NEW#0"]) == len({r[0] for r in archive()})  # a bar a day, also where both names traded
    row = store.runs().orderBy("version").collect()[-1]
    assert (row.version, row.events, row.entities) == (2, 2, len(names)) and set(row.parts.values()) == {1, 2}
    with pytest.raises(ValueError):
        store.entities(9)


def test_broken_publications_are_not_seen_and_are_written_over(spark, frames, tmp_path, monkeypatch):
    rows, events = frames
    store = UniverseStore(spark, str(tmp_path), 3, 50.0)
    store.publish(rows.where("date < '2002-07-01'"), events)
    before = store.daily().count()
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(UniverseStore, "_run_row", lambda *_: (_ for _ in ()).throw(RuntimeError()))
        store.publish(rows.where("date >= '2002-07-01'"), events)
    assert store.run().version == 1 and store.daily().count() == before
    assert store.publish(rows.where("date >= '2002-07-01'"), events) == 2
    # a quarter sent again takes the place of what was stored of it, rows repeated in it count once
    later = rows.where("date >= '2003-01-01' and date < '2003-04-01' and symbol <> 'STEADY'")
    store.publish(later.unionByName(later), events)
    want = jobs.build_point_in_time(rows.where("date < '2003-01-01' or date >= '2003-04-01' or symbol <> 'STEADY'"), events, 3, 50.0)
    got = of(store)
    assert got == state(want.entities, want.daily, want.events, want.members)
    store.expire()
    assert store.daily().count() == len(got[1]) and store.runs().count() == 1 and not list(tmp_path.glob("names/version=1"))
    with pytest.raises(ValueError):
        store.expire(0)


def test_empty_tables_and_nulls(spark, frames, tmp_path):
    rows, events = frames
    store = UniverseStore(spark, str(tmp_path), 3, 50.0)
    assert store.daily().count() == 0
    bad = rows.limit(1).selectExpr("date", "cast(null as string) as symbol", "isin", "open", "high", "low", "close", "volume", "value")
    assert store.publish(bad.unionByName(rows.where("false")), events) == 1
    assert of(store) == ([], [], [], [])
    with pytest.raises(ValueError):
        UniverseStore(spark, str(tmp_path), 3, max_gap_days=30)
