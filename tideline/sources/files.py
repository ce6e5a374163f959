"""Parsers of price files, lists and corporate-action feeds: text first, explicit casts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.sources.lineage import cut

#: Column names of the delivery file, and what they become; fixed values.
DELIVERY = {
    "SYMBOL": "symbol", "SERIES": "series", "DATE1": "date", "PREV_CLOSE": "prev_close", "OPEN_PRICE": "open", "HIGH_PRICE": "high", "LOW_PRICE": "low", "CLOSE_PRICE": "close",
    "TTL_TRD_QNTY": "volume", "DELIV_QTY": "delivery_qty", "DELIV_PER": "delivery_pct",
}
#: The two layouts of the archive; fixed values.
ARCHIVE_NEW = {"TckrSymb": "symbol", "SctySrs": "series", "ISIN": "isin", "OpnPric": "open", "HghPric": "high", "LwPric": "low", "ClsPric": "close", "PrvsClsgPric": "prev_close", "TtlTradgVol": "volume", "TtlTrfVal": "value"}
ARCHIVE_OLD = {"SYMBOL": "symbol", "SERIES": "series", "ISIN": "isin", "OPEN": "open", "HIGH": "high", "LOW": "low", "CLOSE": "close", "PREVCLOSE": "prev_close", "TOTTRDQTY": "volume", "TOTTRDVAL": "value"}
ARCHIVE_NUMBERS = ["open", "high", "low", "close", "prev_close", "volume", "value"]


def number(c: Column) -> Column:
    """A trimmed number; a dash or anything else is NULL."""
    return F.nullif(F.trim(c), F.lit("-")).try_cast("double")


def preferred(rows: DataFrame, series: list[str], by: list[str]) -> DataFrame:
    """Rows of the wanted series, one a key, by the order of the list; inside a series the least row by its other columns."""
    place = F.array_position(F.array(*map(F.lit, series)), F.col("series"))
    w = Window.partitionBy(*by).orderBy(place, *(c for c in rows.columns if c not in by))
    return rows.where(F.col("series").isin(*series)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_delivery(spark: SparkSession, path: str, series: list[str]) -> DataFrame:
    """Daily price and delivery rows of CSV files; a missing column is an error."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False)
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    if missing := [c for c in DELIVERY if c not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    return preferred(delivery_rows(raw), series, ["symbol", "date"])


def delivery_rows(raw: DataFrame, *more: str) -> DataFrame:
    """Typed rows of the delivery file's text columns, and other columns as they are."""
    text = {"symbol", "series"}
    return raw.select(*more, *(F.trim(c).alias(n) if n in text else F.try_to_date(F.trim(c), "dd-MMM-yyyy").alias(n) if n == "date" else number(F.col(c)).alias(n) for c, n in DELIVERY.items()))


#: Columns of the day's file in their order; fixed values.
DAY_FILE = ["SYMBOL", "SERIES", "DATE1", "PREV_CLOSE", "OPEN_PRICE", "HIGH_PRICE", "LOW_PRICE", "LAST_PRICE", "CLOSE_PRICE", "AVG_PRICE", "TTL_TRD_QNTY", "TURNOVER_LACS", "NO_OF_TRADES", "DELIV_QTY", "DELIV_PER"]


@dataclass(frozen=True)
class Landed:
    """What a folder of day files holds: good rows, rows put aside with the reason, and a status for each file."""

    rows: DataFrame
    quarantine: DataFrame
    status: DataFrame


def day_wanted(name: Column) -> Column:
    """The day in a file's name, ``..yyyymmdd.csv``."""
    return F.to_date(F.regexp_extract(name, r"([0-9]{8})[.]csv", 1), "yyyyMMdd")


def land(spark: SparkSession, path: str) -> Landed:
    """Day files read once: typed rows with the day ``wanted``, what could not be read, and ``wanted, status, rows, bad`` of every file.

    A line of another number of fields, without symbol, or with a date or a
    close that is none is put aside with its text; the others of its file
    count.  A file is ``ok`` when all its good rows are of its own day,
    ``holiday`` when any is of another, ``unavailable`` when it has none.
    """
    schema = ", ".join(f"{c} string" for c in [*DAY_FILE, "_line"])
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(path)
    typed = delivery_rows(raw.withColumn("wanted", day_wanted(F.col("_metadata.file_name"))).withColumn("_text", F.coalesce("_line", F.to_csv(F.struct(*DAY_FILE)))), "wanted", "_line", "_text")
    reason = F.when(F.col("_line").isNotNull(), "fields").when(F.coalesce("symbol", F.lit("")) == "", "symbol").when(F.col("date").isNull(), "date").when(F.col("close").isNull(), "close")
    once = cut(typed.withColumn("reason", reason))
    good = F.col("reason").isNull()
    listed = spark.read.format("binaryFile").load(path).select(day_wanted(F.col("path")).alias("wanted")).distinct()  # names alone: no content is read
    seen = once.groupBy("wanted").agg(
        F.count_if(good).alias("rows"), F.count_if(~good).alias("bad"), F.min(F.when(good, F.col("date"))).alias("_a"), F.max(F.when(good, F.col("date"))).alias("_b")
    )
    state = F.when(F.coalesce("rows", F.lit(0)) == 0, "unavailable").when((F.col("_a") == F.col("wanted")) & (F.col("_b") == F.col("wanted")), "ok").otherwise("holiday")
    status = listed.join(seen, "wanted", "left").select("wanted", state.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bad", F.lit(0)).alias("bad"))
    return Landed(once.where(good).drop("_line", "_text", "reason"), once.where(~good).select("wanted", "reason", F.col("_text").alias("text")), status)


def file_status(rows: DataFrame, wanted: str) -> DataFrame:
    """``status``: ok where all rows are of the wanted date, holiday where of another, unavailable where there are none."""
    day = F.lit(wanted).cast("date")
    state = F.when(F.count("*") == 0, "unavailable").when((F.min("date") == day) & (F.max("date") == day), "ok").otherwise("holiday")
    return rows.agg(state.alias("status"))


def melt_vendor(wide: DataFrame) -> DataFrame:
    """Columns ``field|ticker`` to one row a date and ticker; rows without close go."""
    tickers = sorted({c.split("|")[1] for c in wide.columns if "|" in c})
    one = lambda t: F.struct(F.lit(t).alias("symbol"), *(F.col(f"`{f}|{t}`").cast("double").alias(f) if f"{f}|{t}" in wide.columns else F.lit(None).cast("double").alias(f) for f in ("open", "high", "low", "close", "volume")))
    rows = wide.select(F.to_date("date").alias("date"), F.explode(F.array(*map(one, tickers))).alias("r")).select("date", "r.*")
    return rows.where(F.col("close").isNotNull() & ~F.isnan("close"))


def read_constituents(spark: SparkSession, path: str) -> DataFrame:
    """``name, industry, symbol, series, isin`` of an index list; rows without symbol or ISIN go, one row an ISIN."""
    names = {"Company Name": "name", "Industry": "industry", "Symbol": "symbol", "Series": "series", "ISIN Code": "isin"}
    raw = spark.read.csv(path, header=True, inferSchema=False)
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    if missing := [c for c in names if c not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    out = raw.select(*(F.nullif(F.trim(c), F.lit("")).alias(n) for c, n in names.items())).where("symbol is not null and isin is not null")
    w = Window.partitionBy("isin").orderBy("symbol")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


_LISTED = "array<struct<symbol:string,isin:string,stage:string>>"


def parse_surveillance(rows: DataFrame) -> DataFrame:
    """``list_type, symbol, isin, stage`` of JSON columns ``asm`` (two nested lists) and ``gsm`` (one list), once a list and symbol."""
    asm = F.from_json("asm", f"longterm struct<data:{_LISTED}>, shortterm struct<data:{_LISTED}>")
    gsm = F.from_json("gsm", _LISTED)
    parts = [("ASM_LT", asm["longterm"]["data"]), ("ASM_ST", asm["shortterm"]["data"]), ("GSM", gsm)]
    out = None
    for name, items in parts:
        one = rows.select(F.lit(name).alias("list_type"), F.explode(items).alias("r")).select("list_type", F.trim("r.symbol").alias("symbol"), F.trim("r.isin").alias("isin"), "r.stage")
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("list_type", "symbol").orderBy("isin", "stage")
    return out.where("symbol is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Words of an action's subject, in lower case: of a bonus, of a change of face value, and of papers that are no shares; fixed values.
BONUS = "bonus"
FACE_VALUE = ["split", "splt", "sub-division", "sub division", "subdivision", "sub- division", "consolidat"]
NO_SHARES = ["debenture", "preference", "ncrps"]


def _amount(text: Column, leading: bool = False) -> Column:
    """The first amount of money in a text (one that it begins with): a currency mark, ``re`` or ``rs`` with or without a dot, and the number behind it."""
    number = F.regexp_extract(text, ("^ *" if leading else "") + r"(?:re|rs)\.? *([0-9][0-9.]*|\.[0-9.]+)", 1)
    return F.rtrim(number, F.lit(".")).try_cast("double")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def bonus_factor(subject: Column) -> Column:
    """``b / (a + b)`` of the first clause ``bonus a:b`` (also ``bonus issue a:b`` or ``bonus - a:b``), else 1."""
    clauses = F.slice(F.split(subject, BONUS), 2, 1 << 30)
    bare = F.transform(clauses, lambda c: F.regexp_replace(c, "^(?: +issue)? *-? *", ""))
    # what a clause has on either side of its first colon: nothing but a number on the left, a number at the beginning on the right
    left = lambda c: F.rtrim(F.substring_index(c, ":", 1))
    right = lambda c: F.regexp_extract(F.substring(c, F.instr(c, ":") + 1, F.lit(1 << 30)), "^ *([0-9]+)", 1)
    sides = F.transform(F.filter(bare, lambda c: c.contains(":")), lambda c: F.struct(left(c).alias("a"), right(c).alias("b")))
    first = F.get(F.filter(sides, lambda s: s["a"].rlike("^[0-9]+$") & (s["b"] != "")), F.lit(0))

    def factor(side: Column) -> Column:
        return F.when((side["a"] > 0) & (side["b"] > 0), side["b"] / (side["a"] + side["b"])).otherwise(1.0)

    return _let(first, lambda s: _let(F.struct(s["a"].try_cast("double").alias("a"), s["b"].try_cast("double").alias("b")), factor))


def split_factor(subject: Column) -> Column:
    """New over old face value of ``split .. Rs x .. to Rs y``, also of its other words, else 1; a number without a currency mark is no face value."""
    one = FACE_VALUE[0]
    named = reduce(lambda text, word: F.replace(text, F.lit(word), F.lit(one)), FACE_VALUE[1:], subject)

    def after(text: Column) -> Column:
        behind = F.substring(text, F.instr(text, one) + len(one), F.lit(1 << 30))
        # pieces between the "to"s: the first with an amount, and the first after it that begins with one
        return _let(F.transform(F.split(behind, "to"), lambda p: F.struct(_amount(p).alias("any"), _amount(p, True).alias("new"))), amounts)

    def amounts(pieces: Column) -> Column:
        return _let(F.array_position(F.transform(pieces, lambda p: p["any"].isNotNull()), True).cast("int"), lambda first: values(pieces, first))

    def values(pieces: Column, first: Column) -> Column:
        later = F.slice(pieces, first + 1, F.greatest(F.size(pieces) - first, F.lit(0)))
        x, y = F.get(pieces, first - 1)["any"], F.get(F.filter(later, lambda p: p["new"].isNotNull()), F.lit(0))["new"]
        return _let(F.struct(x.alias("x"), y.alias("y")), lambda v: F.when((first > 0) & (v["x"] > 0) & (v["y"] > 0), v["y"] / v["x"]).otherwise(1.0))

    return _let(named, lambda text: F.when(F.instr(text, one) > 0, after(text)).otherwise(1.0))


def price_factor(subject: Column) -> Column:
    """What prices before an action are multiplied by: for a bonus, for a new face value, or for both; NULL for neither, and for papers that are no shares."""
    other = lambda low: reduce(lambda a, b: a | b, (low.contains(w) for w in NO_SHARES))
    both = lambda low: _let(bonus_factor(low) * split_factor(low), lambda f: F.when(f != 1.0, f))
    return _let(F.regexp_replace(F.lower(subject), r"\s+", " "), lambda low: F.when(~other(low), both(low)))


def corporate_actions(feed: DataFrame, start: str, end: str) -> DataFrame:
    """``symbol, isin, ex_date, factor`` of a JSON feed's rows (symbol, isin, exDate, subject), once each, in a range of dates."""
    out = feed.select(F.trim("symbol").alias("symbol"), F.trim("isin").alias("isin"), F.try_to_date("exDate", "dd-MMM-yyyy").alias("ex_date"), price_factor(F.col("subject")).alias("factor"))
    return out.where(F.col("factor").isNotNull() & F.col("ex_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).distinct()


#: Headers and columns of the export, and those the extended one adds, in order; fixed values.
EXPORT = {
    "Symbol": "symbol", "Price": "price", "Direction": "direction", "Weeks in Trend": "weeks_in_trend", "Flip Date": "flip_date", "Flip Price": "flip_price", "% Since Flip": "pct_since_flip",
    "52W High": "high_52w", "52W Low": "low_52w", "% from High": "pct_from_high", "SMA50": "sma50", "SMA150": "sma150", "SMA200": "sma200", "1M%": "ret_1m", "3M%": "ret_3m",
    "Avg Vol (20d)": "avg_vol_20d", "Market Cap (Cr)": "market_cap_cr", "Sector": "industry", "Index": "index_list",
}
EXPORT_MORE = {
    "RS Rating": "rs_rating", "Stock Score": "stock_score", "Grade": "grade", "Sector Rank": "sector_rank", "Sector Score": "sector_score", "ST Value (Stop)": "st_value", "Risk %": "risk_pct",
    "ATR%": "atr_pct", "Vol Ratio": "vol_ratio", "Delivery %": "delivery_pct_20d", "SMA100": "sma100", "6M%": "ret_6m", "12M%": "ret_12m", "Strict 8 Filter": "qualified", "Reasons": "reasons",
}
EXPORT_WHOLE = {"weeks_in_trend", "avg_vol_20d", "rs_rating", "sector_rank"}


def export_rows(stocks: DataFrame, extended: bool = False) -> DataFrame:
    """The export's columns in order, bullish and best first; numbers rounded half-even, to two places or whole."""
    kinds = dict(stocks.dtypes)

    def shown(c: str) -> Column:
        if c in EXPORT_WHOLE:
            return F.rint(F.col(c).cast("double")).cast("long")
        if c == "qualified":
            return F.when(F.col(c), "Yes").otherwise("No")
        if kinds[c] == "date":
            return F.date_format(c, "yyyy-MM-dd")
        return F.rint(F.col(c) * 100) / 100 if kinds[c] in ("double", "float") else F.col(c)

    names = EXPORT | (EXPORT_MORE if extended else {})
    return stocks.orderBy(F.desc("direction"), F.desc_nulls_last("stock_score"), "symbol").select(*(shown(c).alias(h) for h, c in names.items()))


def write_csv(stocks: DataFrame, path: str, extended: bool = False) -> None:
    """One quoted-where-needed CSV file; an export is one week's rows, so one file holds it."""
    export_rows(stocks, extended).coalesce(1).write.mode("overwrite").option("escape", '"').csv(path, header=True)
