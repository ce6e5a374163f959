"""Column expressions with the NULL rules of the scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL for a zero divisor."""
    return F.try_divide(a, b)


def truth(condition: Column) -> Column:
    """A three-valued condition with unknown as false."""
    return F.coalesce(condition, F.lit(False))


def clipped(x: Column, low: float, high: float) -> Column:
    """``x`` held between two numbers; NULL stays NULL, which ``greatest`` alone would lose."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def linear(x: Column, zero_at: float, full_at: float) -> Column:
    """0 at ``zero_at`` to 100 at ``full_at``, in either direction."""
    return clipped((x - zero_at) / (full_at - zero_at), 0, 1) * 100


def half_even(x: Column, places: int) -> Column:
    """Rounding of the binary value, ties to even."""
    return F.rint(x * 10.0**places) / 10.0**places


def one_decimal(x: Column) -> Column:
    """``x`` as text with one decimal: of its binary value, ties to even.

    Ten times a double is rounded once more; what that rounding lost (the
    error of the sum 8x + 2x, whose parts are exact) tells on which side of a
    tie the value was.
    """
    ten = x * 8.0 + x * 2.0
    lost = x * 2.0 - (ten - x * 8.0)
    tie = ten - F.floor(ten) == 0.5
    whole = F.when(tie & (lost > 0), F.ceil(ten).cast("double")).when(tie & (lost < 0), F.floor(ten).cast("double")).otherwise(F.rint(ten))
    return F.format_string("%.1f", whole / 10.0)


def percent_rank(x: Column, by: list[str]) -> Column:
    """Average-tie rank over the number of known values, 0 to 100; NULL stays NULL."""
    over = Window.partitionBy(*by)
    position = F.rank().over(over.orderBy(x.asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), (position + (ties - 1) / 2) / F.count(x).over(over) * 100)


#: Values that are folded into one list: lists of a few are made and joined at the end, as a list is copied for each value put to it.
FOLD_BLOCK = 32


def folded(values: str, begin: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states after each of an array's values, of a recurrence ``step(state, value)`` from ``begin``."""
    last = lambda states: F.try_element_at(states, F.lit(-1))
    own = lambda block: F.slice(block, F.lit(2), F.lit(FOLD_BLOCK))

    def block(done: Column, i: Column) -> Column:
        some = F.slice(F.col(values), i * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK))
        carried = F.array(F.coalesce(last(last(done)), begin))  # a block's first state is the last of the block before
        return F.array_append(done, F.aggregate(some, carried, lambda states, x: F.array_append(states, step(last(states), x))))

    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / FOLD_BLOCK).cast("int"))
    none = F.slice(F.array(F.array(begin)), F.lit(2), F.lit(1))
    return F.flatten(F.transform(F.aggregate(blocks, none, block), own))


def rolling(agg: Column, x: Column, w: WindowSpec, rows: int, least: int | None = None, end: int = 0) -> Column:
    """An aggregate over the ``rows`` rows that end ``end`` rows from here, NULL with under ``least`` known values."""
    frame = w.rowsBetween(end - rows + 1, end)
    return F.when(F.count(x).over(frame) >= (rows if least is None else least), agg.over(frame))


def mean(x: Column, w: WindowSpec, rows: int, least: int | None = None, end: int = 0) -> Column:
    return rolling(F.avg(x), x, w, rows, least, end)


def change(x: Column, w: WindowSpec, rows: int) -> Column:
    """Per cent change against ``rows`` rows before."""
    return (ratio(x, F.lag(x, rows).over(w)) - 1) * 100


def monday(date: Column) -> Column:
    """Monday of the date's week; a weekend belongs to the week before it."""
    return F.to_date(F.date_trunc("week", date))
