"""Joins of points and intervals by equality first: of calendar months, then the range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _month(c: Column) -> Column:
    return F.trunc(c, "month")


def within(spans: DataFrame, points: DataFrame, low: str, high: str, at: str = "date", inside: Column | None = None) -> DataFrame:
    """Rows of ``spans`` with the rows of ``points`` whose ``at`` lies from ``low`` to ``high``, both included.

    A span stands under every month it touches and meets the points of that
    month, so the join is one of equal keys, and no span meets a point of a
    month it has nothing to do with.  ``inside`` narrows the range further.
    An empty span (``high`` before ``low``) meets none.
    """
    cells = spans.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(_month(F.col(low)), _month(F.col(high)), F.expr("interval 1 month"))))
    fits = F.col(at).between(F.col(low), F.col(high))
    met = cells.join(points.withColumn("_cell", _month(F.col(at))), "_cell").drop("_cell")
    return met.where(fits if inside is None else fits & inside)


def latest_at(points: DataFrame, marks: DataFrame, at: str, mark: str) -> DataFrame:
    """``points`` with the latest ``mark`` at or before their date ``at``; those before the first mark have none and go.

    Marks and dates are both calendars (a few hundred rows a year), so they are
    put in one line, and the points are joined by their date.
    """
    dates = points.select(F.col(at).alias("_at")).distinct()
    line = dates.withColumn("_mark", F.lit(None).cast("date")).unionByName(marks.select(F.col(mark).alias("_at"), F.col(mark).alias("_mark")).distinct())
    w = Window.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = line.withColumn("_held", F.last("_mark", True).over(w)).where("_mark is null and _held is not null")
    return points.join(held.select(F.col("_at").alias(at), F.col("_held").alias(mark)), at)
