"""Joins of dated events with monthly rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lease_bounds(months: DataFrame) -> DataFrame:
    return months.groupBy("lease_id").agg(F.min("month_start").alias("lease_start"), F.max("row_end").alias("lease_end"))


def assign(events: DataFrame, months: DataFrame, date: str, *carry: str) -> DataFrame:
    """Each event with the month_num of the row that holds its date; dates outside the term go to the
    nearest row, null dates to the first. Events of leases without rows are left out. The row's columns
    carry come along, and are null where no row starts by the date.

    A sweep: a lease's rows and events in one order by date, in which an event takes the last row read, so
    that a lease with any number of events costs the rows that it has and no pair of event and row is made.
    """
    # Rows follow each other without gaps, so the last that starts by a date is the one that holds it.
    held = events.join(months.where("month_num = 1").select("lease_id"), "lease_id", "left_semi")
    own = F.struct(*[F.col(c) for c in events.columns])
    every = held.select("lease_id", F.col(date).alias("swept_day"), F.lit(1).alias("is_event"), F.lit(None).cast("long").alias("month_num"), own.alias("event")).unionByName(
        months.select("lease_id", F.col("month_start").alias("swept_day"), F.lit(0).alias("is_event"), "month_num", *carry), allowMissingColumns=True
    )
    order = Window.partitionBy("lease_id").orderBy("swept_day", "is_event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(c, ignorenulls=True).over(order)
    every = every.withColumns({"month_num": F.coalesce(last("month_num"), F.lit(1).cast("long")), **{c: last(c) for c in carry}})
    return every.where("is_event = 1").select("event.*", "month_num", *carry).hint("merge")


def asof_backward(day: Column, value: Column) -> Column:
    """Aggregate: value of the last row that starts by day."""
    return F.max_by(value, F.when(F.col("month_start") <= day, F.col("month_start")))


def asof_forward(day: Column, value: Column) -> Column:
    """Aggregate: value of the first row that starts on or after day."""
    return F.min_by(value, F.when(F.col("month_start") >= day, F.col("month_start")))
