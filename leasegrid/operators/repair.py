"""Repairs of extracted schedules and charges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrid.functions.dates import month_index


def infer_ends(rows: DataFrame) -> DataFrame:
    """Missing ends as the day before the next known start, and whether that was done."""
    # Read from the last row up, so that the frame grows by one row at a time.
    after = Window.partitionBy("lease_id").orderBy(F.desc("period_idx")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.date_sub(F.last("period_start", ignorenulls=True).over(after), 1)
    open_ = F.col("period_end").isNull() & F.col("period_start").isNotNull()
    return rows.select(
        "lease_id", "period_idx", "period_start", F.when(open_, following).otherwise(F.col("period_end")).alias("period_end"),
        (open_ & following.isNotNull()).alias("end_inferred"), "monthly_rent",
    )


def collapse(rows: DataFrame, value: str = "monthly_rent") -> DataFrame:
    """Only the rows whose value differs from the one before."""
    order = Window.partitionBy("lease_id").orderBy("month_num")
    return rows.withColumn("before", F.lag(value).over(order)).where(~F.col(value).eqNullSafe(F.col("before")) | (F.col("month_num") == 1)).drop("before")


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("first_of", F.row_number().over(w)).where("first_of = 1").drop("first_of")


def claim_slots(charges: DataFrame) -> DataFrame:
    """The most trusted charge of each bucket takes its slot, the rest custom_1, custom_2, ..."""
    order = [F.desc("confidence"), F.col("ord")]
    rows = charges.withColumn("place", F.row_number().over(Window.partitionBy("lease_id", "bucket").orderBy(*order)))
    own = F.col("bucket").isNotNull() & (F.col("place") == 1)
    rows = rows.withColumn("own", own)
    number = F.row_number().over(Window.partitionBy("lease_id", "own").orderBy(*order))
    return rows.select("lease_id", "ord", "bucket", "confidence", F.when(F.col("own"), F.col("bucket")).otherwise(F.concat(F.lit("custom_"), number.cast("string"))).alias("slot"))


def padded(items: DataFrame, leases: DataFrame, slots: int) -> DataFrame:
    """Exactly slots rows per lease: its items in order, those beyond cut off, empty ones filled in."""
    numbered = items.withColumn("slot", F.row_number().over(Window.partitionBy("lease_id").orderBy("ord")).cast("long")).where(F.col("slot") <= slots)
    every = leases.select("lease_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(slots).cast("long"))).alias("slot"))
    return every.join(numbered, ["lease_id", "slot"], "left").select("lease_id", "slot", "label", "date", F.coalesce("amount", F.lit(0.0)).alias("amount"))


def reanchor(periods: DataFrame, anchors: DataFrame) -> DataFrame:
    """Periods moved to a new start date with their months kept."""
    start = F.min("period_start").over(Window.partitionBy("lease_id"))
    rows = periods.withColumn("origin", start).join(anchors, "lease_id")
    at = lambda d: month_index(d) - month_index(F.col("origin"))
    return rows.select(
        "lease_id", "period_idx", F.add_months("anchor", at(F.col("period_start")).cast("int")).alias("period_start"),
        F.date_sub(F.add_months("anchor", at(F.date_add("period_end", 1)).cast("int")), 1).alias("period_end"), "monthly_rent",
    )


def extraction_confidence(x: DataFrame) -> DataFrame:
    """Weighted score of six fields from (doc_id, n_rows, n_valid_rents, n_flags, provider, has_nnn, n_valid_dates)."""
    n = F.col("n_rows")
    schedule = F.when(n >= 3, 1.0).when(n > 0, 0.5).otherwise(0.0)
    rents = F.when(n > 0, F.col("n_valid_rents") / n).otherwise(0.0)
    flags = F.when(F.col("n_flags") == 0, 1.0).when(F.col("n_flags") <= 3, 0.6).otherwise(0.2)
    provider = F.when(F.col("provider") == "high", 1.0).when(F.col("provider") == "medium", 0.6).otherwise(0.2)
    nnn = F.when(F.col("has_nnn"), 1.0).otherwise(0.5)
    dates = F.when(n > 0, F.col("n_valid_dates") / n).otherwise(0.0)
    overall = (schedule * 3 + rents * 2 + flags * 1.5 + provider * 1.5 + nnn * 0.5 + dates * 2) / 10.5
    rows = x.select("doc_id", F.round(overall, 9).alias("overall"))
    return rows.select("*", F.when(F.col("overall") >= 0.7, "high").when(F.col("overall") >= 0.4, "medium").otherwise("low").alias("level"))
