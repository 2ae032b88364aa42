"""The concession months of a schedule: the option tables of its workbook, and the runs that they form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leasegrid.functions.money import fix6

from .rollup import cents

#: Rows of an option table.
SLOTS = 10
# What a row of each table is called, and its total.
ROW_LABELS = {"abatement": "Abatement month", "free_rent": "Free rent month"}
TOTAL = "TOTAL"


def months(rows: DataFrame) -> DataFrame:
    """lease_id, kind, month_num, date, period_end, amount, pct of the rows of a ledger with a concession of
    their own month: of free rent the scheduled rent, of an abatement what is abated and its share."""
    own = rows.where("concession_scope = 'monthly_row' and concession_type is not null")
    free = F.col("concession_type") == "free_rent"
    share = F.when(F.col("concession_value_mode") == "percent", F.col("concession_value") / 100).when(F.col("scheduled_base_rent") > 0, F.col("abatement_amount") / F.col("scheduled_base_rent")).otherwise(0.0)
    return own.select(
        "lease_id", F.col("concession_type").alias("kind"), "month_num", F.col("period_start").alias("date"), "period_end",
        F.when(free, F.col("scheduled_base_rent")).otherwise(F.col("abatement_amount")).alias("amount"), F.when(~free, fix6(share)).alias("pct"),
    )


def option_tables(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """lease_id, kind, slot, label, month_num, date, amount, pct: both tables of every lease of a ledger, each
    of exactly slots rows, its months in order, empty ones after them, and a total (slot 0) of the rows that
    it has. Months past the last slot are in neither, as in the workbook; n_months tells how many there are."""
    place = F.row_number().over(Window.partitionBy("lease_id", "kind").orderBy("month_num"))
    found = months(rows).withColumn("slot", place).withColumn("n_months", F.count("*").over(Window.partitionBy("lease_id", "kind"))).where(F.col("slot") <= slots)
    sets = found.groupingSets([["lease_id", "kind", "slot"], ["lease_id", "kind"]], "lease_id", "kind", "slot").agg(
        F.grouping("slot").alias("is_total"), F.max("month_num").alias("month_num"), F.max("date").alias("date"), cents("amount").alias("amount"), F.max("pct").alias("pct"), F.max("n_months").alias("n_months")
    )
    one = F.col("is_total") == 0
    sets = sets.select("lease_id", "kind", F.when(one, F.col("slot")).otherwise(0).alias("slot"), *[F.when(one, F.col(c)).alias(c) for c in ("month_num", "date", "pct")], "amount", "n_months")
    every = rows.select("lease_id").distinct().select("lease_id", F.explode(F.array(*map(F.lit, ROW_LABELS))).alias("kind")).select("*", F.explode(F.sequence(F.lit(0), F.lit(slots))).alias("slot"))
    label = F.when(F.col("slot") == 0, TOTAL)
    for kind, name in ROW_LABELS.items():
        label = label.when(F.col("kind") == kind, name)
    total = F.when(F.col("slot") == 0, F.coalesce("amount", F.lit(0.0))).otherwise(F.col("amount"))
    return every.join(sets, ["lease_id", "kind", "slot"], "left").select("lease_id", "kind", F.col("slot").cast("long").alias("slot"), label.alias("label"), "month_num", "date", total.alias("amount"), "pct", "n_months")


def runs(rows: DataFrame) -> DataFrame:
    """lease_id, kind, run, first_month, last_month, start_date, end_date, n_months, amount: the adjoining
    concession months of each kind and share as one, and a row of totals (run 0) for each kind."""
    each = Window.partitionBy("lease_id", "kind", "pct").orderBy("month_num")
    own = months(rows).withColumn("island", F.col("month_num") - F.row_number().over(each))
    islands = own.groupBy("lease_id", "kind", "pct", "island").agg(
        F.min("month_num").alias("first_month"), F.max("month_num").alias("last_month"), F.min("date").alias("start_date"), F.max("period_end").alias("end_date"), F.count("*").alias("n_months"), cents("amount").alias("amount")
    )
    islands = islands.withColumn("run", F.row_number().over(Window.partitionBy("lease_id", "kind").orderBy("first_month")).cast("long"))
    sets = islands.groupingSets([["lease_id", "kind", "run"], ["lease_id", "kind"]], "lease_id", "kind", "run")
    out = sets.agg(
        F.grouping("run").alias("is_total"), F.min("first_month").alias("first_month"), F.max("last_month").alias("last_month"), F.min("start_date").alias("start_date"),
        F.max("end_date").alias("end_date"), F.sum("n_months").alias("n_months"), cents("amount").alias("amount"),
    )
    return out.select("lease_id", "kind", F.when(F.col("is_total") == 1, 0).otherwise(F.col("run")).alias("run"), "first_month", "last_month", "start_date", "end_date", "n_months", "amount")
