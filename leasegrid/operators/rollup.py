"""Roll-ups of the ledger: annual summary, panels, assumptions and tie-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrid.functions.money import whole_cents


def cents(c: str | Column) -> Column:
    """Aggregate: an exact sum of amounts of whole cents, in any order."""
    return F.coalesce(F.sum(whole_cents(c)), F.lit(0)) / F.lit(100.0)


def annual_summary(ledger: DataFrame) -> DataFrame:
    """By lease year, with each year's share of the lease's obligation (0 if that is 0)."""
    rows = ledger.groupBy("lease_id", "year_num").agg(
        F.min("period_start").alias("year_start"), F.max_by("period_end", "month_num").alias("year_end"), F.count("*").alias("n_months"),
        cents("base_rent_applied").alias("base_rent"), cents("total_nnn_amount").alias("nnn"), cents("total_other_charges_amount").alias("other"),
        cents("total_monthly_obligation").alias("obligation"),
    )
    total = F.sum(whole_cents("obligation")).over(Window.partitionBy("lease_id")) / F.lit(100.0)
    return rows.withColumn("share", F.when(total == 0, 0.0).otherwise(F.col("obligation") / total))


def annual_rollup(ledger: DataFrame) -> DataFrame:
    """By lease year and a grand total per lease, whose year_num is null."""
    rows = ledger.groupingSets([["lease_id", "year_num"], ["lease_id"]], "lease_id", "year_num")
    return rows.agg(
        (F.grouping("year_num") == 1).alias("is_total"), F.count("*").alias("n_months"),
        cents("base_rent_applied").alias("base_rent"), cents("total_nnn_amount").alias("nnn"), cents("total_monthly_obligation").alias("obligation"),
    )


def summary_panel(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("lease_id").agg(
        F.count("*").alias("term_months"), F.min("period_start").alias("lease_start"), F.max("period_end").alias("lease_end"),
        cents("base_rent_applied").alias("total_base_rent"), cents("total_nnn_amount").alias("total_nnn"), cents("one_time_charges_amount").alias("total_one_time"),
        cents("total_other_charges_amount").alias("total_other"), cents("abatement_amount").alias("total_abatement"), cents("total_monthly_obligation").alias("total_obligation"),
    )


def tie_out(ledger: DataFrame) -> DataFrame:
    """The first row's remaining balances against the sums of the rows."""
    rows = ledger.groupBy("lease_id").agg(
        F.min_by("total_obligation_remaining", "month_num").alias("head_obligation"), cents("total_monthly_obligation").alias("sum_obligation"),
        F.min_by("total_base_rent_remaining", "month_num").alias("head_base_rent"), cents("base_rent_applied").alias("sum_base_rent"),
    )
    return rows.withColumn("ties", (F.abs(F.col("head_obligation") - F.col("sum_obligation")) < 0.01) & (F.abs(F.col("head_base_rent") - F.col("sum_base_rent")) < 0.01))


def assumptions(ledger: DataFrame, leases: DataFrame) -> DataFrame:
    """One row of derived scalars per lease."""
    analysis = leases.select("lease_id", "analysis_date")
    abated = (F.col("is_concession_row")) & (F.col("concession_type") == "abatement")
    free = (F.col("is_concession_row")) & (F.col("concession_type") == "free_rent")
    at = lambda c, when: F.min_by(c, F.when(when, F.col("month_num")))
    rows = ledger.join(analysis, "lease_id").groupBy("lease_id").agg(
        F.count("*").alias("term_months"), F.min_by("scheduled_base_rent", "month_num").alias("year1_rent"), at("scheduled_base_rent", F.col("year_num") == 2).alias("year2_rent"),
        F.count_if(free).alias("free_months"), at("period_start", free).alias("free_start"), F.max(F.when(free, F.col("period_end"))).alias("free_end"),
        F.count_if(abated).alias("abated_months"), at("period_start", abated).alias("abated_start"),
        F.min_by("concession_value", F.when(abated & (F.col("concession_value_mode") == "percent"), F.col("month_num"))).alias("abated_pct"),
        F.count_if(F.col("is_concession_row") & (F.col("base_rent_applied") == 0)).alias("fully_abated_months"),
        at("base_rent_proration_factor", F.col("proration_basis") == "concession-boundary").alias("boundary_factor"),
        cents(F.when(free, F.col("abatement_amount"))).alias("free_total"), cents(F.when(abated, F.col("abatement_amount"))).alias("abated_total"),
        F.coalesce(F.max(F.when(F.col("period_start") <= F.col("analysis_date"), F.col("month_num"))), F.lit(0)).alias("effective_month"),
    )
    return rows.withColumn("inferred_escalation", F.when((F.col("year1_rent") > 0) & F.col("year2_rent").isNotNull(), F.col("year2_rent") / F.col("year1_rent") - 1).otherwise(F.lit(0.0))).withColumn(
        "months_remaining", F.col("term_months") - F.col("effective_month")
    ).withColumn("months_to_escalation", F.when(F.col("effective_month") == 0, 0).otherwise(12 - F.pmod(F.col("effective_month") - 1, F.lit(12))).cast("long"))


def stub_years(ledger: DataFrame) -> DataFrame:
    """Leases whose first or last year has under 12 months."""
    years = ledger.groupBy("lease_id", "year_num").agg(F.count("*").alias("n"))
    rows = years.groupBy("lease_id").agg(F.min_by("n", "year_num").alias("first_year_months"), F.max_by("n", "year_num").alias("last_year_months"), F.count("*").alias("n_years"))
    return rows.where("first_year_months < 12 or last_year_months < 12")
