"""Data-quality rules, each a set of rows (lease_id, rule_id, ord, severity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrid.functions.dates import months_inclusive


def flagged(rows: DataFrame, rules: list[tuple[str, str, Column]], ord_col: str = "ord") -> DataFrame:
    """A row for each rule (id, severity, condition) that a row breaks."""
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for i, s, c in rules]))
    return rows.select("lease_id", F.col(ord_col).cast("long").alias("ord"), F.explode(hits).alias("x")).select("lease_id", "ord", "x.rule_id", "x.severity")


def neighbours(periods: DataFrame) -> DataFrame:
    order = Window.partitionBy("lease_id").orderBy("period_idx")
    return periods.withColumn("before_end", F.lag("period_end").over(order)).withColumn("before_rent", F.lag("monthly_rent").over(order))


def gaps(periods: DataFrame) -> DataFrame:
    days = F.datediff("period_start", "before_end")
    return neighbours(periods).withColumn("gap_days", days.cast("long")).where("gap_days > 31").select("lease_id", "period_idx", "gap_days")


def overlaps(periods: DataFrame) -> DataFrame:
    return neighbours(periods).where("period_start <= before_end").select("lease_id", "period_idx", "period_start", "before_end")


def jumps(periods: DataFrame, up: float = 0.15, down: float = -0.5) -> DataFrame:
    change = (F.col("monthly_rent") - F.col("before_rent")) / F.col("before_rent")
    rows = neighbours(periods).where("before_rent > 0").withColumn("change", change)
    return rows.where((F.col("change") > up) | (F.col("change") < down)).select("lease_id", "period_idx", "before_rent", "monthly_rent", F.round("change", 6).alias("change"))


def rent_values(periods: DataFrame) -> DataFrame:
    r = F.col("monthly_rent")
    return flagged(periods, [("rent-negative", "warning", r < 0), ("rent-huge", "warning", r > 1_000_000), ("rent-fraction", "warning", (r > 0) & (r < 1))], "period_idx")


def terms(periods: DataFrame) -> DataFrame:
    """Dates out of range by period, and terms over 30 years or under a month by lease (ord -1)."""
    odd = lambda d: (F.year(d) < 1970) | (F.year(d) > 2070)
    rows = flagged(periods, [("start-year", "warning", odd("period_start")), ("end-year", "warning", odd("period_end")), ("end-before-start", "error", F.col("period_end") < F.col("period_start"))], "period_idx")
    years = F.datediff("last", "first") / F.lit(365.25)
    whole = periods.groupBy("lease_id").agg(F.min("period_start").alias("first"), F.max("period_end").alias("last")).withColumn("ord", F.lit(-1))
    return rows.unionByName(flagged(whole, [("term-long", "warning", years > 30), ("term-short", "warning", years < 1 / 12)]))


def param_issues(leases: DataFrame, charges: DataFrame, overrides: DataFrame, concessions: DataFrame, months: DataFrame) -> DataFrame:
    """The parameter rules: square footage, charges, overrides and concessions against the term."""
    # What is checked is one table of all kinds, which meets its lease's bounds once: the months are laid out once.
    bounds = months.groupBy("lease_id").agg(F.min("month_start").alias("lease_start"), F.max("row_end").alias("lease_end"), F.max("month_num").alias("term_months"))
    keys = charges.groupBy("lease_id").agg(F.collect_set("key").alias("keys"))
    aimed = overrides.join(keys, "lease_id", "left").withColumn("known", F.coalesce(F.array_contains("keys", F.col("target_key")), F.lit(False))).drop("keys")
    rows = leases.select("lease_id", "square_footage").withColumns({"ord": F.lit(0), "kind": F.lit("lease")})
    for kind, own in (("charge", charges.drop("key", "canonical_type")), ("override", aimed), ("concession", concessions)):
        rows = rows.unionByName(own.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    rows = rows.join(bounds, "lease_id", "left").withColumns({"has": F.col("lease_start").isNotNull(), "monthly_row": F.col("scope") == "monthly_row"})
    outside = lambda d: (F.col(d) < F.col("lease_start")) | (F.col(d) > F.col("lease_end"))
    past = months_inclusive(F.col("lease_start"), F.col("effective_date")) > F.col("term_months")
    rules = {
        "lease": [("square-footage", "warning", F.coalesce("square_footage", F.lit(0.0)) <= 0), ("no-rows", "warning", ~F.col("has"))],
        "charge": [
            ("charge-year1", "error", F.col("year1").isNull() | F.isnan("year1")), ("charge-escalation", "error", F.col("esc_pct").isNull() | F.isnan("esc_pct")),
            ("charge-start-outside", "warning", outside("charge_start")),
        ],
        "override": [
            ("override-target", "error", (F.col("target_key") != "base_rent") & ~F.col("known")), ("override-date", "error", F.col("effective_date").isNull()),
            ("override-outside", "warning", outside("effective_date")), ("override-amount", "error", F.col("amount").isNull()), ("override-negative", "error", F.col("amount") < 0),
        ],
        "concession": [
            ("concession-month", "error", F.col("monthly_row") & F.col("effective_date").isNull()), ("concession-past-term", "error", F.col("monthly_row") & past),
            ("abatement-value", "error", (F.col("type") == "abatement") & F.col("value").isNull()),
            ("abatement-mode", "error", (F.col("type") == "abatement") & ~F.coalesce("value_mode", F.lit("")).isin("percent", "fixed_amount")),
            ("abatement-percent", "error", (F.col("value_mode") == "percent") & ~F.col("value").between(0, 100)),
            ("window-dates", "error", ~F.col("monthly_row") & (F.col("end_date") < F.col("start_date"))),
        ],
    }
    own = lambda kind: F.col("kind") == kind if kind == "lease" else (F.col("kind") == kind) & F.col("has")
    return flagged(rows, [(name, severity, own(kind) & c) for kind, each in rules.items() for name, severity, c in each])


def invariants(ledger: DataFrame, leases: DataFrame) -> DataFrame:
    """Value rules that a ledger keeps, one row per lease: true where it holds."""
    order = Window.partitionBy("lease_id").orderBy("month_num")
    rows = ledger.withColumn("step", F.col("month_num") - F.coalesce(F.lag("month_num").over(order), F.lit(0)))
    every = lambda c: F.every(c)
    cent = lambda a, b: F.abs(a - b) < 0.005
    n = rows.groupBy("lease_id").agg(
        F.count("*").alias("n_months"), every(F.col("step") == 1).alias("months_sequential"), every(F.col("year_num") == F.floor((F.col("month_num") - 1) / 12) + 1).alias("years_every_12"),
        every(cent(F.col("total_monthly_obligation"), F.col("base_rent_applied") + F.col("total_nnn_amount") + F.col("total_other_charges_amount"))).alias("row_adds_up"),
        every(F.abs(F.col("base_rent_applied") + F.col("abatement_amount") - F.col("period_adjusted_base_rent")) < 0.015).alias("abatement_adds_up"),
        every(~F.isnan("total_monthly_obligation")).alias("no_nan"), every(F.col("period_end") >= F.col("period_start")).alias("ends_after_start"),
        F.max("period_end").alias("last_end"),
    )
    return n.join(leases.select("lease_id", "expire", "term"), "lease_id").select(
        "lease_id", "n_months", "months_sequential", "years_every_12", "row_adds_up", "abatement_adds_up", "no_nan", "ends_after_start",
        (F.abs(F.datediff("last_end", "expire")) <= 31).alias("ends_at_expiry"), F.col("n_months").between(1, 600).alias("term_in_range"),
    )
