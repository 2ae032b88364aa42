"""Every query by name: an operator over the derived portfolio, or over a table as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leasegrid.functions.money import fix2, fix6
from leasegrid.operators import generate, ledger, quality, rollup, scenario
from leasegrid.operators.match import assign
from leasegrid.operators.rollup import cents
from leasegrid.sources.portfolio import Portfolio


def periods(p: Portfolio) -> DataFrame:
    return generate.quick_entry(p.leases())


def dealt_periods(p: Portfolio) -> DataFrame:
    """periods(), of leases that are dealt first: windows and joins by lease need no further exchange."""
    return generate.quick_entry(p.by_lease(p.own_leases()))


def laid_out(p: Portfolio) -> DataFrame:
    return generate.bounded(generate.expand(dealt_periods(p)))


def months(p: Portfolio) -> DataFrame:
    # A plan does not know how many months a lease has and takes them for as few as the leases: without
    # this hint the months of a portfolio of some MB are broadcast, through the driver.
    return laid_out(p).hint("merge")


def inputs(p: Portfolio) -> ledger.Inputs:
    return ledger.Inputs(p.dealt(), laid_out(p), p.charges(), p.concessions(), p.overrides(), p.one_time())


def rows(p: Portfolio) -> DataFrame:
    return ledger.ledger(inputs(p))


def balances(p: Portfolio) -> DataFrame:
    return ledger.with_remaining(rows(p))


def charge_rows(p: Portfolio) -> DataFrame:
    return ledger.charge_rows(p.charges(), months(p), p.overrides(), p.leases())


def duplicate_dates(p: Portfolio) -> DataFrame:
    own = periods(p)
    return generate.duplicates(own.unionByName(own.where("period_idx = 1")))


def one_time_range_sum(p: Portfolio) -> DataFrame:
    own = months(p).select("lease_id", "month_num", "month_start", "row_end")
    found = assign(p.one_time().where("date is not null"), own, "date", "month_start", "row_end")
    return found.where("date between month_start and row_end").groupBy("lease_id", "month_num").agg(cents("amount").alias("amount"))


def audit_trail(p: Portfolio) -> DataFrame:
    source = F.coalesce("concession_type", F.when(F.col("base_rent_override_applied"), "override").otherwise("none"))
    return rows(p).select(
        "lease_id", "month_num", "period_start", "period_end", "scheduled_base_rent", "period_factor", "base_rent_proration_factor", "proration_basis", source.alias("source"),
        "abatement_days", "full_rent_days", "total_days", "period_idx", "source_start", "source_end",
    )


def formula_eligibility(p: Portfolio, commencement_days: int = 30) -> DataFrame:
    """Which cells an annual formula gives, with rent due from commencement_days after the start."""
    own = rows(p).join(p.leases().select("lease_id", "commence"), "lease_id")
    return own.select(
        "lease_id", "month_num", F.when(F.col("period_end") < F.date_add("commence", commencement_days), 0.0).otherwise(F.col("scheduled_base_rent")).alias("expected_scheduled"),
        (~F.col("base_rent_override_applied") & F.col("concession_type").isNull()).alias("base_rent_is_formula"), (F.col("override_keys") == "").alias("charges_are_formula"),
    )


def changed(p: Portfolio, **columns: str) -> DataFrame:
    """The periods with some values made implausible, for the rules to find."""
    return periods(p).withColumns({k: F.expr(v) for k, v in columns.items()})


IRREGULAR = ["lease_id", "month_num", "inferred_annual_base_rent", "is_irregular_base_rent", "base_rent_escalation_type", "irregular_escalation_targets", "has_irregular_escalation"]
MONTHS = ["lease_id", "month_num", "year_num", "month_start", "explicit_end", "monthly_rent", "period_idx", "source_start", "source_end"]

PLANS: dict[str, Callable[[Portfolio], DataFrame]] = {
    "quick_entry_periods": periods,
    "month_expansion": lambda p: generate.expand(periods(p)).select(*MONTHS),
    "duplicate_dates": duplicate_dates,
    "row_bounds": lambda p: months(p).select("lease_id", "month_num", "month_start", "row_end", "is_last"),
    "final_month_proration": lambda p: months(p).where("is_last").select("lease_id", "month_num", "actual_days", "cal_month_days", fix6("factor").alias("factor")),
    "charge_schedule": lambda p: charge_rows(p).where("key <> 'nnn_aggregate'"),
    "aggregate_nnn": lambda p: charge_rows(p).where("key = 'nnn_aggregate'").select("lease_id", "month_num", "amount"),
    "one_time_assignment": lambda p: ledger.one_time_rows(p.one_time(), months(p)).withColumn("amount", fix2("amount")),
    "one_time_range_sum": one_time_range_sum,
    "override_ffill": lambda p: ledger.scheduled(months(p), p.overrides()).where("base_override is not null").select("lease_id", "month_num", "base_override", "scheduled"),
    "explicit_concessions": lambda p: ledger.explicit_concessions(p.concessions(), months(p)).select("lease_id", "month_num", "e.type", "e.value_mode", "e.value"),
    "window_concessions": lambda p: ledger.window_concessions(p.concessions(), months(p)).select("lease_id", "month_num", "w.type", "w.value_mode", "w.value", F.col("overlap").cast("long").alias("overlap")),
    "monthly_ledger": rows,
    "remaining_balances": lambda p: balances(p).select("lease_id", "month_num", *ledger.REMAINING),
    "irregular_flags": lambda p: ledger.with_irregular(rows(p)).select(*IRREGULAR),
    "annual_summary": lambda p: rollup.annual_summary(rows(p)),
    "annual_rollup": lambda p: rollup.annual_rollup(rows(p)),
    "summary_panel": lambda p: rollup.summary_panel(rows(p)),
    "tie_out": lambda p: rollup.tie_out(balances(p)),
    "assumptions": lambda p: rollup.assumptions(rows(p), p.by_lease(p.own_leases())),
    "audit_trail": audit_trail,
    "formula_eligibility": formula_eligibility,
    "inline_scenarios": lambda p: scenario.inline(balances(p)),
    "renegotiation_checkpoints": lambda p: scenario.at_checkpoints(balances(p), True),
    "exit_checkpoints": lambda p: scenario.at_checkpoints(balances(p), False),
    "asof_backward_snapshot": lambda p: scenario.snapshot(rows(p), p.by_lease(p.own_leases())),
    "asof_forward_remaining": lambda p: scenario.asof_remaining(rows(p), p.by_lease(p.own_leases())),
    "npv_from_date": lambda p: scenario.values(rows(p), p.by_lease(p.own_leases())),
    "renegotiation_panel": lambda p: scenario.renegotiation_panel(rows(p), p.by_lease(p.own_leases())),
    "exit_panel": lambda p: scenario.exit_panel(rows(p), p.by_lease(p.own_leases())),
    "schedule_gaps": lambda p: quality.gaps(changed(p, period_start="case when period_idx = 1 then date_add(period_start, 45) else period_start end")),
    "schedule_overlaps": lambda p: quality.overlaps(changed(p, period_start="case when period_idx = 2 then date_sub(period_start, 20) else period_start end")),
    "rent_jumps": lambda p: quality.jumps(changed(p, monthly_rent="monthly_rent * case when period_idx = 1 and lease_id % 3 = 0 then 1.2D when period_idx = 2 then 0.4D else 1D end")),
    "rent_value_checks": lambda p: quality.rent_values(changed(p, monthly_rent="case lease_id % 7 when 0 then -monthly_rent when 1 then monthly_rent * 1000 when 2 then 0.5D else monthly_rent end")),
    "term_checks": lambda p: quality.terms(changed(p, period_start="case when lease_id % 5 = 0 then add_months(period_start, -480) else period_start end", period_end="case when lease_id % 11 = 0 then add_months(period_end, -24) else period_end end")),
    "param_issues": lambda p: quality.param_issues(p.dealt(), p.charges(), p.overrides(), p.concessions(), months(p)),
    "stub_years": lambda p: rollup.stub_years(rows(p)),
    "template_invariants": lambda p: quality.invariants(rows(p), p.by_lease(p.own_leases())),
}


def named(plan: Callable[[Portfolio], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: plan(Portfolio(spark, folder))

