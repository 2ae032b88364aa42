"""Writers of the ledger and of its four sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leasegrid.operators import ledger, rollup, scenario

AUDIT = ["lease_id", "month_num", "period_start", "period_end", "scheduled_base_rent", "period_factor", "base_rent_proration_factor", "proration_basis", "abatement_days", "full_rent_days", "total_days", "concession_type", "override_keys"]


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header, in order of lease and month within each."""
    rows.sortWithinPartitions("lease_id", "month_num").write.csv(path, header=True, mode="overwrite")


def write_workbook(inputs: ledger.Inputs, path: str) -> None:
    """The schedule, the annual summary, the audit trail and the scenarios as Parquet tables under path.

    The schedule is written first and read again by the others, so the ledger is worked out once.
    """
    spark = inputs.months.sparkSession
    ledger.with_irregular(ledger.with_remaining(ledger.ledger(inputs))).write.parquet(f"{path}/lease_schedule", mode="overwrite")
    rows = spark.read.parquet(f"{path}/lease_schedule")
    rollup.annual_summary(rows).write.parquet(f"{path}/annual_summary", mode="overwrite")
    rows.select(*AUDIT).write.parquet(f"{path}/audit_trail", mode="overwrite")
    scenario.renegotiation_panel(rows, inputs.leases).write.parquet(f"{path}/renegotiation", mode="overwrite")
    scenario.exit_panel(rows, inputs.leases).write.parquet(f"{path}/exit", mode="overwrite")
