"""Queries over concession months, and their SQL. Portfolios have few such months a lease, so some are added."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasegrid.operators import ledger, options
from leasegrid.plans import oracle
from leasegrid.plans.queries import PLANS, inputs
from leasegrid.sources.portfolio import Portfolio


def conceded(p: Portfolio) -> DataFrame:
    """The ledger with more concessions: by lease up to fifteen months of free rent with gaps, and as many
    of abatements by amount or share."""
    n = (F.col("lease_id") % 16).cast("int")
    k = F.explode(F.sequence(F.lit(0), n)).alias("k")
    more = p.leases().where("priority = '4-NOT SPECIFIED'").select("lease_id", "commence", k)
    free = (F.col("lease_id") + F.floor(F.col("k") / 4)) % 2 == 0
    percent = F.col("k") % 8 < 6
    none = F.lit(None).cast("date")
    more = more.where("k % 5 <> 3").select(
        "lease_id", (F.col("k") + 100).cast("int").alias("ord"), F.when(free, "free_rent").otherwise("abatement").alias("type"), F.lit("monthly_row").alias("scope"),
        F.when(~free, F.when(percent, "percent").otherwise("fixed_amount")).alias("value_mode"), F.when(free, 100.0).when(percent, 50.0).otherwise(250.0).alias("value"), F.add_months("commence", F.col("k")).alias("effective_date"), none.alias("start_date"), none.alias("end_date"),
    )
    own = inputs(p)
    return ledger.ledger(replace(own, concessions=own.concessions.unionByName(more)))


PLANS |= {"option_tables": lambda p: options.option_tables(conceded(p)), "concession_runs": lambda p: options.runs(conceded(p))}

_MORE = f"""SELECT lease_id, CAST(k+100 AS INTEGER) AS ord, CASE WHEN free THEN 'free_rent' ELSE 'abatement' END AS type, 'monthly_row' AS scope, CASE WHEN free THEN NULL WHEN k%8<6 THEN 'percent' ELSE 'fixed_amount' END AS value_mode,
  CASE WHEN free THEN 100e0 WHEN k%8<6 THEN 50e0 ELSE 250e0 END AS value, {oracle.add_m('commence', 'k')} AS effective_date, NULL AS start_date, NULL AS end_date
  FROM (SELECT *, (lease_id + k//4)%2=0 AS free FROM (SELECT lease_id, commence, unnest(range(0, CAST(lease_id%16 AS INTEGER)+1)) AS k FROM leases WHERE priority='4-NOT SPECIFIED') WHERE k%5<>3)"""
_TABLES = {"concessions": f"{dict(oracle.TABLES)['concessions']} UNION ALL {_MORE}"}
_MONTHS = f""", c AS (SELECT lease_id, concession_type AS kind, month_num, period_start AS date, period_end, CASE WHEN concession_type='free_rent' THEN scheduled_base_rent ELSE abatement_amount END AS amount,
  CASE WHEN concession_type<>'free_rent' THEN {oracle.f6("CASE WHEN concession_value_mode='percent' THEN concession_value/100 WHEN scheduled_base_rent>0 THEN abatement_amount/scheduled_base_rent ELSE 0e0 END")} END AS pct FROM ledger WHERE concession_scope='monthly_row')"""

ORACLE_SQL = {
    "option_tables": oracle.sql(_MONTHS + f""", n AS (SELECT *, row_number() OVER (PARTITION BY lease_id, kind ORDER BY month_num) AS slot, count(*) OVER (PARTITION BY lease_id, kind) AS n_months FROM c),
      t AS (SELECT lease_id, kind, 0 AS slot, NULL AS month_num, NULL AS date, {oracle.cents('amount')} AS amount, NULL AS pct, max(n_months) AS n_months FROM n WHERE slot<={options.SLOTS} GROUP BY ALL UNION ALL SELECT lease_id, kind, slot, month_num, date, amount, pct, n_months FROM n WHERE slot<={options.SLOTS})
      SELECT e.lease_id, e.kind, s.slot, CASE WHEN s.slot=0 THEN 'TOTAL' ELSE e.label END AS label, t.month_num, t.date, CASE WHEN s.slot=0 THEN coalesce(t.amount, 0e0) ELSE t.amount END AS amount, t.pct, t.n_months
      FROM (SELECT DISTINCT lease_id, kind, label FROM ledger, (VALUES ('abatement', 'Abatement month'), ('free_rent', 'Free rent month')) v(kind, label)) e, (SELECT unnest(range(0, {options.SLOTS + 1})) AS slot) s LEFT JOIN t ON t.lease_id=e.lease_id AND t.kind=e.kind AND t.slot=s.slot""", "ledger", _TABLES),
    "concession_runs": oracle.sql(_MONTHS + f""", g AS (SELECT *, month_num - row_number() OVER (PARTITION BY lease_id, kind, pct ORDER BY month_num) AS island FROM c),
      i AS (SELECT lease_id, kind, min(month_num) AS first_month, max(month_num) AS last_month, min(date) AS start_date, max(period_end) AS end_date, count(*) AS n_months, {oracle.cents('amount')} AS amount FROM g GROUP BY lease_id, kind, pct, island),
      r AS (SELECT *, row_number() OVER (PARTITION BY lease_id, kind ORDER BY first_month) AS run FROM i) SELECT lease_id, kind, run, first_month, last_month, start_date, end_date, n_months, amount FROM r
      UNION ALL SELECT lease_id, kind, 0, min(first_month), max(last_month), min(start_date), max(end_date), CAST(sum(n_months) AS BIGINT), {oracle.cents('amount')} FROM r GROUP BY ALL""", "ledger", _TABLES),
}
