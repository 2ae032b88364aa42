"""Queries over charges that users define, from their keys to the exported table, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasegrid.operators import custom, generate, ledger
from leasegrid.plans import oracle
from leasegrid.plans.queries import PLANS, inputs, months
from leasegrid.sources.portfolio import ADDED, BUCKETS, LABELS, Portfolio


def charges(p: Portfolio) -> DataFrame:
    return custom.keyed(p.all_charges())


def amounts(p: Portfolio) -> DataFrame:
    return ledger.charge_rows(charges(p), months(p), p.overrides(), p.leases())


def custom_ledger(p: Portfolio) -> DataFrame:
    """The ledger with every charge of every lease in its totals."""
    return ledger.ledger(replace(inputs(p), charges=charges(p)))


TOTALS = ["lease_id", "month_num", "base_rent_applied", "total_nnn_amount", "total_other_charges_amount", "total_monthly_obligation", "override_keys"]


def seen_keys(p: Portfolio, own: DataFrame) -> DataFrame:
    """lease_id, seen: the keys of charges with an amount in some month but none in their terms, which an
    override has to give them. Only months of leases with such charges are laid out."""
    bare = own.where("not coalesce(year1 > 0, false)")
    leases = p.dealt().join(bare.select("lease_id").distinct(), "lease_id", "left_semi")
    rows = ledger.charge_rows(bare, generate.bounded(generate.expand(generate.quick_entry(leases))).hint("merge"), p.overrides(), leases)
    return rows.where("amount <> 0").groupBy("lease_id").agg(F.collect_set("key").alias("seen"))


def exported(p: Portfolio, mode: str, most: int = custom.MOST_COLUMNS) -> DataFrame:
    """The exported table of a mode. Columns of charges are added up where the ledger reads a lease's charges:
    no row is made for a month and a charge, and months are dealt and joined once."""
    own = charges(p)
    leases = p.by_lease(p.own_leases().where(F.col("nnn_mode") == mode))
    listed = own.where("canonical_type <> 'nnn'") if mode == "aggregate" else own
    listed = listed.groupBy("lease_id").agg(F.collect_list(F.struct("key", "canonical_type", "label", "year1")).alias("listed"))
    shown = leases.select("lease_id").hint("merge").join(listed, "lease_id").join(seen_keys(p, own).hint("merge"), "lease_id", "left")
    shown = shown.select("lease_id", F.filter("listed", lambda c: F.coalesce(c.year1 > 0, F.lit(False)) | F.coalesce(F.array_contains("seen", c.key), F.lit(False))).alias("shown"))
    names = custom.found_titles(custom.titles(shown.select(F.inline("shown")).select("canonical_type", "label")), most)
    if names is None:
        rows = amounts(p)
        return custom.schedule_table(ledger.with_remaining(custom_ledger(p)), rows, custom.active(rows, own, p.leases()), mode, most)
    numbers = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(i).alias("at")) for i, (kind, label) in enumerate(names)]) if names else F.array().cast("array<struct<kind: string, label: string, at: int>>")
    number = lambda c: F.get(F.filter(numbers, lambda n: (n.kind == c.canonical_type) & (n.label == c.label)), F.lit(0))["at"]
    columns = shown.select("lease_id", F.transform("shown", lambda c: F.struct(c.key.alias("key"), number(c).alias("at"))).alias("columns")).hint("merge")
    months = generate.bounded(generate.expand(generate.quick_entry(leases)))
    own_inputs = replace(inputs(p), leases=leases.hint("merge"), months=months, charges=own)
    return custom.schedule_columns(ledger.with_remaining(ledger.ledger(own_inputs, columns, list(names.values()))), list(names.values()), mode)


PLANS |= {
    "custom_charge_keys": charges,
    "custom_charge_totals": lambda p: custom.charge_totals(amounts(p), charges(p)),
    "custom_ledger": lambda p: custom_ledger(p).select(*TOTALS),
    "export_individual": lambda p: exported(p, "individual"),
    "export_aggregate": lambda p: exported(p, "aggregate"),
}

_CHARGES = f"""SELECT lease_id, ord, CASE WHEN first THEN {BUCKETS}[n+1] WHEN brings THEN 'custom_2' ELSE 'custom_' || (rank + CASE WHEN has AND rank >= 2 THEN 1 ELSE 0 END) END AS key,
  CASE WHEN first THEN CASE WHEN n<3 THEN 'nnn' ELSE 'other' END WHEN l_partkey%5<2 THEN 'nnn' ELSE 'other' END AS canonical_type, CASE WHEN first THEN {LABELS}[n+1] ELSE {ADDED}[l_partkey%5+1] END AS label,
  {oracle.f2('l_extendedprice/100')} AS year1, l_discount*100 AS esc_pct, CAST(l_shipdate AS DATE) AS charge_start FROM (
    SELECT *, row_number() OVER (PARTITION BY lease_id, NOT first AND NOT brings ORDER BY ord) AS rank, bool_or(brings) OVER (PARTITION BY lease_id) AS has FROM (
      SELECT *, NOT first AND l_suppkey%4=0 AND row_number() OVER (PARTITION BY lease_id, NOT first AND l_suppkey%4=0 ORDER BY ord)=1 AS brings FROM (
        SELECT *, row_number() OVER (PARTITION BY lease_id, n ORDER BY ord)=1 AS first FROM (
          SELECT *, l_orderkey AS lease_id, CAST((l_linenumber-1)%5 AS INTEGER) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_shipdate) AS ord FROM lineitem))))"""


def _sql(select: str, last: str) -> str:
    return oracle.sql(select, last, {"charges": _CHARGES})


def _exported(mode: str) -> str:
    labels = [*(LABELS + ADDED if mode == "individual" else LABELS[3:] + ADDED[2:])]
    sums = ", ".join(f"""CASE WHEN count(*) FILTER (WHERE label='{x}')>0 THEN {oracle.cents(f"CASE WHEN label='{x}' THEN amount END")} END AS "{x} ($)\"""" for x in labels)
    named = lambda columns: ", ".join(f'r.{c} AS "{t}"' for c, t in columns.items())
    combined = f'r.total_nnn_amount AS "{custom.NNN_COMBINED}", ' if mode == "aggregate" else ""
    return _sql(
        f""", seen AS (SELECT lease_id, key, bool_or(amount<>0) AS seen FROM charge_rows GROUP BY ALL),
        shown AS (SELECT c.lease_id, c.key, c.label FROM charges c JOIN leases l USING (lease_id) LEFT JOIN seen s ON s.lease_id=c.lease_id AND s.key=c.key
          WHERE l.nnn_mode='{mode}' AND NOT (l.nnn_mode='aggregate' AND c.canonical_type='nnn') AND (coalesce(s.seen, false) OR c.year1>0)),
        w AS (SELECT a.lease_id, a.month_num, {sums} FROM charge_rows a JOIN shown s ON s.lease_id=a.lease_id AND s.key=a.key GROUP BY ALL)
        SELECT r.lease_id, {named(custom.HEAD)}, {combined}w.* EXCLUDE (lease_id, month_num), {named(custom.TAIL)} FROM remaining r LEFT JOIN w ON w.lease_id=r.lease_id AND w.month_num=r.month_num WHERE r.nnn_mode='{mode}'""",
        "remaining",
    )


ORACLE_SQL = {
    "custom_charge_keys": _sql("SELECT * FROM charges", "charges"),
    "custom_charge_totals": _sql(f"SELECT lease_id, key, label, c.canonical_type, {oracle.cents('amount')} AS total, count(*) FILTER (WHERE amount<>0) AS n_months, min(month_num) FILTER (WHERE amount<>0) AS first_month FROM charge_rows r JOIN charges c USING (lease_id, key) GROUP BY ALL", "charge_rows"),
    "custom_ledger": _sql(f"SELECT {', '.join(TOTALS)} FROM ledger", "ledger"),
    "export_individual": _exported("individual"),
    "export_aggregate": _exported("aggregate"),
}
