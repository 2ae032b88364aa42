"""Charges that users define: their keys, and tables whose columns the data decide."""

import re

from pyspark.sql import functions as F

from leasegrid.operators import custom
from leasegrid.plans import custom_queries, intake_queries
from leasegrid.sources.portfolio import Portfolio


def test_keys_are_the_least_free_ones(spark):
    rows = [(1, 0, "cams"), (1, 1, None), (1, 2, "custom_1"), (1, 3, None), (1, 4, "custom_4"), (1, 5, None), (1, 6, None), (2, 0, None), (2, 1, "custom_x"), (3, 0, "custom_2"), (3, 1, "custom_3"), (3, 2, None), (3, 3, None)]
    got = {(r.lease_id, r.ord): r.key for r in custom.keyed(spark.createDataFrame(rows, "lease_id long, ord long, key string")).collect()}
    assert [got[1, k] for k in range(7)] == ["cams", "custom_2", "custom_1", "custom_3", "custom_4", "custom_5", "custom_6"]
    assert [got[2, k] for k in range(2)] == ["custom_1", "custom_x"] and [got[3, k] for k in range(4)] == ["custom_2", "custom_3", "custom_1", "custom_4"]


AMOUNTS = "lease_id long, month_num long, canonical_type string, label string, amount double"


def test_columns_follow_the_labels(spark):
    rows = spark.createDataFrame([(1, 1, "other", "Parking", 5.0), (1, 1, "nnn", "Taxes", 7.25), (1, 1, "nnn", "Parking", 1.0), (1, 2, "other", "Parking", 0.1), (1, 2, "other", "Parking", 0.2), (2, 1, "nnn", "Taxes", 3.0)], AMOUNTS)
    table, names = custom.wide(rows, rows)
    assert names == ["Parking (NNN) ($)", "Taxes ($)", "Parking ($)"]
    assert sorted(tuple(r) for r in table.select("lease_id", "month_num", *[F.col(f"`{n}`") for n in names]).collect()) == [(1, 1, 1.0, 7.25, 5.0), (1, 2, None, None, 0.3), (2, 1, None, 3.0, None)]
    mapped, names = custom.wide(rows, rows, most=2)
    assert names == ["charges"]
    assert {(r.lease_id, r.month_num): r.charges for r in mapped.collect()}[1, 1] == {"Parking ($)": 5.0, "Taxes ($)": 7.25, "Parking (NNN) ($)": 1.0}


def test_no_charges_no_columns(spark):
    none = spark.createDataFrame([], AMOUNTS)
    table, names = custom.wide(none, none)
    assert names == [] and table.columns == ["lease_id", "month_num"] and table.count() == 0


def test_modes_decide_the_net_columns(spark):
    leases = spark.createDataFrame([(1, "individual"), (2, "aggregate")], "lease_id long, nnn_mode string")
    charges = spark.createDataFrame([(k, n, t, label, y) for k in (1, 2) for n, t, label, y in (("cams", "nnn", "CAMS", 1.0), ("custom_1", "other", "Parking", 2.0), ("custom_2", "other", "Idle", 0.0))], "lease_id long, key string, canonical_type string, label string, year1 double")
    amounts = spark.createDataFrame([(k, 1, n, 4.0 if n != "custom_2" else 0.0) for k in (1, 2) for n in ("cams", "custom_1", "custom_2")], "lease_id long, month_num long, key string, amount double")
    shown = custom.active(amounts, charges, leases)
    assert sorted((r.lease_id, r.key) for r in shown.collect()) == [(1, "cams"), (1, "custom_1"), (2, "custom_1")]
    columns = [*custom.HEAD, *custom.TAIL]
    rows = leases.select("lease_id", "nnn_mode", F.lit(9.0).alias("total_nnn_amount"), *[F.lit(1).cast("long").alias(c) for c in columns])
    one, two = (custom.schedule_table(rows, amounts, shown, mode) for mode in ("individual", "aggregate"))
    assert "CAMS ($)" in one.columns and custom.NNN_COMBINED not in one.columns and "Idle ($)" not in one.columns
    assert "CAMS ($)" not in two.columns and two.first()[custom.NNN_COMBINED] == 9.0 and two.first()["Parking ($)"] == 4.0


class Bare(Portfolio):
    """A portfolio in which a third of the leases have charges without terms, which only overrides make show."""

    def all_charges(self):
        return super().all_charges().withColumn("year1", F.when(F.col("lease_id") % 3 == 0, 0.0).otherwise(F.col("year1")))


def test_columns_of_the_ledger_are_those_of_charge_rows(spark):
    """What the ledger adds up by title is what the rows of months and charges come to."""
    p = Bare(spark, "/root/testdata/sf0.001")
    for mode in ("individual", "aggregate"):
        own = custom_queries.exported(p, mode)
        names = [c for c in own.columns if c not in {"lease_id", custom.NNN_COMBINED, *custom.HEAD.values(), *custom.TAIL.values()}]
        by_rows = {(r.lease_id, r["Lease Month #"]): r.charges or {} for r in custom_queries.exported(p, mode, 1).select("lease_id", "Lease Month #", "charges").collect()}
        got = {(r.lease_id, r["Lease Month #"]): {n: r[n] for n in names if r[n] is not None} for r in own.collect()}
        assert len(names) > 3 and got == by_rows
        assert any(not charges for charges in got.values()) and any(charges for (lease, _), charges in got.items() if lease % 3 == 0) == (mode == "individual")


def test_an_export_deals_months_by_lease_alone(spark):
    p = Portfolio(spark, "/root/testdata/sf0.001")
    for plan in (custom_queries.exported(p, "individual"), custom_queries.exported(p, "aggregate"), intake_queries.csv_variant(p)):
        told = plan._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"(hashpartitioning|Join) ?[\[(]lease_id#\d+L?, (month_num|key)#", told)
