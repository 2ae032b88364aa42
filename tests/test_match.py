"""Events meet their month in a sweep."""

from datetime import date

from pyspark.sql import functions as F

from leasegrid.operators import generate, ledger, match, options

D = date.fromisoformat


def months(spark, *leases):
    periods = spark.createDataFrame([(k, 0, D(a), D(b), 1000.0) for k, a, b in leases], "lease_id long, period_idx long, period_start date, period_end date, monthly_rent double")
    return generate.bounded(generate.expand(periods))


def test_dates_go_to_their_row(spark):
    rows = months(spark, (1, "2030-01-15", "2030-06-20"), (2, "2030-01-01", "2030-02-28"))
    events = spark.createDataFrame(
        [(1, 0, D("2029-01-01")), (1, 1, D("2030-01-15")), (1, 2, D("2030-02-14")), (1, 3, D("2030-02-15")), (1, 4, D("2040-01-01")), (1, 5, None), (2, 6, D("2030-02-28")), (3, 7, D("2030-01-01")), (1, 3, D("2030-02-15"))],
        "lease_id long, ord int, day date",
    )
    got = sorted((r.ord, r.month_num) for r in match.assign(events, rows, "day").collect())
    assert got == [(0, 1), (1, 1), (2, 1), (3, 2), (3, 2), (4, 6), (5, 1), (6, 2)]


def test_a_lease_with_very_many_events(spark):
    """No pair of event and month is made: what is joined are events with their own lease alone."""
    rows = months(spark, (1, "2000-01-01", "2049-12-31"), (2, "2030-01-01", "2030-12-31"))
    events = spark.range(100_000).select(F.lit(1).cast("long").alias("lease_id"), F.col("id").alias("ord"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 18000).cast("int")).alias("day"))
    found = match.assign(events, rows, "day")
    assert found.where((F.year("day") - 2000) * 12 + F.month("day") != F.col("month_num")).count() == 0 and found.count() == 100_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Join LeftSemi" in plan


def test_windows_meet_the_rows_that_they_overlap(spark):
    rows = months(spark, (1, "2030-01-01", "2030-12-31"))
    none = None
    windows = [(1, 0, "free_rent", "legacy_window", none, 100.0, none, D("2029-01-01"), D("2029-02-01")), (1, 1, "abatement", "legacy_window", "percent", 50.0, none, D("2030-01-20"), D("2030-03-05")), (1, 2, "abatement", "legacy_window", "percent", 10.0, none, D("2030-03-01"), D("2030-02-01")), (1, 3, "free_rent", "legacy_window", none, 100.0, none, D("2030-03-01"), D("2031-03-01"))]
    table = spark.createDataFrame(windows, "lease_id long, ord int, type string, scope string, value_mode string, value double, effective_date date, start_date date, end_date date")
    got = {r.month_num: (r.w.type, r.overlap) for r in ledger.window_concessions(table, rows).collect()}
    assert got[1] == ("abatement", 12) and got[2] == ("abatement", 28) and got[3] == ("abatement", 5) and got[4] == ("free_rent", 30) and len(got) == 12


def test_option_tables_and_runs(spark):
    rows = [(1, m, "monthly_row", "free_rent" if m < 13 else "abatement", None if m < 13 else "percent" if m < 15 else "fixed_amount", 50.0, 100.0, 25.0) for m in [*range(1, 13), 13, 14, 16]] + [(1, 20, None, None, None, None, 100.0, 0.0), (2, 1, None, None, None, None, 5.0, 0.0)]
    ledger_rows = spark.createDataFrame(rows, "lease_id long, month_num long, concession_scope string, concession_type string, concession_value_mode string, concession_value double, scheduled_base_rent double, abatement_amount double")
    ledger_rows = ledger_rows.withColumns({"period_start": F.add_months(F.lit("2030-01-01").cast("date"), (F.col("month_num") - 1).cast("int")), "period_end": F.date_sub(F.add_months(F.lit("2030-01-01").cast("date"), F.col("month_num").cast("int")), 1)})
    got = {(r.lease_id, r.kind, r.slot): (r.label, r.month_num, r.amount, r.pct, r.n_months) for r in options.option_tables(ledger_rows).collect()}
    assert len(got) == 2 * 2 * 11
    assert got[1, "free_rent", 0] == ("TOTAL", None, 1000.0, None, 12) and got[1, "free_rent", 10] == ("Free rent month", 10, 100.0, None, 12)
    assert got[1, "abatement", 1] == ("Abatement month", 13, 25.0, 0.5, 3) and got[1, "abatement", 3][1:4] == (16, 25.0, 0.25) and got[1, "abatement", 4][1:] == (None, None, None, None)
    assert got[2, "abatement", 0] == ("TOTAL", None, 0.0, None, None)
    told = sorted((r.kind, r.run, r.first_month, r.last_month, r.n_months, r.amount) for r in options.runs(ledger_rows).collect())
    assert told == [("abatement", 0, 13, 16, 3, 75.0), ("abatement", 1, 13, 14, 2, 50.0), ("abatement", 2, 16, 16, 1, 25.0), ("free_rent", 0, 1, 12, 12, 1200.0), ("free_rent", 1, 1, 12, 12, 1200.0)]


def test_months_are_not_broadcast(spark):
    """Plans take months for as few as leases; broadcast, those of a few MB of leases fill the driver."""
    from leasegrid.plans import registry

    for name in ("concession_intake", "concessions_by_month", "one_time_range_sum", "window_concessions"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        sides = [part.split("SortMergeJoin")[0].split("BroadcastExchange")[0] for part in plan.split("BroadcastExchange")[1:]]
        assert not any("month_num" in side.split("Exchange hashpartitioning")[0] for side in sides), name
