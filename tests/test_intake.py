"""Forms and extractions on small cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from leasegrid.operators import intake

D = date.fromisoformat
RAW = "lease_id int, list string, ord long, type string, scope string, month_text string, day date, start_date date, end_date date, value_mode string, value_text string"


@pytest.fixture(scope="module")
def months(spark):
    """Twelve months from January 15, 2030."""
    rows = [(1, k + 1, (D("2030-01-15") if k == 0 else date(2030, k + 1, 15)), date(2030 + (k == 11), k + 2 if k < 11 else 1, 14), k == 11) for k in range(12)]
    return spark.createDataFrame(rows, "lease_id int, month_num long, month_start date, row_end date, is_last boolean").cache()


def concessions(spark, *rows):
    """(list, ord, type, scope, month, day, start, end, mode, value)"""
    return spark.createDataFrame([(1, *[D(x) if k in (5, 6, 7) and x else x for k, x in enumerate(r)]) for r in rows], RAW)


def test_typed_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in ("5", " 7 ", "2.5", "0", "-1", "", None, "x", "3.0")], "t string")
    assert [r[0] for r in rows.select(intake.whole_number(F.col("t"))).collect()] == [5, 7, None, None, None, None, None, None, 3]
    assert [r[0] for r in rows.select(intake.number(F.col("t"))).collect()] == [5, 7, 2.5, 0, -1, None, None, None, 3]


def test_concessions_find_month_and_date(spark, months):
    raw = concessions(
        spark,
        ("free_rent", 0, None, None, "2", None, None, None, None, None), ("free_rent", 1, None, None, None, "2030-03-14", None, None, None, None), ("free_rent", 2, None, None, "99", None, None, None, None, None), ("free_rent", 3, None, None, None, None, None, None, None, None),
        ("abatement", 4, None, None, "3", None, None, None, "percent", "25"), ("abatement", 5, None, None, "4", None, None, None, "percent", "0"), ("abatement", 6, None, None, "5", None, None, None, "other", "x"), ("abatement", 7, None, None, "6", None, None, None, "other", "7"),
        ("legacy", 8, "free_rent", "monthly_row", None, "2040-01-01", None, None, None, None), ("legacy", 9, "abatement", "legacy_window", None, None, None, "2030-05-01", "percent", "10"), ("legacy", 10, "abatement", "legacy_window", None, None, "2030-02-01", None, "percent", "10"),
    )
    helper = spark.createDataFrame([(1, D("2030-06-01"), 50.0)], "lease_id int, helper_end date, helper_pct double")
    got = {r.ord: r for r in intake.concession_events(raw, helper, months).collect()}
    assert sorted(got) == [0, 1, 4, 7, 8, 9]
    assert (got[0].effective_date, got[0].value) == (D("2030-02-15"), 100) and (got[1].month_number, got[1].effective_date) == (2, D("2030-02-15"))
    assert got[4].value == 25 and got[7].value_mode is None and (got[8].month_number, got[8].effective_date) == (12, D("2040-01-01")) and got[9].start_date == D("2030-01-15")
    (only,) = intake.concession_events(raw.where("list <> 'legacy' and ord = 0"), helper.withColumn("helper_pct", F.lit(150.0)), months).where("ord = -1").collect()
    assert (only.type, only.scope, only.start_date, only.end_date, only.value) == ("free_rent", "legacy_window", D("2030-01-15"), D("2030-06-01"), 100)


def test_concession_rules(spark, months):
    raw = concessions(
        spark,
        ("free_rent", 0, None, None, "2", None, None, None, None, None), ("abatement", 1, None, None, "2", None, None, None, "percent", "120"), ("free_rent", 2, None, None, " ", None, None, None, None, None), ("free_rent", 3, None, None, "1.5", None, None, None, None, None),
        ("free_rent", 4, None, None, "13", None, None, None, None, None), ("abatement", 5, None, None, "3", None, None, None, "percent", ""), ("abatement", 6, None, None, "4", None, None, None, "percent", "x"), ("abatement", 7, None, None, "5", None, None, None, "words", "5"),
        ("abatement", 8, None, None, "6", None, None, None, "fixed_amount", "500"),
    )
    got = sorted((r.ord, r.rule_id) for r in intake.concession_rules(raw, months).collect())
    assert got == [(1, "month-taken"), (1, "value-percent"), (2, "month-required"), (3, "month-whole"), (4, "month-in-term"), (5, "value-required"), (6, "value-number"), (7, "value-mode")]


def test_override_rules(spark, months):
    charges = spark.createDataFrame([(1, "cams")], "lease_id int, key string")
    rows = [(0, "cams", "x", "2030-03-01", "5"), (1, "cams", "x", "2030-03-14", "-5"), (2, "roof", "x", "2030-01-15", "1"), (3, "", "x", "2030-01-15", "1"), (4, "base_rent", "", None, "1"), (5, "base_rent", "soon", None, "1"), (6, "base_rent", "x", "2040-01-01", "ten"), (7, "base_rent", "x", "2030-05-01", "")]
    raw = spark.createDataFrame([(1, i, t, x, D(d) if d else None, a) for i, t, x, d, a in rows], "lease_id int, ord long, target_key string, date_text string, day date, amount_text string")
    got = sorted((r.ord, r.rule_id) for r in intake.override_rules(raw, charges, months).collect())
    assert got == [(1, "amount-negative"), (1, "row-taken"), (2, "target-unknown"), (3, "target-required"), (4, "date-required"), (5, "date-format"), (6, "amount-number"), (6, "date-outside"), (7, "amount-required")]


def test_hints_meet_charges_by_bucket_then_label(spark):
    charges = spark.createDataFrame([(1, 0, "cams", "Common Area"), (1, 1, "custom_1", "Roof  Fund")], "lease_id int, ord int, key string, label string")
    hints = spark.createDataFrame([(1, 0, "cams", None), (1, 1, "taxes", "roof fund "), (1, 2, None, "Parking"), (1, 3, None, None), (2, 4, "cams", "x")], "lease_id int, ord int, bucket string, label string")
    got = {r.ord: (r.target_key, r.notice) for r in intake.override_hints(hints, charges).collect()}
    assert got == {0: ("cams", False), 1: ("custom_1", False), 2: (None, True), 3: (None, True), 4: (None, True)}


def test_windows_become_monthly_events(spark, months):
    windows = spark.createDataFrame([(1, D("2030-01-20"), D("2030-03-15"), 100.0)], "lease_id int, start_date date, end_date date, pct double")
    assert [(r.month_number, r.type, r.value) for r in intake.window_events(windows, months).orderBy("month_number").collect()] == [(1, "free_rent", None), (2, "free_rent", None), (3, "free_rent", None)]
    assert intake.window_events(windows.withColumn("pct", F.lit(0.0)), months).count() == 0


def test_guards_and_flags(spark):
    raw = spark.createDataFrame(
        [(1, 0, " CAM ", "cams", 600_000.0, 3.0, "nnn", 2.0), (1, 1, " ", "cams", 1.0, 1.0, "nnn", 1.0), (1, 2, "Roof", "roof", float("nan"), 101.0, "x", None), (1, 3, "Tax", "taxes", 9.0, None, "nnn", 0.2)],
        "lease_id int, ord long, label string, bucket string, year1 double, esc_pct double, canonical_type string, confidence double",
    )
    got = {r.ord: tuple(r)[2:] for r in intake.guarded_charges(raw).collect()}
    assert got == {0: ("CAM", "cams", None, 3.0, "nnn", 1.0), 2: ("Roof", None, None, None, "other", 0.5), 3: ("Tax", "taxes", 9.0, None, "nnn", 0.2)}
    built = spark.createDataFrame([(1, 0, "cams", "CAM"), (1, 1, "custom_1", "Roof"), (1, 2, "taxes", "Taxes")], "lease_id int, idx int, key string, label string")
    assert sorted((r.idx, r.field) for r in intake.charge_flags(intake.guarded_charges(raw), built).collect()) == [(0, "year1"), (1, "escPct"), (1, "year1"), (2, "escPct"), (2, "year1")]


def test_one_time_items(spark):
    listed = spark.createDataFrame([(1, 0, " Fee ", None, -5.0, 1), (1, 1, " ", None, 5.0, 1), (1, 2, "Tax", None, -5.0, 0), (1, 3, "Out", None, 5.0, -1)], "lease_id int, ord long, label string, date date, amount double, sign int")
    deposits = spark.createDataFrame([(1, 9.0, None, D("2030-01-01")), (2, 9.0, None, D("2030-01-01")), (3, 0.0, None, None)], "lease_id int, amount double, date date, first_start date")
    got = sorted((r.lease_id, r.label, r.amount) for r in intake.one_time_items(listed, deposits).collect())
    assert got == [(1, "Fee", 5.0), (1, "Out", -5.0), (1, "Tax", -5.0), (2, "Security Deposit", 9.0)]


def test_lease_months(spark):
    rows = spark.createDataFrame([(D("2030-01-30"),), (D("2030-01-31"),), (D("2030-02-27"),), (D("2030-02-28"),), (D("2030-03-31"),)], "d date")
    n, first, last = intake.lease_month(F.col("d"), F.lit(D("2030-01-31")))
    assert [tuple(r) for r in rows.select(n, first, last).collect()] == [
        (None, None, None), (1, D("2030-01-31"), D("2030-02-27")), (1, D("2030-01-31"), D("2030-02-27")), (2, D("2030-02-28"), D("2030-03-30")), (3, D("2030-03-31"), D("2030-04-29")),
    ]


def test_chronology(spark):
    rows = [(1, 0, D("2030-01-15"), D("2031-01-14")), (1, 1, D("2031-01-15"), None), (1, 2, None, D("2033-01-14"))]
    got = intake.chronology(spark.createDataFrame(rows, "lease_id int, period_idx long, period_start date, period_end date")).orderBy("period_idx").collect()
    assert [(r.start_month, r.end_month, r.min_start, r.min_end, r.max_end, r.start_locked) for r in got] == [(1, 12, 1, 1, 12, True), (13, None, 13, 13, None, False), (None, 36, 14, None, None, False)]
