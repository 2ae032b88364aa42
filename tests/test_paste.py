"""Pasted tables, charges in prose, and the choice between readings."""

from datetime import date

from leasegrid.operators import paste

D = date.fromisoformat


def test_pasted_table(spark):
    body = "3/1/18 - 2/28/19\t$98,463.60\n3.1.19 - 2.29.20   S100,000*\n\n3/1/20\n2/28/21 $5\n3/1/21\n3/1/22\n2/28/23 7\nYear 6 $1.000.000.50\nnothing here\nsoon  $1\n2024-01-01  n/a"
    got = paste.pasted(spark.createDataFrame([(1, body), (2, None)], "k int, t string"), "k", "t").orderBy("at").collect()
    assert [(r.period_start, r.period_end, r.monthly_rent, r.relative_year, r.warning) for r in got] == [
        (D("2018-03-01"), D("2019-02-28"), 98463.6, None, None), (D("2019-03-01"), D("2020-02-29"), 100_000.0, None, None), (D("2020-03-01"), D("2021-02-28"), 5.0, None, None),
        (None, None, None, None, "no rent on the line"), (D("2023-02-28"), None, 7.0, None, None), (None, None, 1000000.5, 6, None), (None, None, None, None, "no rent on the line"), (None, None, 1.0, None, "no period"), (D("2024-01-01"), None, None, None, "no rent"),
    ]
    assert got[3].line == "3/1/21 - 3/1/22" and got[1].asterisk


def test_charges_in_prose(spark):
    docs = spark.createDataFrame([(1, "NNN escalate 2.5% every year, amt 10000\nInsurance $1,200.50 per month increases 3% every two years\nnothing\nNNN escalate 2.5% every year, amt 10000")], "k int, t string")
    got = sorted((r.bucket, r.year1, r.esc_pct, r.cadence_months) for r in paste.prose_charges(docs, "k", "t").collect())
    assert got[0] == ("cams", 10_000.0, 2.5, 12) and got[1][:2] == ("insurance", 1200.5) and len(got) == 2


def test_prose_fills_gaps(spark):
    columns = "k int, ord int, bucket string, label string, year1 double, esc_pct double, confidence double"
    charges = spark.createDataFrame([(1, 0, "cams", "CAM", None, None, 0.5), (1, 1, "taxes", "Taxes", 7.0, 1.0, 0.9)], columns)
    told = spark.createDataFrame([(1, "cams", "nnn", 10.0, 2.5), (1, "insurance", "insurance", 3.0, None)], "k int, bucket string, label string, year1 double, esc_pct double")
    got = {r.ord: (r.bucket, r.year1, r.esc_pct, r.confidence) for r in paste.merged(charges, told, "k").collect()}
    assert got == {0: ("cams", 10.0, 2.5, 0.72), 1: ("taxes", 7.0, 1.0, 0.9), 1001: ("insurance", 3.0, None, 0.72)}


def test_choice_of_reading(spark):
    columns = "lease_id int, period_idx int, period_start date, period_end date, monthly_rent double"
    one = lambda i, rent: (i, 0, D("2030-01-01"), D("2030-12-31"), rent)
    parsed = spark.createDataFrame([one(1, 5.0), one(2, 5.0), one(3, 5.0), one(5, 5.0)], columns)
    extracted = spark.createDataFrame([one(1, 5.001), one(2, 6.0), one(4, 5.0), one(5, 6.0)], columns)
    blocked = spark.createDataFrame([(5, "extracted")], "lease_id int, reading string")
    assert sorted(map(tuple, paste.chosen(parsed, extracted, blocked).collect())) == [(1, "parsed", False), (2, "extracted", True), (3, "parsed", False), (4, "extracted", False), (5, "parsed", False)]


def test_a_charge_in_prose_is_read_once(spark):
    """The words of a line are computed once, not for each charge, condition and column that mentions them."""
    plan = paste.prose_charges(spark.createDataFrame([(1, "CAM: 5")], "k int, t string"), "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9$%.,/]+") == 1
