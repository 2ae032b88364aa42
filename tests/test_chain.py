"""The repairs of an extraction in their order, on the examples of the modelled application."""

from datetime import date

from leasegrid.operators import chain
from leasegrid.plans import chain_queries
from leasegrid.sources.portfolio import Portfolio

D = date.fromisoformat
ROWS = "lease_id long, ord long, start_text string, end_text string, monthly_rent double"
MONTHS = "Months 1-6: $0.00 monthly\nMonths 7-60: $23,149.25 monthly\nMonths 61-120: $25,464.18 monthly"


def test_schedules(spark):
    rows = [
        (1, 0, "3/1/18", "2/28/19", 98463.6), (2, 0, "3/1/18-2/28/19", "", 98463.6), (4, 0, "NOT A DATE", "ALSO NOT A DATE", 98463.6), (5, 0, None, None, 0.0), (5, 1, None, None, 23149.25),
        (8, 0, "3/1/18", None, 500.0),
    ]
    texts = [
        "Minimum Annual Rent", "Minimum Annual Rent", "Minimum Annual Rent:\n3/1/18-2/28/19    $98,463.60\n3/1/19-2/29/20    $101,417.51\n3/1/20-2/28/21    $104,460.03",
        "Minimum Annual Rent:\n3/1/18-2/28/19    $98,463.60\n3/1/19-2/29/20    $101,417.51", "Rent Commencement shall be determined later.\n" + MONTHS, "Base Rent:\n3/1/19-2/29/20    $3.00 per rentable square foot per month",
        "Lease term 01/01/2025-01/01/2035\nRent 10000 month, escalated 2% every two years", "nothing", None,
        "The Commencement Date is January 15, 2030.\nBase rent shall begin on the first full calendar month after the Commencement Date.\nMonths 1-60: $37,187.50\nMonths 61-120: $40,906.25", MONTHS,
    ]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "lease_id long, text string")
    known = spark.createDataFrame([(11, "rent_commencement_date", D("2030-03-15"))], "lease_id long, event string, day date")
    schedule, outcome = chain.repaired(spark.createDataFrame(rows, ROWS), docs, known)
    got = {}
    for r in sorted(schedule.collect(), key=lambda r: (r.lease_id, r.place)):
        got.setdefault(r.lease_id, []).append((str(r.period_start), str(r.period_end), r.monthly_rent))
    first = ("2018-03-01", "2019-02-28", 98463.6)
    assert got[1] == got[2] == [first]
    assert got[3] == [first, ("2019-03-01", "2020-02-29", 101417.51), ("2020-03-01", "2021-02-28", 104460.03)] and got[4] == got[3][:2]
    assert 5 not in got and 6 not in got and 9 not in got
    assert len(got[7]) == 5 and got[7][0] == ("2025-01-01", "2026-12-31", 10000.0) and got[7][1] == ("2027-01-01", "2028-12-31", 10200.0) and got[7][4][:1] + got[7][4][2:] == ("2033-01-01", 10824.32)
    assert got[8] == [("2018-03-01", "None", 500.0)]
    assert got[10] == [("2030-02-01", "2035-01-31", 37187.5), ("2035-02-01", "2040-01-31", 40906.25)]
    assert got[11] == [("2030-03-15", "2030-09-14", 0.0), ("2030-09-15", "2035-03-14", 23149.25), ("2035-03-15", "2040-03-14", 25464.18)]
    told = {r.lease_id: (r.stage, r.notice, r.representation, r.n_periods) for r in outcome.collect()}
    assert told[3] == ("recovered", "omitted", "dated_periods", 3) and told[4] == ("recovered", "unparsed", "dated_periods", 2) and told[5] == ("none", "needs_anchor", "relative_month_ranges", 0)
    assert told[6] == ("none", None, None, 0) and told[7] == ("materialized", "materialized", "narrative_escalation", 5) and told[8] == ("read", None, None, 1) and told[9] == ("none", None, None, 0)


CHARGES = "lease_id long, ord long, bucket string, label string, year1 double, esc_pct double, charge_start date, esc_start date, confidence double"
HINTS = "lease_id long, bucket string, label string, date date, amount double"


def test_charges_and_hints(spark):
    charges = spark.createDataFrame([(1, 0, "cams", "Operating Expenses", 3950.0, 3.0, D("2028-04-01"), D("2030-10-01"), 0.94), (2, 0, "cams", "CAM", None, None, None, None, 0.4), (3, 0, None, "Signage", 5.0, None, None, None, None), (4, 0, "insurance", "Insurance", 650.0, 2.0, None, D("2029-08-01"), 0.9)], CHARGES)
    hints = spark.createDataFrame([(1, "cams", "Operating Expenses", D("2030-10-01"), 4275.0)], HINTS)
    texts = [
        (1, "Operating Expenses shall be $3,950.00 per month from April 1, 2028 through September 30, 2030.\nBeginning October 1, 2030, Operating Expenses shall be $4,275.00 per month.\nBeginning January 1, 2034, Operating Expenses shall be $4,620.00 per month through expiration."),
        (2, "NNN escalate 2.5% every year, amt 10000"), (3, "NNN escalate 2.5% every year, amt 10000"), (4, "Insurance:\nFebruary 1, 2027 through July 31, 2029: $650.00 per month\nAugust 1, 2029 through January 31, 2032: $725.00 per month"), (5, None),
    ]
    own, dated = chain.told_charges(charges, hints, spark.createDataFrame(texts, "lease_id long, text string"), ["cams", "insurance"])
    got = {(r.lease_id, r.label): (r.year1, r.esc_pct, r.charge_start and str(r.charge_start), r.esc_start) for r in own.collect()}
    assert got == {
        (1, "Operating Expenses"): (3950.0, None, "2028-04-01", None), (2, "CAM"): (10000.0, 2.5, None, None), (3, "Signage"): (5.0, None, None, None), (3, "nnn"): (10000.0, 2.5, None, None),
        (4, "Insurance"): (650.0, None, "2027-02-01", None),
    }
    assert sorted((r.lease_id, r.bucket, str(r.date), r.amount) for r in dated.collect()) == [(1, "cams", "2030-10-01", 4275.0), (1, "cams", "2034-01-01", 4620.0), (4, "insurance", "2029-08-01", 725.0)]


def test_a_lease_is_repaired_in_one_row(spark):
    """No part of the repairs reads the texts again: leases are scanned for their rows, lines and texts alone."""
    p = Portfolio(spark, "/root/testdata/sf0.001")
    for plan in chain.repaired(*chain_queries.extracted(p)):
        told = plan._jdf.queryExecution().executedPlan().toString()
        assert told.count("Scan parquet") <= 3 and "Window" not in told


def test_what_ranks_rules_and_dates_events(spark):
    """A dated rule on the schedule comes last; of two mentions the first dates an event, and a known day goes before both."""
    months = "\nMonths 1-12: $500.00 monthly"
    texts = [
        "The Delivery Date is March 5, 2030.\nThe Delivery Date is April 5, 2030.\nRent is due 10 days after the Delivery Date." + months, "The Opening Date is May 7, 2031." + months,
        "The later of the Delivery Date and the Opening Date.\nThe Delivery Date is January 2, 2030." + months, "30 days after the Permit Issuance Date rent is due." + months,
    ]
    docs = spark.createDataFrame(list(enumerate(texts, 1)) + [(5, texts[0])], "lease_id long, text string")
    known = spark.createDataFrame([(5, "delivery_date", D("2030-06-01")), (5, "delivery_date", D("2030-07-01")), (5, "no such event", D("2030-01-01"))], "lease_id long, event string, day date")
    schedule, outcome = chain.repaired(spark.createDataFrame([], ROWS), docs, known)
    assert {r.lease_id: str(r.period_start) for r in schedule.collect()} == {1: "2030-03-15", 2: "2031-05-07", 3: "2030-01-02", 5: "2030-06-11"}
    assert {r.lease_id: r.notice for r in outcome.collect()} == {1: "materialized", 2: "materialized", 3: "materialized", 4: "needs_anchor", 5: "materialized"}
