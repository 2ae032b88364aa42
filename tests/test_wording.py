"""Schedules and charges in running text, with the forms that state nothing."""

from datetime import date

from pyspark.sql import functions as F

from leasegrid.operators import wording

D = date.fromisoformat


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string")


def test_dated_rows(spark):
    got = sorted(map(tuple, wording.dated_rows(docs(
        spark, "1/1/30 - 12/31/30 $1,200.50\n1/1/31 through 12/31/31\n monthly $1,300", "1/1/30-12/31/30 $12 per square foot", "1/1/30-12/31/30: 99", "1/1/30 - 12/31/30 increases 3% to $500",
        "13/1/30 - 12/31/30 $500", "1/1/30 - 12/31/30 paid to Mr 500", None, "1/1/30-12/31/30 $500\n1/1/30 - 12/31/2030\t$500",
    ), "k", "t").collect()))
    assert got == [(0, D("2030-01-01"), D("2030-12-31"), 1200.5), (0, D("2031-01-01"), D("2031-12-31"), 1300.0), (7, D("2030-01-01"), D("2030-12-31"), 500.0)]


def test_row_repair(spark):
    rows = spark.createDataFrame([("1/1/30 – 2/1/30", "x"), ("1/1/30", "2/1/30"), ("soon", None), (None, "2/1/30")], "a string, b string")
    assert [tuple(r) for r in rows.select(*wording.repaired_row(F.col("a"), F.col("b"))).collect()] == [(D("2030-01-01"), D("2030-02-01")), (D("2030-01-01"), D("2030-02-01")), (None, None), (None, D("2030-02-01"))]


def test_charge_steps(spark):
    block = "\n".join(f"1/1/{30 + i} $1{i // 2}0" for i in range(10))
    got = sorted(map(tuple, wording.charge_steps(docs(
        spark, f"Insurance:\n{block}", "Insurance $5 from 1/1/30\nTaxes $6 from 1/1/30", "Insurance:\n1/1/30 $5\nand so on\n1/1/31 $6", "Insurance:\nCommon area costs:\n1/1/30 $5", None,
    ), "k", "t", ["insurance", "taxes", "cams"]).collect()))
    steps = [(0, "insurance", D(f"{2030 + i}-01-01"), 100.0 + 10 * (i // 2)) for i in (0, 2, 4, 6)]  # no further down than seven lines
    assert got == [*steps, (1, "insurance", D("2030-01-01"), 5.0), (1, "taxes", D("2030-01-01"), 6.0), (2, "insurance", D("2030-01-01"), 5.0), (3, "cams", D("2030-01-01"), 5.0)]


def test_anchor_choice(spark):
    texts = docs(spark, "no date", "on the Rent Commencement Date", "on the Commencement Date", None, "x")
    rules = spark.createDataFrame(
        [(0, 0, "base_rent_start", "absolute_date", "a", 0.95), (0, 1, "rent_schedule_anchor", "event_date", "b", 0.7), (0, 2, "base_rent_start", "event_date", "c", 0.7), (1, 0, "term_start", "event_date", "d", 0.9)],
        "k int, ord int, scope string, rule_kind string, trigger_event string, confidence double",
    )
    got = sorted((r.k, r.trigger_event, r.confidence) for r in wording.anchor_choice(texts, rules, "k", "t").collect())
    assert got == [(0, "b", 0.7), (1, "rent_commencement_date", 0.7), (2, "rent_commencement_date", 0.58), (3, "rent_commencement_date", 0.58), (4, "rent_commencement_date", 0.58)]


def test_scopes(spark):
    rows = docs(spark, "The Base Rent is", "The initial term of", "CAM and insurance", "The schedule", "Cameras")
    assert [r[0] for r in rows.select(wording.scope(wording.spoken(F.col("t")))).collect()] == ["base_rent_start", "term_start", "charge_start", "rent_schedule_anchor", "rent_schedule_anchor"]


def test_term_and_escalation(spark):
    rows = docs(spark, "The term is from January 1, 2030 through\nDecember 31, 2039.", "Term. January 1, 2030 to January 2, 2030", "Term 01/05/2030 - 01/04/2035", None)
    assert sorted(map(tuple, wording.term_window(rows, "k", "t").collect())) == [(0, D("2030-01-01"), D("2039-12-31")), (2, D("2030-01-05"), D("2035-01-04"))]
    rows = docs(spark, "Rent of $1,000 shall increase by 3% every three years", "Base rent: $50.00, escalated 2.5 % per 6 months", "Rent $5 increases 1% a year", "Rent $5", "Increases of 3%", None)
    assert sorted(map(tuple, wording.escalation_rule(rows, "k", "t").collect())) == [(0, 1000.0, 3.0, 36), (1, 50.0, 2.5, 6), (2, 5.0, 1.0, 12)]


def test_steps_by_named_days(spark):
    block = "Common Area Maintenance:\nFebruary 1, 2027 through January 31, 2028: $4,800.00 per month\nFebruary 1, 2028 through January 31, 2030: $5,050.00 per month\nFebruary 1, 2030 through January 31, 2034: $5,600.00 per month"
    told = "Operating Expenses shall be $3,950.00 per month from April 1, 2028 through September 30, 2030.\nBeginning October 1, 2030, Operating Expenses shall be $4,275.00 per month.\nBeginning January 1, 2034, Operating Expenses shall be $4,620.00 per month through expiration."
    none = "Common Area Maintenance shall be $3,600.00 per month, but billing shall commence on September 1, 2029.\nCommon Area Maintenance shall increase three percent (3%) on each June 1 beginning June 1, 2030."
    got = sorted((r.k, str(r.step_date), r.amount) for r in wording.charge_steps(docs(spark, block, told, none), "k", "t", ["cams", "taxes"]).collect())
    assert got == [
        (0, "2027-02-01", 4800.0), (0, "2028-02-01", 5050.0), (0, "2030-02-01", 5600.0), (1, "2028-04-01", 3950.0), (1, "2030-10-01", 4275.0), (1, "2034-01-01", 4620.0),
    ]


def test_rates_and_areas(spark):
    texts = ["3/1/2024 - 2/28/2025 $5,000.00 for 2,000 square feet", "3/1/19-2/29/20    $300.00 per rentable square foot per month", "3/1/19-2/29/20 $300.00/sf", "3/1/18-2/28/19\n$98,463.60\n3/1/19-2/29/20\n$101,417.51"]
    got = sorted((r.k, r.monthly_rent) for r in wording.dated_rows(docs(spark, *texts), "k", "t").collect())
    assert got == [(0, 5000.0), (3, 98463.6), (3, 101417.51)]


def test_escalations_without_a_sign(spark):
    texts = ["Rent 10000 month, escalated 2% every two years", "Minimum rent of 10,000 per month, increases by 3% every 6 months", "Rent for suite 100, increases 3% every year", "Rent: 900/month escalates 1.5% per year"]
    assert sorted(map(tuple, wording.escalation_rule(docs(spark, *texts), "k", "t").collect())) == [(0, 10000.0, 2.0, 24), (1, 10000.0, 3.0, 6), (3, 900.0, 1.5, 12)]


def test_a_step_is_read_once(spark):
    """A day is taken out of a line once a way, not for each field of the date."""
    plan = wording.charge_steps(docs(spark, "CAM $5 from 1/1/2030"), "k", "t", ["cams"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("beginning") <= 5


def test_anchor_choice_knows_both_events(spark):
    from leasegrid.plans import registry

    got = {(r.trigger_event, r.confidence) for r in registry.QUERIES["anchor_choice"](spark, "/root/testdata/sf0.001").where("lease_id % 3 = 0").collect()}
    assert got == {("rent_commencement_date", 0.72), ("commencement_date", 0.7), ("rent_commencement_date", 0.58)}
