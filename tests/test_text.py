"""Labels, lease wording and repairs on small cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from leasegrid.operators import labels, repair, text
from leasegrid.plans import text_queries
from leasegrid.sources.portfolio import Portfolio

D = date.fromisoformat


@pytest.mark.parametrize("cases", [[
    ("CAM", "cams", "cam", 1.0, "exact"), ("Malntenance Fees", "cams", "common_area_maintenance", 0.95, "exact"), ("Common Area Maint.", "cams", "common_area_maintenance", 0.775, "token"),
    ("Insurance & Tax", "insurance", "property_insurance", 0.64, "fuzzy"), ("S3curity Patr0l", "security", "guard_patrol", 0.72, "ocr_rescue"), ("***T4xes###", "taxes", "real_estate_taxes", 0.72, "ocr_rescue"),
    ("zzz", "otherItems", None, 0.25, "fallback"), ("", "otherItems", None, 0.0, "fallback"), (None, "otherItems", None, 0.0, "fallback"), ("Triple Net Charges", "cams", "nnn_composite", 1.0, "exact"),
]])
def test_label_cascade(spark, cases):
    table = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, raw_label string")
    got = {r.k: r for r in labels.classify(table).collect()}
    assert [(got[k].bucket, got[k].subtype, got[k].confidence, got[k].match_type) for k in range(len(cases))] == [c[1:] for c in cases]


def wins(spark, *texts):
    return text.windows(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "k", "t")


def test_terms_and_their_dates(spark):
    w = wins(spark, "Months 1–6 $0\nMonths 7 to 60: $23,149.25\nmonths 61 through 120\n$25,464.18", "Lease Years 1-5 $100.50", None, "")
    got = text.terms(w, "k").orderBy("start_value").collect()
    assert [(r.start_value, r.end_value, r.monthly_rent) for r in got] == [(1, 6, 0.0), (7, 60, 23149.25), (61, 120, 25464.18)]
    years = text.terms(w, "k", text.YEAR_TERMS).withColumn("anchor", F.lit(D("2030-03-15")))
    assert [(r.period_start, r.period_end) for r in text.materialized(years, "anchor", True).collect()] == [(D("2030-03-15"), D("2035-03-14"))]


def test_start_rules(spark):
    w = wins(spark, "The Commencement Date shall be January 15, 2030.\nRent starts the first full calendar month after the Commencement Date.", "the later of the Delivery Date and the Permit Issuance Date", "30 days after the Opening Date")
    assert [tuple(r) for r in text.absolute_rules(w, "k").collect()] == [(0, "commencement_date", D("2030-01-15"))]
    got = {(r.k, r.rule_kind): (r.trigger_event, r.second_event, r.offset_value) for r in text.phrase_rules(w, "k").collect()}
    assert got == {
        (0, "first_full_calendar_month_after_event"): ("commencement_date", None, None), (1, "later_of"): ("delivery_date", "permit_issuance_date", None), (2, "event_plus_days"): ("opening_date", None, 30),
    }
    days = spark.createDataFrame([("first_full_calendar_month_after_event", D("2030-01-15"), None, None), ("later_of", D("2030-01-15"), D("2030-02-01"), None), ("event_plus_months", D("2030-01-31"), None, 1), ("first_of_month_on_or_after_event", D("2030-02-01"), None, None)], "kind string, a date, b date, n int")
    assert [r[0] for r in days.select(text.resolved(F.col("kind"), F.col("a"), F.col("b"), F.col("n"))).collect()] == [D("2030-02-01"), D("2030-02-01"), D("2030-02-28"), D("2030-02-01")]


def test_narrative_escalation(spark):
    rows = spark.createDataFrame([(1, 10_000.0, 2.0, 120, 24)], "lease_id int, start_rent double, esc_pct double, total_months int, cadence int")
    assert [r.monthly_rent for r in text.escalation_steps(rows).orderBy("start_month").collect()] == [10_000, 10_200, 10_404, 10_612.08, 10_824.32]


@pytest.mark.parametrize(("typed", "value"), [("$1,000.50", 1000.5), ("S98,463.60*", 98463.6), ("1.234.567.89", 1234567.89), ("12 /mo", 12.0), ("n/a", None), (None, None)])
def test_rents_as_text(spark, typed, value):
    assert spark.createDataFrame([(typed,)], "t string").select(text.rent_value(F.col("t"))).first()[0] == value


def test_area_based_rent(spark):
    docs = spark.createDataFrame([(0, "Base rent\nof $3.00 per rentable\nsquare foot per month"), (1, "Base rent $3,000 per month"), (2, None)], "k int, t string")
    assert sorted(map(tuple, text.area_based(docs, "k", "t").collect())) == [(0, True), (1, False), (2, False)]


def test_reanchored_periods_keep_their_months(spark):
    rows = [(1, 0, D("2030-01-01"), D("2030-06-30"), 1.0), (1, 1, D("2030-07-01"), D("2034-12-31"), 2.0), (1, 2, D("2035-01-01"), D("2039-12-31"), 3.0)]
    periods = spark.createDataFrame(rows, "lease_id int, period_idx int, period_start date, period_end date, monthly_rent double")
    got = repair.reanchor(periods, spark.createDataFrame([(1, D("2024-06-26"))], "lease_id int, anchor date")).orderBy("period_idx").collect()
    assert [(r.period_start, r.period_end) for r in got] == [(D("2024-06-26"), D("2024-12-25")), (D("2024-12-26"), D("2029-06-25")), (D("2029-06-26"), D("2034-06-25"))]


def test_markup_to_text(spark):
    assert spark.createDataFrame([("<p>A &amp; B</p>\r\n<script>x</script><b>c</b>",)], "t string").select(text.plain(F.col("t"))).first()[0] == "A & B \n c"


def test_label_evaluation(spark):
    p = Portfolio(spark, "/root/testdata/sf0.001")
    (r,) = text_queries.label_evaluation(p).collect()
    keys = [x.p_partkey % len(text_queries.CASES) for x in p.table("part").select("p_partkey").collect()]
    assert (r.n_cases, r.n_asked) == (len(keys), sum(text_queries.CASES[k][2] is not None for k in keys))
    assert r.bucket_passes >= 0.9 * r.n_cases and r.subtype_passes >= 0.9 * r.n_asked and r.full_passes >= 0.85 * r.n_cases
    found = text_queries.label_confusion(p).where("level = 'bucket'").collect()
    assert sum(x["count"] for x in found) == len(keys) and sum(x["count"] for x in found if x.expected == x.predicted) == r.bucket_passes


def test_label_trace_ends_where_the_cascade_decides(spark):
    p = Portfolio(spark, "/root/testdata/sf0.001")
    table = text_queries.label_table(p).limit(150)
    ends = {r.label_id: r for r in labels.classify(table).collect()}
    kinds = {"exact": "exact", "corrected": "exact", "token": "token", "fuzzy": "fuzzy", "fallback": "fallback", "salvaged exact": "ocr_rescue", "salvaged fuzzy": "ocr_rescue", "salvaged token": "ocr_rescue"}
    seen = set()
    for r in labels.trace(table).collect():
        *before, last = r.trace
        seen.add(last.stage)
        assert not any(x.decides for x in before) and last.decides
        assert last.bucket == ends[r.label_id].bucket and kinds[last.stage] == ends[r.label_id].match_type
    assert {"exact", "token", "fuzzy", "fallback"} <= seen


def test_words_are_computed_once_for_all_phrases(spark):
    rows = spark.createDataFrame([(" a rent "), (" no "), None], "string").select(text.says(F.lower("value"), ["rent", "sum"]).alias("said"))
    assert "contains(lower(" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r.said for r in rows.collect()] == [True, False, None]


def test_texts_are_written_and_read_in_more_than_one_task(spark):
    """A file of leases is one task; texts are dealt by lease before they are written."""
    p = Portfolio(spark, "/root/testdata/sf0.001")
    for plan in (text_queries.wording(p), text_queries.prose_charges(p)):
        assert "REPARTITION_BY_COL" in plan._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_in_their_own_row(spark):
    """Neither query reads a text twice or joins what it found back: leases are scanned once and dealt once."""
    p = Portfolio(spark, "/root/testdata/sf0.001")
    for plan in (text_queries.candidate_ranking(p), text.area_based(text_queries.wording(p), "lease_id", "text")):
        told = plan._jdf.queryExecution().executedPlan().toString()
        assert told.count("Scan parquet") == 1 and told.count("Exchange hashpartitioning") == 1 and "Join" not in told


def test_letters_that_tell_a_window_apart():
    assert all(any(p in name for p in text.RENT_LETTERS) for name in text.RENTS) and all(any(p in name for p in text.AREA_LETTERS) for name in text.AREAS)
    assert all(name.endswith(text.LAST_WORD) for names in text.EVENTS.values() for name in names)
