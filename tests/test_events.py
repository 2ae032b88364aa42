"""Events that several sources date, and events that follow from others."""

from datetime import date

from leasegrid.operators import events

D = date.fromisoformat
RULES = "lease_id long, ord int, event string, rule_kind string, trigger_event string, second_event string, fallback_event string, offset_value int"
KNOWN = "lease_id long, event string, day date"


def test_the_first_source_wins(spark):
    one = spark.createDataFrame([(1, "delivery_date", D("2030-02-01")), (1, "opening_date", None), (1, "party", D("2030-01-01"))], KNOWN)
    two = spark.createDataFrame([(1, "delivery_date", D("2029-01-01")), (1, "opening_date", D("2031-05-05")), (1, "opening_date", D("2031-04-05"))], KNOWN)
    got = sorted(map(tuple, events.merged([one, two]).collect()))
    assert got == [(1, "delivery_date", D("2030-02-01"), 0), (1, "opening_date", D("2031-04-05"), 1)]


def told(spark, known, rules):
    got = events.resolve(spark.createDataFrame(known, KNOWN), spark.createDataFrame(rules, RULES)).collect()
    return {(r.lease_id, r.event): (str(r.day) if r.day else None, r.state, list(r.open)) for r in got}


def test_chains_are_followed_to_their_end(spark):
    known = [(1, "execution_date", D("2030-01-31"))]
    rules = [
        (1, 0, "rent_commencement_date", "later_of", "possession_date", "opening_date", None, None), (1, 1, "delivery_date", "event_plus_days", "execution_date", None, None, 30),
        (1, 2, "possession_date", "first_of_month_on_or_after_event", "delivery_date", None, None, None), (1, 3, "opening_date", "event_plus_months", "execution_date", None, None, 1),
        (1, 4, "opening_date", "event_plus_months", "execution_date", None, None, 9), (1, 5, "execution_date", "event_plus_days", "opening_date", None, None, 9),
    ]
    assert told(spark, known, rules) == {
        (1, "execution_date"): ("2030-01-31", "known", []), (1, "delivery_date"): ("2030-03-02", "resolved", []), (1, "possession_date"): ("2030-04-01", "resolved", []),
        (1, "opening_date"): ("2030-02-28", "resolved", []), (1, "rent_commencement_date"): ("2030-04-01", "resolved", []),
    }


def test_a_pair_goes_by_the_one_that_can_come(spark):
    known = [(k, "delivery_date", D("2030-01-15")) for k in (1, 2, 3)]
    rules = [
        (1, 0, "rent_commencement_date", "later_of", "delivery_date", "permit_issuance_date", None, None),
        (2, 0, "rent_commencement_date", "earlier_of", "delivery_date", "opening_date", None, None), (2, 1, "opening_date", "event_plus_days", "delivery_date", None, None, -5),
        (3, 0, "rent_commencement_date", "event_date", "possession_date", None, "commencement_date", None), (3, 1, "commencement_date", "first_full_calendar_month_after_event", "delivery_date", None, None, None),
    ]
    got = told(spark, known, rules)
    assert got[1, "rent_commencement_date"] == ("2030-01-15", "resolved", ["permit_issuance_date"])
    assert got[2, "rent_commencement_date"] == ("2030-01-10", "resolved", [])
    assert got[3, "rent_commencement_date"] == ("2030-02-01", "resolved", ["possession_date"])


def test_cycles_and_missing_events_are_told(spark):
    known = [(2, "execution_date", D("2030-01-01"))]
    rules = [
        (1, 0, "opening_date", "event_plus_days", "delivery_date", None, None, 1), (1, 1, "delivery_date", "event_plus_days", "possession_date", None, None, 1), (1, 2, "possession_date", "event_date", "opening_date", None, None, None),
        (1, 3, "rent_commencement_date", "event_date", "opening_date", None, None, None), (1, 4, "effective_date", "event_date", "execution_date", None, None, None), (1, 5, "commencement_date", "event_date", "commencement_date", None, None, None),
        (2, 0, "opening_date", "event_date", "delivery_date", None, None, None), (2, 1, "delivery_date", "event_date", "opening_date", None, None, None), (2, 2, "rent_commencement_date", "later_of", "execution_date", "opening_date", None, None),
    ]
    got = told(spark, known, rules)
    assert {e: got[1, e][1] for e in ("opening_date", "delivery_date", "possession_date", "commencement_date")} == dict.fromkeys(("opening_date", "delivery_date", "possession_date", "commencement_date"), "cycle")
    assert got[1, "rent_commencement_date"] == (None, "missing", ["opening_date"]) and got[1, "effective_date"] == (None, "missing", ["execution_date"])
    assert got[2, "rent_commencement_date"] == ("2030-01-01", "resolved", ["opening_date"]) and got[2, "delivery_date"][1] == "cycle"
