"""Queries over events that follow from others, and over the repairs of what was extracted, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasegrid.operators import chain, events
from leasegrid.plans import oracle
from leasegrid.plans.queries import PLANS, periods
from leasegrid.sources.portfolio import Portfolio


def sources(p: Portfolio) -> list[DataFrame]:
    """Two sources of events: what was typed, and what was found, which differ where both know one."""
    own = p.leases()
    event = lambda where, name, days: own.where(where).select("lease_id", F.lit(name).alias("event"), F.date_add("commence", days).alias("day"))
    typed = event("lease_id % 6 <> 4", "execution_date", 0)
    found = event("true", "execution_date", 99).unionByName(event("lease_id % 6 = 0", "delivery_date", 10)).unionByName(event("lease_id % 6 = 0", "no such event", 0))
    return [typed, found]


#: Rules by lease, of which the last column is the offset.
RULES = [
    (0, 0, "rent_commencement_date", "later_of", "possession_date", "opening_date", None, None), (0, 1, "possession_date", "event_plus_days", "delivery_date", None, None, 30), (0, 2, "opening_date", "event_plus_months", "execution_date", None, None, 2),
    (1, 0, "rent_commencement_date", "first_full_calendar_month_after_event", "commencement_date", None, None, None), (1, 1, "commencement_date", "event_plus_months", "execution_date", None, None, 3), (1, 2, "commencement_date", "event_date", "execution_date", None, None, None),
    (2, 0, "rent_commencement_date", "event_date", "possession_date", None, "commencement_date", None), (2, 1, "commencement_date", "event_plus_days", "execution_date", None, None, 15),
    (3, 0, "opening_date", "event_date", "delivery_date", None, None, None), (3, 1, "delivery_date", "event_plus_days", "opening_date", None, None, 1), (3, 2, "rent_commencement_date", "later_of", "execution_date", "opening_date", None, None),
    (4, 0, "rent_commencement_date", "event_plus_days", "execution_date", None, None, 5), (5, 0, "effective_date", "event_date", "permit_issuance_date", None, None, None),
]


def event_resolution(p: Portfolio) -> DataFrame:
    rules = p.spark.createDataFrame(RULES, "k long, ord int, event string, rule_kind string, trigger_event string, second_event string, fallback_event string, offset_value int")
    rules = p.leases().select("lease_id", (F.col("lease_id") % 6).alias("k")).join(F.broadcast(rules), "k").drop("k")
    return events.resolve(events.merged(sources(p)), rules).withColumn("open", F.array_join("open", ","))


def lines_of(p: Portfolio, line: Column) -> DataFrame:
    """lease_id, lines: a line for each period, in order."""
    return periods(p).groupBy("lease_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("period_idx", line.alias("line")))), lambda x: x.line), "\n").alias("lines"))


def extracted(p: Portfolio) -> tuple[DataFrame, DataFrame, DataFrame]:
    """By lease one of seven cases: rows with short dates; none, or unreadable ones, with the rows in the
    text; unreadable ones with months counted from an event that the text dates, or does not; none with a
    term and an escalation; rows with the whole range in one cell."""
    k = F.col("lease_id") % 7
    day = lambda c: F.date_format(c, "M/d/yy")
    usd = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    rows = periods(p).where(k.isin(0, 2, 3, 4, 6)).select(
        "lease_id", F.col("period_idx").alias("ord"), F.when(k == 0, day("period_start")).when(k == 6, F.concat(day("period_start"), F.lit("-"), day("period_end"))).when(k == 4, None).otherwise("NOT A DATE").alias("start_text"),
        F.when(k == 0, day("period_end")).when(k == 6, "").when(k == 4, None).otherwise("ALSO NOT A DATE").alias("end_text"), (F.col("monthly_rent") + 100).alias("monthly_rent"),
    )
    dated = lines_of(p, F.concat(day("period_start"), F.lit("-"), day("period_end"), F.lit("    "), usd(F.col("monthly_rent") + 100)))
    months = F.concat_ws("\n", F.concat(F.lit("Months 1-12: "), usd("year1"), F.lit(" monthly")), F.concat(F.lit("Months 13-24: "), usd(F.col("year1") + 50), F.lit(" monthly")))
    named = lambda c: F.date_format(c, "MMMM d, yyyy")
    text = (
        F.when(k.isin(1, 2), F.concat(F.lit("Minimum Rent:\n"), F.col("lines")))
        .when(k == 3, F.concat(F.lit("The Rent Commencement Date is "), named("commence"), F.lit(".\nBase Rent is due from the first full calendar month after the Rent Commencement Date.\n"), months))
        .when(k == 4, F.concat(F.lit("Rent Commencement shall be determined later.\n"), months))
        .when(k == 5, F.concat(F.lit("Lease term "), F.date_format("commence", "MM/dd/yyyy"), F.lit("-"), F.date_format(F.add_months("commence", 60), "MM/dd/yyyy"), F.lit("\nRent "), F.format_number("year1", 2), F.lit(" month, escalated 2% every two years")))
        .otherwise("Minimum Rent")
    )
    docs = p.spread().join(dated.hint("shuffle_hash"), "lease_id", "left").select("lease_id", text.alias("text"))
    return rows, docs, p.leases().limit(0).select("lease_id", F.lit("").alias("event"), F.col("commence").alias("day"))


def charges_told(p: Portfolio) -> tuple[DataFrame, DataFrame]:
    """By lease one of four cases: a charge without its terms, which the text tells; steps, the second of
    which is a hint already; a charge that the text alone has; text that tells nothing."""
    k = F.col("lease_id") % 4
    own = p.spread()
    usd = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    at = lambda months, days=0: F.date_format(F.date_add(F.add_months("commence", months), days), "MMMM d, yyyy")
    steps = F.concat_ws("\n", F.lit("Common Area Maintenance:"), *[F.concat(at(12 * i), F.lit(" through "), at(12 * i + 12, -1), F.lit(": "), usd(F.col("year1") + 25 * i), F.lit(" per month")) for i in range(3)])
    text = F.when(k == 0, F.concat(F.lit("NNN escalate 2.5% every year, amt "), F.format_number("year1", 2))).when(k == 1, steps).when(k == 2, F.concat(F.lit("Real estate taxes amt "), F.format_number("year1", 2), F.lit(" per month"))).otherwise("Nothing of charges")
    docs = own.select("lease_id", text.alias("text"))
    none = F.lit(None)
    charges = own.select(
        "lease_id", F.lit(0).cast("long").alias("ord"), F.lit("cams").alias("bucket"), F.lit("Common Area Maintenance").alias("label"), F.when(k != 0, F.lit(7.0)).alias("year1"), F.when(k == 1, F.lit(3.0)).alias("esc_pct"),
        none.cast("date").alias("charge_start"), F.when(k == 1, F.col("commence")).alias("esc_start"), F.lit(0.5).alias("confidence"),
    ).unionByName(own.where(k == 3).select("lease_id", F.lit(1).cast("long").alias("ord"), none.cast("string").alias("bucket"), F.lit("Signage").alias("label"), F.lit(9.0).alias("year1"), none.cast("double").alias("esc_pct"), F.col("commence").alias("charge_start"), none.cast("date").alias("esc_start"), F.lit(0.9).alias("confidence")))
    hints = own.where((k == 1) | (k == 3)).select("lease_id", F.lit("cams").alias("bucket"), F.lit("Common Area Maintenance").alias("label"), F.add_months("commence", 12).alias("date"), F.expr("double(replace(format_number(year1 + 25, 2), ',', ''))").alias("amount"))
    return chain.told_charges(charges, hints, docs, ["cams", "insurance", "taxes"])


PLANS |= {
    "event_dates": lambda p: events.merged(sources(p)),
    "event_resolution": event_resolution,
    "repair_chain": lambda p: chain.repaired(*extracted(p))[0],
    "repair_outcome": lambda p: chain.repaired(*extracted(p))[1],
    "told_charges": lambda p: charges_told(p)[0],
    "told_hints": lambda p: charges_told(p)[1],
}

_E = "lease_id, '{e}' AS event, {day} AS day, '{state}' AS state, '{open}' AS open FROM leases WHERE lease_id%6={k}"


def _events() -> str:
    add = oracle.add_m
    full = lambda d: f"CAST(date_trunc('month', {d}) + INTERVAL 1 MONTH AS DATE)"
    rows = [
        *[(k, "execution_date", "commence" if k != 4 else "commence+99", "known", "") for k in range(6)], (0, "delivery_date", "commence+10", "known", ""), (0, "possession_date", "commence+40", "resolved", ""),
        (0, "opening_date", add("commence", "2"), "resolved", ""), (0, "rent_commencement_date", f"greatest(commence+40, {add('commence', '2')})", "resolved", ""), (1, "commencement_date", add("commence", "3"), "resolved", ""),
        (1, "rent_commencement_date", full(add("commence", "3")), "resolved", ""), (2, "commencement_date", "commence+15", "resolved", ""), (2, "rent_commencement_date", "commence+15", "resolved", "possession_date"),
        (3, "opening_date", "CAST(NULL AS DATE)", "cycle", "delivery_date"), (3, "delivery_date", "CAST(NULL AS DATE)", "cycle", "opening_date"), (3, "rent_commencement_date", "commence", "resolved", "opening_date"),
        (4, "rent_commencement_date", "commence+104", "resolved", ""), (5, "effective_date", "CAST(NULL AS DATE)", "missing", "permit_issuance_date"),
    ]
    return " UNION ALL ".join("SELECT " + _E.format(k=k, e=e, day=day, state=state, open=open_) for k, e, day, state, open_ in rows)


_MONTHS = "CAST(date_trunc('month', commence) + INTERVAL 1 MONTH AS DATE)"
_STEPS = f"""SELECT lease_id, 24*i+1 AS place, {oracle.add_m('commence', '24*i')} AS period_start, {oracle.add_m('commence', 'least(24*i+24, 60)')} - 1 AS period_end, {oracle.f2("CAST(printf('%.2f', year1) AS DOUBLE)*pow(1.02e0, i)")} AS monthly_rent, 'materialized' AS stage FROM leases, (VALUES (0),(1),(2)) v(i) WHERE lease_id%7=5"""
_SCHEDULE = f"""SELECT lease_id, CASE WHEN lease_id%7 IN (1,2) THEN period_start - DATE '1970-01-01' ELSE period_idx END AS place, period_start, period_end, {oracle.f2('monthly_rent+100')} AS monthly_rent, CASE WHEN lease_id%7 IN (0,6) THEN 'read' ELSE 'recovered' END AS stage FROM periods WHERE lease_id%7 IN (0,1,2,6)
  UNION ALL SELECT lease_id, 12*i+1, {oracle.add_m(_MONTHS, '12*i')}, {oracle.add_m(_MONTHS, '12*i+12')} - 1, {oracle.f2('year1+50*i')}, 'materialized' FROM leases, (VALUES (0),(1)) v(i) WHERE lease_id%7=3 UNION ALL {_STEPS}"""
_STEP = "CAST(printf('%.2f', year1+25*{i}) AS DOUBLE)"

ORACLE_SQL = {
    "event_dates": oracle.sql("""SELECT lease_id, 'execution_date' AS event, CASE WHEN lease_id%6<>4 THEN commence ELSE commence+99 END AS day, CAST(lease_id%6=4 AS INTEGER) AS source FROM leases
      UNION ALL SELECT lease_id, 'delivery_date', commence+10, 1 FROM leases WHERE lease_id%6=0""", "leases"),
    "event_resolution": oracle.sql(_events(), "leases"),
    "repair_chain": oracle.sql(_SCHEDULE, "periods"),
    "repair_outcome": oracle.sql(f""", s AS ({_SCHEDULE}), n AS (SELECT lease_id, count(*) AS n FROM s GROUP BY lease_id)
      SELECT l.lease_id, ['read','recovered','recovered','materialized','none','materialized','read'][l.lease_id%7+1] AS stage, [NULL,'omitted','unparsed','materialized','needs_anchor','materialized',NULL][l.lease_id%7+1] AS notice,
        ['dated_periods','dated_periods','dated_periods','relative_month_ranges','relative_month_ranges','narrative_escalation','dated_periods'][l.lease_id%7+1] AS representation, coalesce(n, 0) AS n_periods FROM leases l LEFT JOIN n ON n.lease_id=l.lease_id""", "periods"),
    "told_charges": oracle.sql(f"""SELECT lease_id, 0 AS ord, 'cams' AS bucket, 'Common Area Maintenance' AS label, CASE lease_id%4 WHEN 0 THEN {_STEP.format(i=0)} WHEN 1 THEN {_STEP.format(i=0)} ELSE 7e0 END AS year1, CASE WHEN lease_id%4=0 THEN 2.5e0 END AS esc_pct,
        CASE WHEN lease_id%4=1 THEN commence END AS charge_start, CAST(NULL AS DATE) AS esc_start, CASE WHEN lease_id%4=0 THEN 0.72e0 ELSE 0.5e0 END AS confidence FROM leases
      UNION ALL SELECT lease_id, 1001, 'taxes', 'real estate taxes', {_STEP.format(i=0)}, NULL, NULL, NULL, 0.72e0 FROM leases WHERE lease_id%4=2 UNION ALL SELECT lease_id, 1, NULL, 'Signage', 9e0, NULL, commence, NULL, 0.9e0 FROM leases WHERE lease_id%4=3""", "leases"),
    "told_hints": oracle.sql(f"""SELECT lease_id, 'cams' AS bucket, 'Common Area Maintenance' AS label, {oracle.add_m('commence', '12*i')} AS date, {_STEP.format(i='i')} AS amount FROM leases, (VALUES (1),(2)) v(i) WHERE lease_id%4=1 OR (lease_id%4=3 AND i=1)""", "leases"),
}
