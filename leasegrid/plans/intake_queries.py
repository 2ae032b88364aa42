"""Queries over forms and extractions as they are typed or detected, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrid.functions import dates
from leasegrid.operators import intake, ledger
from leasegrid.plans import oracle
from leasegrid.plans.queries import PLANS, changed, inputs, months, periods, rows
from leasegrid.sources import tables
from leasegrid.sources.portfolio import BUCKETS, Portfolio


def one_of(values: list[str | None], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at % len(values) + 1).cast("int"))


def events(p: Portfolio) -> DataFrame:
    """lease_id, ord, commence: events dealt to leases."""
    keys = p.table("orders").agg(F.max("o_orderkey").alias("most"))
    own = p.table("events").crossJoin(F.broadcast(keys)).select((F.col("event_id") % F.col("most") + 1).alias("lease_id"), F.col("event_id").alias("ord"))
    return own.join(p.dealt().select("lease_id", "commence"), "lease_id")


def after(days: Column) -> Column:
    return F.date_add("commence", days.cast("int"))


def typed_concessions(p: Portfolio) -> DataFrame:
    """Concessions as a form holds them: by month, by date, by window; some with what no rule lets pass."""
    k, n = F.col("ord") % 8, F.col("ord")
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    return events(p).select(
        "lease_id", "ord", F.when(k < 2, "free_rent").when(k < 5, "abatement").otherwise("legacy").alias("list"), F.when(k == 5, "free_rent").when(k > 5, "abatement").alias("type"),
        F.when(k == 5, "monthly_row").when(k > 5, "legacy_window").alias("scope"), F.when(k == 0, text(n % 70 + 1)).when(k == 2, F.concat(F.lit(" "), text(n % 130), F.lit(" "))).when(k == 3, "2.5").otherwise(none).alias("month_text"),
        F.when(k.isin(1, 4, 5), after(n * 13 % 2000)).alias("day"), F.when((k == 6) & (n % 3 == 0), F.date_add("commence", 10)).alias("start_date"), F.when(k == 6, after(n * 7 % 900)).alias("end_date"),
        F.when(k == 2, "percent").when(k == 4, "fixed_amount").when(k == 6, F.when(n % 5 == 0, "other").otherwise("percent")).alias("value_mode"),
        F.when(k == 2, text(n % 120)).when(k == 3, "10").when(k == 4, F.when(n % 3 == 0, "abc").otherwise("500")).when(k == 6, text(n % 50)).alias("value_text"),
    )


def concession_intake(p: Portfolio) -> DataFrame:
    helper = p.leases().select("lease_id", after(F.col("custkey") % 300).alias("helper_end"), (F.col("custkey") % 5 * 50).cast("double").alias("helper_pct"))
    return intake.concession_events(typed_concessions(p), helper, months(p))


def concession_rules(p: Portfolio) -> DataFrame:
    n = F.col("ord")
    raw = typed_concessions(p).withColumns({
        "month_text": F.when(n % 8 == 4, (n % 12 + 1).cast("string")).otherwise(F.col("month_text")),
        "value_text": F.when(n % 7 == 0, " ").otherwise(F.col("value_text")), "value_mode": F.when(n % 11 == 0, None).otherwise(F.col("value_mode")),
    })
    return intake.concession_rules(raw, months(p))


def override_rules(p: Portfolio) -> DataFrame:
    n = F.col("ord")
    raw = events(p).select(
        "lease_id", "ord", one_of(["base_rent", "cams", "taxes", "parking", ""], n).alias("target_key"), F.when(n % 6 == 0, " ").when(n % 6 == 1, "13/45/2020").otherwise(F.date_format(after(n * 17 % 2500), "M/d/yyyy")).alias("date_text"),
        one_of(["", "x", "-5", "100"], n).alias("amount_text"),
    ).withColumn("day", dates.parse_token(F.col("date_text")))
    return intake.override_rules(raw, p.charges(), months(p))


def items(p: Portfolio) -> DataFrame:
    """Line items, numbered within their lease."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return p.table("lineitem").withColumn("ord", F.row_number().over(order).cast("long")).withColumnRenamed("l_orderkey", "lease_id").withColumn("ship", F.col("l_shipdate").cast("date"))


def charge_rules(p: Portfolio) -> DataFrame:
    part, day = F.col("l_partkey"), lambda c: F.date_format(c, "M/d/yyyy")
    later = F.date_add("ship", 400)
    raw = items(p).select(
        "lease_id", "ord", F.when(part % 5 == 0, "n/a").when(part % 5 == 1, "").otherwise(F.col("l_quantity").cast("string")).alias("year1_text"), F.when(F.col("l_suppkey") % 4 == 0, "3%").otherwise(" 3 ").alias("esc_text"),
        F.when(part % 7 == 0, "soon").otherwise(day("ship")).alias("start_text"), F.when(part % 3 == 0, "").otherwise(day(later)).alias("esc_start_text"),
    )
    return intake.charge_rules(raw.withColumn("start_day", dates.parse_token(F.col("start_text"))).withColumn("esc_start_day", dates.parse_token(F.col("esc_start_text"))), months(p))


def override_hints(p: Portfolio) -> DataFrame:
    n = F.col("ord")
    hints = events(p).select("lease_id", "ord", F.when(n % 3 == 0, one_of([*BUCKETS, "roof"], n)).alias("bucket"), F.when(n % 3 == 1, one_of(["Common  Area", "insurance ", "TAXES", "Parking", ""], n)).alias("label"))
    label = F.when(F.col("key") == "cams", "Common Area").otherwise(F.initcap("key"))
    return intake.override_hints(hints, p.charges().withColumn("label", label))


def detected(p: Portfolio) -> DataFrame:
    part = F.col("l_partkey")
    bucket = one_of([*BUCKETS, "roof", None], part)
    raw = items(p).select(
        "lease_id", "ord", F.when(part % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), one_of(BUCKETS, part), F.lit(" "))).alias("label"), bucket.alias("bucket"), F.when(part % 11 == 0, float("nan")).otherwise(F.col("l_extendedprice") * 20).alias("year1"),
        (F.col("l_discount") * 1500 - 20).alias("esc_pct"), F.when(F.col("l_suppkey") % 3 == 0, "nnn").otherwise("misc").alias("canonical_type"), F.when(F.col("l_suppkey") % 5 > 0, (F.col("l_quantity") - 10) / 30).alias("confidence"),
    )
    return intake.guarded_charges(raw)


def nnn_mode(p: Portfolio) -> DataFrame:
    cust = F.col("custkey")
    found = p.leases().select(
        "lease_id", F.when(cust % 2 == 0, F.col("nnn_agg_year1")).alias("estimate"), F.when(cust % 3 == 0, F.col("year1")).alias("cams"), F.lit(None).cast("double").alias("insurance"), F.when(cust % 7 == 0, F.col("year1")).alias("taxes")
    )
    charges = p.charges().where("lease_id % 2 = 1").withColumn("label", F.when(F.col("lease_id") % 3 == 0, " ").otherwise(F.col("key")))
    return intake.nnn_mode(found, charges)


def one_time_intake(p: Portfolio) -> DataFrame:
    n, cust = F.col("ord"), F.col("custkey")
    listed = p.one_time().where("lease_id % 3 > 0").select("lease_id", "ord", F.when(n % 11 == 0, " ").otherwise(F.concat(F.lit(" "), "label")).alias("label"), "date", "amount", one_of(["1", "-1", "0"], n).cast("int").alias("sign"))
    deposits = p.leases().select("lease_id", F.when(cust % 4 > 0, F.col("year1")).otherwise(0.0).alias("amount"), F.when(cust % 2 == 0, F.date_add("commence", 5)).alias("date"), F.col("commence").alias("first_start"))
    return intake.one_time_items(listed, deposits)


def field_triage(p: Portfolio) -> DataFrame:
    n = F.col("lease_id")
    found = p.leases().select(
        "lease_id", F.when(n % 5 > 0, F.concat(F.lit("Lease "), n.cast("string"))).otherwise("").alias("lease_name"), F.when(n % 7 > 0, "1000").otherwise("0").alias("square_footage"), F.when(n % 3 > 0, "2030-01-01").alias("abatement_end"),
        F.when(n % 2 > 0, "50").alias("abatement_pct"), (n % 11 / F.lit(10.0)).alias("schedule"), *[F.when(n % (k + 2) > 0, F.col("year1") * (n % (k + 3))).alias(f"charge_{b}") for k, b in enumerate(BUCKETS)],
        F.split(one_of(["cams.year1,lease_name", "square_footage,taxes", "", "abatement_pct,security,schedule"], n), ",").alias("flags"),
    )
    return intake.field_triage(found)


def detected_windows(p: Portfolio) -> DataFrame:
    cust = F.col("custkey")
    windows = p.leases().select("lease_id", F.col("commence").alias("start_date"), after(cust % 400).alias("end_date"), (cust % 3 * 50).cast("double").alias("pct"))
    return intake.window_events(windows, months(p))


def zero_rent(p: Portfolio) -> DataFrame:
    from leasegrid.operators import generate

    own = generate.expand(changed(p, monthly_rent="case when lease_id % 3 = 0 and period_idx > 0 then 0D else monthly_rent end"))
    return intake.zero_rent(own.select("lease_id", F.col("monthly_rent").alias("scheduled_base_rent"), F.lit(False).alias("is_concession_row"))).withColumn("share", F.round("share", 9))


def chronology(p: Portfolio) -> DataFrame:
    return intake.chronology(changed(p, period_end="case when period_idx % 2 = 0 then period_end end", period_start="case when period_idx <> 3 then period_start end"))


def active_charges(p: Portfolio) -> DataFrame:
    none = p.charges().withColumn("year1", F.when(F.col("ord") == 1, 0.0).otherwise(F.col("year1")))
    return intake.active_charges(ledger.charge_rows(none, months(p), p.overrides(), p.leases()), none, p.leases())


def escalated_charges(p: Portfolio) -> DataFrame:
    """The charges of a portfolio whose escalations start on dates of their own."""
    own = p.charges().join(p.leases().select("lease_id", "commence"), "lease_id").withColumn("esc_start", F.when(F.col("ord") != 2, after(F.col("ord") * 100)))
    return ledger.charge_rows(own.drop("commence"), months(p), p.overrides(), p.leases()).where("key <> 'nnn_aggregate'")


def csv_variant(p: Portfolio) -> DataFrame:
    """The export with every charge in a column of its own, read where the ledger reads a lease's charges."""
    own = inputs(p)
    at = F.array(*[F.struct(F.lit(b).alias("key"), F.lit(i).alias("at")) for i, b in enumerate(BUCKETS)])
    out = ledger.with_remaining(ledger.ledger(own, own.leases.select("lease_id", at.alias("columns")).hint("merge"), BUCKETS))
    return out.select(
        "lease_id", F.col("month_num").alias("Lease Month #"), F.col("abatement_amount").alias("Abatement ($)"), *[F.coalesce(b, F.lit(0.0)).alias(f"{b} ($)") for b in BUCKETS], F.col("total_nnn_amount").alias("Total NNN ($)"),
        F.col("one_time_charges_amount").alias("One-time Charges ($)"), F.col("total_obligation_remaining").alias("Total Obligation Remaining ($)"),
    )


def template_raw(p: Portfolio) -> DataFrame:
    n = F.col("lease_id")
    some = lambda k, c: F.when(n % k > 0, c)
    return p.leases().select(
        "lease_id", "commence", "term", some(2, F.date_add("commence", 30)).alias("rent_start"), some(3, F.col("expire")).alias("expire"), some(4, F.col("analysis_date")).alias("analysis_date"), some(5, F.lit(0.08)).alias("discount_rate"),
        some(2, F.col("year1")).alias("cams_year1"), some(3, F.lit(0.04)).alias("cams_esc"), some(2, F.lit(0.01)).alias("security_esc"), some(4, n % 7).alias("abatement_months"), some(3, F.date_add("commence", 40)).alias("abatement_start"),
        some(2, F.lit(0.5)).alias("abatement_pct"), F.col("esc").alias("rent_esc"),
    )


def template_issues(p: Portfolio) -> DataFrame:
    n = F.col("lease_id")
    raw = p.leases().select(
        "lease_id", F.when(n % 13 > 0, F.col("commence")).alias("commence"), F.when(n % 11 == 0, 0).when(n % 11 == 1, 601).otherwise(F.col("term")).alias("term"), F.when(n % 7 > 0, F.col("square_footage")).otherwise(0.0).alias("square_footage"),
        F.when(n % 17 > 0, F.when(n % 5 > 0, F.col("year1")).otherwise(-1.0)).alias("year1"), F.when(n % 3 > 0, F.col("esc")).otherwise(0.5).alias("rent_esc"),
    )
    return intake.template_issues(raw)


def lease_month_ranges(p: Portfolio) -> DataFrame:
    n, first, last = intake.lease_month(F.col("date"), F.col("commence"))
    return p.one_time().join(p.leases().select("lease_id", "commence"), "lease_id").select("lease_id", "ord", n.alias("month_number"), first.alias("month_start"), last.alias("month_end"))


def payloads(p: Portfolio) -> DataFrame:
    """An extraction for each lease as it is answered: fenced and bare JSON, with fields left out, and none."""
    day = lambda c: F.date_format(c, "M/d/yyyy")
    row = F.concat(F.lit('{"periodStart": "'), day("commence"), F.lit('", "periodEnd": "'), day("expire"), F.lit('", "monthlyRent": '), F.format_string("%.2f", F.col("year1")), F.lit("}"))
    forms = [
        F.concat(F.lit('```json\n{"rentSchedule": ['), row, F.lit('], "leaseName": "A", "sfRequired": true, "confidenceFlags": ["cams", "taxes"]}\n```')), F.concat(F.lit('{"rentSchedule": ['), row, F.lit("]}")), F.lit('{"leaseName": null, "confidenceFlags": ["a", "b", "c", "d"]}'),
        F.lit('{"recurringCharges": [{"label": "CAM"}], "rentSchedule": [{"periodStart": "soon", "periodEnd": "1/1/2030", "monthlyRent": 5}]}'), F.lit("I could not read it."), F.lit(None).cast("string"),
    ]
    return p.leases().select("lease_id", F.element_at(F.array(*forms), (F.col("lease_id") % 6 + 1).cast("int")).alias("payload"))


def extraction_defaults(p: Portfolio) -> DataFrame:
    out = tables.completed(payloads(p), "lease_id")
    n = lambda c: F.size(c).cast("long")
    return out.select("lease_id", n("rent_schedule").alias("n_rows"), n("recurring_charges").alias("n_charges"), "lease_name", "sf_required", n("flags").alias("n_flags"), "confidence", n("notices").alias("n_notices"), "meaningful", "usable")


def file_routing(p: Portfolio) -> DataFrame:
    name = F.concat(F.lit("lease "), F.col("lease_id").cast("string"), F.lit("."), one_of(["csv", "XLSX", "pdf", "txt", "HTML", "json", "exe", "v2.docx"], F.col("lease_id")))
    return p.leases().select("lease_id", tables.routed(name).alias("reader"))


PLANS |= {
    "extraction_defaults": extraction_defaults,
    "extracted_periods": lambda p: tables.extracted_periods(payloads(p), "lease_id"),
    "file_routing": file_routing,
    "concession_intake": concession_intake,
    "concession_rules": concession_rules,
    "override_rules": override_rules,
    "charge_rules": charge_rules,
    "override_hints": override_hints,
    "charge_guards": detected,
    "charge_flags": lambda p: intake.charge_flags(detected(p), p.charges().select("lease_id", F.col("ord").alias("idx"), "key", F.col("key").alias("label"))),
    "nnn_mode": nnn_mode,
    "one_time_intake": one_time_intake,
    "field_triage": field_triage,
    "manual_fallback": lambda p: intake.manual_fallback(p.leases().select("lease_id", (F.col("lease_id") % 10 / F.lit(10.0)).alias("overall"), (F.col("lease_id") % 4 / F.lit(3.0)).alias("schedule"))),
    "detected_windows": detected_windows,
    "concessions_by_month": lambda p: intake.monthly_concessions(concession_intake(p).where("scope = 'monthly_row'"), months(p)),
    "zero_rent_share": zero_rent,
    "chronology_bounds": chronology,
    "active_charges": active_charges,
    "escalated_charges": escalated_charges,
    "ledger_page": lambda p: intake.page(rows(p), 1).select("lease_id", "month_num", "period_start", "base_rent_applied", "total_monthly_obligation"),
    "csv_variant": csv_variant,
    "template_inputs": lambda p: intake.template_inputs(template_raw(p)),
    "template_issues": template_issues,
    "calendar_grid": lambda p: intake.calendar_grid(p.leases()),
    "lease_month_ranges": lease_month_ranges,
    "first_seen_labels": lambda p: p.one_time().groupBy("lease_id", "label").agg(F.min("ord").alias("first_ord")).withColumn("place", F.row_number().over(Window.partitionBy("lease_id").orderBy("first_ord"))),
}

_B = "['cams','insurance','taxes','security','otherItems']"
_EV = ", ev AS (SELECT e.lease_id, ord, commence FROM (SELECT event_id%(SELECT max(o_orderkey) FROM orders)+1 AS lease_id, event_id AS ord FROM events) e JOIN leases l ON l.lease_id=e.lease_id)"
_RAW = _EV + """, raw AS (SELECT lease_id, ord, ord%8 AS k, CASE WHEN ord%8<2 THEN 'free_rent' WHEN ord%8<5 THEN 'abatement' ELSE 'legacy' END AS list,
  CASE ord%8 WHEN 0 THEN CAST(ord%70+1 AS VARCHAR) WHEN 2 THEN ' '||(ord%130)||' ' WHEN 3 THEN '2.5' END AS month_text, CASE WHEN ord%8 IN (1,4,5) THEN commence+CAST(ord*13%2000 AS INTEGER) END AS day,
  CASE WHEN ord%8=6 AND ord%3=0 THEN commence+10 END AS start_date, CASE WHEN ord%8=6 THEN commence+CAST(ord*7%900 AS INTEGER) END AS end_date,
  CASE ord%8 WHEN 2 THEN 'percent' WHEN 4 THEN 'fixed_amount' WHEN 6 THEN CASE WHEN ord%5=0 THEN 'other' ELSE 'percent' END END AS value_mode,
  CASE ord%8 WHEN 2 THEN CAST(ord%120 AS VARCHAR) WHEN 3 THEN '10' WHEN 4 THEN CASE WHEN ord%3=0 THEN 'abc' ELSE '500' END WHEN 6 THEN CAST(ord%50 AS VARCHAR) END AS value_text FROM ev)"""
_INTAKE = _RAW + f""", rown AS (SELECT r.*, b.lease_start, coalesce(CASE WHEN r.k=0 OR (r.k=2 AND TRY_CAST(trim(month_text) AS DOUBLE)>0) THEN CAST(TRY_CAST(trim(month_text) AS DOUBLE) AS BIGINT) END,
    (SELECT m.month_num FROM months m WHERE m.lease_id=r.lease_id AND {oracle._CLAMP.format(d='r.day')} BETWEEN m.month_start AND m.row_end AND r.day IS NOT NULL)) AS month_number FROM raw r JOIN bounds b ON b.lease_id=r.lease_id),
  monthly AS (SELECT r.lease_id, r.list, r.ord, CASE WHEN r.k IN (0,1,5) THEN 'free_rent' ELSE 'abatement' END AS type, 'monthly_row' AS scope, r.month_number, CASE WHEN r.k=5 THEN r.day ELSE coalesce(m.month_start, r.day) END AS effective_date,
    CAST(NULL AS DATE) AS start_date, CAST(NULL AS DATE) AS end_date, CASE WHEN r.k IN (0,1,5) THEN 'percent' WHEN r.value_mode IN ('percent','fixed_amount') THEN r.value_mode END AS value_mode, CASE WHEN r.k IN (0,1,5) THEN 100e0 ELSE TRY_CAST(value_text AS DOUBLE) END AS value
    FROM rown r LEFT JOIN months m ON m.lease_id=r.lease_id AND m.month_num=r.month_number WHERE r.k<6),
  wins AS (SELECT lease_id, list, ord, 'abatement' AS type, 'legacy_window' AS scope, CAST(NULL AS BIGINT) AS month_number, CAST(NULL AS DATE) AS effective_date, coalesce(start_date, lease_start) AS start_date, end_date,
    CASE WHEN value_mode='percent' THEN value_mode END AS value_mode, TRY_CAST(value_text AS DOUBLE) AS value FROM rown WHERE k=6),
  implied AS (SELECT l.lease_id, 'legacy' AS list, CAST(-1 AS BIGINT) AS ord, CASE WHEN custkey%5>=2 THEN 'free_rent' ELSE 'abatement' END AS type, 'legacy_window' AS scope, CAST(NULL AS BIGINT) AS month_number, CAST(NULL AS DATE) AS effective_date,
    b.lease_start AS start_date, commence+CAST(custkey%300 AS INTEGER) AS end_date, 'percent' AS value_mode, least(custkey%5*50, 100)*1e0 AS value FROM leases l JOIN bounds b ON b.lease_id=l.lease_id WHERE custkey%5>0 AND l.lease_id NOT IN (SELECT lease_id FROM raw WHERE k>=5)),
  taken AS (SELECT * FROM (SELECT * FROM monthly WHERE month_number IS NOT NULL AND effective_date IS NOT NULL UNION ALL SELECT * FROM wins UNION ALL SELECT * FROM implied) WHERE type='free_rent' OR value>0)"""
_ITEMS = ", items AS (SELECT *, l_orderkey AS lease_id, CAST(l_shipdate AS DATE) AS ship, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem)"
_GUARDS = _ITEMS + f""", guarded AS (SELECT lease_id, ord, {_B}[l_partkey%5+1] AS label, CASE WHEN l_partkey%7<5 THEN {_B}[l_partkey%7+1] END AS bucket, CASE WHEN l_partkey%11>0 AND l_extendedprice*20<=500000 THEN l_extendedprice*20 END AS year1,
  CASE WHEN l_discount*1500-20 BETWEEN 0 AND 100 THEN l_discount*1500-20 END AS esc_pct, CASE WHEN l_suppkey%3=0 THEN 'nnn' ELSE 'other' END AS canonical_type, CASE WHEN l_suppkey%5>0 THEN least(greatest((l_quantity-10)/30, 0e0), 1e0) ELSE 0.5e0 END AS confidence FROM items WHERE l_partkey%6>0)"""


def _state(field: str, empty: str, doubted: str) -> str:
    return f"SELECT lease_id, '{field}' AS field, CASE WHEN {empty} THEN 'missing' WHEN {doubted} THEN 'uncertain' ELSE 'reliable' END AS state FROM leases"


def _month_of(d: str) -> str:
    return f"CAST({oracle.mi(d)}-{oracle.mi('a')}+1-CASE WHEN day({d})<day(a) THEN 1 ELSE 0 END AS BIGINT)"


ORACLE_SQL = {
    "extraction_defaults": oracle.sql("""SELECT lease_id, CAST([1,1,0,1,0,0][lease_id%6+1] AS BIGINT) AS n_rows, CAST(CASE WHEN lease_id%6=3 THEN 1 ELSE 0 END AS BIGINT) AS n_charges, CASE WHEN lease_id%6=0 THEN 'A' END AS lease_name, lease_id%6=0 AS sf_required,
      CAST([2,0,4,0,0,0][lease_id%6+1] AS BIGINT) AS n_flags, ['medium','high','low','high','high','high'][lease_id%6+1] AS confidence, CAST(CASE WHEN lease_id%6>3 THEN 1 ELSE 0 END AS BIGINT) AS n_notices, lease_id%6 IN (0,1,3) AS meaningful, lease_id%6<2 AS usable FROM leases""", "leases"),
    "extracted_periods": oracle.sql("SELECT lease_id, CAST(0 AS BIGINT) AS period_idx, CASE WHEN lease_id%6<3 THEN commence END AS period_start, CASE WHEN lease_id%6<3 THEN expire ELSE DATE '2030-01-01' END AS period_end, CASE WHEN lease_id%6<3 THEN CAST(printf('%.2f', year1) AS DOUBLE) ELSE 5e0 END AS monthly_rent FROM leases WHERE lease_id%6 IN (0,1,3)", "leases"),
    "file_routing": oracle.sql("SELECT lease_id, ['table','workbook','document','text','markup','extraction',NULL,'document'][lease_id%8+1] AS reader FROM leases", "leases"),
    "concession_intake": oracle.sql(_INTAKE + " SELECT * FROM taken", "bounds"),
    "concessions_by_month": oracle.sql(_INTAKE + """ SELECT m.lease_id, m.month_num, coalesce(n_free, 0) AS n_free, coalesce(abated, 0e0) AS abated FROM months m LEFT JOIN (SELECT lease_id, month_number, count(*) FILTER (WHERE type='free_rent') AS n_free,
      sum(value) FILTER (WHERE type='abatement') AS abated FROM taken WHERE scope='monthly_row' GROUP BY ALL) t ON t.lease_id=m.lease_id AND t.month_number=m.month_num""", "bounds"),
    "concession_rules": oracle.sql(_RAW + """, t AS (SELECT r.lease_id, list, ord, k, CASE WHEN k=4 THEN CAST(ord%12+1 AS VARCHAR) ELSE month_text END AS mt, CASE WHEN ord%7=0 THEN '' ELSE coalesce(value_text,'') END AS vt, CASE WHEN ord%11=0 THEN '' ELSE coalesce(value_mode,'') END AS vm, b.term_months FROM raw r JOIN bounds b USING (lease_id) WHERE k<5),
      u AS (SELECT *, CASE WHEN k=3 OR TRY_CAST(trim(mt) AS DOUBLE)<=0 THEN NULL ELSE CAST(TRY_CAST(trim(mt) AS DOUBLE) AS BIGINT) END AS n FROM t), v AS (SELECT *, coalesce(n<=term_months, false) AS inside FROM u),
      w AS (SELECT *, row_number() OVER (PARTITION BY lease_id, n, inside ORDER BY CASE WHEN list='free_rent' THEN 0 ELSE 1 END, ord) AS place FROM v)
      SELECT lease_id, list, ord, CASE WHEN mt IS NULL THEN 'month-required' WHEN n IS NULL THEN 'month-whole' ELSE 'month-in-term' END AS rule_id FROM w WHERE NOT inside
      UNION ALL SELECT lease_id, list, ord, 'month-taken' FROM w WHERE inside AND place>1
      UNION ALL SELECT lease_id, list, ord, CASE WHEN vt='' THEN 'value-required' WHEN vt='abc' THEN 'value-number' WHEN vm='' THEN 'value-mode' ELSE 'value-percent' END FROM w WHERE inside AND list='abatement' AND (vt='' OR vt='abc' OR vm='' OR (vm='percent' AND CAST(vt AS DOUBLE)>100))""", "bounds"),
    "override_rules": oracle.sql(_EV + f""", r0 AS (SELECT *, ['base_rent','cams','taxes','parking',''][ord%5+1] AS tk, CASE WHEN ord%6>1 THEN commence+CAST(ord*17%2500 AS INTEGER) END AS day, ord%4 AS a FROM ev), r1 AS (SELECT r.*, b.lease_start, b.lease_end,
        (SELECT m.month_num FROM months m WHERE m.lease_id=r.lease_id AND r.day IS NOT NULL AND {oracle._CLAMP.format(d='r.day')} BETWEEN m.month_start AND m.row_end) AS mn, tk='base_rent' OR EXISTS (SELECT 1 FROM charges c WHERE c.lease_id=r.lease_id AND c.key=tk) AS known FROM r0 r JOIN bounds b ON b.lease_id=r.lease_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY lease_id, tk, mn ORDER BY ord) AS place FROM r1) """ + oracle.flags([
        ("r", "ord", "target-required", "error", "tk=''"), ("r", "ord", "target-unknown", "error", "tk<>'' AND NOT known"), ("r", "ord", "date-required", "error", "tk<>'' AND ord%6=0"), ("r", "ord", "date-format", "error", "tk<>'' AND ord%6=1"),
        ("r", "ord", "date-outside", "warning", "tk<>'' AND (day<lease_start OR day>lease_end)"), ("r", "ord", "row-taken", "error", "tk<>'' AND day IS NOT NULL AND place>1"), ("r", "ord", "amount-required", "error", "tk<>'' AND day IS NOT NULL AND a=0"),
        ("r", "ord", "amount-number", "error", "tk<>'' AND day IS NOT NULL AND a=1"), ("r", "ord", "amount-negative", "error", "tk<>'' AND day IS NOT NULL AND a=2")]), "charges"),
    "charge_rules": oracle.sql(_ITEMS + ", c AS (SELECT i.*, b.lease_start, b.lease_end FROM items i JOIN bounds b USING (lease_id)) " + oracle.flags([
        ("c", "ord", "year1-number", "error", "l_partkey%5=0"), ("c", "ord", "escalation-number", "error", "l_suppkey%4=0"), ("c", "ord", "start-format", "error", "l_partkey%7=0"), ("c", "ord", "start-outside", "warning", "l_partkey%7>0 AND (ship<lease_start OR ship>lease_end)"),
        ("c", "ord", "escalation-start-outside", "warning", "l_partkey%3>0 AND (ship+400<lease_start OR ship+400>lease_end)")]), "bounds"),
    "override_hints": oracle.sql(_EV + """, h AS (SELECT lease_id, ord, CASE WHEN ord%3=0 THEN ['cams','insurance','taxes','security','otherItems','roof'][ord%6+1] END AS bucket, CASE WHEN ord%3=1 THEN ['Common  Area','insurance ','TAXES','Parking',''][ord%5+1] END AS label FROM ev)
      SELECT h.lease_id, h.ord, h.bucket, h.label, c.key AS target_key, c.key IS NULL AS notice FROM h LEFT JOIN charges c ON c.lease_id=h.lease_id AND c.key=coalesce(h.bucket, CASE h.label WHEN 'Common  Area' THEN 'cams' WHEN 'insurance ' THEN 'insurance' WHEN 'TAXES' THEN 'taxes' END)""", "charges"),
    "charge_guards": "WITH " + _GUARDS[2:] + " SELECT * FROM guarded",
    "charge_flags": oracle.sql(_GUARDS + """, f AS (SELECT g.lease_id, g.ord, min(c.ord) AS idx, any_value(g.year1) AS year1, any_value(g.esc_pct) AS esc_pct, any_value(g.confidence) AS confidence FROM guarded g JOIN charges c ON c.lease_id=g.lease_id AND (c.key=g.bucket OR c.key=g.label) GROUP BY g.lease_id, g.ord)
      SELECT DISTINCT lease_id, idx, 'year1' AS field FROM f WHERE year1 IS NULL OR confidence<0.7e0 UNION SELECT DISTINCT lease_id, idx, 'escPct' FROM f WHERE esc_pct IS NULL AND confidence<0.7e0""", "charges"),
    "nnn_mode": oracle.sql("""SELECT lease_id, CASE WHEN one THEN 'aggregate' ELSE 'individual' END AS nnn_mode, CASE WHEN one THEN nnn_agg_year1 END AS aggregate_year1 FROM (SELECT *, custkey%2=0 AND custkey%3>0 AND custkey%7>0
      AND NOT (lease_id%2=1 AND lease_id%3>0 AND EXISTS (SELECT 1 FROM charges c WHERE c.lease_id=l.lease_id AND canonical_type='nnn')) AS one FROM leases l)""", "charges"),
    "one_time_intake": oracle.sql("""SELECT lease_id, ord, label, date, abs(amount)*CASE ord%3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE CASE WHEN amount<0 THEN -1 ELSE 1 END END AS amount FROM one_time WHERE lease_id%3>0 AND ord%11>0
      UNION ALL SELECT lease_id, 0, 'Security Deposit', CASE WHEN custkey%2=0 THEN commence+5 ELSE commence END, year1 FROM leases WHERE custkey%4>0 AND year1>0 AND lease_id NOT IN (SELECT lease_id FROM one_time WHERE lease_id%3>0)""", "one_time"),
    "field_triage": oracle.sql(" UNION ALL ".join([
        "SELECT lease_id, 'schedule' AS field, CASE WHEN lease_id%11>=8 THEN 'reliable' WHEN lease_id%11>0 THEN 'uncertain' ELSE 'missing' END AS state FROM leases",
        _state("lease_name", "lease_id%5=0", "lease_id%4=0"), _state("square_footage", "lease_id%7=0", "lease_id%4=1"), _state("abatement_end", "lease_id%3=0", "false"), _state("abatement_pct", "lease_id%2=0", "lease_id%4=3"),
        *[_state(b, f"lease_id%{k + 2}=0 OR year1*(lease_id%{k + 3})=0", f"lease_id%4={d}" if d is not None else "false") for k, (b, d) in enumerate([("cams", 0), ("insurance", None), ("taxes", 1), ("security", 3), ("otherItems", None)])],
    ]), "leases"),
    "manual_fallback": oracle.sql("SELECT lease_id FROM leases WHERE lease_id%10<4 OR lease_id%4=0", "leases"),
    "detected_windows": oracle.sql("""SELECT m.lease_id, m.month_num AS month_number, m.month_start AS date, CASE WHEN custkey%3=2 THEN 'free_rent' ELSE 'abatement' END AS type, CASE WHEN custkey%3=1 THEN 50e0 END AS value
      FROM months m JOIN leases l USING (lease_id) WHERE custkey%3>0 AND commence<=m.row_end AND commence+CAST(custkey%400 AS INTEGER)>=m.month_start""", "bounds"),
    "zero_rent_share": oracle.sql("SELECT lease_id, round(avg(CASE WHEN lease_id%3=0 AND period_idx>0 THEN 1e0 ELSE 0e0 END), 9) AS share FROM months0 GROUP BY lease_id HAVING avg(CASE WHEN lease_id%3=0 AND period_idx>0 THEN 1e0 ELSE 0e0 END)>0.5", "months0"),
    "chronology_bounds": oracle.sql(f""", c AS (SELECT lease_id, period_idx, CASE WHEN period_idx<>3 THEN period_start END AS s, CASE WHEN period_idx%2=0 THEN period_end END AS e, min(period_start) OVER (PARTITION BY lease_id) AS a FROM periods),
      n AS (SELECT *, lag(coalesce(e, s)) OVER w AS b, lead(s) OVER w AS nx FROM c WINDOW w AS (PARTITION BY lease_id ORDER BY period_idx)), x AS (SELECT *, {_month_of('s')} AS sm, {_month_of('nx')} AS nm FROM n)
      SELECT lease_id, period_idx, sm AS start_month, {_month_of('e')} AS end_month, CASE WHEN period_idx=0 THEN 1 ELSE {_month_of('b')}+1 END AS min_start, sm AS min_end, CASE WHEN sm IS NULL OR nm>sm THEN nm-1 END AS max_end, period_idx=0 AS start_locked FROM x""", "periods"),
    "active_charges": oracle.sql("""SELECT lease_id, key, canonical_type FROM (SELECT c.lease_id, c.key, c.canonical_type, bool_or(r.amount<>0 AND (c.ord<>1 OR r.override_applied)) AS seen, any_value(CASE WHEN c.ord=1 THEN 0e0 ELSE c.year1 END) AS y FROM charges c JOIN leases l ON l.lease_id=c.lease_id
      LEFT JOIN charge_rows r ON r.lease_id=c.lease_id AND r.key=c.key WHERE NOT (l.nnn_mode='aggregate' AND c.canonical_type='nnn') GROUP BY ALL) WHERE coalesce(seen, false) OR y>0""", "charge_rows"),
    "escalated_charges": oracle.sql(f""", x AS (SELECT r.*, CASE WHEN ord<>2 THEN l.commence+CAST(ord*100 AS INTEGER) END AS es, ov IS NOT NULL OR charge_start IS NULL OR month_start>=charge_start AS on_ FROM charge_rows0 r JOIN (SELECT lease_id, commence FROM leases) l USING (lease_id) WHERE key<>'nnn_aggregate'),
      y AS (SELECT *, CASE WHEN ov IS NULL AND on_ AND es IS NOT NULL THEN CASE WHEN month_start<es THEN 0 ELSE CAST(floor(({oracle.mi('month_start')}-{oracle.mi('es')})/12) AS BIGINT) END END AS ey FROM x)
      SELECT lease_id, month_num, ord, key, canonical_type, on_ AS active, ey AS esc_years, CASE WHEN ov IS NOT NULL THEN 0e0 ELSE esc_pct END AS esc_pct, ov IS NOT NULL AS override_applied,
        {oracle.f2("CASE WHEN ov IS NOT NULL THEN ov*factor WHEN on_ THEN year1*pow(1e0+esc_pct/100, coalesce(ey, year_num-1))*factor ELSE 0e0 END")} AS amount FROM y""", "charge_rows"),
    "ledger_page": oracle.sql("SELECT lease_id, month_num, period_start, base_rent_applied, total_monthly_obligation FROM ledger WHERE month_num BETWEEN 26 AND 50", "ledger"),
    "csv_variant": oracle.sql("SELECT r.lease_id, r.month_num AS \"Lease Month #\", abatement_amount AS \"Abatement ($)\", " + ", ".join(f"coalesce((SELECT sum(amount) FROM charge_rows c WHERE c.lease_id=r.lease_id AND c.month_num=r.month_num AND c.key='{b}'), 0e0) AS \"{b} ($)\"" for b in BUCKETS)
        + ", total_nnn_amount AS \"Total NNN ($)\", one_time_charges_amount AS \"One-time Charges ($)\", total_obligation_remaining AS \"Total Obligation Remaining ($)\" FROM remaining r"),
    "template_inputs": oracle.sql(f""", r AS (SELECT *, CASE WHEN lease_id%4>0 THEN lease_id%7 ELSE 0 END AS am, CASE WHEN lease_id%3>0 THEN commence+40 ELSE commence END AS ast FROM leases)
      SELECT lease_id, commence, term, CASE WHEN lease_id%2>0 THEN commence+30 ELSE commence END AS rent_start, CASE WHEN lease_id%3>0 THEN expire ELSE last_day({oracle.add_m("date_trunc('month', commence)", 'term-1')}) END AS expire,
        CASE WHEN lease_id%4>0 THEN analysis_date ELSE CAST(date_trunc('month', commence) AS DATE) END AS analysis_date, CASE WHEN lease_id%5>0 THEN 0.08e0 ELSE 0.07e0 END AS discount_rate, CASE WHEN lease_id%2>0 THEN year1 ELSE 0e0 END AS cams_year1,
        CASE WHEN lease_id%3>0 THEN 0.04e0 ELSE esc END AS cams_esc, CASE WHEN lease_id%2>0 THEN 0.01e0 ELSE 0.02e0 END AS security_esc, am AS abatement_months, CASE WHEN am>0 THEN ast END AS abatement_start,
        CASE WHEN am>0 THEN last_day({oracle.add_m("date_trunc('month', ast)", 'am-1')}) END AS abatement_end, CASE WHEN am>0 THEN CASE WHEN lease_id%2>0 THEN 0.5e0 ELSE 1e0 END ELSE 0e0 END AS abatement_pct FROM r""", "leases"),
    "template_issues": oracle.sql(", t AS (SELECT lease_id, lease_id%13>0 AND lease_id%17>0 AS whole, CASE lease_id%11 WHEN 0 THEN 0 WHEN 1 THEN 601 ELSE term END AS term FROM leases) " + oracle.flags([
        ("t", "0", "missing-commence", "error", "lease_id%13=0"), ("t", "0", "missing-year1", "error", "lease_id%17=0"), ("t", "0", "term-range", "error", "whole AND (term<1 OR term>600)"), ("t", "0", "area-positive", "error", "whole AND lease_id%7=0"),
        ("t", "0", "rent-negative", "error", "whole AND lease_id%5=0"), ("t", "0", "escalation-range", "error", "whole AND lease_id%3=0")]), "leases"),
    "calendar_grid": oracle.sql(f"SELECT lease_id, k+1 AS month_num, k//12+1 AS year_num, {oracle.add_m('z', 'k')} AS period_start, last_day({oracle.add_m('z', 'k')}) AS period_end FROM (SELECT lease_id, date_trunc('month', commence) AS z, unnest(range(0, term)) AS k FROM leases)", "leases"),
    "lease_month_ranges": oracle.sql(f""", x AS (SELECT o.lease_id, ord, date, commence, CASE WHEN date>=commence THEN {oracle.mi('date')}-{oracle.mi('commence')} END AS n0 FROM one_time o JOIN (SELECT lease_id, commence FROM leases) USING (lease_id)), y AS (SELECT *, n0+1-CASE WHEN {oracle.add_m('commence', 'n0')}>date THEN 1 ELSE 0 END AS n FROM x)
      SELECT lease_id, ord, n AS month_number, {oracle.add_m('commence', 'n-1')} AS month_start, {oracle.add_m('commence', 'n')}-1 AS month_end FROM y""", "one_time"),
    "first_seen_labels": oracle.sql("SELECT *, CAST(row_number() OVER (PARTITION BY lease_id ORDER BY first_ord) AS INTEGER) AS place FROM (SELECT lease_id, label, min(ord) AS first_ord FROM one_time GROUP BY ALL)", "one_time"),
}
