"""Queries over labels, lease wording and markup, and the SQL of those that SQL can state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leasegrid.functions import dates
from leasegrid.functions import label_tables as T
from leasegrid.functions.label_cases import CASES
from leasegrid.operators import labels, paste, repair, text
from leasegrid.operators import wording as text_rows
from leasegrid.plans import oracle
from leasegrid.plans.queries import PLANS, dealt_periods, months, periods, rows
from leasegrid.sources.portfolio import Portfolio

#: (raw label, the bucket it means)
LABELS = [
    ("CAM", "cams"), ("C.A.M. Charges", "cams"), ("Common Area Maint.", "cams"), ("Malntenance Fees", "cams"), ("Op Ex", "cams"), ("Op Expenses", "cams"), ("N.N.N.", "cams"), ("Triple Net Charges", "cams"),
    ("Additional Rent", "cams"), ("Operating Cost Recovery", "cams"), ("0perat1ng Expens5", "cams"), ("Building Expenses (2024)", "cams"), ("Insurance", "insurance"), ("lnsurance", "insurance"), ("Fire Insurance Premium", "insurance"),
    ("Property & Casualty", "insurance"), ("Hazord Insurance", "insurance"), ("R.E. Taxes", "taxes"), ("RE Tax", "taxes"), ("Ad-Valorem Tax", "taxes"), ("***T4xes###", "taxes"), ("Special Asses5ment", "taxes"), ("Real Estate Tax; 2024", "taxes"),
    ("Security", "security"), ("S3curity Patr0l", "security"), ("Guard Services", "security"), ("Securlty Service", "security"), ("Water/Sewer", "otherItems"), ("Trash Removal", "otherItems"), ("Janitorail Servces", "otherItems"),
    ("HVAC Maintenance", "otherItems"), ("Property Management Fee", "otherItems"), ("Gen'l Admin Fee", "otherItems"), ("Landcsaping", "otherItems"), ("Elevato r Service", "otherItems"), ("Parking (monthly)", "otherItems"), ("", "otherItems"), ("zzz", "otherItems"),
]


def label_table(p: Portfolio) -> DataFrame:
    own = p.spark.createDataFrame([(-i - 1, x) for i, (x, _) in enumerate(LABELS)], "label_id long, raw_label string")
    return own.unionByName(p.table("part").select(F.col("p_partkey").alias("label_id"), F.col("p_name").alias("raw_label")))


def label_exact(p: Portfolio) -> DataFrame:
    own = labels.once(label_table(p), "s", labels.normalized(F.col("raw_label")))
    return labels.once(own, "x", labels.exact(F.col("s"))).where("x is not null").select("label_id", "x.bucket", "x.subtype")


def label_token_score(p: Portfolio) -> DataFrame:
    own = labels.once(label_table(p), "s", labels.normalized(F.col("raw_label")))
    return labels.once(own, "x", labels.token_result(F.col("s"))).where("x is not null").select("label_id", "x.bucket", F.round("x.score", 6).alias("score"), "x.ambiguous")


def label_fuzzy(p: Portfolio) -> DataFrame:
    own = label_table(p).withColumn("s", labels.normalized(F.col("raw_label")))
    kinds = labels.once(own.select("s").distinct(), "grams", labels.bigrams(F.col("s")))
    kinds = labels.once(kinds, "n", labels.nearest(F.col("s"), F.col("grams"))).where(F.col("n.score") >= T.FUZZY)
    return own.join(kinds, "s").select("label_id", "n.phrase", F.round("n.score", 9).alias("score"))


def judged(p: Portfolio) -> DataFrame:
    """Each part as a label of the evaluation set, by its key and written in one of four ways: what was
    expected and found, and what of it passes. Labels that read the same are classified once."""
    cases = p.spark.createDataFrame([(k, *c) for k, c in enumerate(CASES)], "case_id long, label string, expected string, expected_subtype string, least double")
    key = F.col("p_partkey")
    rows = p.table("part").select(key.alias("label_id"), (key % len(CASES)).alias("case_id"), (F.floor(key / len(CASES)) % 4).alias("way")).join(F.broadcast(cases), "case_id")
    label = F.col("label")
    rows = rows.withColumn("raw_label", F.when(F.col("way") == 1, F.upper(label)).when(F.col("way") == 2, F.concat(F.lit("  "), label, F.lit(" "))).when(F.col("way") == 3, F.replace(label, F.lit(" "), F.lit("  "))).otherwise(label))
    asked = F.col("expected_subtype").isNotNull()
    right, same, sure = F.col("bucket") == F.col("expected"), F.coalesce(F.col("subtype") == F.col("expected_subtype"), ~asked), F.col("confidence") >= F.col("least")
    return labels.classify(rows).select("case_id", "expected", "bucket", "expected_subtype", "subtype", "match_type", "confidence", asked.alias("asked"), right.alias("right"), same.alias("same"), (right & same & sure).alias("full"))


def label_evaluation(p: Portfolio) -> DataFrame:
    """How many cases of the evaluation set pass by bucket, by subtype where one is asked for, and in full."""
    n = lambda c: F.count(F.when(c, 1))
    return judged(p).agg(
        F.count("*").alias("n_cases"), n(F.col("right")).alias("bucket_passes"), n(F.col("asked")).alias("n_asked"), n(F.col("asked") & F.col("same")).alias("subtype_passes"), n(F.col("full")).alias("full_passes"),
        n(F.col("match_type") == "fallback").alias("fallbacks"), n(F.col("match_type") == "ocr_rescue").alias("rescues"), n(F.col("subtype") == "nnn_composite").alias("composites"),
    )


def label_confusion(p: Portfolio) -> DataFrame:
    """expected and predicted bucket and, where a subtype is asked for, subtype, with how often they met."""
    own = judged(p)
    none = F.coalesce("subtype", F.lit("none"))
    kinds = own.select(F.lit("bucket").alias("level"), "expected", F.col("bucket").alias("predicted")).unionByName(own.where("asked").select(F.lit("subtype").alias("level"), F.col("expected_subtype").alias("expected"), none.alias("predicted")))
    return kinds.groupBy("level", "expected", "predicted").count()


def typed(p: Portfolio) -> DataFrame:
    """Order dates written in several ways."""
    day = F.col("o_orderdate").cast("date")
    forms = [F.date_format(day, "M/d/yy"), F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "MMMM d, yyyy"), dates.excel_serial(day).cast("string"), F.lit("13/45/2020")]
    return p.table("orders").select(F.col("o_orderkey").alias("lease_id"), F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("typed"))


def rents_as_text(p: Portfolio) -> DataFrame:
    total = F.format_number("o_totalprice", 2)
    forms = [F.concat(F.lit("$"), total), F.concat(F.lit("S"), total, F.lit("*")), F.replace(total, F.lit(","), F.lit(".")), F.concat(total, F.lit(" /mo")), F.lit("n/a")]
    return p.table("orders").select(F.col("o_orderkey").alias("lease_id"), F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("typed"))


def wording(p: Portfolio) -> DataFrame:
    """A short lease text for each lease."""
    rent = F.format_string("%.2f", F.col("year1"))
    day = F.date_format("commence", "MMMM d, yyyy")
    return p.spread().select(
        "lease_id",
        F.concat(
            F.lit("The Lease Commencement Date shall be "), day, F.lit(".\n\nBase rent is due monthly"), F.when(F.col("lease_id") % 3 == 0, ", per rentable square foot.").otherwise("."),
            F.lit("\nMonths 1 - 12 $"), rent, F.lit("\nMonths 13 to 24: $"), F.format_string("%.2f", F.col("year1") * 2), F.lit(" a month\nLease Year 3\n$"), rent,
            F.element_at(F.array(*map(F.lit, ["\nRent begins on the Rent Commencement Date.", "\nRent is due from the first full calendar month after the Commencement Date.", "\n30 days after the Delivery Date rent is due.", "\nThe later of the Delivery Date and the Permit Issuance Date."])), (F.col("lease_id") % 4 + 1).cast("int")),
        ).alias("text"),
    )


def wins(p: Portfolio) -> DataFrame:
    return text.windows(wording(p), "lease_id", "text")


def start_rules(p: Portfolio) -> DataFrame:
    return text.phrase_rules(wins(p), "lease_id")


def candidate_ranking(p: Portfolio) -> DataFrame:
    """Each lease's schedule readings, of all four kinds, and the preferred one; month and year ranges and
    escalations are anchored where the text names a date."""
    more = F.when(F.col("lease_id") % 5 == 0, "\n1/1/2030 - 12/31/2030 $500.00").otherwise(""), F.when(F.col("lease_id") % 7 == 0, "\nRent of $900.00 shall increase by 3% every year").otherwise("")
    docs = wording(p).withColumn("text", F.concat("text", *reversed(more)))
    rows_ = labels.once(labels.once(docs, "lines", text.lines_in(F.col("text"))), "wins", text.windows_in(F.col("lines")))
    # How many terms each reading finds, in the text's own row; one read twice counts once.
    each = lambda unit: F.array_distinct(F.flatten(F.transform("wins", lambda w: text.terms_in(w.normalized, unit))))
    found = {
        "dated_periods": F.size(text_rows.dated_of(F.col("text"))), "narrative_escalation": F.when(text_rows.escalation_in(F.col("text")).isNotNull(), 1).otherwise(0),
        "relative_month_ranges": F.size(each(text.MONTH_TERMS)), "lease_year_ranges": F.size(each(text.YEAR_TERMS)),
    }
    dates = F.flatten(F.transform("wins", lambda w: F.transform(text.absolute_in(w.original), lambda x: x.resolved_date)))
    kinds = F.array(*[F.struct(F.lit(k).cast("long").alias("ord"), F.lit(name).alias("representation"), F.lit(text.CONFIDENCE[name]).alias("confidence"), n.cast("long").alias("n_terms")) for k, (name, n) in enumerate(found.items())])
    n = labels.once(rows_, "x", F.struct(F.array_min(dates).alias("anchor"), F.filter(kinds, lambda k: k.n_terms > 0).alias("kinds"))).select("lease_id", "x.anchor", F.inline("x.kinds"))
    known = F.col("anchor").isNotNull() | (F.col("representation") == "dated_periods")
    return text.ranked(n.select("lease_id", "ord", "representation", "confidence", "n_terms", F.when(known, F.col("n_terms")).otherwise(0).alias("n_rows"), F.when(known, 0).otherwise(1).cast("long").alias("n_open")), "lease_id")


def materialization(p: Portfolio) -> DataFrame:
    rows_ = text.terms(wins(p), "lease_id").join(p.leases().select("lease_id", F.col("commence").alias("anchor")), "lease_id")
    return text.materialized(rows_, "anchor").drop("anchor")


def narrative(p: Portfolio) -> DataFrame:
    return text.escalation_steps(
        p.leases().select("lease_id", F.col("year1").alias("start_rent"), (F.col("esc") * 100).alias("esc_pct"), text.term_months(F.col("commence"), F.col("expire")).alias("total_months"), (6 + 6 * (F.col("lease_id") % 4)).alias("cadence"))
    )


def infer_end_dates(p: Portfolio) -> DataFrame:
    return repair.infer_ends(periods(p).withColumn("period_end", F.when(F.col("period_idx") % 2 == 1, F.col("period_end"))).withColumn("period_start", F.when(F.col("period_idx") != 3, F.col("period_start"))))


def charge_claims(p: Portfolio) -> DataFrame:
    rows_ = p.table("lineitem").select(
        F.col("l_orderkey").alias("lease_id"), F.element_at(F.array(*map(F.lit, T.BUCKETS)), (F.col("l_partkey") % 5 + 1).cast("int")).alias("bucket"), (F.col("l_quantity") / 50).alias("confidence"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )
    order = Window.partitionBy("lease_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return repair.claim_slots(rows_.withColumn("ord", F.row_number().over(order).cast("long")))


def charge_dedupe(p: Portfolio) -> DataFrame:
    rows_ = p.table("lineitem").select(F.col("l_orderkey").alias("lease_id"), F.col("l_linenumber").alias("ord"), "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_partkey") % 7).alias("label_no"))
    return repair.first_of(rows_, ["lease_id", "label_no"], [F.col(c) for c in ("ord", "l_partkey", "l_suppkey", "l_extendedprice")]).select("lease_id", "label_no", "ord", "l_extendedprice")


def confidence(p: Portfolio) -> DataFrame:
    n = periods(p).groupBy("lease_id").agg(F.count("*").alias("n_rows"))
    x = n.select(
        F.col("lease_id").alias("doc_id"), (F.col("lease_id") % (F.col("n_rows") + 1)).alias("n_rows"), (F.col("lease_id") % (F.col("n_rows") + 1)).alias("n_valid_rents"), (F.col("lease_id") % 6).alias("n_flags"),
        F.element_at(F.array(*map(F.lit, ["high", "medium", "low"])), (F.col("lease_id") % 3 + 1).cast("int")).alias("provider"), (F.col("lease_id") % 2 == 0).alias("has_nnn"), F.floor((F.col("lease_id") % (F.col("n_rows") + 1)) / 2).alias("n_valid_dates"),
    )
    return repair.extraction_confidence(x)


def bulk_paste(p: Portfolio) -> DataFrame:
    """The portfolio's periods written as tables to paste, in four forms and with a line that is none, and
    read again."""
    rent = F.format_string("%.2f", F.col("monthly_rent"))
    day = lambda c, form: F.date_format(c, form)
    forms = [
        F.concat(day("period_start", "M/d/yy"), F.lit(" - "), day("period_end", "M/d/yyyy"), F.lit("\t$"), rent),
        F.concat(day("period_start", "M.d.yyyy"), F.lit(" to "), day("period_end", "M.d.yyyy"), F.lit("   S"), rent, F.lit("*")),
        F.concat(day("period_start", "yyyy-MM-dd"), F.lit("  "), F.format_number("monthly_rent", 2)),
        F.concat(F.lit("Year "), (F.col("period_idx") + 1).cast("string"), F.lit(" $"), rent),
    ]
    line = F.element_at(F.array(*forms), (F.col("lease_id") % 4 + 1).cast("int"))
    table = dealt_periods(p).groupBy("lease_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("period_idx", line.alias("line")))), lambda x: x.line), "\n\n").alias("text"))
    table = table.withColumn("text", F.concat("text", F.lit("\nsee the exhibit")))
    return paste.pasted(table, "lease_id", "text").select("lease_id", F.col("at").cast("long").alias("at"), "period_start", "period_end", F.col("relative_year").cast("long").alias("relative_year"), "monthly_rent", "asterisk", "warning")


def prose_charges(p: Portfolio) -> DataFrame:
    """Charges told in several ways, and sentences that name a charge and a number but state none."""
    plain, grouped, pct = F.format_string("%.2f", F.col("year1")), F.format_number("year1", 2), F.format_string("%d", F.round(F.col("esc") * 100).cast("int"))
    forms = [
        F.concat(F.lit("NNN escalate "), pct, F.lit("% every year, amt "), plain),
        F.concat(F.lit("Insurance $"), grouped, F.lit(" per month increases "), pct, F.lit("% every two years")),
        F.concat(F.lit("Real estate taxes shall be paid at 100 Main Street, not "), plain),
        F.concat(F.lit("CAM: "), plain, F.lit(" and no more")),
        F.concat(F.lit("Taxes "), pct, F.lit("% per 6 months at $"), grouped),
        F.lit("Additional Rent rises 12% only"),
    ]
    told = F.concat(F.lit("Tenant pays rent.\n"), F.element_at(F.array(*forms), (F.col("lease_id") % 6 + 1).cast("int")))
    return paste.prose_charges(p.spread().select("lease_id", told.alias("text")), "lease_id", "text")


def schedule_choice(p: Portfolio) -> DataFrame:
    own = periods(p)
    other = own.where("lease_id % 7 <> 0").withColumn("monthly_rent", F.when(F.col("lease_id") % 3 == 0, F.col("monthly_rent") + 1).otherwise(F.col("monthly_rent")))
    blocked = p.leases().where("lease_id % 5 = 0").select("lease_id", F.lit("extracted").alias("reading"))
    return paste.chosen(own, other, blocked)


CSV = {"month_num": "Month #", "year_num": "Year #", "period_start": "Period Start", "period_end": "Period End", "scheduled_base_rent": "Scheduled Base Rent", "base_rent_applied": "Base Rent Applied", "total_nnn_amount": "NNN", "total_other_charges_amount": "Other Charges", "total_monthly_obligation": "Total Monthly Obligation", "effective_per_sf": "Effective $/SF"}


def csv_projection(p: Portfolio) -> DataFrame:
    return rows(p).select("lease_id", *[F.col(c).alias(label) for c, label in CSV.items()])


PLANS |= {
    "label_normalize": lambda p: label_table(p).select("label_id", labels.normalized(F.col("raw_label")).alias("normalized_label")),
    "label_exact": label_exact,
    "label_token_score": label_token_score,
    "label_fuzzy": label_fuzzy,
    "label_cascade": lambda p: labels.classify(label_table(p)),
    "label_trace": lambda p: labels.trace(label_table(p)).select("label_id", F.posexplode("trace").alias("place", "x")).select("label_id", "place", "x.*"),
    "label_confusion": label_confusion,
    "label_evaluation": label_evaluation,
    "date_parsing": lambda p: typed(p).select("lease_id", dates.parse_cell(F.col("typed")).alias("day")),
    "rent_string_parsing": lambda p: rents_as_text(p).select("lease_id", text.rent_value(F.col("typed")).alias("rent")),
    "text_windows": lambda p: text.windows(p.table("documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.sum(F.length("original")).alias("n_chars")),
    "term_extraction": lambda p: text.terms(wins(p), "lease_id"),
    "absolute_start_rules": lambda p: text.absolute_rules(wins(p), "lease_id"),
    "start_rules": start_rules,
    "candidate_ranking": candidate_ranking,
    "term_materialization": materialization,
    "narrative_escalation": narrative,
    "sf_rent_detection": lambda p: text.area_based(wording(p), "lease_id", "text"),
    "html_text": lambda p: p.table("pages").select("page_id", text.plain(F.col("html")).alias("text")),
    "infer_end_dates": infer_end_dates,
    "collapse_steps": lambda p: repair.collapse(months(p).select("lease_id", "month_num", "month_start", "monthly_rent")),
    "reanchor_schedule": lambda p: repair.reanchor(periods(p), p.leases().select("lease_id", F.date_add("commence", 40).alias("anchor"))),
    "charge_dedupe": charge_dedupe,
    "slot_claiming": charge_claims,
    "slot_padding": lambda p: repair.padded(p.one_time(), p.leases(), 11),
    "extraction_confidence": confidence,
    "csv_projection": csv_projection,
    "bulk_paste": bulk_paste,
    "prose_charges": prose_charges,
    "schedule_choice": schedule_choice,
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rewrite(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        x = f"regexp_replace({x}, {_q(pattern)}, {_q(by.replace('$1', chr(92) + '1'))}, 'g')"
    return x


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_LABELS = f"""labels AS (SELECT p_partkey AS label_id, p_name AS raw FROM part UNION ALL SELECT * FROM (VALUES {', '.join(f'({-i - 1}, {_q(x)})' for i, (x, _) in enumerate(LABELS))}) v(a, b)),
norm AS (SELECT label_id, {_squeeze(_rewrite(_squeeze(_rewrite("trim(lower(coalesce(raw,'')))", T.ABBREVIATIONS)), T.PUNCTUATION))} AS s FROM labels),
phrases AS (SELECT * FROM (VALUES {', '.join(f'({k}, {_q(a)}, {_q(b)}, {_q(c)})' for k, (a, b, c) in enumerate(T.PHRASES))}) v(place, phrase, bucket, subtype))"""
_WEIGHTED = " UNION ALL ".join(f"SELECT label_id, {k} AS place, {_q(b)} AS bucket, " + "+".join(["0e0", *(f"(CASE WHEN contains(s, {_q(w)}) THEN {n}e0 ELSE 0e0 END)" for w, n in T.WEIGHTS[b])]) + " AS score FROM norm" for k, b in enumerate(T.BUCKETS))
_BG = "list_transform(range(1, length({0})), lambda i: substr({0}, CAST(i AS BIGINT), 2))"
_DICE = f"""grams AS (SELECT s, {_BG.format('s')} AS a FROM (SELECT DISTINCT s FROM norm)), pg AS (SELECT *, {_BG.format('phrase')} AS b FROM phrases),
scored AS (SELECT s, phrase, place, CASE WHEN s=phrase THEN 1e0 WHEN length(s)<2 THEN CASE WHEN contains(s, phrase) OR contains(phrase, s) THEN 0.6e0 ELSE 0e0 END
  ELSE 2*coalesce(list_sum(list_transform(list_distinct(a), lambda g: least(len(list_filter(a, lambda x: x=g)), len(list_filter(b, lambda x: x=g))))), 0)/CAST(len(a)+len(b) AS DOUBLE) END AS score FROM grams, pg)"""
_DAY = "CAST(o_orderdate AS DATE)"

ORACLE_SQL = {
    "label_normalize": f"WITH {_LABELS} SELECT label_id, s AS normalized_label FROM norm",
    "label_exact": f"WITH {_LABELS} SELECT label_id, bucket, subtype FROM norm JOIN phrases ON phrase=s",
    "label_token_score": f"WITH {_LABELS}, w AS ({_WEIGHTED}), r AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY score DESC, place) AS n FROM w) SELECT a.label_id, a.bucket, round(a.score, 6) AS score, b.score/a.score>=0.6e0 AS ambiguous FROM r a JOIN r b ON b.label_id=a.label_id AND b.n=2 WHERE a.n=1 AND a.score>=1.5",
    "label_fuzzy": f"WITH {_LABELS}, {_DICE}, best AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, place) AS n FROM scored) SELECT label_id, phrase, round(score, 9) AS score FROM norm JOIN best USING (s) WHERE n=1 AND score>=0.72",
    "date_parsing": f"SELECT o_orderkey AS lease_id, CASE WHEN o_orderkey%6=5 THEN NULL ELSE {_DAY} END AS day FROM orders",
    "rent_string_parsing": "SELECT o_orderkey AS lease_id, CASE WHEN o_orderkey%5=4 THEN NULL ELSE round(o_totalprice, 2) END AS rent FROM orders",
    "text_windows": r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text,''), '\r?\n+'), lambda s: trim(s, ' ')), lambda s: s<>'') AS l FROM documents)
      SELECT doc_id, CAST(2*len(l)-1 AS BIGINT) AS n_windows, CAST(list_sum(list_transform(l, lambda s: length(s))) + coalesce(list_sum(list_transform(range(1, len(l)), lambda i: length(l[i])+length(l[i+1])+1)), 0) AS BIGINT) AS n_chars FROM l WHERE len(l)>0""",
    "term_extraction": oracle.sql("SELECT lease_id, v.a AS start_value, v.b AS end_value, CASE WHEN v.a=1 THEN year1 ELSE CAST(printf('%.2f', year1*2) AS DOUBLE) END AS monthly_rent FROM leases, (VALUES (CAST(1 AS BIGINT),CAST(12 AS BIGINT)),(13,24)) v(a,b)", "leases"),
    "absolute_start_rules": oracle.sql("SELECT lease_id, 'commencement_date' AS trigger_event, commence AS resolved_date FROM leases", "leases"),
    "start_rules": oracle.sql("""SELECT lease_id, v.kind AS rule_kind, v.event AS trigger_event, v.second AS second_event, v.n AS offset_value, v.c AS confidence FROM leases, (VALUES (0,'event_date','rent_commencement_date',NULL,NULL,0.8e0),(0,'event_date','commencement_date',NULL,NULL,0.8e0),
      (1,'first_full_calendar_month_after_event','commencement_date',NULL,NULL,0.9e0),(2,'event_plus_days','delivery_date',NULL,30,0.84e0),(3,'later_of','delivery_date','permit_issuance_date',NULL,0.82e0)) v(k, kind, event, second, n, c) WHERE lease_id%4=v.k""", "leases"),
    "candidate_ranking": oracle.sql("""SELECT lease_id, v.k AS ord, v.name AS representation, v.c AS confidence, CAST(v.n AS BIGINT) AS n_terms, CAST(v.n AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_open, round(v.c+0.05e0, 6) AS score FROM leases,
      (VALUES (CAST(0 AS BIGINT),'dated_periods',0.95e0,1),(1,'narrative_escalation',0.89e0,1),(2,'relative_month_ranges',0.87e0,2)) v(k, name, c, n) WHERE v.k=CASE WHEN lease_id%5=0 THEN 0 WHEN lease_id%7=0 THEN 1 ELSE 2 END""", "leases"),
    "html_text": r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html,''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS x FROM pages),
      e AS (SELECT page_id, replace(replace(replace(replace(replace(x, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)) AS x FROM b)
      SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(x, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10)||chr(10), 'g'), ' ') AS text FROM e""",
    "term_materialization": oracle.sql(f"SELECT lease_id, v.a AS start_value, v.b AS end_value, CASE WHEN v.a=1 THEN year1 ELSE CAST(printf('%.2f', year1*2) AS DOUBLE) END AS monthly_rent, {oracle.add_m('commence', 'v.a-1')} AS period_start, {oracle.add_m('commence', 'v.b')} - 1 AS period_end FROM leases, (VALUES (CAST(1 AS BIGINT),CAST(12 AS BIGINT)),(13,24)) v(a,b)", "leases"),
    "narrative_escalation": oracle.sql(f", t AS (SELECT lease_id, year1, esc*100 AS pct, 6+6*(lease_id%4) AS cad, CASE WHEN expire<=commence THEN 0 ELSE least({oracle.mi('expire')}-{oracle.mi('commence')} + CASE WHEN {oracle.add_m('commence', oracle.mi('expire') + '-' + oracle.mi('commence'))}<expire THEN 1 ELSE 0 END, 600) END AS tot FROM leases), u AS (SELECT *, unnest(range(1, tot+1, cad)) AS st FROM t WHERE tot>0) SELECT lease_id, CAST(st AS BIGINT) AS start_month, CAST(least(tot, st+cad-1) AS BIGINT) AS end_month, {oracle.f2('year1*pow(1+pct/100, (st-1)//cad)')} AS monthly_rent FROM u", "leases"),
    "sf_rent_detection": oracle.sql("SELECT lease_id, lease_id%3=0 AS sf_required FROM leases", "leases"),
    "infer_end_dates": oracle.sql(""", p AS (SELECT lease_id, period_idx, CASE WHEN period_idx<>3 THEN period_start END AS s, CASE WHEN period_idx%2=1 THEN period_end END AS e, monthly_rent FROM periods), q AS (SELECT *, first_value(s IGNORE NULLS) OVER (PARTITION BY lease_id ORDER BY period_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1 AS nx FROM p)
      SELECT lease_id, period_idx, s AS period_start, CASE WHEN e IS NULL AND s IS NOT NULL THEN nx ELSE e END AS period_end, e IS NULL AND s IS NOT NULL AND nx IS NOT NULL AS end_inferred, monthly_rent FROM q""", "periods"),
    "collapse_steps": oracle.sql("SELECT lease_id, month_num, month_start, monthly_rent FROM (SELECT *, lag(monthly_rent) OVER (PARTITION BY lease_id ORDER BY month_num) AS b FROM months0) WHERE b IS NULL OR b<>monthly_rent", "months0"),
    "reanchor_schedule": oracle.sql(f", p AS (SELECT p.*, min(period_start) OVER (PARTITION BY lease_id) AS o FROM periods p) SELECT lease_id, period_idx, {oracle.add_m('(commence+40)', oracle.mi('period_start') + '-' + oracle.mi('o'))} AS period_start, {oracle.add_m('(commence+40)', oracle.mi('(period_end+1)') + '-' + oracle.mi('o'))} - 1 AS period_end, monthly_rent FROM p JOIN (SELECT lease_id, commence FROM leases) USING (lease_id)", "periods"),
    "bulk_paste": oracle.sql("""SELECT lease_id, period_idx AS at, CASE WHEN lease_id%4<3 THEN period_start END AS period_start, CASE WHEN lease_id%4<2 THEN period_end END AS period_end, CASE WHEN lease_id%4=3 THEN period_idx+1 END AS relative_year,
      monthly_rent, lease_id%4=1 AS asterisk, CAST(NULL AS VARCHAR) AS warning FROM periods UNION ALL SELECT lease_id, count(*), NULL, NULL, NULL, NULL, false, 'no rent on the line' FROM periods GROUP BY lease_id""", "periods"),
    "prose_charges": oracle.sql("""SELECT lease_id, ['cams','insurance',NULL,'cams','taxes'][lease_id%6+1] AS bucket, ['nnn','insurance',NULL,'cam','taxes'][lease_id%6+1] AS label, CAST(printf('%.2f', year1) AS DOUBLE) AS year1,
      CASE WHEN lease_id%6<>3 THEN round(esc*100) END AS esc_pct, CAST([12,24,NULL,NULL,6][lease_id%6+1] AS INTEGER) AS cadence_months FROM leases WHERE lease_id%6 NOT IN (2,5)""", "leases"),
    "schedule_choice": oracle.sql("SELECT lease_id, CASE WHEN lease_id%3=0 AND lease_id%7<>0 AND lease_id%5<>0 THEN 'extracted' ELSE 'parsed' END AS reading, lease_id%3=0 AND lease_id%7<>0 AND lease_id%5<>0 AS conflict FROM (SELECT DISTINCT lease_id FROM periods)", "periods"),
    "charge_dedupe": "SELECT lease_id, label_no, ord, l_extendedprice FROM (SELECT l_orderkey AS lease_id, l_partkey%7 AS label_no, l_linenumber AS ord, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_partkey%7 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r=1",
    "slot_claiming": """WITH c AS (SELECT l_orderkey AS lease_id, ['cams','insurance','taxes','security','otherItems'][l_partkey%5+1] AS bucket, l_quantity/50 AS confidence, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem),
      d AS (SELECT *, row_number() OVER (PARTITION BY lease_id, bucket ORDER BY confidence DESC, ord)=1 AS own FROM c) SELECT lease_id, ord, bucket, confidence, CASE WHEN own THEN bucket ELSE 'custom_' || row_number() OVER (PARTITION BY lease_id, own ORDER BY confidence DESC, ord) END AS slot FROM d""",
    "slot_padding": oracle.sql(", n AS (SELECT *, row_number() OVER (PARTITION BY lease_id ORDER BY ord) AS slot FROM one_time) SELECT l.lease_id, s.slot, n.label, n.date, coalesce(n.amount, 0e0) AS amount FROM leases l CROSS JOIN (SELECT unnest(range(1, 12)) AS slot) s LEFT JOIN n ON n.lease_id=l.lease_id AND n.slot=s.slot", "one_time"),
    "csv_projection": oracle.sql("SELECT lease_id, " + ", ".join(f'{c} AS "{label}"' for c, label in CSV.items()) + " FROM ledger", "ledger"),
    "extraction_confidence": oracle.sql(", n AS (SELECT lease_id, lease_id%(count(*)+1) AS n FROM periods GROUP BY lease_id), o AS (SELECT lease_id AS doc_id, round(((CASE WHEN n>=3 THEN 1e0 WHEN n>0 THEN 0.5e0 ELSE 0e0 END)*3 + (CASE WHEN n>0 THEN 1e0 ELSE 0e0 END)*2 + (CASE WHEN lease_id%6=0 THEN 1e0 WHEN lease_id%6<=3 THEN 0.6e0 ELSE 0.2e0 END)*1.5e0 + [1e0,0.6e0,0.2e0][lease_id%3+1]*1.5e0 + (CASE WHEN lease_id%2=0 THEN 1e0 ELSE 0.5e0 END)*0.5e0 + (CASE WHEN n>0 THEN (n//2)/CAST(n AS DOUBLE) ELSE 0e0 END)*2)/10.5e0, 9) AS overall FROM n) SELECT *, CASE WHEN overall>=0.7 THEN 'high' WHEN overall>=0.4 THEN 'medium' ELSE 'low' END AS level FROM o", "periods"),
}
