"""Form and extraction intake: concessions, overrides, charges and one-time items as they are typed or
detected, brought to what the ledger takes, and the rules that name what is wrong with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrid.functions.dates import month_index

from .match import assign, lease_bounds
from .quality import flagged

MODES = ["percent", "fixed_amount"]
#: The lists of a form, in the order in which their events follow each other.
LEGACY, FREE, ABATEMENT = "legacy", "free_rent", "abatement"
# The largest monthly charge that is believed, and the confidence under which one is flagged.
MOST_CHARGE, LOW_CONFIDENCE = 500_000, 0.7


def whole_number(text: Column) -> Column:
    """A positive whole number as typed, else null."""
    n = F.trim(text).try_cast("double")
    return F.when((n > 0) & (n == F.floor(n)), n.cast("long"))


def number(text: Column) -> Column:
    """A finite number as typed, else null."""
    n = F.trim(text).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def numbered(raw: DataFrame, months: DataFrame) -> DataFrame:
    """raw with month_number: the typed one, else that of the row which holds the day."""
    typed = raw.withColumn("typed", whole_number(F.col("month_text")))
    open_ = typed.where("typed is null and day is not null")
    found = assign(open_.select("lease_id", "list", "ord", "day"), months, "day").select("lease_id", "list", "ord", F.col("month_num").alias("dated"))
    return typed.join(found, ["lease_id", "list", "ord"], "left").withColumn("month_number", F.coalesce("typed", "dated")).drop("typed", "dated")


def concession_events(raw: DataFrame, helper: DataFrame, months: DataFrame) -> DataFrame:
    """lease_id, list, ord, type, scope, month_number, effective_date, start_date, end_date, value_mode, value.

    raw(lease_id, list, ord, type, scope, month_text, day, start_date, end_date, value_mode, value_text)
    holds the lists of a form; helper(lease_id, helper_end, helper_pct) the plain window of leases without
    legacy events. An event needs a month and a date: a month gives the date of its row, a date its
    row's month. What has neither, a window without an end, an abatement without a value above 0: dropped.
    """
    rows = numbered(raw, months).join(lease_bounds(months), "lease_id", "left")
    starts = months.select("lease_id", F.col("month_num").alias("month_number"), "month_start")
    monthly = rows.where((F.col("list") != LEGACY) | (F.col("scope") == "monthly_row")).join(starts, ["lease_id", "month_number"], "left")
    effective = F.when(F.col("list") == LEGACY, F.col("day")).otherwise(F.coalesce("month_start", "day"))
    kind = F.when(F.col("list") == LEGACY, F.when(F.col("type") == "free_rent", "free_rent").otherwise("abatement")).otherwise(F.col("list"))
    free = kind == "free_rent"
    mode = F.when(free, "percent").when(F.col("value_mode").isin(*MODES), F.col("value_mode"))
    value = F.when(free, 100.0).otherwise(number(F.col("value_text")))
    none = F.lit(None).cast("date")
    own = ["lease_id", "list", "ord", kind.alias("type")]
    monthly = monthly.select(*own, F.lit("monthly_row").alias("scope"), "month_number", effective.alias("effective_date"), none.alias("start_date"), none.alias("end_date"), mode.alias("value_mode"), value.alias("value"))
    monthly = monthly.where("month_number is not null and effective_date is not null")
    windows = rows.where((F.col("list") == LEGACY) & (F.coalesce("scope", F.lit("")) != "monthly_row")).select(
        *own, F.lit("legacy_window").alias("scope"), F.lit(None).cast("long").alias("month_number"), none.alias("effective_date"),
        F.coalesce("start_date", "lease_start").alias("start_date"), "end_date", mode.alias("value_mode"), value.alias("value"),
    ).where("start_date is not null and end_date is not null")
    pct = F.least(F.col("helper_pct"), F.lit(100.0))
    implied = helper.join(raw.where(F.col("list") == LEGACY).select("lease_id").distinct(), "lease_id", "left_anti").join(lease_bounds(months), "lease_id").where("helper_end is not null and helper_pct > 0")
    implied = implied.select(
        "lease_id", F.lit(LEGACY).alias("list"), F.lit(-1).cast("long").alias("ord"), F.when(pct == 100, "free_rent").otherwise("abatement").alias("type"), F.lit("legacy_window").alias("scope"), F.lit(None).cast("long").alias("month_number"),
        none.alias("effective_date"), F.col("lease_start").alias("start_date"), F.col("helper_end").alias("end_date"), F.lit("percent").alias("value_mode"), pct.alias("value"),
    )
    return monthly.unionByName(windows).unionByName(implied).where("type = 'free_rent' or value > 0")


def window_events(windows: DataFrame, months: DataFrame) -> DataFrame:
    """lease_id, month_number, date, type, value: a detected window (lease_id, start_date, end_date, pct) as
    one event for each row it overlaps, of a whole percentage free rent."""
    rows = months.join(windows, "lease_id").where("pct > 0 and start_date <= row_end and end_date >= month_start")
    full = F.col("pct") == 100
    return rows.select("lease_id", F.col("month_num").alias("month_number"), F.col("month_start").alias("date"), F.when(full, "free_rent").otherwise("abatement").alias("type"), F.when(~full, F.col("pct")).alias("value"))


def concession_rules(raw: DataFrame, months: DataFrame) -> DataFrame:
    """The rules of a form's free-rent and abatement events: a month in the term, one event a month (the
    first holds it), and of abatements a value, its mode and range. Each event fails at its first fault."""
    term = months.groupBy("lease_id").agg(F.max("month_num").alias("term_months"))
    rows = raw.where(F.col("list") != LEGACY).join(term, "lease_id", "left").withColumn("n", whole_number(F.col("month_text")))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    inside = F.col("n").isNotNull() & (F.col("term_months").isNull() | (F.col("n") <= F.col("term_months")))
    order = Window.partitionBy("lease_id", "n", "inside").orderBy(F.when(F.col("list") == FREE, 0).otherwise(1), "ord")
    rows = rows.withColumn("inside", inside).withColumn("place", F.row_number().over(order))
    first = F.when(blank("month_text"), "month-required").when(F.col("n").isNull(), "month-whole").when(~F.col("inside"), "month-in-term")
    value, mode = number(F.col("value_text")), F.coalesce("value_mode", F.lit(""))
    of_value = F.when(blank("value_text"), "value-required").when(value.isNull(), "value-number").when(~mode.isin(*MODES), "value-mode").when((mode == "percent") & ~value.between(0, 100), "value-percent")
    taken = F.when(first.isNull() & (F.col("place") > 1), "month-taken")
    found = F.filter(F.array(first, taken, F.when(first.isNull() & (F.col("list") == ABATEMENT), of_value)), lambda x: x.isNotNull())
    return rows.select("lease_id", "list", "ord", F.explode(found).alias("rule_id"))


def override_rules(raw: DataFrame, charges: DataFrame, months: DataFrame) -> DataFrame:
    """The rules of overrides as typed: raw(lease_id, ord, target_key, date_text, day, amount_text), where
    day is the date that the text stands for."""
    keys = charges.groupBy("lease_id").agg(F.collect_set("key").alias("keys"))
    # Every override takes the row of its date in one sweep; those that have no place are numbered apart.
    placed = F.coalesce(F.col("day").isNotNull() & (F.col("target_key") != ""), F.lit(False))
    place = F.row_number().over(Window.partitionBy("lease_id", "target_key", "month_num", "placed").orderBy("ord"))
    rows = assign(raw.withColumn("placed", placed), months, "day").withColumn("place", place)
    rows = rows.join(lease_bounds(months), "lease_id").join(keys, "lease_id", "left")
    known = (F.col("target_key") == "base_rent") | F.coalesce(F.array_contains("keys", F.col("target_key")), F.lit(False))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    amount = number(F.col("amount_text"))
    aimed = ~blank("target_key")
    timed = aimed & F.col("day").isNotNull()
    given = timed & ~blank("amount_text")
    return flagged(
        rows,
        [
            ("target-required", "error", ~aimed), ("target-unknown", "error", aimed & ~known), ("date-required", "error", aimed & blank("date_text")),
            ("date-format", "error", aimed & ~blank("date_text") & F.col("day").isNull()), ("date-outside", "warning", timed & ((F.col("day") < F.col("lease_start")) | (F.col("day") > F.col("lease_end")))),
            ("row-taken", "error", timed & (F.col("place") > 1)), ("amount-required", "error", timed & blank("amount_text")), ("amount-number", "error", given & amount.isNull()), ("amount-negative", "error", given & (amount < 0)),
        ],
    )


def charge_rules(raw: DataFrame, months: DataFrame) -> DataFrame:
    """The rules of charges as typed: raw(lease_id, ord, year1_text, esc_text, start_text, start_day,
    esc_start_text, esc_start_day); blanks are allowed throughout."""
    rows = raw.join(lease_bounds(months), "lease_id")
    typed = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    outside = lambda d: (F.col(d) < F.col("lease_start")) | (F.col(d) > F.col("lease_end"))
    return flagged(
        rows,
        [
            ("year1-number", "error", typed("year1_text") & number(F.col("year1_text")).isNull()), ("escalation-number", "error", typed("esc_text") & number(F.col("esc_text")).isNull()),
            ("start-format", "error", typed("start_text") & F.col("start_day").isNull()), ("start-outside", "warning", outside("start_day")),
            ("escalation-start-format", "error", typed("esc_start_text") & F.col("esc_start_day").isNull()), ("escalation-start-outside", "warning", outside("esc_start_day")),
        ],
    )


def override_hints(hints: DataFrame, charges: DataFrame) -> DataFrame:
    """hints(lease_id, ord, bucket, label, ...) with target_key: the charge of that bucket, else the first
    whose label reads the same; null where there is none, and then notice is true."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    by_key = charges.select("lease_id", F.col("key").alias("bucket"), F.col("key").alias("own_key")).distinct()
    by_label = charges.groupBy("lease_id", plain("label").alias("plain")).agg(F.min_by("key", "ord").alias("label_key"))
    rows = hints.join(by_key, ["lease_id", "bucket"], "left").withColumn("plain", plain("label")).join(by_label, ["lease_id", "plain"], "left")
    target = F.coalesce("own_key", F.when(F.col("plain") != "", F.col("label_key")))
    return rows.select(*hints.columns, target.alias("target_key"), target.isNull().alias("notice"))


def guarded_charges(raw: DataFrame) -> DataFrame:
    """Detected charges (lease_id, ord, label, bucket, year1, esc_pct, canonical_type, confidence) with what
    cannot be taken away: amounts past belief or without bounds, escalations outside 0 to 100, buckets that
    are none. Rows without a label go; a confidence is kept within 0 and 1, and 0.5 without one."""
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    buckets = ["cams", "insurance", "taxes", "security", "otherItems"]
    return raw.where("trim(coalesce(label, '')) <> ''").select(
        "lease_id", "ord", F.trim("label").alias("label"), F.when(F.col("bucket").isin(*buckets), F.col("bucket")).alias("bucket"),
        F.when(finite("year1") & (F.col("year1") <= MOST_CHARGE), F.col("year1")).alias("year1"), F.when(F.col("esc_pct").between(0, 100) & ~F.isnan("esc_pct"), F.col("esc_pct")).alias("esc_pct"),
        F.when(F.col("canonical_type") == "nnn", "nnn").otherwise("other").alias("canonical_type"),
        F.when(F.col("confidence").isNull() | F.isnan("confidence"), 0.5).otherwise(F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))).alias("confidence"),
    )


def charge_flags(detected: DataFrame, built: DataFrame) -> DataFrame:
    """lease_id, idx, field of the built charges (lease_id, idx, key, label) to look at: a detected charge
    without an amount or of low confidence flags the first built one of its bucket or label."""
    rows = detected.alias("d").join(built.select("lease_id", "idx", "key", F.col("label").alias("built_label")), "lease_id")
    rows = rows.where(F.coalesce(F.col("key") == F.col("bucket"), F.lit(False)) | (F.col("built_label") == F.col("label")))
    first = rows.groupBy("lease_id", "ord").agg(F.min("idx").alias("idx"), F.first("year1").alias("year1"), F.first("esc_pct").alias("esc_pct"), F.first("confidence").alias("confidence"))
    low = F.col("confidence") < LOW_CONFIDENCE
    fields = F.array_compact(F.array(F.when(F.col("year1").isNull() | low, "year1"), F.when(F.col("esc_pct").isNull() & low, "escPct")))
    return first.select("lease_id", "idx", F.explode(fields).alias("field")).distinct()


def nnn_mode(found: DataFrame, charges: DataFrame) -> DataFrame:
    """lease_id, nnn_mode, aggregate_year1: one estimate for all net charges counts if there is one and no
    net charge by itself, neither in the lease's own fields nor among its detected charges."""
    nets = charges.groupBy("lease_id").agg(F.bool_or((F.col("canonical_type") == "nnn") & (F.trim("label") != "")).alias("nets"))
    own = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in ("cams", "insurance", "taxes")])
    rows = found.join(nets, "lease_id", "left")
    whole = F.col("estimate").isNotNull() & ~own & ~F.coalesce("nets", F.lit(False))
    return rows.select("lease_id", F.when(whole, "aggregate").otherwise("individual").alias("nnn_mode"), F.when(whole, F.col("estimate")).alias("aggregate_year1"))


def one_time_items(listed: DataFrame, deposits: DataFrame) -> DataFrame:
    """lease_id, ord, label, date, amount: the listed charges (lease_id, ord, label, date, amount, sign) that
    have a name; for leases with none listed, the deposit (lease_id, amount, date, first_start). An amount
    takes the sign that is told, else its own."""
    sign = F.when(F.col("sign").isin(1, -1), F.col("sign")).otherwise(F.when(F.col("amount") < 0, -1).otherwise(1))
    own = listed.where("trim(coalesce(label, '')) <> ''").select("lease_id", "ord", F.trim("label").alias("label"), "date", (F.abs("amount") * sign).alias("amount"))
    rest = deposits.where("amount > 0").join(listed.select("lease_id").distinct(), "lease_id", "left_anti")
    return own.unionByName(rest.select("lease_id", F.lit(0).cast("long").alias("ord"), F.lit("Security Deposit").alias("label"), F.coalesce("date", "first_start").alias("date"), "amount"))


FIELDS = ["lease_name", "square_footage", "abatement_end", "abatement_pct"]


def field_triage(found: DataFrame) -> DataFrame:
    """lease_id, field, state (reliable, uncertain, missing) of an extraction: found has the fields as text,
    charge_<bucket> as numbers, schedule (a score) and flags, the names of doubtful fields."""
    state = lambda c, empty, doubted: F.when(empty, "missing").when(doubted, "uncertain").otherwise("reliable")
    told = lambda name: F.array_contains("flags", name)
    out = [F.struct(F.lit("schedule").alias("field"), F.when(F.col("schedule") >= 0.8, "reliable").when(F.col("schedule") > 0, "uncertain").otherwise("missing").alias("state"))]
    out += [F.struct(F.lit(c).alias("field"), state(c, F.coalesce(F.col(c), F.lit("")).isin("", "0"), told(c)).alias("state")) for c in FIELDS]
    for bucket in ("cams", "insurance", "taxes", "security", "otherItems"):
        own = F.col(f"charge_{bucket}")
        out.append(F.struct(F.lit(bucket).alias("field"), state(bucket, F.coalesce(own, F.lit(0.0)) == 0, told(bucket) | told(f"{bucket}.year1")).alias("state")))
    return found.select("lease_id", F.explode(F.array(*out)).alias("x")).select("lease_id", "x.*")


def manual_fallback(scores: DataFrame) -> DataFrame:
    """The extractions that are to be read by hand: a low score overall or no schedule at all."""
    return scores.where("overall < 0.4 or schedule = 0").select("lease_id")


def zero_rent(ledger: DataFrame, most: float = 0.5) -> DataFrame:
    """lease_id, share of the leases that owe no scheduled rent in over most of their months, abated ones aside."""
    zero = (F.col("scheduled_base_rent") == 0) & ~F.col("is_concession_row")
    return ledger.groupBy("lease_id").agg(F.avg(F.when(zero, 1.0).otherwise(0.0)).alias("share")).where(F.col("share") > most)


def chronology(periods: DataFrame) -> DataFrame:
    """What months each period of a schedule may start and end in, given its neighbours; months count from
    the first period's start, and a period without an end bounds the next by its start."""
    order = Window.partitionBy("lease_id").orderBy("period_idx")
    anchor = F.first("period_start").over(order)
    month = lambda d: F.when(anchor.isNotNull() & d.isNotNull(), month_index(d) - month_index(anchor) + 1 - F.when(F.dayofmonth(d) < F.dayofmonth(anchor), 1).otherwise(0)).cast("long")
    before = F.lag(F.coalesce("period_end", "period_start")).over(order)
    start, after = month(F.col("period_start")), month(F.lead("period_start").over(order))
    first = F.lag("period_idx").over(order).isNull()
    return periods.select(
        "lease_id", "period_idx", start.alias("start_month"), month(F.col("period_end")).alias("end_month"), F.when(first, F.lit(1).cast("long")).otherwise(month(before) + 1).alias("min_start"),
        start.alias("min_end"), F.when(start.isNull() | (after > start), after - 1).alias("max_end"), first.alias("start_locked"),
    )


def active_charges(rows: DataFrame, charges: DataFrame, leases: DataFrame) -> DataFrame:
    """lease_id, key, canonical_type of the charges that a schedule shows: those with an amount in some
    month or in their terms; in aggregate mode no net ones."""
    seen = rows.groupBy("lease_id", "key").agg(F.bool_or(F.col("amount") != 0).alias("seen"))
    own = charges.join(leases.select("lease_id", "nnn_mode"), "lease_id").where("not (nnn_mode = 'aggregate' and canonical_type = 'nnn')")
    return own.join(seen, ["lease_id", "key"], "left").where("coalesce(seen, false) or year1 > 0").select("lease_id", "key", "canonical_type")


def monthly_concessions(events: DataFrame, months: DataFrame) -> DataFrame:
    """lease_id, month_num, n_free, abated: how many free-rent events a month has and what its other events
    add up to, 0 where there is none."""
    sums = events.groupBy("lease_id", F.col("month_number").alias("month_num")).agg(F.count(F.when(F.col("type") == "free_rent", 1)).alias("n_free"), F.sum(F.when(F.col("type") == "abatement", F.col("value"))).alias("abated"))
    return months.select("lease_id", "month_num").join(sums, ["lease_id", "month_num"], "left").select("lease_id", "month_num", F.coalesce("n_free", F.lit(0)).alias("n_free"), F.coalesce("abated", F.lit(0.0)).alias("abated"))


def page(rows: DataFrame, number_: int, size: int = 25) -> DataFrame:
    """The rows of one page of every lease's ledger, by month."""
    return rows.where(F.col("month_num").between(number_ * size + 1, (number_ + 1) * size))


def template_inputs(raw: DataFrame) -> DataFrame:
    """A template's inputs with its defaults: analysis from the first of the month of commencement where
    none is given, 7 % a year, net charges that grow as the rent does and others by 2 %, no abatement."""
    fill = lambda c, v: F.coalesce(F.col(c), v).alias(c)
    last = F.last_day(F.add_months(F.trunc("commence", "MM"), F.col("term").cast("int") - 1))
    months_off = F.coalesce("abatement_months", F.lit(0))
    off_start = F.when(months_off > 0, F.coalesce("abatement_start", "commence"))
    return raw.select(
        "lease_id", "commence", "term", fill("rent_start", F.col("commence")), fill("expire", last), fill("analysis_date", F.trunc("commence", "MM")), fill("discount_rate", F.lit(0.07)),
        fill("cams_year1", F.lit(0.0)), fill("cams_esc", F.col("rent_esc")), fill("security_esc", F.lit(0.02)), months_off.alias("abatement_months"), off_start.alias("abatement_start"),
        F.when(months_off > 0, F.last_day(F.add_months(F.trunc(off_start, "MM"), (months_off - 1).cast("int")))).alias("abatement_end"),
        F.when(months_off > 0, F.coalesce("abatement_pct", F.lit(1.0))).otherwise(F.lit(0.0)).alias("abatement_pct"),
    )


def template_issues(raw: DataFrame) -> DataFrame:
    """Inputs that a template refuses: a missing one, or one out of range."""
    required = ["commence", "term", "square_footage", "year1", "rent_esc"]
    rules = [(f"missing-{c}", "error", F.col(c).isNull()) for c in required]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    rules += [(n, "error", complete & c) for n, c in (("term-range", ~F.col("term").between(1, 600)), ("area-positive", F.col("square_footage") <= 0), ("rent-negative", F.col("year1") < 0), ("escalation-range", ~F.col("rent_esc").between(0, 0.2)))]
    return flagged(raw.withColumn("ord", F.lit(0)), rules)


def calendar_grid(leases: DataFrame) -> DataFrame:
    """lease_id, month_num, year_num, period_start, period_end: the months of a term from the first of the
    month of commencement on, each a calendar month."""
    k = F.explode(F.sequence(F.lit(0), F.col("term").cast("int") - 1))
    rows = leases.where("term > 0").select("lease_id", "commence", k.alias("k"))
    start = F.add_months(F.trunc("commence", "MM"), F.col("k"))
    return rows.select("lease_id", (F.col("k") + 1).cast("long").alias("month_num"), (F.floor(F.col("k") / 12) + 1).alias("year_num"), start.alias("period_start"), F.last_day(start).alias("period_end"))


def lease_month(day: Column, anchor: Column) -> tuple[Column, Column, Column]:
    """The number of the lease month that holds a day, counted from the anchor, and its first and last day."""
    n = month_index(day) - month_index(anchor)
    n = F.when(day >= anchor, n - F.when(F.add_months(anchor, n) > day, 1).otherwise(0) + 1)
    return n.cast("long"), F.add_months(anchor, (n - 1).cast("int")), F.date_sub(F.add_months(anchor, n.cast("int")), 1)
