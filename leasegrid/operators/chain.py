"""From what was extracted of a lease and its text to a schedule and charges: the repairs in their order.

Every stage works on all leases at once and replaces a lease's schedule as a whole or leaves it; each row
says which stage set it, and each lease how it came to that and what is still to be told.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasegrid.functions.dates import let

from . import events, paste, text, wording
from .labels import once
from .text import CONFIDENCE

LEASE = "lease_id"
#: The order in which readings of equal score are preferred.
READINGS = ["dated_periods", "relative_month_ranges", "lease_year_ranges", "narrative_escalation"]
# The rank of a rule that gives its own date, and the default anchor with what stands in for it.
ABSOLUTE_CONFIDENCE, DEFAULT_FALLBACK = 0.95, "commencement_date"
SCOPES = ["base_rent_start", "rent_schedule_anchor"]


def anchored(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows(lease_id, text, wins) with anchor, the date that a schedule in months or years counts from, and
    n_open, how many events it would take that have no date.

    Events are dated by known(lease_id, event, day), then by what the text says of them, first mention
    first. The rule is the best of those on base rent or the schedule, ones with a date of their own last;
    else the rent commencement date, for which the commencement date stands in if the text does not name it.
    """
    dates = events.merged([known]).groupBy(LEASE).agg(F.map_from_entries(F.collect_list(F.struct("event", "day"))).alias("dates"))  # at most one an event
    none = F.lit(None).cast("string")
    # Windows come in their order, and so does what they tell.
    scoped = lambda w: wording.scope(wording.spoken(w.normalized)).alias("scope")
    told = F.flatten(F.transform("wins", lambda w: F.transform(text.absolute_in(w.original), lambda x: F.struct(scoped(w), w.ord.alias("ord"), x.trigger_event.alias("trigger_event"), x.resolved_date.alias("resolved_date")))))
    said = F.flatten(F.transform("wins", lambda w: F.transform(text.phrases_in(w.normalized), lambda x: F.struct(scoped(w), w.ord.alias("ord"), x.alias("x")))))

    def rule(absolute: bool, own: Column, confidence: Column, kind: Column, second: Column, offset: Column, day: Column, trigger: Column) -> Column:
        """A rule after what ranks it."""
        rank = F.struct(F.lit(absolute).alias("absolute"), (-confidence).alias("less"), own.ord.alias("ord"), kind.alias("rule_kind"), trigger.alias("trigger_event"))
        return F.struct(rank.alias("rank"), F.struct(kind.alias("rule_kind"), trigger.alias("trigger_event"), second.alias("second_event"), none.alias("fallback"), offset.alias("offset_value"), day.alias("resolved_date")).alias("rule"))

    def on_schedule(rules: Column) -> Column:
        return F.filter(rules, lambda x: x.scope.isin(*SCOPES))

    rows = once(rows.join(dates, LEASE, "left"), "told", told)
    dated = F.transform(on_schedule(F.col("told")), lambda x: rule(True, x, F.lit(ABSOLUTE_CONFIDENCE), F.lit("absolute_date"), none, F.lit(None).cast("int"), x.resolved_date, x.trigger_event))
    phrased = F.transform(on_schedule(said), lambda x: rule(False, x, x.x.confidence, x.x.rule_kind, x.x.second_event, x.x.offset_value, F.lit(None).cast("date"), x.x.trigger_event))
    names = wording.says(wording.spoken(F.coalesce(F.col("text"), F.lit(""))), ["rent commencement date"])
    default = F.struct(
        F.lit("event_date").alias("rule_kind"), F.lit(wording.DEFAULT[0]).alias("trigger_event"), none.alias("second_event"), F.when(~names, DEFAULT_FALLBACK).alias("fallback"),
        F.lit(None).cast("int").alias("offset_value"), F.lit(None).cast("date").alias("resolved_date"),
    )
    rows = once(rows, "r", F.coalesce(F.array_min(F.concat(dated, phrased)).rule, default))
    r = F.col("r")

    def day(event: Column) -> Column:
        first = F.get(F.filter("told", lambda x: x.trigger_event == event), F.lit(0)).resolved_date
        return F.coalesce(F.when(F.col("dates").isNotNull() & event.isNotNull(), F.try_element_at("dates", event)), first)

    pair = r.rule_kind.isin(*events.PAIRED)
    main = F.when(pair, day(r.trigger_event)).otherwise(F.coalesce(day(r.trigger_event), day(r.fallback)))
    at = F.when(r.rule_kind == "absolute_date", r.resolved_date).otherwise(text.resolved(r.rule_kind, main, day(r.second_event), F.coalesce(r.offset_value, F.lit(0))))
    asked = F.array_compact(F.array(r.trigger_event, F.when(pair, r.second_event), F.when(day(r.trigger_event).isNull(), r.fallback)))
    open_ = F.when(r.rule_kind == "absolute_date", 0).otherwise(F.size(F.filter(asked, lambda e: day(e).isNull())))
    return once(rows, "a", F.struct(at.alias("anchor"), open_.cast("long").alias("n_open"))).drop("dates", "told", "r").select("*", "a.*").drop("a")


PERIODS = "array<struct<place: bigint, period_start: date, period_end: date, monthly_rent: double>>"


def _between(place: Column, anchor: Column, first: Column, last: Column, rent: Column) -> Column:
    """A period of the months first to last from an anchor; without one it has no dates."""
    return F.struct(place.cast("long").alias("place"), F.add_months(anchor, (first - 1).cast("int")).alias("period_start"), F.date_sub(F.add_months(anchor, last.cast("int")), 1).alias("period_end"), rent.alias("monthly_rent"))


def readings(own: Column) -> list[Column]:
    """The schedule of a lease in each way that it can be read (READINGS), as arrays of periods, which want
    an anchor to have dates: own are its rows so far; wins, text and anchor are columns."""
    dated = F.filter(own, lambda x: x.period_start.isNotNull() & x.period_end.isNotNull() & x.monthly_rent.isNotNull())
    terms = lambda unit: F.array_distinct(F.flatten(F.transform("wins", lambda w: text.terms_in(w.normalized, unit))))
    anchor = F.col("anchor")
    months = F.transform(terms(text.MONTH_TERMS), lambda t: _between(t.start_value, anchor, t.start_value, t.end_value, t.monthly_rent))
    # Years as the months that they are; the value that orders them stays that of the text.
    years = F.transform(terms(text.YEAR_TERMS), lambda t: _between(t.start_value, anchor, (t.start_value - 1) * 12 + 1, t.end_value * 12, t.monthly_rent))

    def steps(term: Column, rule: Column) -> Column:
        grown = text.steps_in(rule.start_rent, rule.esc_pct, rule.cadence_months, text.term_months(term.term_start, term.term_end))
        return F.transform(grown, lambda s: _between(s.start_month, term.term_start, s.start_month, s.end_month, s.monthly_rent))

    # A text that states no rate has no steps, and its term need not be read.
    grows = let(wording.escalation_in(F.col("text")), lambda rule: F.when(rule.isNotNull(), let(wording.term_in(F.col("text")), lambda term: F.when(term.isNotNull(), steps(term, rule)))))
    return [F.coalesce(x.cast(PERIODS), F.array().cast(PERIODS)) for x in (dated, months, years, grows)]


def told(extracted: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each lease: stage and notice of its rows so far, own; best, the best reading of its text; and
    whether that takes the place of own. All that a lease has is read in its row, each text once."""
    cells = once(extracted, "days", F.struct(*[day.alias(name) for name, day in zip(("period_start", "period_end"), wording.repaired_row(F.col("start_text"), F.col("end_text")), strict=True)]))
    period = F.struct(F.col("ord").cast("long").alias("place"), F.col("days.period_start").alias("period_start"), F.col("days.period_end").alias("period_end"), F.col("monthly_rent").cast("double").alias("monthly_rent"))
    read = cells.select(LEASE, period.alias("x")).groupBy(LEASE).agg(F.collect_list("x").alias("read"))
    rows = docs.select(LEASE, "text").join(read.hint("shuffle_hash"), LEASE, "left")
    found = F.transform(wording.dated_of(F.col("text")), lambda x: F.struct(F.unix_date(x.period_start).cast("long").alias("place"), x.period_start.alias("period_start"), x.period_end.alias("period_end"), x.monthly_rent.alias("monthly_rent")))
    rows = once(rows, "found", found.cast(PERIODS))
    n_read = F.size(F.coalesce("read", F.array().cast(PERIODS)))
    n_dated = F.size(F.coalesce(F.filter("read", lambda x: F.coalesce(x.period_start, x.period_end).isNotNull()), F.array().cast(PERIODS)))
    first = F.when(n_dated > 0, "read").when(F.size("found") > 0, "recovered").otherwise("none")
    notice = F.when(F.col("stage") == "recovered", F.when(n_read == 0, "omitted").otherwise("unparsed"))
    own = F.when(F.col("stage") == "read", F.col("read").cast(PERIODS)).when(F.col("stage") == "recovered", F.col("found")).otherwise(F.array().cast(PERIODS))
    rows = rows.withColumn("stage", first).select(LEASE, "text", "stage", notice.alias("notice"), own.alias("own"))
    rows = anchored(once(once(rows, "lines", text.lines_in(F.col("text"))), "wins", text.windows_in(F.col("lines"))), known)

    def ranked(place: int, periods: Column) -> Column:
        """A reading after what ranks it, null without terms."""
        name = F.lit(READINGS[place])
        n_rows = F.size(F.filter(periods, lambda x: x.period_start.isNotNull())).cast("long")
        n_open = F.col("n_open") if place in (1, 2) else F.lit(0).cast("long")
        score = text.score(F.lit(CONFIDENCE[READINGS[place]]), name, F.size(periods), n_rows, n_open)
        return F.when(F.size(periods) > 0, F.struct(F.round(score, 6).alias("score"), F.lit(-1 - place).alias("ord"), name.alias("representation"), n_rows.alias("n_rows"), periods.alias("periods")))

    rows = once(rows, "every", F.array(*readings(F.col("own")))).drop("wins", "text")
    # No two readings of a lease have the same ord, so that periods are never compared.
    rows = once(rows, "best", F.array_max(F.array(*[ranked(k, F.col("every")[k]) for k in range(len(READINGS))]))).drop("every")
    usable = F.exists("own", lambda x: x.period_start.isNotNull() & x.period_end.isNotNull() & F.coalesce(x.monthly_rent >= 0, F.lit(False)))
    return rows.withColumn("takes", ~usable & (F.coalesce("best.n_rows", F.lit(0)) > 0))


def repaired(extracted: DataFrame, docs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The schedules of all leases of docs(lease_id, text), one text a lease, and how each came about.

    extracted(lease_id, ord, start_text, end_text, monthly_rent) is what was read of a schedule; known
    (lease_id, event, day) dates events. Without rows, or without a date in any of them, the dated rows of
    the text take their place, and without such rows there are none left. Where no row then has both its
    dates and a rent, the best reading of the text with dates takes the place of what there is.

    Returns (lease_id, place, period_start, period_end, monthly_rent, stage) and one row a lease: lease_id,
    stage ("read", "recovered", "materialized", "none"), notice ("omitted", "unparsed", "materialized",
    "needs_anchor" or null), representation (of the best reading) and n_periods.
    """
    rows = told(extracted, docs, known)
    takes = F.col("takes")
    schedule = rows.select(LEASE, F.when(takes, "materialized").otherwise(F.col("stage")).alias("stage"), F.inline(F.when(takes, F.col("best.periods")).otherwise(F.col("own"))))
    schedule = schedule.select(LEASE, "place", "period_start", "period_end", "monthly_rent", "stage")
    wants = ~takes & (F.size("own") == 0) & F.col("best.representation").isNotNull()
    outcome = rows.select(
        LEASE, F.when(takes, "materialized").otherwise(F.col("stage")).alias("stage"), F.when(takes, "materialized").when(wants, "needs_anchor").otherwise(F.col("notice")).alias("notice"),
        F.col("best.representation").alias("representation"), F.when(takes, F.col("best.n_rows")).otherwise(F.size("own").cast("long")).alias("n_periods"),
    )
    return schedule, outcome


def told_charges(charges: DataFrame, hints: DataFrame, docs: DataFrame, buckets: list[str]) -> tuple[DataFrame, DataFrame]:
    """The charges and the dated overrides that a lease comes to with what its text tells of them.

    charges(lease_id, ord, bucket, label, year1, esc_pct, charge_start, esc_start, confidence) are filled
    from charges told in prose, the first of the same bucket or label, and added to by those that match
    none. Where the text sets a charge's sum more than once, the first sum is its first year's, it starts
    then if nothing else is known and grows no more by a rate; the others become hints(lease_id, bucket,
    label, date, amount), but for those that are there already.
    """
    own = paste.merged(charges.select(LEASE, "ord", "bucket", "label", "year1", "esc_pct", "confidence"), paste.prose_charges(docs, LEASE, "text"), LEASE)
    own = own.join(charges.select(LEASE, "ord", "charge_start", "esc_start"), [LEASE, "ord"], "left")
    steps = wording.charge_steps(docs, LEASE, "text", buckets)
    firsts = steps.groupBy(LEASE, "bucket").agg(F.min_by(F.struct("step_date", "amount"), "step_date").alias("first"), F.count("*").alias("n")).where("n > 1").select(LEASE, "bucket", "first")
    # A charge's bucket may be null, and then nothing of the steps is its own.
    own = own.join(firsts, [LEASE, "bucket"], "left")
    set_ = F.col("first").isNotNull()
    told = own.where(set_).select(LEASE, "bucket", "label", F.col("first.step_date").alias("from")).join(steps, [LEASE, "bucket"]).where(F.col("step_date") > F.col("from"))
    fresh = told.select(LEASE, "bucket", "label", F.col("step_date").alias("date"), "amount").distinct().alias("fresh")
    seen = hints.alias("seen")
    same = reduce(lambda a, b: a & b, [F.col(f"fresh.{c}").eqNullSafe(F.col(f"seen.{c}")) for c in (LEASE, "bucket", "label", "date", "amount")])
    own = own.select(
        LEASE, "ord", "bucket", "label", F.when(set_, F.col("first.amount")).otherwise(F.col("year1")).alias("year1"), F.when(~set_, F.col("esc_pct")).alias("esc_pct"),
        F.when(set_, F.coalesce("charge_start", "first.step_date")).otherwise(F.col("charge_start")).alias("charge_start"), F.when(~set_, F.col("esc_start")).alias("esc_start"), "confidence",
    )
    return own, hints.unionByName(fresh.join(seen, same, "left_anti"))
