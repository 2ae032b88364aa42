"""The monthly obligation ledger: charges, overrides, concessions, one-time items and remaining balances."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrid.functions.dates import days_inclusive, let, overlap_days, years_since
from leasegrid.functions.money import clamp_percent, fix2, fix6, growth, whole_cents

from .match import assign

BASE, AGGREGATE = "base_rent", "nnn_aggregate"


@dataclass
class Inputs:
    """The tables of a portfolio; months as bounded() returns them."""

    leases: DataFrame
    months: DataFrame
    charges: DataFrame
    concessions: DataFrame
    overrides: DataFrame
    one_time: DataFrame


def override_steps(overrides: DataFrame, months: DataFrame) -> DataFrame:
    """lease_id, target_key, month_num, amount: the override that takes effect in a row; of several the
    latest date's, of equal dates the last in the list."""
    known = overrides.where("effective_date is not null").withColumn("amount", F.coalesce("amount", F.lit(0.0)))
    rows = assign(known.withColumn("target_key", F.coalesce("target_key", F.lit(BASE))), months, "effective_date")
    return rows.groupBy("lease_id", "target_key", "month_num").agg(F.max_by("amount", F.struct("effective_date", "ord")).alias("amount"))


def carried(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """rows with the last known value so far, by month within keys."""
    order = Window.partitionBy(*keys).orderBy("month_num").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(order))


def scheduled(months: DataFrame, overrides: DataFrame) -> DataFrame:
    """months with base_override (carried forward), scheduled (unrounded) and adjusted rent."""
    base = override_steps(overrides, months).where(F.col("target_key") == BASE).select("lease_id", "month_num", F.col("amount").alias("step"))
    rows = carried(months.join(base, ["lease_id", "month_num"], "left"), ["lease_id"], "step", "base_override").drop("step")
    return rows.withColumn("scheduled", F.coalesce("base_override", "monthly_rent")).withColumn("adjusted", F.col("scheduled") * F.col("factor"))


def explicit_concessions(concessions: DataFrame, months: DataFrame) -> DataFrame:
    """The first concession of each row that names a month: lease_id, month_num, and its fields as e."""
    known = concessions.where("scope = 'monthly_row' and effective_date is not null")
    rows = assign(known, months, "effective_date")
    event = F.struct("type", "scope", "value_mode", "value", F.col("effective_date").alias("start_date"), F.col("effective_date").alias("end_date"))
    return rows.groupBy("lease_id", "month_num").agg(F.min_by(event, F.struct("ord", "type", "value_mode")).alias("e"))


def window_concessions(concessions: DataFrame, months: DataFrame) -> DataFrame:
    """The first window of each row that overlaps it by a day or more, and by how many days. A window finds
    its first and its last row by assign(), and meets the rows between."""
    windows = concessions.where("scope = 'legacy_window' and start_date <= end_date")
    windows = assign(assign(windows, months, "start_date").withColumnRenamed("month_num", "first"), months, "end_date")
    windows = windows.withColumn("month_num", F.explode(F.sequence("first", "month_num"))).drop("first")
    days = overlap_days(F.col("month_start"), F.col("row_end"), F.col("start_date"), F.col("end_date"))
    event = F.struct("type", "scope", "value_mode", "value", "start_date", "end_date")
    rows = months.select("lease_id", "month_num", "month_start", "row_end").join(windows, ["lease_id", "month_num"]).withColumn("overlap", days).where("overlap > 0")
    return rows.groupBy("lease_id", "month_num").agg(F.min_by(F.struct(event.alias("w"), "overlap"), "ord").alias("x")).select("lease_id", "month_num", "x.w", "x.overlap")


def with_concessions(rows: DataFrame) -> DataFrame:
    """Adds to rows with e (an explicit concession) and w (a window) the applied rent (unrounded), what
    is abated, and the fields of the concession that counts."""
    windowed = F.col("e").isNull() & F.col("w").isNotNull()
    total = days_inclusive(F.col("month_start"), F.col("row_end"))
    overlap = F.when(windowed, overlap_days(F.col("month_start"), F.col("row_end"), F.col("w.start_date"), F.col("w.end_date")))
    rows = rows.withColumns({"windowed": windowed, "overlap": overlap, "days": total, "c": F.coalesce("e", "w")})
    windowed, overlap, total = F.col("windowed"), F.col("overlap"), F.col("days")
    share = F.when(windowed, overlap / total).otherwise(F.lit(1.0))
    c, adjusted = F.col("c"), F.col("adjusted")
    value = F.coalesce(c.value, F.lit(0.0))
    applied = (
        F.when(c.isNull(), adjusted)
        .when(c.type == "free_rent", F.when(windowed, adjusted * (1 - share)).otherwise(F.lit(0.0)))
        .when(c.value_mode == "fixed_amount", F.greatest(F.lit(0.0), adjusted - value * share))
        .when(c.value_mode == "percent", adjusted * (1 - clamp_percent(value) / 100 * share))
        .otherwise(adjusted)
    )
    whole = F.when(F.col("factor") < 1, "final-month").otherwise("full")
    basis = F.when(F.col("e").isNotNull(), "concession-event").when(windowed & (overlap < total), "concession-boundary").otherwise(whole)
    days = lambda x: F.when(windowed, x).otherwise(0).cast("long")
    return rows.withColumn("applied", applied).select(
        "*", F.greatest(F.lit(0.0), adjusted - F.col("applied")).alias("abated"), basis.alias("proration_basis"), c.isNotNull().alias("is_concession_row"),
        days(overlap).alias("abatement_days"), days(F.greatest(total - overlap, F.lit(0))).alias("full_rent_days"), days(total).alias("total_days"),
        c.type.alias("concession_type"), c.scope.alias("concession_scope"), c.value_mode.alias("concession_value_mode"),
        F.when(c.type == "free_rent", 100.0).otherwise(F.when(c.isNotNull(), value)).alias("concession_value"),
    )


def charge_rows(charges: DataFrame, months: DataFrame, overrides: DataFrame, leases: DataFrame) -> DataFrame:
    """One row per lease, month and charge: active, esc_years, amount and whether an override sets it.
    Leases in aggregate mode have no individual nnn charges, but one of their own.

    Months meet the spans of their lease's charges, of which one a charge covers a row, in one join on the
    lease: neither months nor rows are dealt again or sorted by charge.
    """
    lists = merged_charges(leases.select("lease_id", "nnn_mode", "nnn_agg_year1", "nnn_agg_esc_pct"), charges)
    lists = lists.join(override_lists(overrides.where(F.col("target_key") != BASE)), "lease_id", "left")
    fields = ["ord", "key", "canonical_type", "year1", "esc_pct", "charge_start", "esc_start"]
    each = F.transform("charges", lambda c: F.transform(spans(c.key), lambda s: F.struct(*[c[f].alias(f) for f in fields], *[s[f].alias(f) for f in ("since", "until", "step")])))
    own = lists.select("lease_id", F.explode(F.flatten(each)).alias("x")).select("lease_id", "x.*").hint("merge")
    rows = months.select("lease_id", "month_num", "year_num", "month_start", "row_end", "is_last", "factor").alias("m").join(own.alias("x"), (F.col("m.lease_id") == F.col("x.lease_id")) & F.expr(COVERS))
    set_, day = F.col("step").isNotNull(), F.col("month_start")
    active = set_ | F.col("charge_start").isNull() | (day >= F.col("charge_start"))
    years = F.when(~set_ & active, years_since(day, F.col("esc_start")))
    return rows.select(
        "m.lease_id", "month_num", "ord", "key", "canonical_type", active.alias("active"), years.cast("long").alias("esc_years"),
        F.when(set_, 0.0).otherwise(F.col("esc_pct")).alias("esc_pct"), set_.alias("override_applied"), fix2(charged(F.col("step"))).alias("amount"),
    )


def one_time_rows(one_time: DataFrame, months: DataFrame) -> DataFrame:
    """lease_id, month_num, label, amount; undated items fall in the first row."""
    items = one_time.where("amount is not null and amount <> 0").withColumn("label", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("One-time Charge")))
    return assign(items, months, "date").groupBy("lease_id", "month_num", "label").agg(F.sum("amount").alias("amount"))


CHARGE = "array<struct<ord: int, key: string, canonical_type: string, year1: double, esc_pct: double, charge_start: date, esc_start: date>>"
OVERRIDE = "array<struct<target_key: string, since: date, until: date, step: double>>"

def override_lists(overrides: DataFrame) -> DataFrame:
    """lease_id, overrides: each override with the date of the next on its target, until which it holds."""
    known = overrides.where("effective_date is not null")
    known = known.select("lease_id", F.struct(F.coalesce("target_key", F.lit(BASE)).alias("target_key"), F.col("effective_date").alias("since"), "ord", F.coalesce("amount", F.lit(0.0)).alias("step")).alias("o"))
    lists = known.groupBy("lease_id").agg(F.array_sort(F.collect_list("o")).alias("listed"))
    after = lambda o, i: F.when(F.get("listed", i + 1).target_key == o.target_key, F.get("listed", i + 1).since)
    held = F.transform("listed", lambda o, i: F.struct(o.target_key.alias("target_key"), o.since.alias("since"), after(o, i).alias("until"), o.step.alias("step")))
    return lists.select("lease_id", held.cast(OVERRIDE).alias("overrides"))


def spans(key: Column) -> Column:
    """since, until, step of what the column overrides holds of a key, and of the time before, which has no step."""
    own = F.filter("overrides", lambda o: o.target_key == key)
    none = F.struct(F.lit(None).cast("date").alias("since"), F.array_min(F.transform(own, lambda o: o.since)).alias("until"), F.lit(None).cast("double").alias("step"))
    whole = F.struct(F.lit(None).cast("date").alias("since"), F.lit(None).cast("date").alias("until"), F.lit(None).cast("double").alias("step"))
    each = F.transform(own, lambda o: F.struct(o.since.alias("since"), o.until.alias("until"), o.step.alias("step")))
    return F.when(F.col("overrides").isNull(), F.array(whole)).otherwise(F.concat(F.array(none), each))


#: Whether a row has reached a date; past the last row all dates fall in it.
REACHED = "({0} <= row_end or is_last)"
#: Whether a span covers a row: of the spans of a key one does.
COVERS = f"(since is null or {REACHED.format('since')}) and (until is null or not {REACHED.format('until')})"

def merged_charges(leases: DataFrame, charges: DataFrame) -> DataFrame:
    """One row per lease: lease_id, nnn_mode and charges, in order. Leases in aggregate mode have no
    individual net charges, but one of their own."""
    esc_start = F.col("esc_start") if "esc_start" in charges.columns else F.lit(None).cast("date").alias("esc_start")
    own = charges.groupBy("lease_id").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "canonical_type", "year1", "esc_pct", "charge_start", esc_start))).cast(CHARGE).alias("charges"))
    rows = leases.join(own, "lease_id", "left").withColumn("nnn_mode", F.coalesce("nnn_mode", F.lit("individual")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    none = F.lit(None).cast("date")
    whole = F.struct(F.lit(-1).alias("ord"), F.lit(AGGREGATE).alias("key"), F.lit("nnn").alias("canonical_type"), zero("nnn_agg_year1").alias("year1"), zero("nnn_agg_esc_pct").alias("esc_pct"), none.alias("charge_start"), none.alias("esc_start"))
    listed = F.coalesce(F.col("charges"), F.array().cast(CHARGE))
    aggregate = F.col("nnn_mode") == "aggregate"
    return rows.withColumn("charges", F.when(aggregate, F.concat(F.array(whole).cast(CHARGE), F.filter(listed, lambda c: c.canonical_type != "nnn"))).otherwise(listed))


def header(x: Inputs) -> DataFrame:
    """One row per lease: its fields, and its lists of overrides, concessions, charges and one-time
    items, which are short by nature. Each list is grouped by lease, as the months are dealt."""
    own = lambda df, name, *columns: df.groupBy("lease_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    concessions = own(x.concessions, "concessions", "ord", "type", "scope", "value_mode", "value", "effective_date", "start_date", "end_date")
    once = own(x.one_time.where("amount is not null and amount <> 0"), "items", "date", "ord", "amount")
    rows = merged_charges(x.leases.select("lease_id", "square_footage", "nnn_mode", "nnn_agg_year1", "nnn_agg_esc_pct"), x.charges)
    for table in (override_lists(x.overrides), concessions, once):
        rows = rows.join(table, "lease_id", "left")
    return rows


#: What charges, and spans of them, a month reads as columns; those of longer lists are added up in the list.
SLOTS = 8
TERMS = ["year1", "esc_pct", "charge_start", "esc_start"]


def terms(leases: DataFrame) -> DataFrame:
    """A header's lists as rows of months read them: held, the spans of charges; rents, those of the base
    rent; explicit and windows, the concessions in order; items. Where the header has columns, a list of
    (key, at), a span knows at which of a table's columns its charge counts."""
    at = (lambda key: [F.get(F.filter("columns", lambda t: t.key == key), F.lit(0))["at"].alias("at")]) if "columns" in leases.columns else lambda key: []
    net = lambda c: F.coalesce(c.canonical_type == "nnn", F.lit(False)).alias("net")
    held = F.flatten(F.transform("charges", lambda c: F.transform(spans(c.key), lambda s: F.struct(net(c), *[s[f].alias(f) for f in ("since", "until", "step")], *[c[f].alias(f) for f in TERMS], *at(c.key)))))
    some = lambda list_: F.when(F.size(list_) > 0, list_)
    return leases.withColumns({
        "held": held, "rents": some(F.filter("overrides", lambda o: o.target_key == BASE)),
        "explicit": some(F.filter("concessions", lambda c: (c.scope == "monthly_row") & c.effective_date.isNotNull())), "windows": some(F.filter("concessions", lambda c: c.scope == "legacy_window")),
    })


def reached(day: Column) -> Column:
    return (day <= F.col("row_end")) | F.col("is_last")


def covers(s: Column) -> Column:
    """COVERS, of a span in a list."""
    return (s.since.isNull() | reached(s.since)) & (s.until.isNull() | ~reached(s.until))


def holds(day: Column) -> Column:
    """Whether a row holds a date, that of the first row also what is before, that of the last what is after."""
    return ((day >= F.col("month_start")) | (F.col("month_num") == 1)) & reached(day)


def rounded_cents(x: Column) -> Column:
    return whole_cents(fix2(x))


def further_cents(net: bool) -> Column:
    """What the charges past SLOTS come to in a row, in cents, each rounded by itself."""
    rest = F.filter(F.slice("held", F.lit(SLOTS + 1), F.size("held")), lambda s: (s.net == net) & covers(s))
    cents = lambda s: let(charged(s.step, s), rounded_cents)
    return F.when(F.size("held") > SLOTS, F.aggregate(rest, F.lit(0).cast("long"), lambda sum_, s: sum_ + F.coalesce(cents(s), F.lit(0)))).otherwise(F.lit(0).cast("long"))


def further_shown() -> Column:
    """at and cents of each charge past SLOTS that counts in a column of a row."""
    rest = F.filter(F.slice("held", F.lit(SLOTS + 1), F.size("held")), lambda s: s["at"].isNotNull() & covers(s))
    told = F.transform(rest, lambda s: F.struct(s["at"].alias("at"), F.coalesce(let(charged(s.step, s), rounded_cents), F.lit(0)).alias("cents")))
    return F.coalesce(F.when(F.size("held") > SLOTS, told), F.array().cast("array<struct<at: int, cents: bigint>>"))


def in_column(number: int) -> Column:
    """What shown has in a column, null without any."""
    own = F.filter("shown", lambda x: x["at"] == number)
    return let(own, lambda some: F.when(F.size(some) > 0, F.aggregate(some, F.lit(0).cast("long"), lambda sum_, x: sum_ + x.cents) / F.lit(100.0)))


def charged(step: Column, of: Column | None = None) -> Column:
    """What a charge (columns, or the fields of one) comes to in a row, not rounded: its override, else its terms."""
    own = lambda c: F.col(c) if of is None else of[c]
    on = own("charge_start").isNull() | (F.col("month_start") >= own("charge_start"))
    years = F.coalesce(years_since(F.col("month_start"), own("esc_start")), F.col("year_num") - 1)
    grown = F.when(on, growth(own("year1"), own("esc_pct") / 100, years)).otherwise(F.lit(0.0))
    return F.coalesce(step, grown) * F.col("factor")


def ledger(x: Inputs, columns: DataFrame | None = None, titles: Sequence[str] = ()) -> DataFrame:
    """The ledger: one row per lease and month. With columns(lease_id, columns: a list of (key, at)) it has
    further ones by the names of titles, of which the one numbered at sums up the charges of such a key; null
    where the lease has none.

    Each month meets its lease's lists, which are hashed by lease, and adds up what counts in it: months are
    neither sorted nor grouped, and no row is made for a month and an event. A row holds an event whose
    date lies in it, or before the first row, or after the last; the override in effect is the latest,
    by date and place in the list, of those that rows so far hold.
    """
    leases = header(x)
    if columns is not None:
        leases = leases.join(columns, "lease_id", "left")
    first = lambda key: F.array_min(F.transform(F.filter("overrides", lambda o: o.target_key == key), lambda o: o.since))
    keyed = F.filter(F.transform("charges", lambda c: F.struct(c.key.alias("key"), first(c.key).alias("since"))), lambda c: c.since.isNotNull())
    leases = terms(leases).select("lease_id", "square_footage", "nnn_mode", "held", "rents", "explicit", "windows", "items", F.when(F.col("overrides").isNotNull(), keyed).alias("keyed"))
    months = x.months.select("lease_id", "month_num", "year_num", "month_start", "row_end", "is_last", "period_idx", "source_start", "source_end", "monthly_rent", "factor", "actual_days", "cal_month_days")
    rows = months.join(leases.hint("shuffle_hash"), "lease_id")
    item = lambda i: F.when(i.date.isNull(), F.col("month_num") == 1).otherwise(holds(i.date))
    set_ = F.transform(F.filter("keyed", lambda c: reached(c.since)), lambda c: c.key)
    keys = F.when(F.col("keyed").isNull(), "").otherwise(F.array_join(set_, "|"))
    rows = rows.select(
        *months.columns, "square_footage", "nnn_mode", "keyed", "held", F.get(F.filter("rents", covers), F.lit(0)).step.alias("base_override"),
        F.get(F.filter("explicit", lambda c: holds(c.effective_date)), F.lit(0)).alias("e"), F.get(F.filter("windows", lambda c: (c.start_date <= F.col("row_end")) & (c.end_date >= F.col("month_start"))), F.lit(0)).alias("w"),
        *[f(F.get("held", F.lit(i))).alias(f"{name}{i}") for i in range(SLOTS) for name, f in (("net", lambda s: s.net), ("charge", lambda s: F.when(covers(s), charged(s.step, s))))],
        *([] if columns is None else [further_shown().alias("further_shown"), *[F.when(covers(s), s["at"]).alias(f"at{i}") for i in range(SLOTS) for s in [F.get("held", F.lit(i))]]]),
        F.coalesce(F.aggregate(F.filter("items", item), F.lit(0.0), lambda sum_, i: sum_ + i.amount), F.lit(0.0)).alias("once"),
    )
    rows = rows.withColumn("scheduled", F.coalesce("base_override", "monthly_rent")).withColumn("adjusted", F.col("scheduled") * F.col("factor"))
    rows = with_concessions(rows)
    # All that is rounded, in the projection of a higher-order function: what Spark fuses into one method would
    # be too long for the JVM to compile, and rows would take a hundred times as long. It is one that the
    # amounts themselves need, as what a query leaves unread is not planned.
    rows = rows.select(
        "*", keys.alias("override_keys"), further_cents(True).alias("further_net"), further_cents(False).alias("further_other"),
        *[F.coalesce(rounded_cents(F.col(f"charge{i}")), F.lit(0)).alias(f"cents{i}") for i in range(SLOTS)],
        fix6(F.when(F.col("scheduled") == 0, 0.0).otherwise(F.col("applied") / F.col("scheduled"))).alias("base_rent_proration_factor"), fix6("factor").alias("period_factor"),
        fix2("scheduled").alias("scheduled_base_rent"), fix2("adjusted").alias("period_adjusted_base_rent"), fix2("applied").alias("base_rent_applied"),
        fix2("abated").alias("abatement_amount"), fix2("once").alias("one_time_charges_amount"),
    )
    # Added up in a projection of their own: each sum is one expression, which is not split into methods.
    part = lambda net: reduce(add, [F.when(F.col(f"net{i}") == net, F.col(f"cents{i}")).otherwise(F.lit(0)) for i in range(SLOTS)])
    rows = rows.withColumns({"net_cents": F.col("further_net") + part(True), "other_cents": F.col("further_other") + part(False)})
    if columns is not None:
        slots = F.array(*[F.struct(F.col(f"at{i}").alias("at"), F.col(f"cents{i}").alias("cents")) for i in range(SLOTS)])
        rows = rows.withColumn("shown", F.concat(F.filter(slots, lambda x: x["at"].isNotNull()), "further_shown"))
    other = F.col("other_cents") + whole_cents("one_time_charges_amount")
    rows = rows.withColumns({"total_nnn_amount": F.col("net_cents") / F.lit(100.0), "total_other_charges_amount": other / F.lit(100.0), "total_monthly_obligation": (other + F.col("net_cents") + whole_cents("base_rent_applied")) / F.lit(100.0)})
    return rows.select(
        "lease_id", "month_num", "year_num", F.col("month_start").alias("period_start"), F.col("row_end").alias("period_end"), "period_idx", "source_start", "source_end",
        "scheduled_base_rent", "period_adjusted_base_rent", "base_rent_applied", "abatement_amount",
        "base_rent_proration_factor", "period_factor",
        "proration_basis", "abatement_days", "full_rent_days", "total_days", "actual_days", "cal_month_days", "is_concession_row",
        F.col("base_override").isNotNull().alias("base_rent_override_applied"), "nnn_mode",
        "total_nnn_amount", "one_time_charges_amount", "total_other_charges_amount", "total_monthly_obligation",
        F.when(F.col("square_footage") > 0, fix6(F.col("total_monthly_obligation") / F.col("square_footage"))).alias("effective_per_sf"), "square_footage",
        "concession_type", "concession_scope", "concession_value_mode", "concession_value", "override_keys", *[in_column(i).alias(title) for i, title in enumerate(titles)],
    )


REMAINING = {
    "total_obligation_remaining": "total_monthly_obligation",
    "total_nnn_remaining": "total_nnn_amount",
    "total_base_rent_remaining": "base_rent_applied",
    "total_other_charges_remaining": "total_other_charges_amount",
}


def with_remaining(rows: DataFrame) -> DataFrame:
    """Adds what is due from each row to the end. The order falls, so that each sum grows by one row."""
    order = Window.partitionBy("lease_id").orderBy(F.desc("month_num")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cents = lambda c: F.sum(whole_cents(c)).over(order) / F.lit(100.0)
    return rows.select("*", *[cents(c).alias(out) for out, c in REMAINING.items()])


def with_irregular(rows: DataFrame) -> DataFrame:
    """Adds the rent expected from the first year and the rate of its first regular row of year two,
    and what departs from it."""
    lease = Window.partitionBy("lease_id")
    first = F.min_by("scheduled_base_rent", "month_num").over(lease)
    regular = (F.col("year_num") == 2) & ~F.col("base_rent_override_applied")
    second = F.min_by("scheduled_base_rent", F.when(regular, F.col("month_num"))).over(lease)
    rows = rows.withColumn("year1_rent", first).withColumn("year2_rent", second)
    rate = F.when((F.col("year1_rent") > 0) & F.col("year2_rent").isNotNull(), F.col("year2_rent") / F.col("year1_rent") - 1).otherwise(F.lit(0.0))
    rows = rows.withColumn("inferred_annual_base_rent", fix2(growth(F.col("year1_rent"), rate, F.col("year_num") - 1)))
    expected = F.col("inferred_annual_base_rent")
    off = F.abs(F.col("scheduled_base_rent") - expected) > F.greatest(F.lit(0.01), F.abs(expected) * 0.0015)
    irregular = F.col("base_rent_override_applied") | off
    targets = F.concat_ws("|", F.when(irregular, BASE), F.nullif(F.col("override_keys"), F.lit("")))
    return rows.select(
        "*", irregular.alias("is_irregular_base_rent"), F.when(irregular, "irregular").otherwise("annual").alias("base_rent_escalation_type"),
        targets.alias("irregular_escalation_targets"), (targets != "").alias("has_irregular_escalation"),
    ).drop("year1_rent", "year2_rent")
