"""Schedule wording: windows of lines, start rules, rent terms and what they come to as dated periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrid.functions.dates import civil, first_full_month_after, first_of_month_on_or_after, let, month_index
from leasegrid.functions.money import fix2

from .labels import once

# The events that a rule can name, and how they are written.
EVENTS = {
    "rent_commencement_date": ["rent commencement date"],
    "commencement_date": ["lease commencement date", "term commencement date", "commencement date"],
    "effective_date": ["effective date"],
    "execution_date": ["execution date"],
    "delivery_date": ["delivery date"],
    "possession_date": ["possession date"],
    "opening_date": ["opening date"],
    "permit_issuance_date": ["permit issuance date", "permit issue date"],
    "substantial_completion_date": ["substantial completion date"],
}
MONTHS = "january february march april may june july august september october november december".split()
NAMED = r"(?:" + "|".join(MONTHS) + r")\s+\d{1,2},\s*\d{4}"
DATE = rf"(?:{NAMED}|\d{{1,2}}/\d{{1,2}}/\d{{4}})"
MONEY = r"\$\s*([\d,]+(?:\.\d{1,2})?)"
#: Units of terms, and how far after its range a rent may stand.
MONTH_TERMS, YEAR_TERMS, REACH = "month", "year", 80
CONFIDENCE = {"dated_periods": 0.95, "narrative_escalation": 0.89, "relative_month_ranges": 0.87, "lease_year_ranges": 0.83}


def normalized(text: Column) -> Column:
    """Lower case, dashes alike, blanks single, ranges between digits written with a hyphen."""
    dashes = F.regexp_replace(F.coalesce(text, F.lit("")), "[‐-―−﹘﹣－�]", "-")
    spaced = F.regexp_replace(F.regexp_replace(dashes, " ", " "), r"[^\S\r\n]+", " ")
    return F.lower(F.trim(F.regexp_replace(spaced, r"(\d) ?- ?(\d)", "$1-$2")))


def lines_in(text: Column) -> Column:
    """A text's lines that are not blank, as an array."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n+"), lambda s: F.trim(s)), lambda s: s != "")


def windows_in(lines: Column, deep: int = 2) -> Column:
    """ord, span, original, normalized of each of an array of lines, and of it with the deep - 1 next."""
    def window(at: Column, span: Column) -> Column:
        place = (at * deep + span - 1).cast("long").alias("ord")
        return let(F.concat_ws(" ", F.slice(lines, at + 1, span)), lambda s: F.struct(place, span.cast("long").alias("span"), s.alias("original"), normalized(s).alias("normalized")))

    spans = lambda at: F.sequence(F.lit(1), F.least(F.lit(deep), F.size(lines) - at))
    return F.flatten(F.transform(lines, lambda _, at: F.transform(spans(at), lambda span: window(at, span))))


def windows(docs: DataFrame, key: str, text: str, deep: int = 2) -> DataFrame:
    """key, ord, span, original, normalized: each line that is not blank, and it with the deep - 1 next."""
    rows = once(docs, "lines", lines_in(F.col(text))).select(key, "lines")
    return rows.select(key, F.inline(windows_in(F.col("lines"), deep)))


def money(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\d.]", "").try_cast("double")


def terms_in(low: Column, unit: str = MONTH_TERMS) -> Column:
    """start_value, end_value, monthly_rent of the ranges that a window, normalized, states: an array.

    A window is cut before every mention of the unit with a number; each piece then opens with one range,
    and its rent is the first sum of money in reach of it.
    """
    range_ = rf"^{unit}s? (\d{{1,3}})(?: ?(?:-|to|through) ?(\d{{1,3}}))?(?!\d)"
    pieces = F.filter(F.split(low, rf"(?=\b{unit}s? \d)"), lambda s: s.rlike(range_))

    def term(piece: Column) -> Column:
        part = lambda k: F.regexp_extract(piece, range_, k)
        near = F.substring(piece, F.length(part(0)) + 1, F.lit(REACH + 20))
        sum_ = F.regexp_extract(near, rf"^([^$]{{0,{REACH}}}){MONEY}", 2)
        return F.struct(part(1).cast("long").alias("start_value"), F.coalesce(F.nullif(part(2), F.lit("")), part(1)).cast("long").alias("end_value"), money(sum_).alias("monthly_rent"))

    # Few windows mention the unit with a number; a split compiles its pattern for each.
    found = F.when(low.rlike(rf"\b{unit}s? \d"), F.filter(F.transform(pieces, term), lambda t: (t.end_value >= t.start_value) & t.monthly_rent.isNotNull()))
    return F.coalesce(found, F.array().cast("array<struct<start_value: bigint, end_value: bigint, monthly_rent: double>>"))


def terms(wins: DataFrame, key: str, unit: str = MONTH_TERMS) -> DataFrame:
    """key, start_value, end_value, monthly_rent: the ranges that the windows state, each once."""
    return wins.select(key, F.inline(terms_in(F.col("normalized"), unit))).distinct()


def materialized(rows: DataFrame, anchor: str, years: bool = False) -> DataFrame:
    """Terms against an anchor date as dated periods; lease years are twelve months each."""
    first = (F.col("start_value") - 1) * 12 + 1 if years else F.col("start_value")
    last = F.col("end_value") * 12 if years else F.col("end_value")
    return rows.where(F.col(anchor).isNotNull()).select(
        "*", F.add_months(anchor, (first - 1).cast("int")).alias("period_start"), F.date_sub(F.add_months(anchor, last.cast("int")), 1).alias("period_end")
    )


def parsed(text: Column) -> Column:
    """A date as the windows write it."""
    def date(low: Column) -> Column:
        named = lambda k: F.regexp_extract(low, r"^([a-z]+)\s+(\d{1,2}),\s*(\d{4})$", k)
        number = F.array_position(F.array(*map(F.lit, MONTHS)), named(1)).cast("string")
        slashed = lambda k: F.regexp_extract(low, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", k)
        return F.when(named(1) != "", civil(named(3), number, named(2))).when(slashed(1) != "", civil(slashed(3), slashed(1), slashed(2)))

    return let(F.lower(text), date)


def _names(event: str) -> str:
    return "|".join(EVENTS[event])


#: How far after an event's name its date may start, and the longest date.
DATE_REACH, DATE_LENGTH = 70, 18
#: What every event's name ends in.
LAST_WORD = "date"


def absolute_in(original: Column) -> Column:
    """trigger_event, resolved_date of each event with a date in reach after its name in a window: an array."""
    def first_date(low: Column, event: str) -> Column:
        after = F.slice(F.split(low, rf"\b(?:{_names(event)})\b"), 2, 1 << 20)
        dates = F.transform(after, lambda s: F.regexp_extract(F.substring(s, 1, DATE_REACH + DATE_LENGTH), DATE, 0))
        return F.try_element_at(F.filter(dates, lambda d: d != ""), F.lit(1))

    def found(low: Column) -> Column:
        # Few windows have an event's name, and fewer a date.
        named = lambda e: reduce(lambda a, b: a | b, [F.contains(low, F.lit(n)) for n in EVENTS[e]])
        each = F.array_compact(F.array(*[F.when(named(e), F.struct(F.lit(e).alias("trigger_event"), first_date(low, e).alias("day"))) for e in EVENTS]))
        dated = F.transform(F.filter(each, lambda x: x.day.isNotNull()), lambda x: F.struct(x.trigger_event.alias("trigger_event"), parsed(x.day).alias("resolved_date")))
        return F.when(F.contains(low, F.lit(LAST_WORD)) & low.rlike(DATE), F.filter(dated, lambda x: x.resolved_date.isNotNull()))

    return F.coalesce(let(F.lower(original), found), F.array().cast("array<struct<trigger_event: string, resolved_date: date>>"))


def absolute_rules(wins: DataFrame, key: str, *carry: str) -> DataFrame:
    """key, trigger_event, resolved_date of each event with a date in reach after its name, each once for
    what the windows' columns carry hold."""
    return wins.select(key, *carry, F.inline(absolute_in(F.col("original")))).distinct()


# Rule kinds, the words that lead to an event's name, and their confidence. A number
# stands before the words of an offset.
CUES = [
    ("first_full_calendar_month_after_event", ["first full calendar month after"], 0.9),
    ("first_of_month_on_or_after_event", [f"first day of {m} {w}" for m in ("the month", "month", "the calendar month", "calendar month") for w in ("after", "following")], 0.85),
    ("event_plus_days", ["day after", "days after"], 0.84),
    ("event_plus_months", ["month after", "months after"], 0.84),
    ("event_date", ["from and after", "upon", "commences on", "shall commence on", "begins on", "starting on"], 0.8),
]
#: How far after such words the event's name may start.
NAME_REACH = 45


def cued(low: Column, kind: str, cues: list[str]) -> Column:
    """What precedes and what follows each place where one of the cues stands as whole words."""

    def places(pieces: Column) -> Column:
        two = F.transform(F.sequence(F.lit(2), F.size(pieces)), lambda i: F.struct(F.element_at(pieces, i - 1).alias("before"), F.element_at(pieces, i).alias("after")))
        return F.when(F.size(pieces) > 1, two)

    every = F.flatten(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(cue)), places(F.split(low, rf"\b{cue}\b"))) for cue in cues])))
    return F.filter(every, lambda x: x.before.rlike(r"\d{1,3} $")) if kind.startswith("event_plus") else every


def event_table() -> Column:
    """Every event with its names, as an array."""
    return F.array(*[F.struct(F.lit(e).alias("event"), F.array(*map(F.lit, names)).alias("names")) for e, names in EVENTS.items()])


def named_in(after: Column, names: Column) -> Column:
    """Whether one of the names starts in reach."""
    return F.exists(names, lambda n: F.instr(F.substring(after, F.lit(1), F.length(n) + (NAME_REACH - 1)), n) > 0)


RULE = "struct<rule_kind: string, trigger_event: string, second_event: string, offset_value: int, confidence: double>"


def phrases_in(low: Column) -> Column:
    """rule_kind, trigger_event, second_event, offset_value, confidence of the rules in the words of a window,
    normalized: an array.

    A cue and, in reach after it, an event's name make a rule; where a window speaks of the later or the
    earlier of events, the first two that it names do.
    """
    anyof = lambda phrases: low.rlike("|".join(phrases))

    def rule(kind: Column | str, trigger: Column, second: Column | None, offset: Column | None, confidence: float) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("rule_kind"), trigger.alias("trigger_event"), (F.lit(None) if second is None else second).cast("string").alias("second_event"), (F.lit(None) if offset is None else offset).cast("int").alias("offset_value"), F.lit(confidence).alias("confidence"))

    def alone(kind: str, confidence: float, places: Column) -> Column:
        def of(e: Column, named: Column) -> Column:
            offset = F.regexp_extract(F.get(named, F.lit(0)).before, r"(\d{1,3}) $", 1).try_cast("int") if kind.startswith("event_plus") else None
            return F.when(F.size(named) > 0, rule(kind, e.event, None, offset, confidence))

        return F.when(F.size(places) > 0, F.transform(event_table(), lambda e: let(F.filter(places, lambda x: named_in(x.after, e.names)), lambda named: of(e, named))))

    later, earlier = (F.instr(F.concat(F.lit(" "), low), f" {w} of ") > 0 for w in ("later", "earlier"))
    first_at = lambda e: F.array_min(F.filter(F.transform(e.names, lambda n: F.instr(low, n)), lambda at: at > 0))
    firsts = F.array_sort(F.filter(F.transform(event_table(), lambda e: F.struct(first_at(e).alias("at"), e.event.alias("event"))), lambda x: x["at"].isNotNull()))
    pair = let(firsts, lambda f: F.when(F.size(f) >= 2, F.array(rule(F.when(later, "later_of").otherwise("earlier_of"), F.get(f, F.lit(0)).event, F.get(f, F.lit(1)).event, None, 0.82))))
    def of_kind(kind: str, cues: list[str], confidence: float) -> Column:
        return let(cued(low, kind, cues), lambda places: alone(kind, confidence, places))

    every = [of_kind(*cue) for cue in CUES]
    # Few windows name an event and have a cue.
    may = anyof([n for names in EVENTS.values() for n in names]) & anyof(["later of", "earlier of", *(c for _, cues, _ in CUES for c in cues)])
    rules = F.array_compact(F.flatten(F.array_compact(F.array(*[x.cast(f"array<{RULE}>") for x in (*every, F.when(later | earlier, pair))]))))
    return F.coalesce(F.when(may, rules), F.array().cast(f"array<{RULE}>"))


def phrase_rules(wins: DataFrame, key: str, *carry: str) -> DataFrame:
    """key, rule_kind, trigger_event, second_event, offset_value, confidence of rules in words, each once
    for what the windows' columns carry hold."""
    return wins.select(key, *carry, F.inline(phrases_in(F.col("normalized")))).distinct()


def resolved(kind: Column, first: Column, second: Column, offset: Column) -> Column:
    """The date of a rule, given its events' dates; an unknown event leaves the other, or null."""
    return (
        F.when(kind == "event_date", first)
        .when(kind == "event_plus_days", F.date_add(first, offset))
        .when(kind == "event_plus_months", F.add_months(first, offset))
        .when(kind == "first_of_month_on_or_after_event", first_of_month_on_or_after(first))
        .when(kind == "first_full_calendar_month_after_event", first_full_month_after(first))
        .when(kind == "later_of", F.greatest(first, second))
        .when(kind == "earlier_of", F.least(first, second))
    )


def score(confidence: Column, representation: Column, n_terms: Column, n_rows: Column, n_open: Column) -> Column:
    """What a reading of a schedule is worth: its confidence, better with rows, worse with open dependencies."""
    empty = (representation == "dated_periods") & (n_rows == 0) & (n_terms > 0)
    return confidence + F.when(n_rows > 0, 0.05).otherwise(0.0) - F.least(F.lit(0.12), n_open * 0.04) - F.when(empty, 0.3).otherwise(0.0)


def ranked(candidates: DataFrame, key: str) -> DataFrame:
    """The best candidate of each document, by score."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "ord")
    own = score(*[F.col(c) for c in ("confidence", "representation", "n_terms", "n_rows", "n_open")])
    return candidates.withColumn("score", F.round(own, 6)).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def term_months(start: Column, end: Column, most: int = 600) -> Column:
    """The least number of anchored months from start that reaches end."""
    n = month_index(end) - month_index(start)
    return F.when(end <= start, 0).otherwise(F.least(n + F.when(F.add_months(start, n) < end, 1).otherwise(0), F.lit(most)))


def _paces(cadence: Column) -> Column:
    return F.greatest(F.coalesce(cadence, F.lit(12)), F.lit(1))


def _step(month: Column, start_rent: Column, esc_pct: Column, cadence: Column, total: Column) -> Column:
    n = F.floor((month - 1) / cadence)
    return F.struct(
        month.cast("long").alias("start_month"), F.least(total, month + cadence - 1).cast("long").alias("end_month"),
        fix2(start_rent * F.pow(1 + esc_pct / 100, n.cast("double"))).alias("monthly_rent"),
    )


def steps_in(start_rent: Column, esc_pct: Column, cadence: Column, total: Column) -> Column:
    """start_month, end_month, monthly_rent of a narrative escalation: an array, null without months."""
    return F.when(total > 0, F.transform(F.sequence(F.lit(1), total.cast("int"), _paces(cadence).cast("int")), lambda month: _step(month, start_rent, esc_pct, _paces(cadence), total)))


def escalation_steps(rows: DataFrame) -> DataFrame:
    """Terms of a narrative escalation: rent of months cadence long, grown by esc_pct each step."""
    total = F.col("total_months")
    out = rows.where("total_months > 0").withColumn("cadence", _paces(F.col("cadence"))).withColumn("month", F.explode(F.sequence(F.lit(1), total.cast("int"), F.col("cadence").cast("int"))))
    return out.select("lease_id", _step(F.col("month"), F.col("start_rent"), F.col("esc_pct"), F.col("cadence"), total).alias("x")).select("lease_id", "x.*")


# What a rent is called, units of area, what the area may be called, and units of time.
RENTS = ["base rent", "minimum rent", "annual base rent", "monthly base rent"]
AREAS = ["square foot", "square feet", "sq ft", "sq. ft", "sq. ft.", "sq.ft.", "sqft", "sf", "rsf", "usf"]
AREA_KINDS = ["", "rentable ", "usable ", "gross ", "leasable "]
TIMES = ["per year", "per yr", "per annum", "per month", "per mo", "annual", "annually", "monthly"]


def says(words: Column, phrases: list[str]) -> Column:
    """Whether one of the phrases stands in the words, which are set apart by single blanks."""
    # A function over the phrases would compute the words anew for each of them.
    return let(words, lambda w: F.exists(F.array(*[F.lit(f" {p} ") for p in phrases]), lambda p: F.contains(w, p)))


#: Letters of which every name of a rent, and every unit of area, holds some.
RENT_LETTERS, AREA_LETTERS = ["rent"], ["sq", "sf"]


def states_area_rent(low: Column) -> Column:
    """Whether a window, normalized, states a base rent by area."""
    def stated(words: Column) -> Column:
        priced = F.regexp_replace(F.regexp_replace(words, r"(?<=\d) (?=\d)", ""), r"\$ ?\d[\d.]*", "\\$n")
        return says(words, RENTS) & says(words, AREAS) & (says(words, TIMES) | says(priced, [f"$n per {k}{a}" for k in AREA_KINDS for a in AREAS]))

    plain_ = F.replace(low, F.lit("/"), F.lit(" per "))
    return let(F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(plain_, r"[^a-z0-9$.]+", " "), r"\.(?= |$)", ""), F.lit(" ")), stated)


def area_based(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, sf_required: whether up to three lines of a key's text together state a base rent by area: a rent by name, a
    unit of area, and a price for one or a unit of time. Read where the text is, without a row for a window;
    only windows with the letters of a rent and of a unit are taken apart."""
    anyof = lambda s, parts: reduce(lambda a, b: a | b, [F.contains(s, F.lit(p)) for p in parts])
    may = lambda s: let(F.lower(s), lambda low: anyof(low, RENT_LETTERS) & anyof(low, AREA_LETTERS))
    lines = F.col("lines")
    window = lambda at, span: F.concat_ws(" ", F.slice(lines, at + 1, span))
    spans = lambda at: F.sequence(F.lit(1), F.least(F.lit(3), F.size(lines) - at))
    hit = F.exists(F.transform(lines, lambda _, at: at), lambda at: F.when(may(window(at, F.lit(3))), F.exists(spans(at), lambda span: let(window(at, span), lambda s: F.when(may(s), states_area_rent(normalized(s))).otherwise(False)))).otherwise(False))
    rows = once(docs.select(key, F.col(text).alias("text")), "lines", F.when(may(F.coalesce("text", F.lit(""))), lines_in(F.col("text"))))
    return rows.select(key, F.coalesce(hit, F.lit(False)).alias("sf_required"))


def rent_value(text: Column) -> Column:
    """A rent as typed or read: S for $, commas, asterisks, and all dots but the last as thousands."""
    s = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^[Ss](?=[\d,])", "\\$")
    clean = F.regexp_replace(F.regexp_replace(s, r"[$,*\s]", ""), r"\.(?=.*\.)", "")
    return F.regexp_extract(clean, r"^[-+]?(?:\d+\.?\d*|\.\d+)", 0).try_cast("double")


def plain(markup: Column) -> Column:
    """Text of markup: tags to blanks, entities to characters, blank lines no more than one."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        body = F.replace(body, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\r\n?", "\n"), "[ \t]+", " "), r"\n{3,}", "\n\n"))
