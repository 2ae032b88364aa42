"""Schedules and charges in running text: dated rows, steps of a charge, the term, and what anchors a schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrid.functions.dates import let, parse_token
from leasegrid.functions.label_tables import PHRASES

from .labels import once
from .paste import DAY, WORDS, cleaned, lines, lines_in, only_fillers
from .text import AREA_KINDS, DATE, NAMED, money, parsed, says

# Words that make an amount a rate, and the least rent of a dated row.
RATE_WORDS = [
    "annual", "annually", "per year", "yearly", "per sf", "rsf", "usf", "psf", "percent", "escalate", "escalated", "escalation", "escalates", "increase", "increases", "increased",
    *[f"per {kind}square {unit}" for kind in AREA_KINDS for unit in ("foot", "feet", "ft")],
]
LEAST_RENT = 100
#: Lines that a charge's heading reaches down to.
REACH = 7
NUMBER = r"(\d[\d,]*(?:\.\d\d?)?)"
SUM = rf"\$ ?{NUMBER}"
#: A day in figures or with the month's name.
ANY_DAY = rf"(?:{NAMED}|{DAY})"


def spoken(line: Column) -> Column:
    """A line in lower-case words set apart by single blanks; a slash between words reads per."""
    low = F.regexp_replace(F.lower(line), r"/(?=[a-z])", " per ")
    return F.concat(F.lit(" "), F.regexp_replace(low, r"[^a-z0-9%$]+", " "), F.lit(" "))


def is_rate(line: Column) -> Column:
    return says(spoken(line), RATE_WORDS) | F.contains(line, F.lit("%"))


def dated_in(lines: Column) -> Column:
    """period_start, period_end, monthly_rent of an array of cleaned lines, each once: as dated_rows, an array."""
    part = lambda line, k: F.regexp_extract(line, rf"({DAY})-({DAY})(?!\d)(.*)$", k)
    amount = lambda tail, k: F.regexp_extract(tail, r"^([^\d]*)(\d[\d,]*(?:\.\d\d?)?)", k)
    ranged = F.filter(F.transform(lines, lambda line, at: F.when(line.rlike(rf"{DAY}-{DAY}"), F.struct(line.alias("line"), F.coalesce(F.get(lines, at + 1), F.lit("")).alias("after")))), lambda x: x.isNotNull())
    read = F.transform(ranged, lambda x: F.struct(parse_token(part(x.line, 1)).alias("period_start"), parse_token(part(x.line, 2)).alias("period_end"), F.concat(part(x.line, 3), F.lit(" "), x.after).alias("tail")))
    fine = F.filter(read, lambda x: x.period_start.isNotNull() & x.period_end.isNotNull() & only_fillers(F.lower(amount(x.tail, 1))) & ~is_rate(x.tail))
    rents = F.transform(fine, lambda x: F.struct(x.period_start.alias("period_start"), x.period_end.alias("period_end"), money(amount(x.tail, 2)).alias("monthly_rent")))
    return F.array_distinct(F.filter(rents, lambda x: x.monthly_rent >= LEAST_RENT))


#: Two days in figures leave this in a text, however they are set.
_GAP = r"[\s\u00a0]*"
FIGURES = rf"\d{_GAP}[./]{_GAP}\d{{1,2}}{_GAP}[./]{_GAP}\d\d"


def dated_of(text: Column) -> Column:
    """dated_in of a text's lines; a text without days in figures is not taken apart."""
    return F.coalesce(F.when(text.rlike(FIGURES), let(lines_in(text), dated_in)), F.array().cast("array<struct<period_start: date, period_end: date, monthly_rent: double>>"))


def dated_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, period_start, period_end, monthly_rent of lines that give a range of dates and, on them or on
    the next line, a monthly rent of at least LEAST_RENT; each once for a key's text. Where the words make it a rate of
    another kind, the line is none."""
    return docs.select(key, F.inline(dated_of(F.col(text))))


def repaired_row(start: Column, end: Column) -> tuple[Column, Column]:
    """The dates of a schedule row as read; a whole range in its first cell gives both."""
    part = lambda own, k: F.regexp_extract(own, rf"^({DAY})-({DAY})$", k)
    date = lambda k, other: let(cleaned(F.trim(start)), lambda own: let(part(own, k), lambda day: F.when(day != "", parse_token(day)).otherwise(other(own))))
    return date(1, parse_token), date(2, lambda _: parse_token(cleaned(F.trim(end))))


def search_terms(bucket: str) -> list[str]:
    """What a charge of a bucket may be called, longer than a few letters."""
    return [phrase for phrase, own, _ in PHRASES if own == bucket and len(phrase) > 2]


def day_of(text: Column) -> Column:
    """A day as ANY_DAY finds it."""
    return let(text, lambda t: F.coalesce(parse_token(t), parsed(t)))


def step_of(line: Column) -> tuple[Column, Column]:
    """The day from which a line sets a sum, and the sum. A line does that in one of three ways: it opens
    with a day or a range of days and goes on with the sum; it tells a sum that holds from a day on; or a
    sum that begins on a day. Other days in a line, such as that of billing, set none."""
    ways = [
        (rf"(?i)^({ANY_DAY})(?:\s*(?:-|through|to)\s*{ANY_DAY})?\s*[:,-]?\s*{SUM}", 1, 2),
        (rf"(?i){SUM}.*?\bfrom\s+({ANY_DAY})", 2, 1),
        (rf"(?i)\bbeginning\s+({ANY_DAY}),?.*?{SUM}", 1, 2),
    ]
    each = [(day_of(F.regexp_extract(line, way, at)), money(F.regexp_extract(line, way, of))) for way, at, of in ways]
    return F.coalesce(*[day for day, _ in each]), F.coalesce(*[F.when(day.isNotNull(), sum_) for day, sum_ in each])


def charge_steps(docs: DataFrame, key: str, text: str, buckets: list[str]) -> DataFrame:
    """key, bucket, step_date, amount: the steps of each bucket's charge where its amount changes.

    A step is a line that sets a sum from a day on (step_of). It is the charge's if the line names it, or if it stands under
    a heading that does, at most REACH lines down, with no line between that stops the block: one that
    ends in a colon, or that neither starts with a date nor names the charge.
    """
    rows = once(lines(docs, key, text), "words", spoken(F.col("line")))
    day, amount = step_of(F.col("line"))
    rows = once(rows, "s", F.struct(day.alias("day"), amount.alias("amount"))).select(key, "at", "line", "words", "s.*")
    named = F.array(*[F.struct(F.lit(b).alias("bucket"), says(F.col("words"), search_terms(b)).alias("names")) for b in buckets])
    rows = rows.withColumn("x", F.explode(named)).select(key, "at", "line", "day", "amount", "x.*")
    step = F.col("day").isNotNull() & F.col("amount").isNotNull()
    colon, dated = F.col("line").rlike(r":\s*$"), F.col("line").rlike(rf"(?i)^{ANY_DAY}")
    heading = F.col("names") & (colon | (~F.contains("line", F.lit("$")) & ~step))
    stop = ~step & (colon | (~dated & ~F.col("names")))
    before = Window.partitionBy(key, "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("headed", F.max(F.when(heading, F.col("at"))).over(before)).withColumn("stopped", F.max(F.when(stop, F.col("at"))).over(before))
    under = (F.col("headed") >= F.col("at") - REACH) & (F.coalesce("stopped", F.lit(-1)) <= F.col("headed"))
    found = rows.where(step & (F.col("names") | F.coalesce(under, F.lit(False)))).groupBy(key, "bucket", F.col("day").alias("step_date"), "amount").agg(F.min("at").alias("at"))
    order = Window.partitionBy(key, "bucket").orderBy("step_date", "at")
    found = found.withColumn("last", F.lag("amount").over(order))
    return found.where("last is null or last <> amount").select(key, "bucket", "step_date", "amount")


# What a sentence is about, by the words in it, in order of precedence.
SCOPES = [
    ("base_rent_start", ["base rent", "minimum rent", "monthly rent", "annual rent", "fixed rent", "rent shall", "rent schedule"]),
    ("term_start", ["lease term", "term shall", "initial term", "commencement of the term"]),
    ("charge_start", ["cam", "common area", "operating expense", "operating expenses", "insurance", "tax", "additional rent", "charge"]),
]
# Confidences of an anchor that is read off the terms' own words, and of the default.
INLINE = [("rent commencement date", "rent_commencement_date", 0.7)]
#: Both events that a text may name inline, with their confidences in the modelled application.
INLINE_EVENTS = [("rent commencement date", "rent_commencement_date", 0.72), ("commencement date", "commencement_date", 0.7)]
DEFAULT = ("rent_commencement_date", 0.58)


def scope(words: Column) -> Column:
    out = F.lit("rent_schedule_anchor")
    for name, phrases in reversed(SCOPES):
        out = F.when(says(words, phrases), name).otherwise(out)
    return out


def anchor_choice(docs: DataFrame, rules: DataFrame, key: str, text: str, events: list[tuple[str, str, float]] = INLINE) -> DataFrame:
    """key, trigger_event, rule_kind, confidence of what a schedule is counted from: of the rules (key, ord,
    scope, rule_kind, trigger_event, confidence) on base rent or the schedule the best, dated ones last;
    without any the first of the events (phrase, event, confidence) that the text names; else the default."""
    order = Window.partitionBy(key).orderBy((F.col("rule_kind") == "absolute_date").cast("int"), F.desc("confidence"), "ord")
    best = rules.where(F.col("scope").isin("base_rent_start", "rent_schedule_anchor")).withColumn("place", F.row_number().over(order)).where("place = 1")
    best = best.select(key, F.struct("trigger_event", "rule_kind", "confidence").alias("best"))
    as_event = lambda event, confidence: F.struct(F.lit(event).alias("trigger_event"), F.lit("event_date").alias("rule_kind"), F.lit(confidence).alias("confidence"))
    words = spoken(F.coalesce(F.col(text), F.lit("")))
    inline = as_event(*DEFAULT)
    for phrase, event, confidence in reversed(events):
        inline = F.when(says(words, [phrase]), as_event(event, confidence)).otherwise(inline)
    return docs.join(best, key, "left").select(key, F.coalesce("best", inline).alias("x")).select(key, "x.*")


def term_in(text: Column) -> Column:
    """term_start, term_end of a text, null where it does not give both."""
    part = lambda line, k: F.regexp_extract(line, rf"(?i)\bterm\b[^.]{{0,80}}?({DATE})[^.]{{1,40}}?({DATE})", k)
    both = let(F.regexp_replace(text, r"\s+", " "), lambda line: F.struct(parsed(part(line, 1)).alias("term_start"), parsed(part(line, 2)).alias("term_end")))
    return let(both, lambda x: F.when(x.term_start.isNotNull() & x.term_end.isNotNull(), x))


def term_window(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term_start, term_end of texts that give the term's first and last day."""
    return once(docs.select(key, text), "x", term_in(F.col(text))).where("x is not null").select(key, "x.*")


def escalation_in(text: Column) -> Column:
    """start_rent, esc_pct, cadence_months of a text, null where it does not give the first two."""
    clause = r"\b(?:increas|escalat)[a-z]* (?:[a-z]+ ){0,3}?(\d+(?:\.\d+)?) ?%([^.]*)"

    def rule(low: Column) -> Column:
        # Without its sign a sum is told by the month that it is for.
        bare = F.regexp_extract(low, rf"\brent\b[^$.\d]{{0,60}}{NUMBER} ?(?:/ ?|per |a )?month(?:ly)?\b", 1)
        rent = F.coalesce(money(F.regexp_extract(low, rf"\brent\b[^$.]{{0,60}}{SUM}", 1)), money(bare))
        grows = F.regexp_extract(low, clause, 1).try_cast("double")
        return F.struct(rent.alias("start_rent"), grows.alias("esc_pct"), let(F.regexp_extract(low, clause, 2), cadence).alias("cadence_months"))

    def cadence(rest: Column) -> Column:
        often = lambda k: F.regexp_extract(rest, r"(?:every|each|per) (?:([a-z]+|\d+) )?(year|month)s?\b", k)
        spelled = F.nullif(F.array_position(F.array(*map(F.lit, WORDS)), often(1)), F.lit(0)).cast("int")
        n = F.when(often(1) == "", 1).otherwise(F.coalesce(often(1).try_cast("int"), spelled, F.lit(1)))
        return F.when(often(2) == "month", n).when(often(2) == "year", n * 12).otherwise(12).cast("long")

    # A text without the sign states no rate.
    found = F.when(F.contains(text, F.lit("%")), let(F.regexp_replace(F.lower(text), r"\s+", " "), rule))
    return let(found, lambda x: F.when(x.start_rent.isNotNull() & x.esc_pct.isNotNull(), x))


def escalation_rule(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, start_rent, esc_pct, cadence_months of texts whose rent grows by a rate every so often: the sum
    that follows the word rent (with its sign, or for a month), the rate after a word of growth, and how often, yearly if not said."""
    return once(docs.select(key, text), "x", escalation_in(F.col(text))).where("x is not null").select(key, "x.*")
