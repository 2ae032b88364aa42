"""Pasted rent tables and charges told in prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasegrid.functions.dates import parse_token

from .labels import once
from .text import money, rent_value

DAY = r"\d{1,2}/\d{1,2}/\d{2,4}"


def cleaned(line: Column) -> Column:
    """A line with its dashes alike, ranges closed up and dates written with slashes."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(line, F.lit("")), " ", " "), "[‐-―−﹘﹣－]", "-")
    s = F.regexp_replace(s, "(\\d)\\s*�+\\s*(\\d)", "$1-$2")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)(\d)\s+(?:to|through)\s+(\d)", "$1-$2"), r"(\d)\s*-\s*(\d)", "$1-$2")
    s = F.regexp_replace(F.regexp_replace(s, r"(?<=\d)\s+(?=/)", ""), r"(?<=/)\s+(?=\d)", "")
    return F.regexp_replace(s, r"\b(\d{1,2})\.(\d{1,2})\.(\d{2,4})\b", "$1/$2/$3")


def lines_in(text: Column) -> Column:
    """A text's lines that are not blank, cleaned, as an array."""
    own = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(F.regexp_replace(s, "\r", ""))), lambda s: s != "")
    return F.transform(own, cleaned)


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, line of every line that is not blank."""
    return docs.select(key, F.posexplode(lines_in(F.col(text))).alias("at", "line"))


def joined(rows: DataFrame, key: str) -> DataFrame:
    """rows with a date alone on a line put before the line that it begins.

    A line opens a pair if it is a date and the next starts with one; in a stretch of such lines every
    other one does, as the one between is taken by it.
    """
    order = Window.partitionBy(key).orderBy("at")
    opens = F.col("line").rlike(f"^{DAY}$") & F.coalesce(F.lead("line").over(order).rlike(f"^{DAY}"), F.lit(False))
    rows = rows.withColumn("next", F.lead("line").over(order)).withColumn("opens", opens)
    stretch = F.col("at") - F.row_number().over(Window.partitionBy(key, "opens").orderBy("at"))
    rows = rows.withColumn("stretch", F.when(F.col("opens"), stretch))
    place = F.row_number().over(Window.partitionBy(key, "opens", "stretch").orderBy("at"))
    rows = rows.withColumn("pair", F.col("opens") & (place % 2 == 1))
    taken = F.coalesce(F.lag("pair").over(order), F.lit(False))
    return rows.withColumn("taken", taken).where("not taken").select(key, "at", F.when(F.col("pair"), F.concat_ws(" - ", "line", "next")).otherwise(F.col("line")).alias("line"))


def pasted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, period, rent text, start, end, relative_year, monthly_rent, asterisk, warning of each line."""
    rows = joined(lines(docs, key, text), key)
    line = F.col("line")
    two = lambda pattern: F.when(line.rlike(pattern), F.struct(F.trim(F.regexp_extract(line, pattern, 1)).alias("period"), F.trim(F.regexp_extract(line, pattern, 2)).alias("rent")))
    rows = rows.withColumn("x", F.coalesce(two(r"^([^\t]*\S[^\t]*)\t(.*\S.*)$"), two(r"^(.*?\S)\s{2,}(\S.*)$"), two(r"^(.*\S)\s+([S$]?\d[\d,.*]*)$")))
    period, rent = F.col("x.period"), F.col("x.rent")
    part = lambda k: F.regexp_extract(period, rf"^({DAY}|\d{{4}}-\d{{2}}-\d{{2}})\s*-\s*({DAY}|\d{{4}}-\d{{2}}-\d{{2}})$", k)
    ranged = (part(1) != "") & parse_token(part(1)).isNotNull() & parse_token(part(2)).isNotNull()
    year = F.regexp_extract(period, r"^[Yy]ear\s+(\d+)$", 1).try_cast("int")
    out = rows.select(
        key, "at", "line", period.alias("period"), rent.alias("rent"), F.when(ranged, parse_token(part(1))).otherwise(parse_token(period)).alias("period_start"),
        F.when(ranged, parse_token(part(2))).alias("period_end"), year.alias("relative_year"), rent_value(rent).alias("monthly_rent"), F.coalesce(F.contains(rent, F.lit("*")), F.lit(False)).alias("asterisk"),
    )
    no_period, no_rent = F.col("period_start").isNull() & F.col("relative_year").isNull(), F.col("monthly_rent").isNull()
    warning = F.when(F.col("period").isNull(), "no rent on the line").when(no_period & no_rent, "no period and no rent").when(no_period, "no period").when(no_rent, "no rent")
    return out.withColumn("warning", warning)


# What a charge is called in prose and the bucket that means, longer names first.
CHARGES = [
    ("common area maintenance", "cams"), ("operating expenses", "cams"), ("operating expense", "cams"), ("property insurance", "insurance"), ("real estate taxes", "taxes"),
    ("real estate tax", "taxes"), ("additional rent", None), ("insurance", "insurance"), ("taxes", "taxes"), ("cams", "cams"), ("cam", "cams"), ("nnn", "cams"),
]
# Words that may stand between a charge, its amount and its rate, and number words.
FILLERS = ["amount", "amt", "at", "escalate", "escalated", "escalates", "increase", "increased", "increases", "month", "monthly", "per"]
WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def told_charge(rows: DataFrame, line: Column) -> DataFrame:
    """rows with x, the charge that a line names first: label, bucket, and the line after its name. Each
    step of the reading is computed once."""
    rows = once(rows, "spaced", F.concat(F.lit(" "), F.regexp_replace(line, "[^a-z0-9$%.,/]+", " "), F.lit(" ")))
    rows = once(rows, "words", F.translate("spaced", ",/$.%", "     "))
    spaced = F.col("spaced")
    found = F.array_compact(F.array(*[
        F.when(at > 0, F.struct(at.alias("named_at"), F.lit(place).alias("place"), F.lit(name).alias("label"), F.lit(bucket).cast("string").alias("bucket"), F.substring(spaced, at + len(name) + 1, F.length(spaced)).alias("rest")))
        for place, (name, bucket) in enumerate(CHARGES)
        for at in [F.instr("words", f" {name} ")]
    ]))
    return once(rows, "x", F.array_min(found)).drop("spaced", "words")


def only_fillers(text: Column) -> Column:
    return F.forall(F.filter(F.split(text, "[^a-z]+"), lambda w: w != ""), lambda w: w.isin(*FILLERS))


def prose_charges(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, bucket, label, year1, esc_pct, cadence_months of the charges that lines state, each once.

    A line is read in pieces: the charge, the clause of its rate ("3% every two years"), and the first
    number outside the clause, which is the amount. Only filler words may stand between them: without
    an amount so placed the line states no charge, and a clause further off is not the charge's.
    """
    rows = told_charge(lines(docs, key, text), F.lower("line")).where("x is not null").select(key, "x.label", "x.bucket", "x.rest")
    clause = r"([\d.]+) *% *(?:every|per) (?:([a-z]+|\d+) )?(year|month)s?"
    part = lambda k: F.regexp_extract("rest", clause, k)
    # Every piece is computed once: the conditions below would have each of them read again for each mention.
    rows = once(rows, "c", F.struct(part(0).alias("clause"), part(1).try_cast("double").alias("rate"), part(2).alias("many"), part(3).alias("unit"))).select(key, "label", "bucket", "rest", "c.*")
    before = F.when(F.col("clause") == "", F.col("rest")).otherwise(F.expr("substring_index(rest, clause, 1)"))
    rows = once(rows, "before", before)
    rows = once(rows, "after", F.substring(F.col("rest"), F.length("before") + F.length("clause") + 1, F.length("rest")))
    number = lambda c, k: F.regexp_extract(c, r"^([^\d]*)(\d[\d,]*(?:\.\d\d?)?)(?!\d* *%)(.*)$", k)
    rows = once(rows, "early", number("before", 2) != "")
    early = F.col("early")
    rows = once(rows, "amount", F.when(early, number("before", 2)).otherwise(number("after", 2)))
    rows = once(rows, "gap", F.when(early, number("before", 1)).otherwise(F.concat("before", number("after", 1))))
    near = (F.col("clause") != "") & F.when(early, only_fillers(number("before", 3))).otherwise(True)
    spelled = F.nullif(F.array_position(F.array(*map(F.lit, WORDS)), F.col("many")), F.lit(0)).cast("int")
    n = F.when(F.col("many") == "", 1).otherwise(F.coalesce(F.col("many").try_cast("int"), spelled))
    near = near & n.isNotNull()
    return rows.where((F.col("amount") != "") & only_fillers(F.col("gap"))).select(
        key, "bucket", "label", money(F.col("amount")).alias("year1"), F.when(near, F.col("rate")).alias("esc_pct"),
        F.when(near, n * F.when(F.col("unit") == "year", 12).otherwise(1)).cast("int").alias("cadence_months"),
    ).where("year1 is not null").distinct()


def merged(charges: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """charges(key, ord, bucket, label, year1, esc_pct, confidence) with gaps filled from what is told of the
    first charge of the same bucket or label; what matches none is added, at confidence 0.72."""
    left = charges.alias("c").join(told.alias("t"), key)
    plain = lambda c: F.lower(F.trim(F.col(c)))
    same = (F.col("c.bucket") == F.col("t.bucket")) | (plain("c.label") == plain("t.label"))
    first = left.where(same).groupBy(key, F.col("t.label").alias("told"), F.col("t.year1").alias("told_year1"), F.col("t.esc_pct").alias("told_esc")).agg(F.min("c.ord").alias("ord"))
    fill = first.groupBy(key, "ord").agg(F.min_by("told_year1", "told").alias("told_year1"), F.min_by("told_esc", "told").alias("told_esc"))
    own = charges.join(fill, [key, "ord"], "left")
    hit = F.col("told_year1").isNotNull()
    own = own.select(key, "ord", "bucket", "label", F.coalesce("year1", "told_year1").alias("year1"), F.coalesce("esc_pct", "told_esc").alias("esc_pct"), F.when(hit, F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.72))).otherwise(F.col("confidence")).alias("confidence"))
    fresh = told.join(first.select(key, F.col("told").alias("label"), F.col("told_year1").alias("year1")), [key, "label", "year1"], "left_anti")
    number = 1000 + F.row_number().over(Window.partitionBy(key).orderBy("label", "year1"))
    return own.unionByName(fresh.select(key, number.alias("ord"), "bucket", "label", "year1", "esc_pct", F.lit(0.72).alias("confidence")))


def chosen(parsed: DataFrame, extracted: DataFrame, blocked: DataFrame) -> DataFrame:
    """For each lease which of two readings of its schedule counts: the extracted one where both are
    usable and differ, else the parsed one if usable, else the extracted; blocked(lease_id, reading)
    lists readings with errors."""
    def ends(rows: DataFrame, name: str) -> DataFrame:
        bad = blocked.where(F.col("reading") == name).select("lease_id").distinct()
        return rows.join(bad, "lease_id", "left_anti").groupBy("lease_id").agg(
            F.struct(F.count("*").alias("n"), F.min("period_start").alias("first"), F.max("period_end").alias("last"), F.min_by("monthly_rent", "period_idx").alias("rent")).alias(name)
        )

    both = ends(parsed, "parsed").join(ends(extracted, "extracted"), "lease_id", "full")
    p, x = F.col("parsed"), F.col("extracted")
    same = (p.n == x.n) & (p.first == x.first) & (p.last == x.last) & (F.abs(p.rent - x.rent) < 0.01)
    conflict = p.isNotNull() & x.isNotNull() & ~same
    return both.select("lease_id", F.when(conflict | p.isNull(), "extracted").otherwise("parsed").alias("reading"), conflict.alias("conflict"))
