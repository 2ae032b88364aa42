"""Readers: rent tables from delimited files, extraction JSON, and text out of files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leasegrid.functions.dates import parse_cell

# What a header contains, once reduced to letters and digits, for each column; the first
# header that contains any of them is taken.
HEADERS = {
    "period_start": ["periodstart", "startdate", "start", "commencement", "from", "leasestart"],
    "period_end": ["periodend", "enddate", "end", "expiry", "expiration", "to", "leaseend"],
    "monthly_rent": ["monthlybaserent", "monthlyrent", "baserent", "rent", "monthly"],
}

#: Holds the rows of a delimited file that do not fit its header.
MALFORMED = "_malformed"


def detect_columns(headers: list[str]) -> dict[str, str | None]:
    """Which header holds each column of a rent table, None where none does."""
    plain = {h: re.sub("[^a-z0-9]", "", h.lower()) for h in headers}
    return {c: next((h for h in headers if any(p in plain[h] for p in patterns)), None) for c, patterns in HEADERS.items()}


def normalised(raw: DataFrame, lease: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(periods, warnings) of rows of text: rows without two dates and a number become warnings.

    A blank rent counts as 0. With lease, that column tells the leases apart; else all rows are one's. A
    row that a reader marked in MALFORMED is warned of, and kept if it has all three all the same.
    """
    found = detect_columns([c for c in raw.columns if c not in (lease, MALFORMED)])
    missing = [c for c, h in found.items() if h is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(raw.columns)}")
    cell = lambda c: F.trim(F.coalesce(F.col(f"`{found[c]}`").cast("string"), F.lit("")))
    rows = raw.select(
        (F.col(lease) if lease else F.lit(1)).cast("long").alias("lease_id"), F.monotonically_increasing_id().alias("period_idx"), parse_cell(cell("period_start")).alias("period_start"),
        parse_cell(cell("period_end")).alias("period_end"), F.when(cell("monthly_rent") == "", 0.0).otherwise(cell("monthly_rent").try_cast("double")).alias("monthly_rent"),
        (F.col(MALFORMED).isNotNull() if MALFORMED in raw.columns else F.lit(False)).alias("malformed"),
    )
    good = "period_start is not null and period_end is not null and monthly_rent is not null"
    said = F.array_compact(F.array(F.when(F.col("malformed"), "row has another number of fields than the header"), F.when(F.expr(f"not ({good})"), "row skipped: it lacks a start, an end or a rent")))
    warnings = rows.select("lease_id", "period_idx", F.explode(said).alias("message"))
    return rows.where(good).drop("malformed"), warnings


def read_csv(spark: SparkSession, path: str, lease: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Periods and warnings of CSV files with a header; blank lines do not count."""
    columns = spark.read.csv(path, header=True).columns
    schema = ", ".join(f"`{c}` string" for c in [*columns, MALFORMED])
    return normalised(spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED), lease)


CHARGE = "struct<year1: double, escPct: double, chargeStart: string, escStart: string>"
EXTRACTION = (
    "rentSchedule array<struct<periodStart: string, periodEnd: string, monthlyRent: double>>, leaseName string, squareFootage double, rentCommencementDate string, "
    f"sfRequired boolean, cams {CHARGE}, insurance {CHARGE}, taxes {CHARGE}, security {CHARGE}, otherItems {CHARGE}, "
    "oneTimeItems array<struct<label: string, amount: double, dueDate: string, sign: int>>, estimatedNNNMonthly double, confidenceFlags array<string>, notices array<string>, "
    "recurringCharges array<struct<label: string, year1: double, escPct: double, chargeStart: string, escStart: string, canonicalType: string, bucketKey: string, confidence: double>>"
)


def decoded(payload: Column) -> Column:
    """Extraction JSON, with or without a code fence around it; nulls where it cannot be read."""
    return F.from_json(F.regexp_replace(F.trim(payload), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1"), EXTRACTION)


# How many doubtful fields leave an extraction at medium confidence.
MEDIUM_FLAGS = 3


def usable_schedule(schedule: Column) -> Column:
    """Whether some row of a rent schedule has two dates and a rent that is not negative."""
    return F.coalesce(F.exists(schedule, lambda r: parse_cell(r.periodStart).isNotNull() & parse_cell(r.periodEnd).isNotNull() & (r.monthlyRent >= 0)), F.lit(False))


def completed(docs: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """Every document's extraction with nothing left open: lists that may be empty, a confidence by the
    number of doubtful fields, whether anything was found and whether its schedule can be used as it is,
    and a notice where the payload could not be read."""
    x = F.col("x")
    filled = lambda c: F.coalesce(x[c], F.array())
    text = F.regexp_replace(F.trim(F.col(payload)), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")
    rows = docs.select(key, decoded(F.col(payload)).alias("x"), F.get_json_object(text, "$").isNull().alias("unread"))
    n = F.size(filled("confidenceFlags"))
    return rows.select(
        key, filled("rentSchedule").alias("rent_schedule"), filled("recurringCharges").alias("recurring_charges"), filled("oneTimeItems").alias("one_time_items"), x.leaseName.alias("lease_name"), x.squareFootage.alias("square_footage"),
        F.coalesce(x.sfRequired, F.lit(False)).alias("sf_required"), filled("confidenceFlags").alias("flags"), F.when(n == 0, "high").when(n <= MEDIUM_FLAGS, "medium").otherwise("low").alias("confidence"),
        F.concat(filled("notices"), F.when(F.col("unread"), F.array(F.lit("the extraction could not be read"))).otherwise(F.array())).alias("notices"),
        ((F.size(filled("rentSchedule")) > 0) | (F.size(filled("recurringCharges")) > 0) | (F.coalesce(x.leaseName, F.lit("")) != "") | x.squareFootage.isNotNull()).alias("meaningful"),
        usable_schedule(x.rentSchedule).alias("usable"),
    )


def extracted_periods(docs: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """lease_id, period_idx, period_start, period_end, monthly_rent of each document's rent schedule."""
    rows = docs.select(F.col(key).alias("lease_id"), F.posexplode(decoded(F.col(payload)).rentSchedule).alias("period_idx", "x"))
    return rows.select("lease_id", F.col("period_idx").cast("long").alias("period_idx"), parse_cell(F.col("x.periodStart")).alias("period_start"), parse_cell(F.col("x.periodEnd")).alias("period_end"), F.col("x.monthlyRent").alias("monthly_rent"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, ext, scanned and content of whole files; scanned where under 15 % of the first 4096 bytes are printable."""
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    share = F.length(F.regexp_replace(head, "[^ -~]", "")) / F.greatest(F.length(head), F.lit(1))
    return spark.read.format("binaryFile").load(path).select("path", F.lower(F.substring_index("path", ".", -1)).alias("ext"), (share < 0.15).alias("scanned"), "content")


# Which reader takes a file, by its extension.
READERS = {"csv": "table", "xlsx": "workbook", "xls": "workbook", "pdf": "document", "docx": "document", "txt": "text", "html": "markup", "htm": "markup", "json": "extraction"}


def routed(name: Column) -> Column:
    """Which reader a file of this name goes to; null for a kind that none takes."""
    ext = F.lower(F.substring_index(name, ".", -1))
    return F.create_map(*[F.lit(x) for pair in READERS.items() for x in pair])[ext]


def usable(text: Column) -> Column:
    """Whether a text is worth reading: 80 characters or more, 40 letters or more."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return (F.length(flat) >= 80) & (F.regexp_count(flat, F.lit("[A-Za-z]")) >= 40)
