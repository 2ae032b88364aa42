"""Queries that read rent tables out of files and pages, which they write from the portfolio, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasegrid.functions import dates
from leasegrid.plans import oracle
from leasegrid.plans.queries import PLANS, dealt_periods, periods
from leasegrid.sources import layout, tables
from leasegrid.sources.portfolio import Portfolio
from leasegrid.sources.scratch import folder


def csv_files(p: Portfolio) -> tuple[DataFrame, DataFrame]:
    """The periods as CSV under headers of another wording, with dates in three forms, blank and unreadable
    rents and dates, and read again."""
    k = F.col("lease_id") % 6
    form = lambda c: F.when(k == 0, F.date_format(c, "M/d/yy")).when(k == 1, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "MMMM d, yyyy"))
    own = periods(p).select(
        "lease_id", F.when(k == 5, "on signing").otherwise(form("period_start")).alias("Lease Start"), form("period_end").alias("Expiration Date"), F.lit("x, \"y\"").alias("Notes"),
        F.when(k == 3, "").when(k == 4, "n/a").otherwise(F.col("monthly_rent").cast("string")).alias("Monthly Base Rent ($)"),
    )
    path = folder(p.spark, "csv")
    own.write.csv(path, header=True, escape='"')
    return tables.read_csv(p.spark, path, "lease_id")


def glyphs(p: Portfolio) -> DataFrame:
    """Each lease's schedule as pieces of text on pages of three lines, in no order, a little uneven in
    height, with blank pieces; by lease the rent is missing from a line, or from the headers."""
    k = F.col("lease_id") % 5
    piece = lambda x, text: F.struct(F.lit(float(x)).alias("x"), text.alias("str"))
    day = lambda c: F.concat(F.lit(" "), F.date_format(c, "MM/dd/yyyy"))
    at = lambda n, pieces: F.transform(F.array(*pieces), lambda g: F.struct(n.alias("n"), g.x.alias("x"), g.str.alias("str")))
    line, none = F.lit(0).cast("long"), F.array().cast("array<struct<n: bigint, x: double, str: string>>")
    head = at(line, [piece(200, F.lit("Lease End")), piece(350, F.when(k == 0, "Remarks").otherwise("Monthly Rent")), piece(50, F.lit("Lease Start"))])
    body = at(F.col("period_idx") + 1, [
        piece(350, F.when((k == 1) & (F.col("period_idx") == 1), "").otherwise(F.concat(F.lit("$"), F.format_number("monthly_rent", 2)))), piece(200, day("period_end")), piece(50, day("period_start")), piece(120, F.lit("  ")),
    ])
    # The headers come with a lease's first period: leases are dealt once, and pieces not at all.
    every = dealt_periods(p).select("lease_id", F.explode(F.concat(F.when(F.col("period_idx") == 0, head).otherwise(none), body)).alias("g")).select("lease_id", "g.n", "g.x", "g.str")
    return every.select("lease_id", F.floor(F.col("n") / 3).cast("long").alias("page"), "x", (700 - 20 * (F.col("n") % 3) + F.col("x") / 1000).alias("y"), F.lit(0).alias("ord"), "str")


def page_tables(p: Portfolio) -> tuple[DataFrame, DataFrame]:
    return layout.rent_tables(layout.laid_out(glyphs(p), "lease_id"), "lease_id")


def month_starts(p: Portfolio) -> DataFrame:
    day = F.col("commence")
    return p.leases().select("lease_id", dates.first_of_month_on_or_after(day).alias("first_of_month"), dates.first_full_month_after(day).alias("first_full_month"))


PERIOD = ["lease_id", "period_start", "period_end", "monthly_rent"]

PLANS |= {
    "csv_scan": lambda p: csv_files(p)[0].select(*PERIOD),
    "csv_warnings": lambda p: csv_files(p)[1].groupBy("lease_id", "message").agg(F.count("*").alias("n")),
    "page_lines": lambda p: layout.laid_out(glyphs(p), "lease_id").withColumn("cells", F.array_join("cells", "|")),
    "page_tables": lambda p: page_tables(p)[0].select("lease_id", "line", *PERIOD[1:]),
    "page_warnings": lambda p: page_tables(p)[1],
    "month_starts": month_starts,
    "usable_text": lambda p: p.table("documents").select("doc_id", tables.usable(F.col("text")).alias("usable")),
}

_RENT = "CASE WHEN lease_id%5=1 AND period_idx=1 THEN 0e0 ELSE CAST(printf('%.2f', monthly_rent) AS DOUBLE) END"
_SHOWN = "CASE WHEN lease_id%5=1 AND period_idx=1 THEN '' ELSE '|$' || format('{:,.2f}', monthly_rent) END"
ORACLE_SQL = {
    "csv_scan": oracle.sql("SELECT lease_id, period_start, period_end, CASE WHEN lease_id%6=3 THEN 0e0 ELSE monthly_rent END AS monthly_rent FROM periods WHERE lease_id%6<4", "periods"),
    "csv_warnings": oracle.sql("SELECT lease_id, 'row skipped: it lacks a start, an end or a rent' AS message, count(*) AS n FROM periods WHERE lease_id%6>=4 GROUP BY ALL", "periods"),
    "page_lines": oracle.sql(f"""SELECT lease_id, period_idx+2 AS line, strftime(period_start, '%m/%d/%Y') || '|' || strftime(period_end, '%m/%d/%Y') || {_SHOWN} AS cells FROM periods
      UNION ALL SELECT lease_id, 1, 'Lease Start|Lease End|' || CASE WHEN lease_id%5=0 THEN 'Remarks' ELSE 'Monthly Rent' END FROM leases WHERE expire>=commence""", "periods"),
    "page_tables": oracle.sql(f"SELECT lease_id, period_idx+2 AS line, period_start, period_end, {_RENT} AS monthly_rent FROM periods WHERE lease_id%5<>0", "periods"),
    "page_warnings": oracle.sql("SELECT lease_id, CAST(0 AS BIGINT) AS line, 'the columns of a rent table are not there' AS message FROM leases WHERE expire>=commence AND lease_id%5=0", "leases"),
    "month_starts": oracle.sql("SELECT lease_id, CASE WHEN day(commence)=1 THEN commence ELSE CAST(date_trunc('month', commence) + INTERVAL 1 MONTH AS DATE) END AS first_of_month, CAST(date_trunc('month', commence) + INTERVAL 1 MONTH AS DATE) AS first_full_month FROM leases", "leases"),
    "usable_text": r"SELECT doc_id, length(t)>=80 AND length(regexp_replace(t, '[^A-Za-z]', '', 'g'))>=40 AS usable FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)",
}
